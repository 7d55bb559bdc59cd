"""Sharding, centroid clustering and fill-in-the-middle against brute force, round trips and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import centroids, infilling, sharding

ODD = [(1, ""), (2, None), (None, "null id ab1"), (3, "x y"), (3, "x y"), (3, "x z"), (4, "é" * 50 + "abc" + "日本 " * 9), (5, "<P>no"), (6, "a<"), (7, "S>b"), (8, "word " * 60_000), (9, "\n\t\0 "), (None, None), (10, "<<M<")]


def write(spark, tmp_path, rows, schema, name):
    df = spark.createDataFrame(rows, schema)
    for c in ("n", "shard", "row", "key", "at", "part", "form", "fim", "weight"):
        df = df.withColumn(c, F.lit("clash"))
    df.repartition(3).write.parquet(f"file://{tmp_path}/{name}.parquet")
    return df, f"file://{tmp_path}"


# ------------------------------------------------------------------ sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40, 63, 64, 65, 1000, 4097])
def test_permutation_is_one_and_runs_backwards(n):
    p = sharding.Permutation(n)
    rows = np.arange(n)
    got = p.forward(rows)
    assert sorted(got.tolist()) == list(range(n)) and (p.inverse(got) == rows).all()
    shard, slot = sharding.place_of(rows, n)
    assert (sharding.row_at(shard, slot, n) == rows).all()


def test_permutation_of_many_rows_shuffles():
    n = (1 << 62) - 1
    p = sharding.Permutation(n)
    rows = np.random.default_rng(1).integers(0, n, 5000)
    got = p.forward(rows)
    assert ((got >= 0) & (got < n)).all() and (p.inverse(got) == rows).all()
    with pytest.raises(ValueError, match="2\\*\\*62"):
        sharding.Permutation(1 << 62)
    p = sharding.Permutation(20_000).forward(np.arange(20_000))
    neighbours = np.abs(np.diff(p)) / 20_000
    assert abs(neighbours.mean() - 1 / 3) < 0.01 and abs(np.corrcoef(p, np.arange(20_000))[0, 1]) < 0.03
    assert abs((np.diff(p) > 0).mean() - 0.5) < 0.02 and not (sharding.Permutation(20_000, "other").forward(np.arange(20_000)) == p).mean() > 0.01


def test_shards_against_their_law(spark, tmp_path):
    rows = [*ODD, *((100 + k, "copy") for k in range(200)), *((7, "same id and text") for _ in range(150))]
    df, base = write(spark, tmp_path, rows, "doc_id long, text string", "documents")
    got = sharding.op11_sharding(spark, base).collect()
    raw = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len(raw(t)) + 16, zlib.crc32(raw(t))) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    sizes = [len(slots[k]) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    # by brute force: number in the order of id, size and digest, then the permutation
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(raw(r[1])), zlib.crc32(raw(r[1]))))
    p = sharding.Permutation(len(rows)).forward(np.arange(len(rows))).tolist()
    assert Counter((i, zlib.crc32(raw(t)), x % 40, x // 40) for (i, t), x in zip(order, p, strict=True)) == Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in got)
    again = sharding.op11_sharding(spark, base).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_written_shards_are_read_back_in_order(spark, tmp_path):
    df = spark.createDataFrame([(k, f"text {k}", "s") for k in range(333)], "doc_id long, text string, shard string").repartition(5)
    placed = sharding.sharded(df, ["doc_id"], shards=7)
    assert placed.columns == ["doc_id", "text", "shard", "slot"]
    sharding.write_shards(placed, f"file://{tmp_path}/out", files=4)
    row = sharding.row_at(np.array([3]), np.array([5]), 333, 7)[0]
    got = spark.read.parquet(f"file://{tmp_path}/out/shard=3").filter("slot = 5").collect()
    assert [(r.doc_id, r.text) for r in got] == [(row, f"text {row}")]
    assert sharding.sharded(df.limit(0), ["doc_id"]).count() == 0


# ------------------------------------------------------------------ centroids


def brute_clusters(rows, dim, scale, k, rounds, seed):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()))
    centres = [v for _, v in first[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((distance(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centres = [[sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centres)]
    return Counter((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), centres


@pytest.mark.parametrize(("spread", "k"), [(1.0, 7), (3000.0, 5), (0.002, 40)])
def test_clusters_against_brute_force(spark, spread, k):
    rng = random.Random(k)
    vector = lambda: [rng.gauss(0, spread) for _ in range(6)]
    hot = vector()
    rows = [(i, hot if i % 3 == 0 else vector()) for i in range(240)] + [(7, vector()), (7, hot), (None, vector()), (None, hot)]
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 5 + [None]), (904, [1.0] * 5 + [float("nan")]), (905, [1.0] * 5 + [float("inf")])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("clash")).withColumn("cluster", F.lit("clash")).repartition(3)
    got = centroids.clustered(df, dim=6, k=k)
    want, centres = brute_clusters(rows, 6, 256, k, 5, "2")
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got.members.collect()) == want
    told = {r.cluster: r for r in got.centroids.collect()}
    assert [told[c].centroid for c in range(len(centres))] == centres
    for c in told:
        own = [(d, n) for (_, x, d), n in want.items() if x == c]
        assert told[c].members == sum(n for _, n in own) and told[c].inertia == sum(d * n for d, n in own)


def test_clusters_of_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (None, [0.5, 0.25])], "vec_id long, embedding array<float>")
    got = centroids.clustered(df, dim=2)
    assert got.centroids.count() == 2 and {tuple(r) for r in got.members.collect()} == {(1, 0, 0), (None, 1, 0)}
    for empty in (df.limit(0), df.filter("vec_id = 2")):
        got = centroids.clustered(empty, dim=2)
        assert got.members.count() == got.centroids.count() == 0


def test_nearest_in_doubles_and_in_longs():
    rng = np.random.default_rng(3)
    for top in (100, 1 << 21, 1 << 27):
        x, c = rng.integers(-top, top + 1, (300, 64)), rng.integers(-top, top + 1, (9, 64))
        c[5] = c[2]
        cluster, distance = centroids.nearest(x, c)
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x[:40]]
        assert [e.index(min(e)) for e in exact] == cluster[:40].tolist() and [min(e) for e in exact] == distance[:40].tolist()


# ------------------------------------------------------------------ fill in the middle


def plain_fim(i, text):
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "", re.S)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, text or "", "plain", n, None, None, text or ""
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h[3] % 100 < 20 else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return i, out, "spm" if h[3] % 100 < 20 else "psm", n, len(prefix), len(middle), text


def fim_rows():
    rng = random.Random(4)
    alphabet = [*"abZ  .,1\n", "é", "日", "😀", "<", "P", ">", "S", "M", "ſ", "K"]
    return [*ODD, *((1000 + k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for k in range(400))]


def test_fill_in_middle_against_token_lists(spark, tmp_path):
    rows = fim_rows()
    df, base = write(spark, tmp_path, rows, "doc_id long, text string", "documents")
    made = infilling.fill_in_middle(df)
    assert sorted(made.columns) == sorted(df.columns)
    got = made.select("doc_id", "fim.*", infilling.restored().alias("back"), "key").collect()
    assert all(r.key == "clash" for r in got)
    want = Counter(plain_fim(i, t) for i, t in rows)
    assert Counter((r.doc_id, r.output, r.form, r.n, r.prefix_chars, r.middle_chars, r.back) for r in got) == want
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = infilling.op13_fill_in_middle(spark, base).collect()
    assert Counter((r.doc_id, r.output_sha256, r.form, r.n, r.prefix_chars, r.middle_chars, r.restored_sha256) for r in digests) == Counter((i, sha(o), f, n, p, m, sha(t)) for i, o, f, n, p, m, t in want.elements())
    assert {r.form for r in digests} == {"plain", "psm", "spm"} and infilling.fill_in_middle(df.limit(0)).count() == 0
