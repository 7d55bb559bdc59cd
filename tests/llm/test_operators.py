"""The corpus operators against SQL, brute force, round trips and held-out accuracy, on given tables and on odd ones."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, same
from tidewire.llm import chunks, fingerprint, html_text, jaccard, langid, mixing, packing, registry, repeats, substring, suffix, topk, warc

BASE = "/root/testdata/sf0.001"
COMMON = " ".join(f"w{i}" for i in range(60))
ODD = [
    (1, "", "s", 0), (2, None, "s", None), (None, "null id " + COMMON, None, 1), (3, COMMON, "a", 1), (3, COMMON, "a", 1), (4, COMMON + " tail é", "b", 2), (5, "x " * 3000 + COMMON, "b", 3),
    (6, "a b c", "b", 4), (7, "A  b\tC", "b", 5), (8, " \n ", "b", 6), (9, "ß" * 120, "c", 7), (10, "ß" * 119 + "q", "c", 8),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and repeated rows, ties, and columns named like those the operators use."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string, chunk long")
    for c in ("key", "id0", "bucket", "rank", "n", "spans", "sig", "salt"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{BASE}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_is_its_sql(spark, name):
    same(registry.QUERIES[name](spark, BASE), connect(BASE), registry.ORACLES[name])


def test_near_duplicates_of_odd_rows(odd):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.near_duplicates(odd).collect()}
    assert got[3, 56] == got[4, 58] == 3 and got[6, 1] == got[7, 1] == 6
    assert got[1, 0] == 1 and got[2, 0] == 2 and got[8, 0] == 8
    assert jaccard.near_duplicates(odd).count() == len(ODD) and jaccard.near_duplicates(odd.limit(0)).count() == 0


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.5], "c"), (100, [1.0, 0.5], "c"), (1, None, "c"), (2, [1.0, None], "c"), (3, [float("nan"), 1.0], "c"), (4, [1.0, 0.5], "c"), (5, [2.0], "c"), (None, [1.0, 1.0], "c")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v, F.col("vec_id") % 100 == 0).collect())
    s = 1024 * 1024 + 512 * 512
    assert got == [(0, 1, 4, s), (0, 2, 100, s), (100, 1, 0, s), (100, 2, 4, s)]
    assert topk.top_k(v.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nx", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>"), (4, "u", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("keep", F.lit("clash"))
    index = warc.write_archive(pages)
    got = sorted((r.page_id, r.record_type, r.refers_to or 0, r.payload_bytes, bytes(r.payload)) for r in warc.read_records(index).collect())
    p = "<p>é</p>".encode()
    assert got == [(1, "revisit", 4, len(p), b""), (2, "revisit", 3, 0, b""), (3, "response", 0, 0, b""), (4, "response", 0, len(p), p), (4, "response", 0, len(p), p)]


def test_substring_of_odd_rows(odd):
    found = substring.without_repeats(odd)
    got = {(r.doc_id, r.chunk): r.text for r in found.collect()}
    assert found.columns == odd.columns and len(got) == len(set((r[0], r[3]) for r in ODD))
    assert got[3, 1] == "" and got[4, 2] == "tail é" and got[2, None] is None and got[None, 1] == "null id"
    assert got[5, 3] in ("", "x") and got[8, 6] == " \n "


def test_language_is_right_on_held_out_rows(spark, documents):
    got = langid.op5_langid(spark, BASE).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out AND lang_pred <> 'und'")
    assert got.filter("lang = lang_pred").count() / got.count() > 0.9
    assert got.filter("score < 0 OR score > 1").count() == 0


def test_language_of_odd_rows(odd, documents):
    model = langid.fit(documents, ~langid.held_out())
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert got[2].lang_pred == got[1].lang_pred == got[8].lang_pred == "und" and got[2].score == 0
    assert langid.recognised(odd, model, 0.0).columns == odd.columns


def test_mixture_keeps_all_within_its_limit(documents, odd):
    for docs in (documents, odd.select("doc_id", "source", "text")):
        want = Counter(r.doc_id for r in docs.collect())
        mixed = mixing.mix(docs)
        times = Counter(r.doc_id for r in mixed.collect())
        assert set(times) == set(want) and all(want[k] <= times[k] <= 2 * want[k] for k in want)
        tokens, read = ({r.source: r.n or 0 for r in d.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()} for d in (mixed.filter("epoch = 0"), mixed))
        assert all(read[s] <= 1.5 * tokens[s] + 1 for s in tokens)


def test_packing_is_gapless_and_whole(spark, documents, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (documents, odd):
        texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        ids = [[*t.encode(x, add_special_tokens=False).ids, 0] for _, x in texts]
        want = Counter()
        for (i, _), own in zip(texts, ids, strict=True):
            first = len(own) % 2048 or 2048
            cuts = [0, *range(first, len(own) + 1, 2048)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                want[i, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own[a:b]))] += 1
        got = packing.pack(packing.pieces(docs)).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        places = defaultdict(list)
        for r in got:
            places[r.sequence_id].append((r.offset, r.length))
        for own in places.values():
            at = 0
            for a, n in sorted(own):
                assert a == at
                at += n
            assert at <= 2048
        total = sum(len(x) for x in ids)
        assert len(places) <= total / 2048 * 1.25 + 1


def test_html(spark):
    text, title = html_text.render("<title>T &amp; t</title><p>one<p>two<ul><li>a<li>b</ul><table><tr><td>x<td>yy<tr><td>zzz<td>w</table><script>no</script><div hidden>no</div>end")
    assert title == "T & t" and text == "one\n\ntwo\n\n- a\n- b\n\nx    yy\nzzz  w\n\nend"
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<b>é")], "page_id long, html string")
    assert [(r.page_id, r.text) for r in html_text.extract(df).orderBy("page_id").collect()] == [(1, None), (2, ""), (3, "é")]


def test_html_shows_formulas_and_text_of_drawings():
    text = lambda source: html_text.render(source)[0]
    assert text("<p>if <math><semantics><mrow><mi>x</mi><mo>=</mo><mspace/><mn>2</mn></mrow><annotation encoding='TeX'>x=2</annotation></semantics></math> then") == "if x=2 then"
    drawing = "<svg viewBox='0 0 1 1'>loose<title>no</title><desc>no</desc><defs><text>no</text></defs><style>no{}</style><path d='M0'/><circle r=1 /><g><text x=1>North<tspan>ern</tspan></text><text>South</text></g><text display='none'>no</text><foreignObject><b>East</b></foreignObject></svg>"
    assert text(f"<p>a{drawing}b</p><p>c</p>") == "a Northern South East b\n\nc"
    assert text("<svg><title/><text>t</text></svg>u") == "t u"
    assert text("<svg><path d='M0'><p>out of the drawing") == "out of the drawing"
    assert text("<desc>an unknown element</desc> shows") == "an unknown element shows"


def test_fingerprints(spark, documents):
    got = {r.doc_id: r for r in fingerprint.op9_fingerprint(spark, BASE).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in documents.collect()), reverse=True)
    assert len(got) == len(rows)
    for (i, text), (j, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        h = len(text) // 2
        edited = text[: len(text) - h] + after[:h]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
        bag = [Counter(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in (text, edited, after)]
        true = lambda a, b: sum((a & b).values()) / max(1, sum((a | b).values()))
        assert abs(got[i].near_edited - true(bag[0], bag[1])) < 0.35 and abs(got[i].near_next - true(bag[0], bag[2])) < 0.35
        if text == after:
            assert got[i].fingerprint == got[j].fingerprint and got[i].near_next == 1


def brute_suffix(rows, length=50):
    first = {}
    for i, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            first[s] = min(first.get(s, 1 << 63), 1 << 62 if i is None else i)
    out = []
    for i, text in rows:
        raw, gone = (text or "").encode(), set()
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < (1 << 62 if i is None else i):
                gone.update(range(k, k + length))
        kept = bytes(b for k, b in enumerate(raw) if k not in gone)
        out.append((i, len(raw), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_suffix_against_brute_force(spark, documents, tmp_path):
    rows = [(r.doc_id, r.text) for r in documents.orderBy("n_chars").limit(120).collect()] + [(r[0], r[1]) for r in ODD]
    base = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).write.parquet(f"{base}/documents.parquet")
    assert Counter(tuple(r) for r in suffix.op10_suffix(spark, base).collect()) == brute_suffix(rows)


def test_window_minima_past_24_bits():
    values = np.random.default_rng(3).integers(0, 1 << 64, (1 << 24) + 2000, np.uint64)
    got, tail = repeats.window_minima(values, 31), (1 << 24) - 100
    assert len(got) == len(values) - 30
    want = np.lib.stride_tricks.sliding_window_view(values[tail:] >> np.uint64(24), 31).argmin(1) + np.arange(tail, len(got))
    assert (got[tail:] == want).all()


def test_anchors_and_fingerprints_do_not_depend_on_stretches(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 40, n)).encode() for n in (3000, 500)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    def found():
        a = suffix.Anchors(data, offsets, 50, 20)
        return [x.tolist() for x in (a.token, a.text, a.first, a.windows, a.place)], substring.Windows(data, offsets, 35, 8).place.tolist()

    whole = found()
    monkeypatch.setattr(repeats, "STRETCH", 257)
    assert found() == whole


@pytest.mark.parametrize("block", [5, 64, 1 << 18])
def test_transform_puts_equal_windows_into_one_class(monkeypatch, tmp_path, block):
    monkeypatch.setattr(suffix, "BLOCK", block)
    rng = np.random.default_rng(block)
    for letters in (1, 2, 4, 26):
        docs = [bytes(rng.integers(97, 97 + letters, rng.integers(5, 19)).astype(np.uint8)) for _ in range(rng.integers(1, 60))]
        size = np.array([len(d) for d in docs])
        got = suffix.suffix_classes(np.frombuffer(b"".join(docs), np.uint8), np.cumsum(size) - size, size, 5, f"file://{tmp_path}").tolist()
        windows = [d[i : i + 5] for d in docs for i in range(len(d) - 4)]
        assert len(set(zip(windows, got, strict=True))) == len(set(windows)) == len(set(got))
    assert not list(tmp_path.iterdir())


def texts_with_copies():
    """A long text and others with parts of it, a line that very many contexts have, near copies, equal texts and equal ids."""
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join(f"{x:x}" for x in rng.integers(0, 1 << 24, n))
    long, line = prose(30_000), "every page ends with this very common line of text"
    texts = [long, long[5000:9000], prose(40) + long[1000:1049] + "!", prose(40) + long[1000:1050] + "!", long[:2000] * 3]
    texts += [prose(3) + line + prose(3) for _ in range(150)] + [line, line * 4, "ab" * 200, "a" * 300, "ba" * 90]
    texts += [texts[7], texts[7], texts[8][:60] + "x" + texts[8][60:], "", None, "ß" * 40, "ß" * 24 + "é" + "ß" * 24]
    rows = [(int(i), x) for i, x in zip(rng.permutation(len(texts)), texts, strict=True)]
    return [*rows, (rows[3][0], prose(5) + line), (None, line + "?"), (None, prose(9)), rows[1]]


@pytest.mark.parametrize(("portion", "often", "chunk_bytes"), [(1 << 22, 4096, 2 << 20), (3000, 20, 4000)])
def test_copied_spans_of_long_texts_and_common_lines(spark, portion, often, chunk_bytes):
    rows = texts_with_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = suffix.copied_spans(df, portion=portion, often=often, chunk_bytes=chunk_bytes)
    got = Counter()
    for r in found.collect():
        raw = r.text.encode()
        kept, n = suffix.without(raw, r.spans)
        got[r.doc_id, len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()] += 1
    assert got == brute_suffix(rows)
    assert suffix.copied_spans(df.limit(0)).count() == 0


def test_copied_spans_of_a_text_over_16_mib(spark):
    rng = np.random.default_rng(6)
    noise = bytes(rng.integers(97, 123, 17 << 20).astype(np.uint8)).decode()
    passage = bytes(rng.integers(65, 91, 300).astype(np.uint8)).decode()
    df = spark.createDataFrame([(1, passage), (2, passage[:100] + noise + passage), (3, noise[-80:])], "doc_id long, text string")
    got = {r.doc_id: r.spans and np.frombuffer(r.spans, "<i8").reshape(-1, 2).tolist() for r in suffix.copied_spans(df).select("doc_id", "spans").collect()}
    size = 17 << 20
    assert got == {1: None, 2: [[0, 100], [size + 100, size + 400]], 3: [[0, 80]]}


def brute_substring(rows, window=35):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    times = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, text), w in zip(rows, words, strict=True):
        gone = {k + x for k in range(len(w) - window + 1) if times[tuple(w[k : k + window])] > 1 for x in range(window)}
        out.append((i, text if text is None or not gone else b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def test_substring_index_batch_by_batch_is_the_whole_table(spark):
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10_000, n))
    shared = [prose(50) for _ in range(6)]
    rows = [(i, prose(20) + " " + shared[i % 6] + " " + prose(20) if i % 5 < 3 else prose(60)) for i in range(70)] + [(70, None), (71, ""), (None, shared[0]), (72, shared[2] * 3), (73, prose(40_000) + " " + shared[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = substring.FingerprintIndex(spark, 1)
    gone: dict = defaultdict(set)
    ids = {}
    parts = df.randomSplit([1.0] * 6, seed=3)
    for k, part in enumerate(parts):
        texts = chunks.chunked(part, first=k)
        for r in texts.collect():
            ids.update({(r.chunk, j): x for j, x in enumerate(chunks.rows_in(r.rows).column(0).to_pylist())})
        answer = index.append(texts)
        assert len(index.runs) <= substring.MOST_RUNS
        for r in answer.collect():
            for row, a, b in np.frombuffer(repeats.unpress(r.spans), "<i8").reshape(-1, 3).tolist():
                gone[ids[r.chunk, row]].update(range(a, b))
    index.drop()
    text = dict(rows)
    got = {i: t if t is None or not gone[i] else " ".join(w for k, w in enumerate(t.split()) if k not in gone[i]) for i, t in text.items()}
    assert got == dict(brute_substring(rows))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in substring.without_repeats(df, batches=3).collect() if r.text) == sorted((i is None, i or 0, t) for i, t in brute_substring(rows) if t)


def test_pipeline_stages_keep_their_promises(spark, documents):
    import corpus_pipeline as p

    docs = documents
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, docs, BASE)
        assert kept.columns == documents.columns
        if name == "near_duplicates":
            classes = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
            assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in classes.items() if i == c)
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    packed = p.STAGES[-1][1](spark, docs, BASE)
    assert packed.filter("piece = 0").count() == docs.count()
