"""Online grouping against a plain version that looks at every live group, on one giant topic, in few and in many stretches."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import grouping, rules
from tidewire.plans import texts
from tidewire.sources.tables import table

SCHEMA = "id long, published timestamp, seen timestamp, tickers array<string>, sectors array<string>, regions array<string>, tokens array<string>, event_class string, hash string, vector array<double>"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def overlap(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def plain_groups(rows):
    """Every item in order against all groups that are live, without an index."""
    hour = lambda t: t.timestamp() / 3600
    groups, out = [], {}
    for i, published, seen, *sets, event, head, vector in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        t, s, g, w = (set(x or ()) for x in sets)
        now = hour(seen)
        if published is not None and now - hour(published) > 48:
            out[i] = i
            continue
        live = [x for x in groups if now - x["seen"] <= 72]
        best = next((x for x in live if head in x["heads"] and now - x["heads"][head] <= 48), None)
        if best is None:
            score = lambda x: 0.4 * overlap(t, x["t"]) + 0.2 * overlap(s, x["s"]) + 0.1 * overlap(g, x["g"]) + 0.2 * bool(event and event == x["event"]) + 0.1 * overlap(w, x["w"])
            top = max((score(x) for x in live), default=0)
            best = next((x for x in live if score(x) == top), None) if top >= 0.6 - 1e-12 else None
        if best is None and vector is not None:
            known = sorted((x for x in live if x["v"] is not None), key=lambda x: -x["seen"])[:100]
            cosine = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
            scored = [(0.6 * cosine(vector, x["v"]) + 0.4 * overlap(t, x["t"]), x) for x in known]
            top = max((v for v, _ in scored), default=0)
            best = min((x for v, x in scored if v == top), key=lambda x: x["n"]) if top >= 0.7 - 1e-12 else None
        if best is None:
            best = {"n": len(groups), "id": i, "t": set(), "s": set(), "g": set(), "w": w, "v": vector, "counts": {}, "event": None, "heads": {}}
            groups.append(best)
        best["t"] |= t
        best["s"] |= s
        best["g"] |= g
        if event:
            best["counts"][event] = best["counts"].get(event, 0) + 1
            best["event"] = min(best["counts"], key=lambda c: (-best["counts"][c], c))
        best["heads"][head], best["seen"] = now, now
        out[i] = best["id"]
    return {**{r[0]: r[0] for r in rows}, **out}


def giant_topic(seed, n, span_h, vectors):
    rng = random.Random(seed)
    some = lambda names, k: sorted(set(rng.choices(names, k=k)))
    directions = [np.array([rng.gauss(0, 1) for _ in range(4)]) for _ in range(6)]
    rows = []
    for i in range(n):
        seen = START + dt.timedelta(hours=rng.randrange(span_h) + rng.choice([0, 0.25, 0.5]))
        published = rng.choice([seen, seen, seen, None, seen - dt.timedelta(hours=60)]) if i % 4 == 0 else seen
        vector = (directions[rng.randrange(6)] + np.array([rng.gauss(0, 0.2) for _ in range(4)])).tolist() if vectors and rng.random() < 0.6 else None
        tickers = ["SPY"] if rng.random() < 0.35 else some([f"T{k}" for k in range(9)], rng.choice([0, 1, 1, 2, 3]))
        rows.append((i, published, seen, tickers, some(["energy", "tech", "macro"], rng.choice([0, 1, 2])), some(["us", "eu"], rng.choice([0, 1])), some(list("abcdefgh"), 3), rng.choice([None, "m_a", "earnings", "fed_action"]), f"h{rng.randrange(n // 2)}", vector))
    rows += [(n, None, None, ["SPY"], [], [], [], None, "h1", None), (n + 1, None, START, None, None, None, None, None, None, None)]
    return rows


@pytest.mark.parametrize(("seed", "n", "span_h", "vectors", "stretch"), [(1, 700, 500, False, 50_000), (2, 240, 400, False, 70), (3, 200, 600, True, 80), (4, 150, 40, True, 60)])
def test_groups_are_those_of_the_plain_version(spark, seed, n, span_h, vectors, stretch):
    rows = giant_topic(seed, n, span_h, vectors)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found, rounds = grouping.online_groups(df if vectors else df.drop("vector"), "id", "published", "seen", stretch_rows=stretch)
    got = {r.id: r.grp for r in found.collect()}
    assert got == plain_groups(rows)
    assert len(set(got.values())) < 0.8 * len(rows) and rounds <= max(2, -(-len(rows) // stretch))
    blocks = {}
    for r in found.collect():
        blocks.setdefault(r.grp, set()).add(r.block)
    assert all(len(b) == 1 for b in blocks.values())


def test_stretches_have_like_sizes_and_an_empty_table_gives_none(spark):
    rows = giant_topic(6, 400, 300, False)
    df = spark.createDataFrame(rows, SCHEMA)
    assert grouping.online_groups(df.limit(0), "id", "published", "seen")[0].count() == 0
    ranged = df.repartitionByRange(8, "seen", "id").groupBy(F.spark_partition_id()).count()
    sizes = sorted(r["count"] for r in ranged.collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_a_filter_on_materiality_matches_no_pattern_again(spark):
    d = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    scored = rules.with_materiality(d, texts._phrase(), F.col("text"))
    tests = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")
    assert tests(scored) == tests(scored.filter("materiality.score >= 25")) == tests(scored.filter("materiality.score >= 25 AND array_contains(materiality.labels, 'm_a')").select("doc_id")) > 50


def test_groups_and_headlines_that_are_too_old_leave_at_once():
    groups = grouping.OnlineGroups()
    for k in range(1000):
        item = {"tickers": {"SPY", f"T{k}"}, "sectors": set(), "regions": set(), "tokens": {f"w{k}"}, "event_class": "m_a" if k % 2 else None, "hash": f"h{k}", "published_h": None}
        assert groups.attach(k, item, float(k)) == k
        assert len(groups.live) <= 73 and len(groups.by_hash) <= 49 and len(groups.by_ticker) <= 74 and len(groups.by_ticker["SPY"]) <= 73
    assert set(groups.live) == set(range(927, 1000)) and set(groups.by_class) == {"m_a"}


def test_a_round_groups_a_stretch_once(spark, monkeypatch):
    met, behind = spark.sparkContext.accumulator(0), grouping._behind

    def counted(rows, states):
        met.add(len(rows))
        return behind(rows, states)

    monkeypatch.setattr(grouping, "_behind", counted)
    rows = giant_topic(7, 120, 400, True)
    found, rounds = grouping.online_groups(spark.createDataFrame(rows, SCHEMA), "id", "published", "seen", stretch_rows=61)
    assert {r.id: r.grp for r in found.collect()} == plain_groups(rows)
    assert 0 < met.value <= 0.75 * len(rows) * (rounds - 1)


def test_no_score_exceeds_what_an_item_can_reach():
    rng = random.Random(8)
    some = lambda names: set(rng.sample(names, rng.randrange(len(names) + 1)))
    for _ in range(2000):
        a, b = ({"tickers": some("AB"), "sectors": some("cd"), "regions": some("ef"), "tokens": some("ghi"), "event_class": rng.choice([None, "m_a", "x"])} for _ in range(2))
        assert grouping.attach_score(a, b) <= grouping.most_score(a)
