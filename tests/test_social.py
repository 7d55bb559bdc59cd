"""Admission of social topics against a plain fold over the raw topics."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewire.functions.text import STOPWORDS
from tidewire.operators import social
from tidewire.plans import QUERIES

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "id long, at timestamp, pos int, ticker string, n int, title string, summary string, bull string, bear string, heat string, posts array<struct<handle:string,url:string,stance:string,claim:string,engagement:string>>, citations array<string>"


def tokens(title):
    return {w for w in re.sub("[^a-z0-9]+", " ", title.lower()).split() if len(w) > 2 and w not in STOPWORDS}


def plain(rows, daily=20):
    status = lambda url: set(re.findall(r"/status/(\d+)", url or ""))
    out, sound = {}, {}
    for i, at, pos, ticker, n, title, summary, bull, bear, heat, posts, citations in rows:
        cited = set().union(*(status(c) for c in citations or []))
        h = int(heat) if heat and re.fullmatch(r"\s*[+-]?\d+\s*", heat) else 0
        good = [p for p in posts or [] if p is not None and (p[0] or "").strip() and (p[1] or "").strip() and (p[3] or "").strip() and (p[2] or "").strip().lower() in ("bull", "bear", "neutral") and status(p[1]) and status(p[1]) <= cited]
        if not all((x or "").strip() for x in (title, summary, bull, bear)):
            out[i] = ("missing_required_fields", None)
        elif not 1 <= h <= 5:
            out[i] = ("invalid_heat", None)
        elif posts is None:
            out[i] = ("posts_not_list", None)
        elif len(good) < 3:
            out[i] = ("too_few_verified_posts", None)
        else:
            sound.setdefault((at, pos, ticker), []).append((-h, n, i, title))
    live, today = [], {}
    for (at, _, ticker), topics in sorted(sound.items()):
        (heat, _, i, title), *rest = sorted(topics)
        out.update({r[2]: ("rank", None) for r in rest})
        if -heat < 4:
            out[i] = ("heat", None)
            continue
        live = [t for t in live if at - t["at"] <= dt.timedelta(hours=48)]
        own = next((t for t in live if t["ticker"] == ticker), None)
        if own:
            own["title"] = title
            out[i] = ("refresh", own["id"])
            continue
        overlap = lambda t: len(tokens(title) & tokens(t["title"])) / min(len(tokens(title)), len(tokens(t["title"]))) if tokens(title) and tokens(t["title"]) else 0
        best = max(reversed(live), key=overlap, default=None)
        if best and overlap(best) >= 0.55:
            out[i] = ("dup", best["id"])
        elif today.get(at.date(), 0) >= daily:
            out[i] = ("cap", None)
        else:
            today[at.date()] = today.get(at.date(), 0) + 1
            live.append({"id": i, "at": at, "ticker": ticker, "title": title})
            out[i] = ("admit", i)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_are_those_of_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    words = "merger chips keynote margin supply tariff launch guidance demand recall".split()
    rows = []
    for i in range(700):
        pos = rng.randrange(60)
        url = lambda k: f"https://x.com/a/status/{i * 10 + k}"  # noqa: B023, E731
        posts = [(rng.choice(["u", "@v", " ", None]) if rng.random() < 0.1 else "u", url(k) if rng.random() < 0.95 else "no id", rng.choice(["bull", "Bear ", "odd"]) if rng.random() < 0.2 else "neutral", "claim", "null") for k in range(rng.randrange(2, 9))]
        title = rng.choice([None, "", "a of"]) if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(3)) + f" {'xyz'[i % 3] * 3}{rng.randrange(40)}"
        rows.append((i, START + dt.timedelta(hours=6 * rng.randrange(30)), pos, f"T{pos}", i, title, "s", "b", "x" if rng.random() < 0.97 else " ", rng.choice(["1", "3", "4", "5", "4", "5", " 5 ", "6", "hot", None, "4.0"]), posts if rng.random() < 0.97 else None, [url(k) for k in range(8)] if rng.random() < 0.95 else None))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.id: (r.verdict, r.topic) for r in social.admitted(df).collect()}
    want = plain(rows)
    assert got == want
    assert {"admit", "refresh", "dup", "rank", "heat", "invalid_heat", "too_few_verified_posts", "missing_required_fields"} <= {v for v, _ in want.values()}
    assert social.admitted(df.limit(0)).count() == 0


def test_the_cap_of_a_day_spares_refreshes(spark):
    post = lambda i: [("u", f"https://x.com/a/status/{i}{k}", "bull", "c", None) for k in range(8)]
    rows = [(i, START + dt.timedelta(hours=i // 25), i % 25, f"T{i % 25}", 0, f"word{i % 25}x only", "s", "b", "b", "5", post(i), [p[1] for p in post(i)]) for i in range(50)]
    got = {r.id: (r.verdict, r.topic) for r in social.admitted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain(rows)
    assert [v for v, _ in got.values()].count("admit") == 20 and [v for v, _ in got.values()].count("cap") == 10 and [v for v, _ in got.values()].count("refresh") == 20
    judged = social.verified(spark.createDataFrame(rows[:1], SCHEMA)).first()
    assert len(judged.posts) == 6 and judged.dropped == 0 and judged.posts[0].handle == "@u" and judged.heat == 5


def test_query_of_topics(spark):
    found = QUERIES["social_admission"](spark, "/root/testdata/sf0.001").groupBy("verdict").count().collect()
    assert {"admit", "refresh", "rank", "heat", "too_few_verified_posts", "missing_required_fields", "invalid_heat", "posts_not_list"} <= {r.verdict for r in found}


def test_like_titles_of_other_tickers_meet_live_topics_alone(spark):
    """Twelve thousand topics of two days with one title: pairs of them would be 72 million, of which the fold needs those with the one live topic."""
    n = 12_000
    post = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(F.lit("u").alias("handle"), F.concat(F.lit("https://x.com/a/status/"), k.cast("string")).alias("url"), F.lit("bull").alias("stance"), F.lit("c").alias("claim"), F.lit(None).cast("string").alias("engagement")))
    text = [F.lit(x).alias(c) for c, x in (("title", "merger chips keynote"), ("summary", "s"), ("bull", "b"), ("bear", "b"), ("heat", "5"))]
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.floor(F.col("id") / (n // 8)) * 21_600)
    rows = spark.range(n).select("id", at.alias("at"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("T"), "id").alias("ticker"), F.lit(0).alias("n"), *text, post.alias("posts"), F.transform(post, lambda p: p["url"]).alias("citations"))
    out = social.admitted(rows)
    assert {(r.verdict, r.topic): r["count"] for r in out.groupBy("verdict", "topic").count().collect()} == {("admit", 0): 1, ("dup", 0): n - 1}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
