"""Groups as state of a stream: their rows, their end, late rows, and a stream that is stopped and resumed."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewire.operators import rules
from tidewire.streaming import groups, ingest

SCHEMA = "item long, g string, materiality_score int, kind string, stance string, independence string, tier string, tickers array<string>, sectors array<string>, regions array<string>, event_class string, published_at timestamp, created_at timestamp"
START = dt.datetime(2024, 1, 1)


def member(item, g, hour, score=10, kind="news", event=None, tickers=("A",), stance="neutral"):
    at = START + dt.timedelta(hours=hour)
    return item, g, score, kind, stance, f"p{item % 3}", "tier1" if item % 2 else "other", list(tickers), [], None, event, at, at


def run(spark, tmp_path, batches, watermark="1 hour", horizon=72.0, late=None):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
    stream = ingest.read(spark, f"{tmp_path}/src", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    out = groups.group_states(stream, "g", "item", F.lit(False) if late is None else late, watermark, horizon)
    seen = []
    with groups.state_store(spark):
        q = out.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).outputMode("update").foreachBatch(lambda df, k: seen.append((k, df.collect()))).start()
        assert q.awaitTermination(120)
    return seen, [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]


def test_states_are_the_summary_of_all_members(spark, tmp_path):
    first = [member(1, "a", 0, 80, "pr_wire", "m_a"), member(2, "a", 1, None, "pr_wire", "m_a"), member(3, "b", 2, 5, "institutional", "earnings", ("B", "C"))]
    second = [member(4, "a", 3, 20, "news", "earnings", ("Z",)), member(5, "a", 3, 20, "news", "earnings", (), "state_media"), member(6, "c", 4, None, "news", None)]
    seen, _ = run(spark, tmp_path, [first, second], "100 hours", 1000.0)
    latest = {r.g: r for _, rows in seen for r in rows}
    want = {r.g: r for r in rules.group_summary(spark.createDataFrame(first + second, SCHEMA), "g").collect()}
    assert set(latest) == set(want) == {"a", "b", "c"}
    for g, w in want.items():
        for c in w.asDict():
            assert latest[g][c] == w[c], (g, c)
        assert not latest[g].closed and latest[g].late is None
    assert seen[0][1][0].g in "ab" and [r.max_materiality for _, rows in seen for r in rows if r.g == "a"][0] < 80  # press wires alone are capped


def test_a_group_ends_after_its_horizon_and_opens_anew(spark, tmp_path):
    batches = [[member(1, "a", 0, 50, event="m_a")], [member(2, "b", 100)], [member(3, "b", 101)], [member(4, "a", 102, 7, event="earnings")], [member(5, "b", 103)]]
    seen, total = run(spark, tmp_path, batches)
    rows = [r for _, rs in seen for r in rs]
    ended = [r for r in rows if r.closed]
    assert [(r.g, r.members, r.max_materiality, r.event_class) for r in ended] == [("a", 1, 50, "m_a")]
    again = [r for r in rows if r.g == "a" and r.opened_by == 4]
    assert [(r.members, r.max_materiality, r.event_class) for r in again] == [(1, 7, "earnings")]
    assert max(r.members for r in rows if r.g == "b") == 3
    assert min(total[2:]) < max(total)  # the state of the ended group is gone


def test_late_rows_are_groups_of_their_own(spark, tmp_path):
    batches = [[member(1, "a", 60), member(2, "a", 61)], [member(3, "a", 10), member(4, "a", 62)]]
    seen, _ = run(spark, tmp_path, batches, "100 hours", late=F.col("published_at") < F.lit(START + dt.timedelta(hours=12)))
    rows = [r for _, rs in seen for r in rs]
    assert [(r.late, r.members, r.closed) for r in rows if r.late is not None] == [(3, 1, True)]
    assert max(r.members for r in rows if r.late is None) == 3 and min(r.first_seen_at for r in rows if r.late is None) == START + dt.timedelta(hours=60)


def test_a_group_is_one_row_of_state_and_null_members_count(spark, tmp_path):
    first = [member(1, "a", 0, 80, "pr_wire", "m_a", ("A", None)), member(2, "a", 1, None, None, None, ()), member(3, "b", 2, event="zé\"\\", tickers=("B", "Ω"), stance=None)]
    seen, total = run(spark, tmp_path, [first, [member(4, "a", 3, None, "pr_wire", "earnings", ("Z",)), member(5, "b", 3, 20)]], "100 hours", 1000.0)
    latest = {r.g: r for _, rows in seen for r in rows}
    assert total[:2] == [2, 2]
    assert (latest["a"].tickers, latest["a"].event_class, latest["a"].members, latest["a"].independent_pub_count) == (["A", "Z"], "earnings", 3, 2)
    assert latest["a"].max_materiality < 80 and (latest["b"].tickers, latest["b"].event_class) == (["A", "B", "Ω"], "zé\"\\")


def test_a_batch_is_reckoned_once_while_it_is_merged(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(parts):
        for p in parts:
            read.add(len(p))
            yield p

    upsert = ingest.upsert_by_key(f"{tmp_path}/table", ["id"])
    for k in range(2):
        upsert(spark.range(50 * k, 50 * k + 100).withColumn("batch", F.lit(k)).mapInPandas(counted, "id long, batch int"), k)
    assert read.value == 200
    assert [r["count"] for r in spark.read.parquet(f"{tmp_path}/table").groupBy("batch").count().orderBy("batch").collect()] == [50, 100]
