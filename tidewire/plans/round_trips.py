"""Sources and sinks there and back: what is written to the shared folder, read again and compared with SQL on the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import relational
from tidewire.plans import forms
from tidewire.plans.catalogue import query
from tidewire.session import checkpoint_dir, cut
from tidewire.sources import sinks, tables
from tidewire.sources.tables import table
from tidewire.streaming import groups, ingest


def there_and_back(spark: SparkSession, work: Callable[[str], DataFrame]) -> DataFrame:
    """The rows that ``work`` reads from a folder of its own, which is deleted once they are checkpointed."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/round-trip-{uuid.uuid4().hex}"
    try:
        return cut(work(base))
    finally:
        fs, path = sinks._filesystem(spark, base)
        fs.delete(path, True)


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-25'")
def errors_of_a_span(spark: SparkSession, base: str) -> DataFrame:
    """A range of times of one status; both conditions reach the scan."""
    e = table(spark, base, "events")
    return e.filter((F.col("event_type") == "error") & (F.col("ts") >= F.lit("2024-01-20").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-25").cast("timestamp"))).select("event_id", "event_type", "value")


@query("SELECT event_id, event_type, value FROM events WHERE event_id % 11 > 0 ORDER BY event_id DESC LIMIT 100")
def json_log_tail(spark: SparkSession, base: str) -> DataFrame:
    """The last hundred records (the report's number) of a log of JSON lines, some of which are broken."""

    def work(folder: str) -> DataFrame:
        e = table(spark, base, "events").select("event_id", "event_type", "value")
        sinks.append_metrics(e.filter("event_id % 11 > 0"), f"{folder}/log")
        e.filter("event_id % 11 = 0").select(F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string")).alias("value")).write.mode("append").text(f"{folder}/log")
        return tables.json_lines(spark, f"{folder}/log", "event_id long, event_type string, value double", 100, "event_id")

    return there_and_back(spark, work)


@query("SELECT event_id, CAST(ts AS DATE) AS day, CASE WHEN CAST(ts AS DATE) >= DATE '2024-01-20' THEN value + 1 ELSE value END AS value FROM events WHERE NOT (CAST(ts AS DATE) >= DATE '2024-01-20' AND event_id % 2 = 0)")
def replaced_days(spark: SparkSession, base: str) -> DataFrame:
    """Days of a table replaced by later versions of them, twice; the others stay."""

    def work(folder: str) -> DataFrame:
        e = table(spark, base, "events").select("event_id", F.col("ts").cast("date").alias("day"), "value")
        sinks.append(e.filter("day < '2024-01-10'"), f"{folder}/raw")
        sinks.append(e.filter("day >= '2024-01-10'"), f"{folder}/raw")
        sinks.replace_partitions(spark.read.parquet(f"{folder}/raw"), f"{folder}/days", "day")
        late = e.filter("day >= '2024-01-20' AND event_id % 2 = 1").withColumn("value", F.col("value") + 1)
        for _ in range(2):
            sinks.replace_partitions(late, f"{folder}/days", "day")
        return spark.read.parquet(f"{folder}/days").select("event_id", F.col("day").cast("date").alias("day"), "value")

    return there_and_back(spark, work)


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -1 - c_custkey, c_custkey, 'N' FROM customer")
def merged_twice(spark: SparkSession, base: str) -> DataFrame:
    """A table merged with changes and new rows, written back as its new state; the same merge again changes nothing."""

    def work(folder: str) -> DataFrame:
        o = table(spark, base, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        new = table(spark, base, "customer").select((-1 - F.col("c_custkey")).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.lit("N").alias("o_orderstatus"))
        changes = o.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")).unionByName(new)
        merge = lambda old, rows: relational.replace_by_key(old, rows, ["o_orderkey"], [F.col("o_custkey")])
        for rows in (o, changes, changes):
            sinks.merge_into(spark, f"{folder}/table", rows, merge)
        return spark.read.parquet(f"{folder}/table")

    return there_and_back(spark, work)


@query("SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, max(value) AS most FROM events GROUP BY 1, 2")
def streamed_days(spark: SparkSession, base: str) -> DataFrame:
    """Tumbling windows of a stream in three batches, each group's row written by key as it changes."""

    def work(folder: str) -> DataFrame:
        e = table(spark, base, "events").select("event_id", "event_type", "ts", "value")
        for k in range(3):
            e.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{folder}/src")
        stream = ingest.read(spark, f"{folder}/src", e.schema, files_per_batch=1)
        days = ingest.tumbling(stream, "ts", ["event_type"], "1 day", "60 days", [F.count("*").alias("n"), F.max("value").alias("most")])
        ingest.run_available(days, ingest.upsert_by_key(f"{folder}/days", ["event_type", "start"]), mode="update")
        return spark.read.parquet(f"{folder}/days").select("event_type", "start", "n", "most")

    return there_and_back(spark, work)


@query(forms.GROUPS_SQL)
def streamed_groups(spark: SparkSession, base: str) -> DataFrame:
    """What groups say of their members, kept as state of a stream in three batches; the horizon is that of the table, so no group ends."""

    def work(folder: str) -> DataFrame:
        e = table(spark, base, "events")
        for k in range(3):
            forms.members_of_groups(e.filter(F.col("event_id") % 3 == k)).write.mode("append").parquet(f"{folder}/src")
        source = spark.read.parquet(f"{folder}/src")
        stream = ingest.read(spark, f"{folder}/src", source.schema, files_per_batch=-(-len(source.inputFiles()) // 3))
        with groups.state_store(spark):
            ingest.run_available(groups.group_states(stream, "g", "event_id", F.lit(False), "60 days", 60 * 24), ingest.upsert_by_key(f"{folder}/groups", ["g", "opened_by"]), mode="update")
        return forms._shown(spark.read.parquet(f"{folder}/groups"))

    return there_and_back(spark, work)


@query("""WITH o AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o) SELECT user_id, min(ts) AS first, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, base: str) -> DataFrame:
    """Sessions that end with two hours of silence."""
    e = table(spark, base, "events")
    return ingest.sessions(e, "ts", ["user_id"], "2 hours", "1 hour", [F.min("ts").alias("first"), F.count("*").alias("n")]).select("user_id", "first", "n")
