"""Streaming ingest: duplicates dropped by key, late rows set aside, tumbling and sliding aggregates, idempotent upserts by batch.

Every function takes and gives streaming DataFrames (batch ones work as well); ``run_available`` drives a stream through what is
there and stops, with its checkpoint in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.fixed_values import PR_WIRE_CAP
from tidewire.session import checkpoint_dir
from tidewire.sources.sinks import merge_into, replace_partitions


def read(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df = reader.parquet(path)
    times = {f.name: F.col(f.name).cast("timestamp") for f in schema if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(times) if times else df


def deduplicated(stream: DataFrame, at: str, keys: list[str], horizon: str = "72 hours") -> DataFrame:
    """The first row of every key; state is kept for the horizon."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def split_late(stream: DataFrame, at: str, arrived: Column, hours: float = 48) -> tuple[DataFrame, DataFrame]:
    """Rows in time and late ones: a late row never joins what is there already, and isn't dropped either."""
    late = F.coalesce((F.unix_micros(arrived) - F.unix_micros(F.col(at))) / 3.6e9 > hours, F.lit(False))
    return stream.filter(~late), stream.filter(late)


def tumbling(stream: DataFrame, at: str, keys: list[str], every: str, watermark: str, aggregates: list[Column], slide: str | None = None) -> DataFrame:
    """Aggregates of windows that follow each other, or overlap with ``slide``, with start and end."""
    w = F.window(at, every, slide) if slide else F.window(at, every)
    return stream.withWatermark(at, watermark).groupBy(w.alias("w"), *keys).agg(*aggregates).withColumns({"start": F.col("w.start"), "end": F.col("w.end")}).drop("w")


def sessions(stream: DataFrame, at: str, keys: list[str], gap: str, watermark: str, aggregates: list[Column]) -> DataFrame:
    """Sessions by a gap of silence."""
    return stream.withWatermark(at, watermark).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(*aggregates)


def group_state(stream: DataFrame, key: str) -> DataFrame:
    """What a group says of its members so far, kept as state by key; for the output mode ``update``, in which each batch gives the groups that it
    changed. Columns as of ``rules.group_summary`` but for the event class, which needs counts of counts."""
    sets = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    flag = lambda c, n: F.coalesce(F.bool_or(c), F.lit(False)).alias(n)
    most, wire = F.max("materiality_score"), F.bool_and(F.col("kind") == "pr_wire")
    seen = F.coalesce("published_at", "created_at")
    return stream.groupBy(key).agg(
        F.when(wire, F.least(most, F.lit(PR_WIRE_CAP))).otherwise(most).alias("max_materiality"), F.count("*").alias("members"),
        F.size(F.collect_set(F.when(F.col("stance") != "state_media", F.col("independence")))).alias("independent_pub_count"), sets("tickers"), sets("sectors"), sets("regions"),
        flag(F.col("tier").isin("wire", "tier1"), "has_tier1_primary"), flag(F.col("kind") == "institutional", "has_institutional_primary"), F.min(seen).alias("first_seen_at"), F.max(seen).alias("last_seen_at"),
    )


def upsert_by_key(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows of the batch take the place of rows with the same key in the table, so a batch written twice counts once. A batch has
    a key once. The batch is kept while it is written, as it is read twice and would be reckoned twice, with its state."""

    def upsert(df: DataFrame, _: int) -> None:
        rows = df.persist()
        try:
            merge_into(df.sparkSession, path, rows, lambda old, new: old.join(new.select(*keys), keys, "left_anti").unionByName(new))
        finally:
            rows.unpersist()

    return upsert


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None] | None = None, output: str | None = None, mode: str = "append", timeout: int = 3600) -> str:
    """Run to the end of what is there; rows go to ``batch`` or as Parquet to a folder, which is returned."""
    base = f"{checkpoint_dir(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    out = output or f"{base}/rows"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode(mode)
    q = writer.foreachBatch(batch).start() if batch else writer.format("parquet").start(out)
    if not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError(f"the stream still ran after {timeout} s")
    return out


def upsert_by_day(path: str, day: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: days of the batch take the place of the same days in the table, so a batch written twice counts once."""
    return lambda df, _: replace_partitions(df, path, day)
