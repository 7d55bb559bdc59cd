"""Sinks: append, replace, replace by partition, JSON lines, and merges written back as a new state."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Records as JSON lines."""
    df.write.mode("append").json(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Partitions that ``df`` has take the place of those in the table; the others stay. Writing the same day twice is
    therefore the same as once."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path; a merge needs a session that has the JVM at hand, so not Spark Connect."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _filesystem(spark, path)
    return fs.exists(p)


def merge_into(spark: SparkSession, path: str, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Write ``merge(table, incoming)`` as the table's new state.

    The new state goes to a folder beside the table; once it is whole, the old state is renamed away and the new one into its place. A failed
    job leaves the old state; if the second renaming fails the old state is put back. Between the two renamings, which move no data, the
    table is not there: readers of that moment must try again.
    """
    table = spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], incoming.schema)
    fresh = f"{path.rstrip('/')}__{uuid.uuid4().hex}"
    fs, p = _filesystem(spark, path)
    new, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (fresh, f"{fresh}_old"))
    try:
        merge(table, incoming).write.parquet(fresh)
        if fs.exists(p) and not fs.rename(p, old):
            raise OSError(f"{path} could not be renamed")
        try:
            moved = fs.rename(new, p)
        except Exception:
            _put_back(fs, old, p)
            raise
        if not moved:
            _put_back(fs, old, p)
            raise OSError(f"{fresh} could not be renamed to {path}")
    finally:
        if fs.exists(new):
            fs.delete(new, True)
    if fs.exists(old):
        fs.delete(old, True)
    spark.catalog.refreshByPath(path)


def _put_back(fs, old, path) -> None:
    if fs.exists(old) and not fs.exists(path):
        fs.rename(old, path)


def update_by_key(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the columns that ``changes`` has taken from its rows, for keys that it has; other rows and columns stay. Keys of
    ``changes`` are unique. A change to null is a change."""
    new = [c for c in changes.columns if c not in keys]
    told = changes.select(*[F.col(c).alias(f"__key_{i}") for i, c in enumerate(keys)], F.struct(*new).alias("__new"))
    met = table.join(told, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__key_{i}") for i, c in enumerate(keys)]), "left")
    return met.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns])


def delete_where(table: DataFrame, condition) -> DataFrame:
    """The table without the rows for which ``condition`` holds; where it is null the row stays."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def markdown_page(title: str, lines: str, sources: str):
    """A page as one text column: title, bullets of an array of lines, sources; empty parts are left out."""
    bullets = F.transform(F.coalesce(F.col(lines), F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x))
    refs = F.coalesce(F.col(sources), F.array().cast("array<string>"))
    tail = F.when(F.size(refs) > 0, F.concat(F.lit("Sources: "), F.array_join(refs, ", ")))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), F.col(title)), F.nullif(F.array_join(bullets, "\n"), F.lit("")), tail)
