"""Joins, latest-of and merge operators over DataFrames; all are plain plans that Catalyst can optimise.

Merges return the new state of a table. Writing it is the sinks' affair (``tidewire.sources.sinks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], strict: bool = False) -> DataFrame:
    """For each left row the values of the latest right row of its key at or before (``strict``: before) its time; null without one.

    Both sides are laid into one series per key and the last right row is carried forward, so no pair of rows is formed and
    keys of any skew cost a sort.
    """
    tie = F.lit(0 if strict else 1)  # where a left row stands among right rows of the same time
    a = left.select(*keys, F.col(left_time).alias("__t"), tie.alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__r"))
    b = right.select(*keys, F.col(right_time).alias("__t"), (F.lit(1) - tie).alias("__side"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.struct(*values).alias("__r"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionByName(b).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).filter(F.col("__l").isNotNull())
    return carried.select("__l.*", *[F.col(f"__r.{v}").alias(f"asof_{v}") for v in values])


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, shift: int, tolerance: int, values: list[str]) -> DataFrame:
    """For each left row the right row of its key whose day is nearest to its day + shift, at most ``tolerance`` days off; of equals the earlier.

    Days are dealt into cells as wide as the tolerance and each right row is met from three cells, so the join is an equi-join.
    """
    cell = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01")) / max(1, tolerance))
    wanted = left.withColumn("__row", F.struct(*left.columns)).withColumn("__day", F.date_add(F.col(left_day), shift))
    near = wanted.withColumn("__cell", F.explode(F.array(*[cell(F.col("__day")) + k for k in (-1, 0, 1)])))
    other = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(right_day).alias("__other"), *[F.col(v).alias(f"near_{v}") for v in values], cell(F.col(right_day)).alias("__c"))
    on = F.col("__cell") == F.col("__c")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__k_{k}"))
    off = F.abs(F.datediff("__day", "__other"))
    best = near.join(other, on).filter(off <= tolerance).groupBy("__row").agg(F.min_by(F.struct(*[f"near_{v}" for v in values], F.col("__other").alias("near_day")), F.struct(off, "__other")).alias("__best"))
    found = best.select("__row.*", "__best.*")
    return left.join(found.select(*left.columns, "near_day", *[f"near_{v}" for v in values]), left.columns, "left")


def nth_of_sorted(df: DataFrame, keys: list[str], value: str, name: str, parts: int = 64) -> DataFrame:
    """The upper median of each key: element n // 2, from 0, of the sorted values; nulls left out.

    Equal values are counted together. A key's values are dealt into ranges by approximate quantiles, the ranges' sizes tell in which
    one the element lies, and only that one is sorted: a key of any size is no more than about ``1 / parts`` of its values to a task.
    """
    key = "__key"  # as a struct, in which nulls are equal
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.struct(*keys).alias(key), F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    edges = counts.groupBy(key).agg(F.percentile_approx("__v", [i / parts for i in range(1, parts)], 1000).alias("__edges"), F.sum("__n").alias("__all"))
    on = [key, "__salt"]  # a key's counts meet its edges in several parts
    met = counts.withColumn("__salt", F.pmod(F.xxhash64("__v"), F.lit(parts))).join(edges.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))), on)
    dealt = met.withColumn("__part", F.size(F.filter("__edges", lambda e: e < F.col("__v")))).select(key, "__v", "__n", "__all", "__part")
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(key, "__part").agg(F.sum("__n").alias("__size"), F.first("__all").alias("__all")).withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    target = F.floor(F.col("__all") / 2)
    holds = sizes.filter((F.col("__before") <= target) & (target < F.col("__before") + F.col("__size"))).select(key, "__part", "__before")
    up_to = F.sum("__n").over(Window.partitionBy(key).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before")
    ranked = dealt.join(holds, [key, "__part"]).withColumn("__up_to", up_to)
    return ranked.filter((F.col("__up_to") > target) & (F.col("__up_to") - F.col("__n") <= target)).select(f"{key}.*", F.col("__v").alias(name))


def most_common(df: DataFrame, keys: list[str], value: str, name: str, n: int = 1) -> DataFrame:
    """The n most frequent values of each key with their counts; ties by value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n).select(*keys, F.col(value).alias(name), "n", "rank")


# ------------------------------------------------------------------ merges


def insert_ignore(table: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The table and those incoming rows whose key it lacks, the first of each."""
    new = latest_per_key(incoming, keys, order).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(new.select(*table.columns))


def replace_by_key(table: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Incoming rows replace those of their key; the last of several wins (``order`` puts it first)."""
    last = latest_per_key(incoming, keys, order)
    return table.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*table.columns))


def upsert_sticky(table: DataFrame, incoming: DataFrame, keys: list[str], sticky: str, value: str) -> DataFrame:
    """As ``replace_by_key`` for one row a key, but a column that once had ``value`` keeps it."""
    old = table.select(*keys, *[F.col(c).alias(f"__{c}") for c in table.columns if c not in keys], F.lit(True).alias("__old"))
    new = incoming.select(*table.columns, F.lit(True).alias("__new"))
    both = new.join(old, keys, "full")
    out = []
    for c in table.columns:
        if c in keys:
            out.append(F.col(c))
        elif c == sticky:
            out.append(F.when(F.col(f"__{c}") == value, F.lit(value)).when(F.col("__new"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c))
        else:
            out.append(F.when(F.col("__new"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c))
    return both.select(*out)


def upsert_counter(table: DataFrame, incoming: DataFrame, keys: list[str], seen: str) -> DataFrame:
    """(keys, first_seen, last_seen, seen_count): counts add up, the first time stays, the last moves on."""
    new = incoming.groupBy(*keys).agg(F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.count("*").alias("seen_count"))
    both = table.select(*keys, "first_seen", "last_seen", "seen_count").unionByName(new)
    return both.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen_count").alias("seen_count"))


def coalesce_merge(table: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming values that aren't null overwrite; null ones keep what is there."""
    new = incoming.select(*keys, *[F.col(c).alias(f"__{c}") for c in table.columns if c not in keys])
    return table.join(new, keys, "full").select(*keys, *[F.coalesce(f"__{c}", c).alias(c) for c in table.columns if c not in keys]).select(*table.columns)


def delete_not_in(table: DataFrame, kept: DataFrame, keys: list[str], scope: Column) -> DataFrame:
    """Of the rows in scope only those whose key is kept; the others untouched."""
    inside = table.filter(scope).join(kept.select(*keys).distinct(), keys, "left_semi")
    return table.filter(~F.coalesce(scope, F.lit(False))).unionByName(inside.select(*table.columns))


def cascade_delete(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def effective_rank(snapshots: DataFrame, day: str, key: str, rank: str, days: int = 2) -> DataFrame:
    """The best rank of each key over the latest ``days`` distinct days."""
    latest = snapshots.select(day).distinct().orderBy(F.desc(day)).limit(days)
    return snapshots.join(F.broadcast(latest), day, "left_semi").groupBy(key).agg(F.min(rank).alias("effective_rank"))
