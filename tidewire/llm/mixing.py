"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens (words) to the power of an exponent between 0 and 1, normalised. The exponent is found by
bisection: the least one, so the flattest mixture, under which no source repeats more than ``max_repeats`` times; or, with
``entropy``, the one whose mixture has that share of the greatest possible entropy. The weights become budgets of
tokens, and these are realised by block permutations: documents fall into blocks by a hash; every whole epoch of
a source takes all its blocks, the last one takes them in an order of its own until the budget is met, and inside the
block where that happens documents in the order of their hash. So a source's last epoch is two numbers, a cut among blocks
and one among documents, and the documents themselves are not shuffled.

The driver gets the sources' token counts, each count once with how many sources have it: at most the square root of twice the
tokens, however many sources there are. The table of sources is broadcast up to ``BROADCAST_SOURCES`` rows; larger ones are joined in
``SALTS`` parts, so that no source's documents go to one task.

Without ``budget`` (in tokens) the budget is the least under which every source is read once in full, so that nothing is lost.

Defined results: a null source is a source; a source without tokens is read once; null text has no tokens and goes with its source;
repeated rows share a hash and so a fate; an empty table gives an empty result. All columns are kept and ``epoch`` (from 0), ``block``,
``place``, which sorts an epoch's blocks, ``n_tokens`` and ``weight`` are added, in the place of columns that have these names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.session import cut

MAX_REPEATS, BLOCKS, BROADCAST_SOURCES, SALTS = 1.5, 1024, 100_000, 64
ADDED = ("epoch", "block", "place", "n_tokens", "weight")


class Sources:
    """Token counts of sources and how many sources have each, and what an exponent makes of them. Sources without tokens don't count."""

    def __init__(self, tokens: np.ndarray, times: np.ndarray):
        has = tokens > 0
        self.tokens, self.times = tokens[has].astype(np.float64), times[has].astype(np.float64)
        self.total = float((self.tokens * self.times).sum())
        self.share = self.tokens / self.total if self.total else self.tokens

    def norm(self, exponent: float) -> float:
        """What the shares to that power sum up to."""
        return float((self.times * self.share**exponent).sum())

    def budget(self, exponent: float, budget: float | None) -> float:
        return budget if budget is not None else float((self.tokens / (self.share**exponent / self.norm(exponent))).max())

    def most_repeats(self, exponent: float, budget: float | None) -> float:
        return float((self.share**exponent / self.norm(exponent) * self.budget(exponent, budget) / self.tokens).max())

    def entropy_share(self, exponent: float) -> float:
        n = self.times.sum()
        w = self.share**exponent / self.norm(exponent)
        return 1.0 if n < 2 else float(-(self.times * w * np.log(w)).sum() / math.log(n))

    def bisect(self, max_repeats: float | None, entropy: float | None, budget: float | None, rounds: int = 60) -> float:
        """The exponent; both goals move one way with it, so halving the interval finds it."""

        def too_flat(a: float) -> bool:
            if entropy is not None:
                return self.entropy_share(a) > entropy
            return self.most_repeats(a, budget) > max_repeats + 1e-9

        lo, hi = 0.0, 1.0
        if not too_flat(lo):
            return lo
        for _ in range(rounds):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if too_flat(mid) else (lo, mid)
        return hi


def _words() -> Column:
    return F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def marked(documents: DataFrame, seed: int) -> DataFrame:
    """The documents (``row``) with source (never null), hash, tokens and block."""
    source = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    h = F.xxhash64("doc_id", "text", F.lit(seed))
    return documents.select(F.struct("*").alias("row"), source.alias("source"), h.alias("hash"), _words().alias("tokens"), F.pmod(h, F.lit(BLOCKS)).cast("int").alias("block"))


def _place(epoch: Column, seed: int) -> Column:
    return F.xxhash64("source", "block", epoch.cast("int"), F.lit(seed + 1))


def _edge(parts: DataFrame, order: list[str]) -> DataFrame:
    """Of the parts (source, tokens, room, ...) in order, the one in which each source's room ends, with what is left of the room there."""
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("before", before).filter("before <= room AND before + tokens > room").withColumn("room", F.col("room") - F.col("before")).drop("before", "tokens")


def plan(rows: DataFrame, max_repeats: float | None, entropy: float | None, budget: float | None, seed: int) -> DataFrame:
    """Per source: weight, whole epochs, and where the last one stops: at ``stop_place`` among blocks, and in that block at ``stop_hash``
    among documents (null: not at all). The place is found in three steps: a block, a stretch of its hashes, a document."""
    counted = cut(rows.select("source", "hash", "tokens", "block"))
    blocks = cut(counted.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")))
    per = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    found = per.groupBy("tokens").agg(F.count("*").alias("times")).toArrow()
    sources = Sources(found["tokens"].to_numpy(), found["times"].to_numpy())
    if not sources.total:
        return per.select("source", F.lit(0.0).alias("weight"), F.lit(1).alias("whole"), F.lit(None).cast("long").alias("stop_place"), F.lit(None).cast("long").alias("stop_hash"))
    exponent = sources.bisect(max_repeats, entropy, budget)
    has = F.col("tokens") > 0
    weight = F.when(has, F.pow(F.col("tokens") / F.lit(sources.total), F.lit(exponent)) / F.lit(sources.norm(exponent))).otherwise(F.lit(0.0))
    goal = F.col("weight") * F.lit(sources.budget(exponent, budget))
    per = per.withColumn("weight", weight).withColumn("whole", F.when(has, F.floor(goal / F.col("tokens") + 1e-9)).otherwise(F.lit(1)).cast("int"))
    per = cut(per.withColumn("room", F.when(has, F.greatest(F.lit(0), F.floor(goal - F.col("whole") * F.col("tokens") + 0.5))).otherwise(F.lit(0)).cast("long")))

    want = per.filter("room > 0").select("source", "whole", "room")
    cells = blocks.join(want, "source").withColumn("place", _place(F.col("whole"), seed))
    edge = _edge(cells, ["place", "block"]).select("source", "block", "place", "room")
    near = counted.join(edge, ["source", "block"]).withColumn("stretch", F.shiftright("hash", 54))
    stretches = near.groupBy("source", "place", "room", "stretch").agg(F.sum("tokens").alias("tokens"))
    inner = _edge(stretches, ["stretch"]).select("source", "stretch", F.col("room").alias("left"))
    last = near.join(inner, ["source", "stretch"])
    up_to = last.withColumn("sum", F.sum("tokens").over(Window.partitionBy("source").orderBy("hash").rangeBetween(Window.unboundedPreceding, 0)))
    lowest = F.min("stretch") * F.lit(1 << 54) - 1  # no document of the stretch: all before it
    stop = up_to.groupBy("source").agg(F.first("place").alias("stop_place"), F.coalesce(F.max(F.when(F.col("sum") <= F.col("left"), F.col("hash"))), lowest).alias("stop_hash"))
    return per.join(stop, "source", "left").select("source", "weight", "whole", "stop_place", "stop_hash")


def mix(documents: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: float | None = None, seed: int = 0, broadcast_sources: int = BROADCAST_SOURCES, marks: bool = True) -> DataFrame:
    """The mixture: every document as often as its source's budget says; without ``marks`` with its own columns alone."""
    rows = marked(documents, seed)
    table = cut(plan(rows, max_repeats, entropy, budget, seed))
    if table.count() <= broadcast_sources:
        joined = rows.join(F.broadcast(table), "source")
    else:
        salt = F.pmod(F.shiftright("hash", 20), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("salt", salt).join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["source", "salt"])
    last = _place(F.col("whole"), seed)
    partly = (last < F.col("stop_place")) | ((last == F.col("stop_place")) & (F.col("hash") <= F.col("stop_hash")))
    times = F.col("whole") + F.coalesce(partly, F.lit(False)).cast("int")
    out = joined.withColumn("times", times).filter("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    if not marks:
        return out.select("row.*")
    return out.select(*[F.col(f"row.`{c}`") for c in documents.columns if c not in ADDED], "epoch", "block", _place(F.col("epoch"), seed).alias("place"), F.col("tokens").alias("n_tokens"), "weight")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "epoch", "block", "place", "n_tokens", F.round("weight", 9).alias("weight"))
