"""Exact top-k search by inner product: a ball tree per shard, branch and bound with a shared k-th score.

Vectors are dealt to shards by their id, at most about ``shard_rows`` a shard. Every query is first answered on one home shard,
then on a few others (``WAVES``), then on the rest. The k-th score of all that was found in earlier waves is a floor for
the final one and goes with the query, so that nodes whose upper bound ``q.c + |q| r`` is below it are never opened.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; only
vectors of equal dimension are compared; rows that repeat an id and its vector count once; a query never
finds its own id; ties go to the smaller id; scores that don't fit in a long are cut to its range; an
empty table gives an empty result. Other columns of the input, whatever their names, are left alone.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.session import cut

LEAF, SHARD_ROWS, SLAB_ROWS = 256, 65_536, 65_536
#: How many shards a query has met after each wave; the last wave takes it to all.
WAVES = (1, 5)
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id, dim and floor(scale * x) of every component as packed doubles (whole numbers)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims, out = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    ids.append(i)
                    dims.append(len(x))
                    out.append(np.floor(np.clip(x * scale, -1e300, 1e300)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "vec"])

    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return picked.mapInArrow(pack, "vec_id long, dim int, vec binary")


class BallTree:
    """Nodes in arrays; the rows of a node are order[lo:hi]."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.order = x, np.arange(len(x))
        self.centre, self.radius, self.span, self.kids = [], [], [], []
        self._build(0, len(x), leaf)
        self.x = x[self.order]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def _build(self, lo: int, hi: int, leaf: int) -> None:
        stack = [(lo, hi, -1)]
        while stack:
            lo, hi, parent = stack.pop()
            rows = self.x[self.order[lo:hi]]
            centre = rows.mean(0)
            me = len(self.span)
            self.centre.append(centre)
            self.radius.append(math.sqrt(float(((rows - centre) ** 2).sum(1).max())))
            self.span.append((lo, hi))
            self.kids.append([])
            if parent >= 0:
                self.kids[parent].append(me)
            if hi - lo > leaf and self.radius[me] > 0:
                axis = int(np.argmax(rows.max(0) - rows.min(0)))
                mid = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(rows[:, axis], mid)]
                stack += [(lo, lo + mid, me), (lo + mid, hi, me)]

    def search(self, ids: np.ndarray, q: np.ndarray, own: int, k: int, floor: float) -> list[tuple[float, int]]:
        """The k best (score, id), all at least ``floor``; nodes are opened by falling upper bound."""
        size = math.sqrt(float(q @ q))
        bound = lambda n: float(self.centre[n] @ q) + size * float(self.radius[n])
        slack = 1e-9 * (1 + size * float(np.abs(self.centre).max() + self.radius.max()))
        heap, best, kth = [(-bound(0), 0)], [], floor
        while heap:
            upper, n = heapq.heappop(heap)
            if -upper + slack < kth:
                break
            if self.kids[n]:
                for m in self.kids[n]:
                    b = bound(m)
                    if b + slack >= kth:
                        heapq.heappush(heap, (-b, m))
                continue
            lo, hi = self.span[n]
            scores = self.x[lo:hi] @ q
            near = np.flatnonzero(scores >= kth)
            best += [(float(scores[i]), int(ids[lo + i])) for i in near if ids[lo + i] != own]
            best.sort(key=lambda t: (-t[0], t[1]))
            del best[k:]
            if len(best) == k:
                kth = max(kth, best[-1][0])
        return best


def _exact(ids: np.ndarray, x: np.ndarray, q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """Whole numbers too large for doubles: Python integers, cut to the range of a long."""
    y = [int(v) for v in q]
    scores = [(max(-(2**63), min(2**63 - 1, sum(int(a) * b for a, b in zip(row, y, strict=True)))), int(i)) for i, row in zip(ids, x, strict=True) if i != own]
    return sorted(scores, key=lambda t: (-t[0], t[1]))[:k]


def _searcher(k: int):
    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(rows) and len(queries):
            rows = rows.drop_duplicates(["vec_id", "vec"])
            x = np.frombuffer(b"".join(rows["vec"]), np.float64).reshape(len(rows), -1)
            ids = rows["vec_id"].to_numpy()
            y = np.frombuffer(b"".join(queries["q_vec"]), np.float64).reshape(len(queries), -1)
            small = float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] < 2**52
            tree = BallTree(x) if small else None
            own_ids = ids[tree.order] if small else ids
            for q, own, floor in zip(y, queries["query_id"], queries["kth"], strict=True):
                found = tree.search(own_ids, q, own, k, -math.inf if pd.isna(floor) else float(floor)) if small else _exact(ids, x, q, own, k)
                out += [(own, i, int(s)) for s, i in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, shard_rows: int = SHARD_ROWS, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """The k rows with the largest inner product for every row of ``vectors`` that ``is_query`` selects.

    ``is_query`` speaks of the column vec_id. Returns query_id, rank (from 1), vec_id, score.
    """
    spark: SparkSession = vectors.sparkSession
    packed = quantised(vectors, id_col, vec_col, scale)
    n, asking = packed.select(F.count("*"), F.count_if(F.coalesce(is_query, F.lit(False)))).first()
    shards = max(1, math.ceil(n / shard_rows), min(spark.sparkContext.defaultParallelism, math.ceil(n / 1024)))
    slabs = max(1, math.ceil(asking / slab_rows))
    every = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b - 1)))
    rows = packed.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("slab", every(0, slabs))
    queries = packed.filter(is_query).dropDuplicates().select(
        F.col("vec_id").alias("query_id"), F.col("dim").alias("q_dim"), F.col("vec").alias("q_vec"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int").alias("home"), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(slabs)).cast("int").alias("slab")
    )
    in_order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best_of = lambda found: found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= k)

    found, met = None, 0
    for until in [w for w in WAVES if w < shards] + [shards]:
        asked = queries.withColumn("shard", every(met, until)).withColumn("shard", F.pmod(F.col("home") + F.col("shard"), F.lit(shards)))
        if found is None:
            asked = asked.withColumn("kth", F.lit(None).cast("long"))
        else:
            asked = asked.join(best_of(found).filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth")), "query_id", "left")
        new = rows.groupBy("shard", "dim", "slab").cogroup(asked.groupBy("shard", "q_dim", "slab")).applyInPandas(_searcher(k), FOUND)
        found, met = new if found is None else found.unionByName(new), until
        if until < shards:
            found = cut(found)
    return best_of(found).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
