"""Centroid clustering of quantised vectors: Lloyd's rounds over distinct vectors with multiplicities.

1. Vectors become whole numbers, floor(scale * x). Identical ones are grouped with their number, counted before the shuffle, so that
   a vector with very many copies is one row from then on.
2. Each round deals the distinct vectors to the nearest centroid and sums them, times their multiplicity, as whole numbers: a task sends a
   number a centroid and component. A centroid becomes the floor of sum by count, exactly. Only centroids pass through the driver.
3. Assignments are joined back to the ids by a 16-byte digest of the vector. What has a large share of all rows is split: its rows are
   dealt to several parts, and its one assignment is sent to each of them.

Distances are exact: products of small components in doubles (below 2**53), others in longs. A component must be within 2**27 after
scaling, or the call fails with a message, as squared distances could leave a long otherwise.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part; ids that repeat are rows
of their own, each comes back; null ids take part and are taken as first centroids only after all others; fewer vectors than centroids
give fewer centroids, and equal vectors may start several, of which the first gets all; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import partitions, string_buffers
from tidewire.session import cut

DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, "2"
LARGEST, SMALL, LOW_BITS, STRIP = 1 << 27, 1 << 21, 20, 8192


class Clustering(NamedTuple):
    """``members``: vec_id, cluster, distance of every vector that takes part. ``centroids``: cluster, members, inertia, total_inertia (of all),
    centroid (array), a row a centroid."""

    members: DataFrame
    centroids: DataFrame


def quantised(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """vec_id, the components floor(scale * x) as packed integers, and a digest of them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), dim), False))
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # null components are NaN here
            finite = np.isfinite(x).all(1)
            x = np.floor(x[finite] * scale)
            if np.abs(x).max(initial=0) > LARGEST:
                raise ValueError(f"components times {scale} must be within 2**27")
            rows = [r.tobytes() for r in x.astype("<i4")]
            keys = [hashlib.blake2b(r, digest_size=16).digest() for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(finite)), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())], names=["vec_id", "key", "vec"])

    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return picked.mapInArrow(pack, "vec_id long, key binary, vec binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return string_buffers(column)[0].view("<i4").reshape(-1, dim).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of every row (the smaller of equals) and the squared distance."""
    cluster, distance = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
    for lo in range(0, len(x), STRIP):
        q = x[lo : lo + STRIP]
        if max(np.abs(q).max(initial=0), np.abs(centroids).max(initial=0)) <= SMALL and x.shape[1] <= 1024:
            products = (q.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
        else:
            products = q @ centroids.T
        d = (q * q).sum(1)[:, None] - 2 * products + (centroids * centroids).sum(1)[None, :]
        cluster[lo : lo + STRIP] = d.argmin(1)
        distance[lo : lo + STRIP] = d.min(1)
    return cluster, distance


def _summed(centroids: np.ndarray):
    """A task's sums: (cluster, component, sum), and the count as component -1."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, STRIP):
                part = b.slice(lo, STRIP)
                x, weight = _matrix(part.column(0), dim), part.column(1).to_numpy()
                cluster, _ = nearest(x, centroids)
                order = np.argsort(cluster, kind="stable")
                own, begin = np.unique(cluster[order], return_index=True)
                if len(own):  # a multiplicity in two halves, so that no product of a strip leaves a long
                    halves = weight[order] >> LOW_BITS, weight[order] & ((1 << LOW_BITS) - 1)
                    high, low = (np.add.reduceat(x[order] * h[:, None], begin, axis=0).astype(object) for h in halves)
                    total[own] += high * (1 << LOW_BITS) + low
                    count[own] += np.add.reduceat(weight[order], begin)
        full = np.flatnonzero(count)
        sums = [Decimal(v) for c in full for v in (*total[c].tolist(), int(count[c]))]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(full, dim + 1), pa.int32()), pa.array(np.tile(np.append(np.arange(dim), -1), len(full)), pa.int32()), pa.array(sums, pa.decimal128(38, 0))], names=["cluster", "component", "total"])

    return run


def lloyd_round(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round; those without vectors stay."""
    sums = distinct.select("vec", "weight").mapInArrow(_summed(centroids), "cluster int, component int, total decimal(38,0)")
    found = {(r["cluster"], r["component"]): int(r["total"]) for r in sums.groupBy("cluster", "component").agg(F.sum("total").alias("total")).collect()}  # a number a centroid and component
    out = centroids.copy()
    for c in {c for c, _ in found}:
        out[c] = [found[c, i] // found[c, -1] for i in range(centroids.shape[1])]
    return out


def first_centroids(vectors: DataFrame, k: int, dim: int, seed: str) -> np.ndarray:
    """The vectors of the k smallest digests of ``seed:vec_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(digest.alias("digest"), "vec").orderBy(F.asc_nulls_last("digest"), "vec").limit(k).collect()
    return np.frombuffer(b"".join(bytes(r["vec"]) for r in rows), "<i4").reshape(-1, dim).astype(np.int64)


def clustered(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> Clustering:
    """Clusters of the vectors by k centroids and so many rounds, then one more assignment."""
    spark = vectors.sparkSession
    kept = quantised(vectors, id_col, vec_col, dim, scale)
    centroids = first_centroids(kept, k, dim, seed)
    schema = "cluster int, members long, inertia long, total_inertia long, centroid array<int>"
    if not len(centroids):
        return Clustering(kept.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), spark.createDataFrame([], schema))
    distinct = cut(kept.groupBy("key", "vec").agg(F.count("*").alias("weight")).select("key", "vec", "weight"))
    for _ in range(rounds):
        centroids = lloyd_round(distinct, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, distance = nearest(_matrix(b.column(1), dim), centroids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cluster), pa.array(distance)], names=["key", "weight", "cluster", "distance"])

    assigned = cut(distinct.mapInArrow(assign, "key binary, weight long, cluster int, distance long"))
    spread = F.col("weight").cast("decimal(18,0)") * F.col("distance").cast("decimal(19,0)")
    found = {r["cluster"]: r for r in assigned.groupBy("cluster").agg(F.sum("weight").alias("members"), F.sum(spread).alias("inertia")).collect()}  # a row a centroid
    size = {c: r["members"] for c, r in found.items()}
    inertia = {c: int(r["inertia"]) for c, r in found.items()}
    table = [(c, size.get(c, 0), inertia.get(c, 0), sum(inertia.values()), row.tolist()) for c, row in enumerate(centroids)]
    return Clustering(_joined_back(kept, assigned, sum(size.values())), spark.createDataFrame(table, schema))


def _joined_back(kept: DataFrame, assigned: DataFrame, total: int) -> DataFrame:
    """vec_id, cluster and distance of every row. A vector with more than a quarter of a partition's share of the rows is dealt
    to parts; there can be four such vectors a partition at most, which bounds what is broadcast."""
    share = max(1, total // (4 * partitions(kept.sparkSession)))
    parts = F.when(F.col("weight") > share, F.ceil(F.col("weight") / share)).otherwise(1).cast("int")
    large = assigned.filter(F.col("weight") > share).select("key", parts.alias("parts"))
    rows = kept.select("vec_id", "key").withColumn("at", F.monotonically_increasing_id()).join(F.broadcast(large), "key", "left")
    rows = rows.select("vec_id", "key", F.when(F.col("parts").isNotNull(), F.pmod("at", "parts")).otherwise(0).cast("int").alias("part"))
    sent = assigned.select("key", "cluster", "distance", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return rows.join(sent, ["key", "part"]).select("vec_id", "cluster", "distance")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    told = found.centroids.select("cluster", F.col("inertia").alias("cluster_inertia"), F.col("total_inertia").alias("inertia"), digest.alias("centroid_sha256"))
    return found.members.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    near = "SELECT v.*, c.cluster, list_sum([power(v.q[i] - c.q[i], 2)::BIGINT FOR i IN range(1, {dim} + 1)])::BIGINT AS distance FROM v, c{k} c QUALIFY row_number() OVER (PARTITION BY v.rid ORDER BY distance, cluster) = 1"
    steps = []
    for k in range(ROUNDS):
        steps += [
            f"a{k} AS MATERIALIZED ({near.format(dim=DIM, k=k)})",
            f"s{k} AS (SELECT cluster, i, sum(q[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{k}, range(1, {DIM} + 1) t(i) GROUP BY cluster, i)",
            f"c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{k} c LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{k} GROUP BY cluster) m ON m.cluster = c.cluster)",
        ]
    return f"""
WITH k AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings WHERE len(embedding) = {DIM}),
v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rid, [CAST(floor({SCALE} * x) AS BIGINT) FOR x IN e] AS q FROM k WHERE len([x FOR x IN e IF isfinite(x)]) = {DIM}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS INT) AS cluster, q FROM v QUALIFY cluster < {CENTROIDS}),
{", ".join(steps)},
f AS ({near.format(dim=DIM, k=ROUNDS)})
SELECT f.vec_id, f.cluster, f.distance, CAST(sum(f.distance) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(f.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM f JOIN c{ROUNDS} c ON c.cluster = f.cluster
"""


ORACLE = _oracle()
