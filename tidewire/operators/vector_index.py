"""An index for retrieval by cosine: vectors dealt to cells around trained directions, kept in the shared folder.

``build`` trains directions on a bounded sample (``sample_rows``) and deals every row to the nearest; the table has for each row its angle to the
direction, and for each cell how many rows it has and the widest angle. ``search`` looks at the ``probes`` nearest cells of a query. ``exact`` looks
at these first, which gives a k-th score, and then at every other cell that can hold a better row: with a the angle between query and direction, a row at
angle b to it has a cosine of cos(a - b) at most, so a cell counts only if cos(a - widest) reaches the k-th score, and a row only if its own bound does.
Cells of more than ``part_rows`` rows are met in parts, so a crowded direction is no single task. Vectors of length 0, which have no angle, are a cell of their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.retrieval import _unit, top_k
from tidewire.session import cut

CELLS, SAMPLE_ROWS, ROUNDS, PROBES, PART_ROWS, STRIP = 64, 20_000, 8, 8, 200_000, 4096
NOWHERE, SLACK = -1, 1e-9


def trained(x: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Directions of unit vectors by spherical k-means; of a sample, so on one machine."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for k in range(len(c)):
            total = x[own == k].sum(0)
            size = np.linalg.norm(total)
            if size > 0:
                c[k] = total / size
    return c


def _angles(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ c.T, -1.0, 1.0))


class VectorIndex:
    """An index at a path; ``VectorIndex(spark, path)`` opens one that ``build`` wrote, in any session."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        told = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        self.dim, self.kind = told["dim"], told["kind"]
        self.directions = np.array(told["directions"], float).reshape(-1, self.dim)
        cells = {r["cell"]: r for r in spark.read.parquet(f"{path}/cells").collect()}  # a row a cell
        self.parts = {c: r["parts"] for c, r in cells.items()}
        self.widest = np.array([cells[k]["widest"] if k in cells else -np.inf for k in range(len(self.directions))])

    @staticmethod
    def build(rows: DataFrame, row_id: str, vector: str, path: str, cells: int = CELLS, sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS) -> VectorIndex:
        """Index every row of the dimension that the longest vectors have; rows without one take no part."""
        spark = rows.sparkSession
        kept = rows.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL AND id IS NOT NULL")
        dim = kept.agg(F.max(F.size("v"))).first()[0] or 1
        kept = kept.filter(F.size("v") == dim)
        drawn = kept.orderBy(F.xxhash64("id")).limit(sample_rows).select("v").toPandas()["v"]  # a bounded sample, the same each time
        x = _unit(drawn, dim)
        x = x[np.linalg.norm(x, axis=1) > 0]
        directions = trained(x, cells) if len(x) else np.empty((0, dim))
        kind = dict(kept.dtypes)["id"]

        def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                if not len(p):
                    continue
                u = _unit(p["v"], dim)
                angle = _angles(u, directions) if len(directions) else np.full((len(u), 1), np.pi / 2)
                null = np.linalg.norm(u, axis=1) == 0
                yield pd.DataFrame({"id": p["id"], "cell": np.where(null, NOWHERE, angle.argmin(1)).astype(np.int32), "angle": np.where(null, 0.0, angle.min(1)), "v": list(u)})

        dealt = kept.mapInPandas(deal, f"id {kind}, cell int, angle double, v array<double>")
        dealt.repartition(F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/rows")
        written = spark.read.schema(f"id {kind}, angle double, cell int").parquet(f"{path}/rows")
        written.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("widest"), F.ceil(F.count("*") / part_rows).cast("int").alias("parts")).coalesce(1).write.parquet(f"{path}/cells")
        spark.createDataFrame([(json.dumps({"dim": dim, "kind": kind, "directions": directions.ravel().tolist()}),)], "value string").coalesce(1).write.text(f"{path}/manifest")
        return VectorIndex(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"id {self.kind}, angle double, v array<double>, cell int").parquet(f"{self.path}/rows")

    def _asked(self, queries: DataFrame, query_id: str, vector: str) -> DataFrame:
        asked = queries.select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("qv"))
        return asked.filter(F.col("q").isNotNull() & (F.size("qv") == self.dim) & ~F.exists("qv", lambda x: x.isNull()))

    def _visits(self, asked: DataFrame, probes: int, beyond: bool) -> DataFrame:
        """(q, qv, cell, part, floor): the nearest cells of each query, or, with its k-th score ``kth``, all others that can hold a better row."""
        directions, widest, parts, dim = self.directions, self.widest, self.parts, self.dim
        kind = dict(asked.dtypes)["q"]

        def visit(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in rows:
                if not len(p):
                    continue
                u = _unit(p["qv"], dim)
                angle = _angles(u, directions) if len(directions) else np.empty((len(u), 0))
                order = np.argsort(angle, axis=1, kind="stable")
                out = []
                for i, (q, v) in enumerate(zip(p["q"], u, strict=True)):
                    near = order[i, :probes].tolist()
                    floor = -2.0
                    if beyond:
                        floor = -2.0 if pd.isna(p["kth"].iloc[i]) else float(p["kth"].iloc[i])
                        best = np.cos(np.maximum(0.0, angle[i] - widest))
                        near = [c for c in order[i, probes:].tolist() if best[c] >= floor - SLACK and c in parts]
                    elif NOWHERE in parts:
                        near = [*near, NOWHERE]
                    out += [(q, v, c, k, float(angle[i, c]) if c >= 0 else 0.0, floor) for c in near for k in range(parts.get(c, 0))]
                yield pd.DataFrame(out, columns=["q", "qv", "cell", "part", "away", "floor"])

        return asked.mapInPandas(visit, f"q {kind}, qv array<double>, cell int, part int, away double, floor double")

    def _found(self, visits: DataFrame, k: int) -> DataFrame:
        kind, dim, parts = dict(visits.dtypes)["q"], self.dim, self.parts
        sizes = F.create_map(*[F.lit(x) for c in parts.items() for x in c]) if parts else None
        rows = self.rows().withColumn("part", F.pmod(F.xxhash64("id"), sizes[F.col("cell")]).cast("int") if sizes is not None else F.lit(0))

        def meet(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(asked) and len(own):
                x, angle, ids = np.stack(own["v"].to_numpy()), own["angle"].to_numpy(), own["id"].to_numpy()
                flat = int(own["cell"].iloc[0]) == NOWHERE
                for lo in range(0, len(asked), STRIP):
                    some = asked.iloc[lo : lo + STRIP]
                    score = np.stack(some["qv"].to_numpy()) @ x.T
                    floor = some["floor"].to_numpy()[:, None]
                    if not flat:
                        score[np.cos(np.abs(some["away"].to_numpy()[:, None] - angle[None, :])) < floor - SLACK] = -3
                    for i, q in enumerate(some["q"]):
                        keep = np.flatnonzero(score[i] >= floor[i] - SLACK)
                        best = keep[np.lexsort((ids[keep], -score[i][keep]))][:k]
                        out += [(q, ids[j], score[i][j]) for j in best]
            return pd.DataFrame(out, columns=["query_id", "id", "cosine"])

        met = visits.groupBy("cell", "part").cogroup(rows.groupBy("cell", "part")).applyInPandas(meet, f"query_id {kind}, id {self.kind}, cosine double")
        return met

    def search(self, queries: DataFrame, query_id: str, vector: str, k: int, probes: int = PROBES) -> DataFrame:
        """query_id, id, cosine and rank of the k best rows in the ``probes`` nearest cells."""
        return top_k(self._found(self._visits(self._asked(queries, query_id, vector), probes, False), k), ["query_id"], [F.desc("cosine"), "id"], k)

    def exact(self, queries: DataFrame, query_id: str, vector: str, k: int, probes: int = PROBES) -> DataFrame:
        """query_id, id, cosine and rank of the k best of all rows."""
        asked = self._asked(queries, query_id, vector)
        near = cut(top_k(self._found(self._visits(asked, probes, False), k), ["query_id"], [F.desc("cosine"), "id"], k))
        kth = near.filter(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("cosine").alias("kth"))
        rest = self._found(self._visits(asked.join(kth, "q", "left"), probes, True), k)
        return top_k(near.drop("rank").unionByName(rest), ["query_id"], [F.desc("cosine"), "id"], k)
