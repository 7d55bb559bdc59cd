"""Retrieval by cosine: a set of queries against all rows, in blocks, with the best of a block kept before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: So many numbers of queries travel to all tasks as one matrix; more are dealt in blocks of ``BLOCK_VALUES`` numbers, and the rows in as large ones to each.
BROADCAST_VALUES, BLOCK_VALUES = 8_000_000, 2_000_000
#: So many scores are held at once, so many best ones while a task goes through its rows, and so many rows are given on at once.
TILE, HELD, GIVEN = 2_000_000, 4_000_000, 100_000
#: A matrix product may differ so much from the sum of a pair's products.
ROUNDING = 1e-9


def _unit(vectors: pd.Series, dim: int) -> np.ndarray:
    x = np.nan_to_num(np.array(vectors.to_list(), np.float64).reshape(len(vectors), dim))
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


class _Best:
    """The k best rows of each query and parent (without parents: one for all), and at least ``least``, while blocks of rows pass; ties go to the smaller row.

    A product of matrices in tiles finds what may be among them. The score of such a pair is the sum of its products alone, so that copies of a vector
    have equal scores wherever they stand in a tile.
    """

    def __init__(self, q: np.ndarray, k: int, least: float, kind):
        self.q, self.k, self.least, self.parents = q, k, least, {}
        self.score, self.row = np.full((len(q), 0, k), -np.inf), np.empty((len(q), 0, k), kind)

    def add(self, x: np.ndarray, rows: np.ndarray, parents: np.ndarray) -> None:
        for p in parents:
            self.parents.setdefault(p, len(self.parents))
        more = len(self.parents) - self.score.shape[1]
        if more:
            self.score = np.concatenate([self.score, np.full((len(self.q), more, self.k), -np.inf)], axis=1)
            self.row = np.concatenate([self.row, np.empty((len(self.q), more, self.k), self.row.dtype)], axis=1)
        cells = np.array([self.parents[p] for p in parents])
        order = np.argsort(cells, kind="stable")
        x, rows, cells = x[order], rows[order], cells[order]
        wide = min(len(x), 2048)
        high = max(1, TILE // wide)
        for j in range(0, len(x), wide):
            for i in range(0, len(self.q), high):
                self._tile(i, self.q[i : i + high], x[j : j + wide], rows[j : j + wide], cells[j : j + wide])

    def _tile(self, first: int, q: np.ndarray, x: np.ndarray, rows: np.ndarray, cells: np.ndarray) -> None:
        near = q @ x.T
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        ends = np.r_[starts[1:], len(cells)]
        bound = np.maximum(self.score[first : first + len(q), cells[starts], self.k - 1], self.least)
        for n, (a, e) in enumerate(zip(starts, ends, strict=True)):
            part = near[:, a:e]
            if e - a > self.k:
                own = part.max(axis=1) if self.k == 1 else np.partition(part, e - a - self.k, axis=1)[:, e - a - self.k]
                np.maximum(bound[:, n], own, out=bound[:, n])
        at, col = np.nonzero(near >= np.repeat(bound, ends - starts, axis=1) - ROUNDING)
        step = max(1, TILE // q.shape[1])
        for a in range(0, len(at), step):
            self._merge(first, q, x, rows, cells, at[a : a + step], col[a : a + step])

    def _merge(self, first: int, q: np.ndarray, x: np.ndarray, rows: np.ndarray, cells: np.ndarray, at: np.ndarray, col: np.ndarray) -> None:
        score = _pairs(q[at], x[col])
        keep = score >= self.least
        new = pd.DataFrame({"q": first + at[keep], "cell": cells[col[keep]], "score": score[keep], "row": rows[col[keep]]})
        if not len(new):
            return
        met = new[["q", "cell"]].drop_duplicates()
        old_q, old_cell = np.repeat(met["q"].to_numpy(), self.k), np.repeat(met["cell"].to_numpy(), self.k)
        old = pd.DataFrame({"q": old_q, "cell": old_cell, "score": self.score[met["q"], met["cell"]].ravel(), "row": self.row[met["q"], met["cell"]].ravel()})
        both = pd.concat([old[old["score"] > -np.inf], new], ignore_index=True).sort_values(["score", "row"], ascending=[False, True])
        both["place"] = both.groupby(["q", "cell"], sort=False).cumcount()
        both = both[both["place"] < self.k]
        where = both["q"].to_numpy(), both["cell"].to_numpy(), both["place"].to_numpy()
        self.score[where], self.row[where] = both["score"].to_numpy(), both["row"].to_numpy()

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(places of queries, rows, parents, scores) of what is held."""
        told = np.array([*self.parents, None], object)[:-1]
        for i in range(0, len(self.q), step := max(1, GIVEN // max(1, self.score[0].size))):
            a, cell, place = np.nonzero(self.score[i : i + step] > -np.inf)
            yield i + a, self.row[i + a, cell, place], told[cell], self.score[i + a, cell, place]


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _scored(batches: Iterator[pd.DataFrame], ids: np.ndarray, q: np.ndarray, names: list[str], k: int | None, least: float | None) -> Iterator[pd.DataFrame]:
    """query_id, the row's names (id, perhaps parent) and cosine: what is best in all batches together, or without ``k`` all that reach ``least``."""
    row_id, parent = names[0], names[1] if len(names) > 1 else None
    least = -2.0 if least is None else least

    def told(best: _Best, start: int) -> Iterator[pd.DataFrame]:
        for a, rows, parents, score in best.found():
            if len(a):
                yield pd.DataFrame({"query_id": ids[start + a], row_id: rows, **({parent: parents} if parent else {}), "cosine": score})

    held = None
    for b in batches:
        if not len(b) or not len(ids):
            continue
        x, rows = _unit(b["v"], q.shape[1]), b[row_id].to_numpy()
        if k is None:
            step = max(1, TILE // len(x))
            for i in range(0, len(q), step):
                at, col = np.nonzero(q[i : i + step] @ x.T >= least - ROUNDING)
                for j in range(0, len(at), TILE // 64):
                    a, c = i + at[j : j + TILE // 64], col[j : j + TILE // 64]
                    score = np.concatenate([_pairs(q[a[m : m + 8192]], x[c[m : m + 8192]]) for m in range(0, len(a), 8192)])
                    a, c, score = a[score >= least], c[score >= least], score[score >= least]
                    yield pd.DataFrame({"query_id": ids[a], **{n: b[n].to_numpy()[c] for n in names}, "cosine": score})
            continue
        parents = b[parent].astype(object).where(b[parent].notna(), None).to_numpy() if parent else np.zeros(len(b), int)
        each = 1 if parent else k
        new = len(set(parents))
        if held is not None and len(q) * (len(held.parents) + new) * each > HELD:
            yield from told(held, 0)
            held = None
        if len(q) * new * each <= HELD:
            held = held or _Best(q, each, least, rows.dtype)
            held.add(x, rows, parents)
            continue
        for i in range(0, len(q), step := max(1, HELD // (new * each))):
            best = _Best(q[i : i + step], each, least, rows.dtype)
            best.add(x, rows, parents)
            yield from told(best, i)
    if held is not None:
        yield from told(held, 0)


def cosine_candidates(rows: DataFrame, row_id: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int | None, least: float | None = None, parent: str | None = None, broadcast_values: int = BROADCAST_VALUES, block: int | None = None) -> DataFrame:
    """query_id, row_id, (parent) and cosine: of every block of rows the k best of each query (with parents: the best of each query and parent), and at least ``least``.

    Up to ``broadcast_values`` numbers of queries are broadcast, more are met in blocks of ``block`` queries; the result is the same. Queries
    of another dimension than the largest, or with nulls, and rows of another dimension have no part in it; a norm of 0 scores 0.
    Scores are held in tiles and only the best are kept, so the memory of a task doesn't grow with rows and queries.
    """
    asked = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).filter("v IS NOT NULL AND q IS NOT NULL")
    many, dim = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = dim or 1
    asked = asked.filter((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))
    names = [row_id, *([parent] if parent else [])]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    q_kind = {f.name: f.dataType.simpleString() for f in queries.schema}[query_id]
    schema = ", ".join([f"query_id {q_kind}", *(f"`{n}` {kinds[n]}" for n in names), "cosine double"])
    picked = rows.select(*names, F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") == dim)

    if many * dim <= broadcast_values:
        got = asked.toPandas()
        shared = rows.sparkSession.sparkContext.broadcast((got["q"].to_numpy(), _unit(got["v"], dim)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from _scored(batches, *shared.value, names, k, least)

        return picked.mapInPandas(run, schema)

    own = max(1, BLOCK_VALUES // dim)
    q_blocks, r_blocks = -(-many // (block or own)), -(-max(1, picked.count()) // own)
    in_block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = asked.withColumn("qb", in_block("q", q_blocks)).withColumn("rb", all_of(r_blocks))
    right = picked.withColumn("rb", in_block(row_id, r_blocks)).withColumn("qb", all_of(q_blocks))

    def meet(q: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        got = list(_scored(iter([own]), q["q"].to_numpy(), _unit(q["v"], dim), names, k, least)) if len(q) else []
        return pd.concat(got, ignore_index=True) if got else pd.DataFrame({c: [] for c in ("query_id", *names, "cosine")})

    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(meet, schema)


def top_k(found: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def cosine_top_k(rows: DataFrame, row_id: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int, least: float | None = None) -> DataFrame:
    """The k best rows of each query; ``least`` applies after the cut, so there may be fewer."""
    best = top_k(cosine_candidates(rows, row_id, vector, queries, query_id, query_vector, k), ["query_id"], [F.desc("cosine"), row_id], k)
    return best.filter(F.col("cosine") >= least) if least is not None else best


def best_per_parent(rows: DataFrame, row_id: str, vector: str, parent: str, queries: DataFrame, query_id: str, query_vector: str, k: int) -> DataFrame:
    """The best row of each parent, then the k best parents of each query."""
    found = cosine_candidates(rows, row_id, vector, queries, query_id, query_vector, 1, parent=parent)
    one = top_k(found, ["query_id", parent], [F.desc("cosine"), row_id], 1).drop("rank")
    return top_k(one, ["query_id"], [F.desc("cosine"), parent], k)


def two_stage_top_k(rows: DataFrame, row_id: str, vector: str, weight: str, queries: DataFrame, query_id: str, query_vector: str, k: int, least: float) -> DataFrame:
    """Rows at least so similar; of these the max(20, 3 k) most similar, and of these the k heaviest."""
    near = cosine_candidates(rows, row_id, vector, queries, query_id, query_vector, max(20, 3 * k), least)
    first = top_k(near, ["query_id"], [F.desc("cosine"), row_id], max(20, 3 * k)).drop("rank")
    return top_k(first.join(rows.select(row_id, weight), row_id), ["query_id"], [F.desc(weight), F.desc("cosine"), row_id], k)


def multi_query(rows: DataFrame, row_id: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, owner: str, each: int, cap: int) -> DataFrame:
    """Several queries of one owner: the best of each query but the row it is itself, then each row's best query, and ``cap`` rows an owner."""
    others = cosine_candidates(rows, row_id, vector, queries, query_id, query_vector, each + 1).filter(F.col(row_id) != F.col("query_id"))
    hits = top_k(others, ["query_id"], [F.desc("cosine"), row_id], each).drop("rank")
    owned = hits.join(queries.select(F.col(query_id).alias("query_id"), owner), "query_id")
    one = top_k(owned, [owner, row_id], [F.desc("cosine"), "query_id"], 1).drop("rank")
    return top_k(one, [owner], [F.desc("cosine"), row_id], cap)


def centroids(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector of each key at length 1: sums over vectors of the key's largest dimension, divided by all its rows.

    Tasks add up vectors before the shuffle, so a key sends a row a batch, of any number of vectors.
    """
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}[key]
    sized = rows.filter(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))

    def add(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for value, own in part.groupby(key, sort=False, dropna=False):
            dim = max(own["v"].map(len))
            same = own["v"][own["v"].map(len) == dim]
            out.append((value, int(own["n"].sum()), np.nansum(np.stack(same.to_numpy()).astype(float), axis=0)))
        values, counts, sums = zip(*out, strict=True)
        return pd.DataFrame({key: pd.Series(values, dtype=object), "n": counts, "v": list(sums)})

    schema = f"`{key}` {kind}, n long, v array<double>"
    partial = sized.mapInPandas(lambda parts: (add(p.assign(n=1)) for p in parts if len(p)), schema)
    whole = partial.groupBy(key).applyInPandas(add, schema)
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    mean = F.transform("v", lambda x: x / F.col("n"))
    return whole.select(key, "n", mean.alias("v")).select(key, "n", F.when(size > 0, F.transform("v", lambda x: x / size)).otherwise(F.col("v")).alias("centroid"))


def duplicate_band(score):
    """Whether a belief repeats another: from 0.88 it does, from 0.80 it is judged once more."""
    return F.when(score >= 0.88, "duplicate").when(score >= 0.80, "rerank").otherwise("new")
