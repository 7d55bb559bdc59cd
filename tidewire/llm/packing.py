"""Sequence packing by patterns: non-negative least squares over patterns of few documents.

Documents are tokenised, closed with an end id and cut into pieces of at most ``size`` ids, the first of which may
be shorter. Full pieces are sequences of their own. The histogram of the other lengths, at most size - 1
numbers, is all that the driver sees: patterns of two or three lengths that fill a sequence are enumerated, their
repeat counts are fitted by non-negative least squares, rounded down to what the histogram has, and the residual
is packed best fit on the histogram. Every length then has a table of slots, ranges of ranks that belong
to a place in a run of sequences; a piece finds its slot by its rank among pieces of its length. Ranks are
dealt by (length, salt), so that a length which very many pieces have is spread over many tasks.

Ids are those of the tokenizers file; the tiktoken file of the same vocabulary gives them in a fifth of the time.

Defined results: null text is empty, that is, the end id alone; rows that repeat an id are packed each; a null id
is kept; empty tables give empty results; other columns are left alone.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import partitions
from tidewire.session import cut

SIZE, END, SLACK, SPECIAL = 2048, 0, 8, {"<|endoftext|>": 50256}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str):
    """A tiktoken encoding of the vocabulary; strings of special tokens in a text are those tokens, as by default in tokenizers."""
    if vocabulary not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _ENCODERS[vocabulary]


def pieces(documents: DataFrame, size: int = SIZE, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, piece, start, length and the CRC of the ids of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            out: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(enc.encode_to_numpy(text.as_py() or "", allowed_special="all").astype("<u4"), np.uint32(END))
                first = len(ids) % size or size
                ends = [min(first, len(ids)), *range(first + size, len(ids) + 1, size)]
                at = 0
                for k, e in enumerate(ends):
                    crc = zlib.crc32(ids[at:e].tobytes())
                    out.append((i, k, at, e - at, crc, zlib.crc32(f"{i} {k} {crc}".encode())))
                    at = e
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


# ------------------------------------------------------------------ the plan, from the histogram alone


def patterns(lengths: np.ndarray, size: int, widest: int = 3) -> np.ndarray:
    """Patterns of one to three of the given lengths as rows of places in ``lengths`` (-1: none), none of which has room for
    a longer last member."""
    n = len(lengths)
    out = []
    for i in range(n):
        room = size - lengths[i]
        j = np.arange(i + 1)
        j = j[lengths[j] <= room]
        if not len(j):
            out.append([[i, -1, -1]])
            continue
        # with two, the largest that fits; with three, each second with the largest third that fits
        out.append([[i, j[-1], -1]])
        if widest > 2:
            third = np.searchsorted(lengths, room - lengths[j], "right") - 1
            third = np.minimum(third, j)
            ok = third >= 0
            out.append(np.stack([np.full(ok.sum(), i), j[ok], third[ok]], 1))
    return np.unique(np.concatenate([np.asarray(x).reshape(-1, 3) for x in out]), axis=0) if out else np.empty((0, 3), np.int64)


def fit_repeats(pattern: np.ndarray, lengths: np.ndarray, counts: np.ndarray, size: int, rounds: int = 60) -> np.ndarray:
    """Non-negative repeat counts whose use of each length is near ``counts`` in least squares; unused room costs extra.

    Projected gradient steps, accelerated, with the diagonal of the normal matrix as scale.
    """
    present = pattern >= 0
    where = np.where(present, pattern, 0)
    waste = (size - (lengths[where] * present).sum(1)) / size
    weight = 1 / np.sqrt(np.maximum(counts, 1.0))
    goal = counts * weight
    n = len(lengths)

    def used(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(where[:, k], x * present[:, k], n) for k in range(pattern.shape[1])) * weight

    def back(y: np.ndarray) -> np.ndarray:
        return ((weight * y)[where] * present).sum(1)

    scale = np.maximum(back(weight * np.bincount(where.ravel(), present.ravel(), n)), 1e-12)
    x = z = np.zeros(len(pattern))
    t = 1.0
    for _ in range(rounds):
        step = (back(used(z) - goal) + 0.5 * waste) / scale
        new = np.maximum(z - step, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[pd.DataFrame, int]:
    """Slots (length, from_rank, sequence, offset; a slot's run ends where the next one of its length begins) and the number of sequences."""
    lengths = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[x] for x in lengths], np.int64)
    taken = np.zeros(len(lengths), np.int64)
    slots: list[tuple[int, int, int, int]] = []
    sequences = 0

    def place(members: list[int], repeat: int) -> None:
        nonlocal sequences
        at = 0
        for i in members:
            slots.append((int(lengths[i]), int(taken[i]), sequences, at))
            taken[i] += repeat
            left[i] -= repeat
            at += int(lengths[i])
        sequences += repeat

    if len(lengths):
        p = patterns(lengths, size)
        room = size - (np.where(p >= 0, lengths[np.maximum(p, 0)], 0)).sum(1)
        p, room = p[room <= SLACK], room[room <= SLACK]
        x = fit_repeats(p, lengths, left.astype(float), size)
        good = np.flatnonzero(x >= 1)
        for k in good[np.lexsort((-x[good], room[good]))]:
            members = [int(i) for i in p[k] if i >= 0]
            most = min(int(left[i]) // members.count(i) for i in set(members))
            if repeat := min(int(x[k]), most):
                place(members, repeat)
        while left.any():  # best fit: the longest left, then again and again the longest that still fits
            i = int(np.flatnonzero(left)[-1])
            members, free = [i], size - int(lengths[i])
            have = left.copy()
            have[i] -= 1
            while free > 0:
                fits = np.flatnonzero(have[: np.searchsorted(lengths, free, "right")])
                if not len(fits):
                    break
                pair = _pair(lengths, have, free) if len(fits) > 1 else None
                chosen = pair if pair else [int(fits[-1])]
                for j in chosen:
                    have[j] -= 1
                    members.append(j)
                    free -= int(lengths[j])
            place(members, max(1, min(int(left[i]) // members.count(i) for i in set(members))))
    return pd.DataFrame(slots, columns=["length", "from_rank", "sequence", "at"]).astype("int64"), sequences


def _pair(lengths: np.ndarray, have: np.ndarray, free: int) -> list[int] | None:
    """Two lengths that fill ``free`` better than any single one, if there are."""
    there = np.flatnonzero(have[: np.searchsorted(lengths, free, "right")])
    own = lengths[there]
    if own[-1] == free:
        return None
    other = np.searchsorted(own, free - own, "right") - 1
    same = (other == np.arange(len(own))) & (have[there] < 2)
    other = np.where(same, other - 1, other)
    total = np.where(other >= 0, own + own[np.maximum(other, 0)], 0)
    best = int(total.argmax())
    return [int(there[best]), int(there[other[best]])] if total[best] > own[-1] else None


# ------------------------------------------------------------------ applying it


def pack(cut_pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Give every piece a sequence_id and an offset in it."""
    spark = cut_pieces.sparkSession
    cut_pieces = cut(cut_pieces)
    salts = 4 * partitions(spark)
    short = cut_pieces.filter(F.col("length") < size).withColumn("cell", F.pmod("salt", F.lit(salts)).cast("int"))
    sizes = short.groupBy("length", "cell").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, sequences = plan(histogram, size)
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    own = Window.partitionBy("length", "cell").orderBy("salt", "doc_id", "piece")
    ranked = short.withColumn("rank", F.row_number().over(own) - 1).join(begins, ["length", "cell"]).withColumn("rank", F.col("rank") + F.col("begin"))
    table = spark.sparkContext.broadcast({int(k): g.to_numpy() for k, g in slots.sort_values(["length", "from_rank"]).groupby("length")})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own, rows = table.value[int(n)], length == n
                at = np.searchsorted(own[:, 1], rank[rows], "right") - 1
                sequence[rows] = own[at, 2] + rank[rows] - own[at, 1]
                offset[rows] = own[at, 3]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = ranked.select(*columns, "rank").mapInArrow(find, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    full = cut_pieces.filter(F.col("length") >= size).select(*columns, (F.lit(sequences) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
