"""Which hashed strings of a corpus occur more than once, at a few shuffled bytes a string.

A task hashes a chunk of texts at a time and packs the distinct hashes into one binary row a bucket. Within a chunk a hash is sent
once, with how often it occurs, so that a string which very many documents share reaches its bucket once a chunk and not once a
document. The reducer of a bucket answers each row with a state for each hash, in the order sent; a chunk hashes its texts again to
know which is which, so no places are sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tidewire.llm.common import U, partitions

PACKED = "bucket int, chunk long, token binary, check binary, times binary"
ANSWERED = "chunk long, bucket int, states binary"
#: States of a hash: it occurs nowhere else, it occurs again, it occurs ``often`` times or more.
ALONE, AGAIN, OFTEN = 0, 1, 2
HOT = 4096


def buckets_of(df: DataFrame) -> int:
    return min(2 * partitions(df.sparkSession), 60_000)


def press(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def unpress(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def press_numbers(values: np.ndarray) -> bytes:
    """Whole numbers, compressed byte by byte of their steps; small where they ascend."""
    values = values.astype(np.int64)
    return press(np.diff(values, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpress_numbers(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(unpress(raw), np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(8, -1).T).view(np.int64).ravel())


class Dealt:
    """The distinct hashes of a chunk in the order in which they are sent. ``check`` is a second hash that must be equal as well."""

    def __init__(self, token: np.ndarray, check: np.ndarray | None, buckets: int):
        order = np.argsort(token, kind="stable") if check is None else np.lexsort((check, token))
        same = token[order][1:] == token[order][:-1]
        if check is not None:
            same &= check[order][1:] == check[order][:-1]
        head = np.concatenate(([True], ~same))[: len(token)]
        self.inverse = np.empty(len(token), np.int64)
        self.inverse[order] = np.cumsum(head) - 1
        first = order[head]
        begin = np.flatnonzero(head)
        self.times = np.diff(np.append(begin, len(token)))
        self.token, self.check = token[first], None if check is None else check[first]
        bucket = (self.token % U(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.bounds = np.searchsorted(bucket[self.order], np.arange(buckets + 1))
        self.buckets = buckets

    def rows(self, chunk: int, width: int) -> pa.RecordBatch:
        """A row a bucket, with ``width`` bytes of each hash (beside what the bucket tells)."""
        short = (self.token[self.order] // U(self.buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        times = np.minimum(self.times, 0xFFFF)[self.order].astype("<u2")
        check = None if self.check is None else self.check[self.order].astype("<u4")
        full = np.flatnonzero(np.diff(self.bounds))
        cuts = [(self.bounds[k], self.bounds[k + 1]) for k in full]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(full, pa.int32()),
                pa.array(np.full(len(full), chunk), pa.int64()),
                pa.array([np.ascontiguousarray(short[a:b]).tobytes() for a, b in cuts], pa.binary()),
                pa.array([None if check is None else check[a:b].tobytes() for a, b in cuts], pa.binary()),
                pa.array([press(times[a:b].tobytes()) if (times[a:b] > 1).any() else None for a, b in cuts], pa.binary()),
            ],
            names=["bucket", "chunk", "token", "check", "times"],
        )

    def states(self, answers: pa.Table) -> np.ndarray:
        """The state of every hash given, from the rows that answer this chunk."""
        sent = np.zeros(len(self.token), np.uint8)
        for bucket, raw in zip(answers.column("bucket").to_pylist(), answers.column("states").to_pylist(), strict=True):
            if raw is not None:
                sent[self.bounds[bucket] : self.bounds[bucket + 1]] = np.frombuffer(unpress(raw), np.uint8)
        out = np.empty(len(self.token), np.uint8)
        out[self.order] = sent
        return out[self.inverse]


def _reducer(width: int, often: int):
    def reduce(rows: pa.Table) -> pa.Table:
        tokens = rows.column("token").to_pylist()
        lens = np.array([len(x) // width for x in tokens])
        token = np.zeros((lens.sum(), 8), np.uint8)
        token[:, :width] = np.frombuffer(b"".join(tokens), np.uint8).reshape(-1, width)
        token = token.view("<u8").ravel()
        times = np.concatenate([np.ones(n, np.int64) if x is None else np.frombuffer(unpress(x), "<u2").astype(np.int64) for n, x in zip(lens, rows.column("times").to_pylist(), strict=True)])
        checks = rows.column("check").to_pylist()
        if checks[0] is None:
            order = np.argsort(token, kind="stable")
            same = token[order][1:] == token[order][:-1]
        else:
            check = np.frombuffer(b"".join(checks), "<u4")
            order = np.lexsort((check, token))
            same = (token[order][1:] == token[order][:-1]) & (check[order][1:] == check[order][:-1])
        begin = np.flatnonzero(np.concatenate(([True], ~same)))
        total = np.add.reduceat(times[order], begin)
        state = np.empty(len(token), np.uint8)
        state[order] = np.repeat(np.where(total >= often, OFTEN, np.where(total > 1, AGAIN, ALONE)).astype(np.uint8), np.diff(np.append(begin, len(token))))
        ends = np.cumsum(lens)
        own = [(a, b) for a, b in zip(ends - lens, ends, strict=True)]
        keep = [k for k, (a, b) in enumerate(own) if state[a:b].any()]
        return pa.table(
            {
                "chunk": rows.column("chunk").take(pa.array(keep, pa.int64())),
                "bucket": rows.column("bucket").take(pa.array(keep, pa.int64())),
                "states": pa.array([press(state[slice(*own[k])].tobytes()) for k in keep], pa.binary()),
            }
        )

    return reduce


def answered(packed: DataFrame, width: int, often: int = HOT) -> DataFrame:
    """The answers of all buckets; rows whose hashes all occur nowhere else get none."""
    return packed.groupBy("bucket").applyInArrow(_reducer(width, often), ANSWERED)


#: An index goes beside the upper 40 bits of a hash, in 24 bits, so minima are taken over at most this many values at a time.
STRETCH = 1 << 24


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` values the place of the least one, the leftmost among equals.

    The upper 40 bits count, so equal runs choose equal places. Long input is read in stretches that overlap by ``width - 1``.
    """
    windows = len(values) - width + 1
    if windows < 1:
        return np.empty(0, np.int64)
    step = STRETCH - width + 1
    if windows <= step:
        return _minima(values, width)
    out = np.empty(windows, np.int64)
    for lo in range(0, windows, step):
        own = _minima(values[lo : lo + step + width - 1], width)
        out[lo : lo + len(own)] = own + lo
    return out


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    best, span = (values & ~U(0xFFFFFF)) | np.arange(n, dtype=U), 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if width > span:
        best = np.minimum(best[: n - width + 1], best[width - span :])
    return (best & U(0xFFFFFF)).astype(np.int64)


def anchored(place: np.ndarray, start: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of windows, ascending by start, that have the same place and owner."""
    if not len(place):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begin = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))))
    return begin, np.append(begin[1:], len(place)) - 1


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as sorted ranges that don't touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return start[new], end[np.append(new[1:], len(start)) - 1]
