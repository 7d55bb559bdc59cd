"""Helpers shared by the corpus operators: hashing of words and bytes in NumPy, Arrow batches, checkpoints.

Text is handled as UTF-8 bytes. Spark hands a task Arrow batches; ``text_chunks`` cuts
them into runs of a few MB, and all hashes of a run are computed by vector operations.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession

U = np.uint64
CHUNK_BYTES, CHUNK_ROWS = 2 << 20, 60_000


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path in the shared folder, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


# --------------------------------------------------------------------------- hashing

_TABLE = np.random.default_rng(20240601).integers(0, 2**64, 256, dtype=np.uint64) | U(1)
BYTE_BASE, WORD_BASE, CHECK_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _inverse(base: int) -> int:
    x = base
    for _ in range(6):
        x = x * (2 - base * x) % (1 << 64)
    return x


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of an odd base (or of its inverse) modulo 2**64."""
    have = _POWERS.get((base, inverse))
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        b = _inverse(base) if inverse else base
        have = np.empty(size, U)
        have[0], k = 1, 1
        while k < size:
            have[k : 2 * k] = have[:k] * U(pow(b, k, 1 << 64))
            k *= 2
        _POWERS[base, inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the output."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences identify byte strings, see ``string_hash``."""
    c = np.zeros(len(data) + 1, U)
    np.cumsum(_TABLE[data] * powers(BYTE_BASE, len(data)), out=c[1:])
    return c


def string_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each short byte range (tens of bytes); equal strings get equal hashes wherever they are. It is a polynomial modulo 2**64,
    which long strings can be made to cancel out in; words, which may be long, have ``word_hash``."""
    return mix((sums[end] - sums[start]) * powers(BYTE_BASE, len(sums), True)[start] + (end - start).astype(U))


LANE = 8
_LANE_KEYS = np.random.default_rng(20240602).integers(0, 2**64, 1 << 10, dtype=np.uint64)


def lane_keys(index: np.ndarray) -> np.ndarray:
    """A key for the place of each lane in its word; places far into very long words are mixed from two."""
    low, high = index & 1023, index >> 10
    keys = _LANE_KEYS[low]
    return keys if not high.any() else mix(keys + high.astype(U) * U(BYTE_BASE))


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal ranges get equal hashes wherever they are.

    A range is read as lanes of 8 bytes. Each lane is scrambled with a key of its place before the lanes are added up, so no arrangement
    of bytes cancels out; ranges of up to 8 bytes differ in their hash if they differ at all in length and bytes but by chance (2**-64).
    """
    if not len(start):
        return np.empty(0, U)
    padded = np.concatenate((data, np.zeros(LANE, np.uint8)))
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    count = np.maximum(1, (size + LANE - 1) // LANE)
    first = np.cumsum(count) - count
    longest = int(count.max())
    if longest == 1:
        at, inside = start, np.zeros(len(start), np.int64)
    else:
        inside = np.arange(int(count.sum())) - np.repeat(first, count)
        at = np.repeat(start, count) + LANE * inside
    left = np.minimum(LANE, (size if longest == 1 else np.repeat(size, count)) - LANE * inside)
    value = lanes[at] & (U(0xFFFFFFFFFFFFFFFF) >> (U(8) * (U(LANE) - np.maximum(left, 1).astype(U))))
    value = mix(value ^ lane_keys(inside))
    total = value if longest == 1 else np.add.reduceat(value, first)
    return mix(total + size.astype(U) * U(BYTE_BASE))


def chained(a: np.ndarray, b: np.ndarray, seed: int = WORD_BASE) -> np.ndarray:
    """Hash of two hashes in their order."""
    return mix(a * U(seed) + b)


def run_hash(items: np.ndarray, k: int, base: int = WORD_BASE) -> np.ndarray:
    """64-bit hash of every k consecutive items: runs of 1, 2, 4, ... are chained, and those that k is made of."""
    if len(items) < k:
        return np.empty(0, U)
    out, at, size, power = None, 0, 1, items
    while True:
        if k & size:
            out = power[: len(items) - k + 1] if out is None else chained(out, power[at : at + len(out)], base)
            at += size
        if size * 2 > k:
            return out if k > 1 else mix(out * U(base))
        power = chained(power[:-size], power[size:], base)
        size *= 2


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word ``[^\\x20\\x09-\\x0D]+`` and, per text, the index of its first word (one entry more)."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        first[edge] |= inside[edge]
        last[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


# --------------------------------------------------------------------------- Arrow


def give_back() -> None:
    """Memory that a task has freed goes back to the system, as its worker lives on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each value begins in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about ``most`` bytes each, or one longer row."""
    data, off = string_buffers(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = min(a + CHUNK_ROWS, max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1))
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def slices(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The bytes of values[bounds[i]:bounds[i + 1]] for each i."""
    return [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
