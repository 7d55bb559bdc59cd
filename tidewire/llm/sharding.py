"""Sharding by a permutation: every row has a global row number, and a keyed permutation of the numbers tells its shard and slot.

Rows are sorted by ranges of their key; the numbers of rows of the ranges, one number a range, give each row its global number without
a single task that sees all rows. A Feistel network permutes the numbers of the next power of two, and a number that lands outside
is permuted again until it lands inside (cycle walking), which keeps it a permutation. With p the permuted number, the shard
is p mod shards and the slot p div shards: shards differ by one row at most, slots have no gaps. ``place_of`` and ``row_at``
compute both ways from numbers alone, so a reader can seek to any slot, and the same seed gives the same shuffle on any cluster.

Equal texts are spread like any other rows, so a text with very many copies fills no shard.

Defined results: null text has no bytes; rows with a null id come first; rows that repeat an id are ordered by size, text digest,
then by where they were read; an empty table gives an empty result; all other columns of ``sharded``'s input come back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import partitions
from tidewire.session import cut

SHARDS, SEED, ROUNDS, OVERHEAD = 40, "shards", 8, 16
ROW_BITS = 33  # of monotonically_increasing_id


def round_keys(seed: str = SEED, rounds: int = ROUNDS) -> list[tuple[int, int, int, int]]:
    """Two odd multipliers below 2**31 and two addends below 2**61 for each round."""
    out = []
    for k in range(rounds):
        h = hashlib.blake2b(f"{seed}:{k}".encode(), digest_size=32).digest()
        a, b, c, d = (int.from_bytes(h[i : i + 8], "little") for i in range(0, 32, 8))
        out.append((a % 2**31 | 1 << 30 | 1, b % 2**61, c % 2**31 | 1 << 30 | 1, d % 2**61))
    return out


class Permutation:
    """A keyed permutation of 0 to n - 1; n is below 2**62, so that no step leaves 63 bits."""

    def __init__(self, n: int, seed: str = SEED, rounds: int = ROUNDS):
        if n >= 1 << 62 or rounds % 2:
            raise ValueError("at most 2**62 - 1 rows and an even number of rounds")
        self.n, self.keys = n, round_keys(seed, rounds)
        bits = max(2, (n - 1).bit_length())
        self.low = bits // 2
        self.high = bits - self.low

    @staticmethod
    def _scramble(x: np.ndarray, key: tuple[int, int, int, int]) -> np.ndarray:
        return (((x * key[0] + key[1]) >> 16) & (2**31 - 1)) * key[2] + key[3] >> 20

    def _network(self, x: np.ndarray) -> np.ndarray:
        left, right, wide, narrow = x >> self.low, x & ((1 << self.low) - 1), self.high, self.low
        for key in self.keys:
            left, right, wide, narrow = right, left ^ (self._scramble(right, key) & ((1 << wide) - 1)), narrow, wide
        return left << self.low | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right, wide, narrow = x >> self.low, x & ((1 << self.low) - 1), self.high, self.low
        for key in reversed(self.keys):
            left, right, wide, narrow = right ^ (self._scramble(left, key) & ((1 << narrow) - 1)), left, narrow, wide
        return left << self.low | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x, np.int64))
        outside = np.flatnonzero(x >= self.n)
        while len(outside):
            x[outside] = step(x[outside])
            outside = outside[x[outside] >= self.n]
        return x

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self._network)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self._back)


def place_of(row: np.ndarray, n: int, shards: int = SHARDS, seed: str = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of global row numbers of n rows."""
    p = Permutation(n, seed).forward(row)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, seed: str = SEED) -> np.ndarray:
    """The global row number that is at a slot of a shard."""
    return Permutation(n, seed).inverse(np.asarray(slot, np.int64) * shards + shard)


def numbered(rows: DataFrame, order: list[str], name: str = "row") -> tuple[DataFrame, int]:
    """The rows with their global number in the order of the given columns, and how many there are. Ties are ordered by where they
    were read, so a key that a third of all rows share is split over ranges like any other."""
    spark = rows.sparkSession
    read, place = (f"{'_'.join(rows.columns)}_{x}" for x in ("read", "place"))
    ranged = rows.withColumn(read, F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order, read).sortWithinPartitions(*order, read)
    held = cut(ranged.drop(read).withColumn(place, F.monotonically_increasing_id()))  # ranges stay what they were counted as
    found = held.groupBy(F.shiftright(place, ROW_BITS).alias("range")).count().collect()  # a number a range
    counts = np.zeros(max((r["range"] for r in found), default=-1) + 1, np.int64)
    for r in found:
        counts[r["range"]] = r["count"]
    before = np.cumsum(counts) - counts

    @F.pandas_udf("long")
    def number(at: pd.Series) -> pd.Series:
        at = at.to_numpy(np.int64)
        return pd.Series(before[at >> ROW_BITS] + (at & ((1 << ROW_BITS) - 1)))

    return held.withColumn(name, number(place)).drop(place), int(counts.sum())


def sharded(rows: DataFrame, order: list[str], shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """The rows with ``shard`` and ``slot`` (columns of these names are replaced)."""
    name = f"{'_'.join(rows.columns)}_row"
    all_rows, n = numbered(rows.drop("shard", "slot"), order, name)

    @F.pandas_udf("long")
    def permuted(row: pd.Series) -> pd.Series:
        return pd.Series(Permutation(n, seed).forward(row.to_numpy(np.int64)))

    p = permuted(name)
    return all_rows.withColumn(name, p).withColumns({"shard": F.pmod(name, F.lit(shards)).cast("int"), "slot": F.expr(f"`{name}` div {shards}")}).drop(name)


def write_shards(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Sharded rows as Parquet, a folder a shard; a shard's files are ranges of its slots, in their order."""
    dealt = rows.repartitionByRange(files or partitions(rows.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = cut(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    placed = sharded(narrow, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _network_sql(source: str, kept: str) -> str:
    """A select of ``kept`` and x: the network over column x of ``source``, which also has high and low."""
    q = f"SELECT {kept}, high, low, x >> low AS l, x & ((1::BIGINT << low) - 1) AS r FROM {source}"
    wide, narrow = "high", "low"
    for a, b, c, d in round_keys():
        f = f"(((((r * {a} + {b}) >> 16) & 2147483647) * {c} + {d}) >> 20) & ((1::BIGINT << {wide}) - 1)"
        q, wide, narrow = f"SELECT {kept}, high, low, r AS l, xor(l, {f}) AS r FROM ({q})", narrow, wide
    return f"SELECT {kept}, high, low, (l << low) | r AS x FROM ({q})"


#: crc32 by a table of 256 entries, computed from its polynomial.
ORACLE = f"""
WITH RECURSIVE entries AS (SELECT list(v ORDER BY i) AS es FROM (SELECT i, list_reduce([i] || [0 FOR x IN range(8)], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS v FROM range(256) t(i))),
bs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS nb FROM documents),
d AS (SELECT doc_id, CAST(nb + {OVERHEAD} AS BIGINT) AS size,
  xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(range(nb), lambda i: CAST('0x' || substring(h, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(es[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32 FROM bs, entries),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS nr, count(*) OVER () AS total FROM d),
w AS (SELECT nr, nr AS x, total, bits // 2 AS low, bits - bits // 2 AS high FROM (SELECT *, greatest(2, CASE WHEN total > 1 THEN length(bin(total - 1)) ELSE 0 END)::INT AS bits FROM n)),
walk AS (SELECT * FROM ({_network_sql("w", "nr, total")}) UNION ALL SELECT * FROM ({_network_sql("(SELECT * FROM walk WHERE x >= total)", "nr, total")}))
SELECT n.doc_id, n.size, n.text_crc32, 'rows' AS law, CAST(x % {SHARDS} AS INT) AS shard, CAST(x // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM n JOIN walk ON walk.nr = n.nr AND walk.x < walk.total
"""
