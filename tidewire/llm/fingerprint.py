"""Document fingerprints by consistent weighted sampling.

Terms are words, weighted by how often they occur. For sample k a term w of weight S draws r and c from
Gamma(2, 1) and b from [0, 1), all functions of (w, k) alone; with t = floor(ln S / r + b) it competes with
ln c - r (t - b) - r, and the term with the least value gives the pair (w, t) as the sample. Two texts agree
on a sample with a probability equal to the generalised Jaccard similarity of their weights. A sample is
kept as 16 bits, so unlike samples agree by chance once in 65,536.

Defined results: null text is empty; a text without words has the fingerprint of zeros, like another such
text (1) and unlike any other (0); rows with a null id follow all others, in the order of a hash of their text, downwards; rows that
repeat an id (or, without one, a hash) follow each other by text. Equal texts have equal fingerprints. An empty table gives an
empty result, and one row succeeds itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import U, partitions, text_chunks, word_hash, word_spans

SAMPLES, STEP = 64, 1 << 13
FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(4242).integers(0, 2**64, (2, n), dtype=np.uint64) | U(1)


def _bits(terms: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    x = terms[:, None] ^ seeds[None, :]
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    return x


def _uniform(x: np.ndarray, shift: int, bits: int) -> np.ndarray:
    """A number in (0, 1) from some of the bits."""
    u = ((x >> U(shift)) & U((1 << bits) - 1)).astype(np.float32)
    u += np.float32(0.5)
    u *= np.float32(2.0**-bits)
    return u


def _gamma(x: np.ndarray) -> np.ndarray:
    """A Gamma(2, 1) number, the sum of two exponential ones."""
    u = _uniform(x, 40, 24)
    u *= _uniform(x, 16, 24)
    np.log(u, out=u)
    return np.negative(u, out=u)


def _draws(terms: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, b and ln c of every term and sample."""
    s = _seeds(samples)
    x = _bits(terms, s[0])
    r, b = _gamma(x), _uniform(x, 0, 16)
    return r, b, np.log(_gamma(_bits(terms, s[1])))


def _samples(terms: np.ndarray, term: np.ndarray, weight: np.ndarray, samples: int) -> np.ndarray:
    """For each (term, weight) and sample: the value that competes in the upper bits and the sample in the lower ones of a
    positive double, so that the least double is the winner."""
    out = np.empty((len(term), samples), U)
    low = (terms & U(0xFFFFFFFF)) * U(0x9E3779B1)
    for lo in range(0, len(term), STEP):  # terms ascend, so a step draws for few terms
        own, heavy = term[lo : lo + STEP], weight[lo : lo + STEP]
        base = own[0]
        r, b, ln_c = _draws(terms[base : own[-1] + 1], samples)
        value = (ln_c + r * (b - np.float32(1)))[own - base]  # for weight 1, of which t is 0
        sample = np.repeat((low[own] * U(0xC2B2AE3D27D4EB4F))[:, None], samples, 1)
        more = np.flatnonzero(heavy > 1)
        at = own[more] - base
        rr, bb = r[at], b[at]
        t = np.floor(np.log(heavy[more].astype(np.float32))[:, None] / rr + bb)
        value[more] = ln_c[at] - rr * (t - bb) - rr
        sample[more] = (low[own[more]][:, None] + t.astype(np.int64).astype(U) * U(0x85EBCA6B)) * U(0xC2B2AE3D27D4EB4F)
        bits = value.view(np.uint32)
        rank = bits ^ (np.uint32(0x80000000) | (bits.view(np.int32) >> np.int32(31)).view(np.uint32))
        out[lo : lo + STEP] = ((rank.astype(U) + U(1 << 21)) << U(30)) | (sample >> U(48))
    return out.view(np.float64)


def signatures(data: np.ndarray, offsets: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """A row of 16-bit samples for each text; zeros for a text without words."""
    start, end, first = word_spans(data, offsets)
    texts = len(offsets) - 1
    out = np.zeros((texts, samples), np.uint16)
    if not len(start):
        return out
    terms, at = np.unique(word_hash(data, start, end), return_inverse=True)
    pair = np.repeat(np.arange(texts), np.diff(first)) * len(terms) + at
    pair, weight = np.unique(pair, return_counts=True)
    text = pair // len(terms)
    # a pair's samples depend on its term and weight alone, and most pairs of a run share them with others
    form, at = np.unique(pair % len(terms) * (len(start) + 1) + weight, return_inverse=True)
    drawn = _samples(terms, form // (len(start) + 1), form % (len(start) + 1), samples)
    begins = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(text)], strict=True):
        least = np.minimum.reduce(drawn[at[lo : min(hi, lo + STEP)]], axis=0)
        for k in range(lo + STEP, hi, STEP):
            np.minimum(least, np.minimum.reduce(drawn[at[k : min(hi, k + STEP)]], axis=0), out=least)
        out[text[lo]] = np.maximum((least.view(U) & U(0xFFFF)).astype(np.uint16), 1)
    return out


def of_texts(texts: list[str], samples: int = SAMPLES) -> np.ndarray:
    parts = [signatures(d, o, samples) for _, _, d, o in text_chunks(pa.array(texts, pa.large_string()), 4 << 20)]
    return np.concatenate(parts) if parts else np.zeros((0, samples), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


def hexed(rows: np.ndarray) -> list[str]:
    return [x.astype(">u2").tobytes().hex() for x in rows]


def fingerprint(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in text_chunks(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], pa.array(hexed(signatures(data, offsets, samples)))], names=["doc_id", "fingerprint"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


# ------------------------------------------------------------------ each document beside its successor


def beside_next(documents: DataFrame) -> DataFrame:
    """Rows dealt by ranges of doc_id (null: of a hash of the text, below all ids) and sorted so that each is followed by the next.

    ``bucket`` numbers the ranges; the last row of each is a guest, the first row of the range that follows (of the
    highest range, for the lowest). Only one id a range passes through the driver.
    """
    spark = documents.sparkSession
    text, ident = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    docs = documents.select(ident.alias("doc_id"), text.alias("text"), F.coalesce(ident, F.xxhash64(text)).alias("at"), ident.isNull().alias("none"))
    n = 3 * partitions(spark)
    quantiles = lambda part: sorted({int(x) for x in part.select("at").approxQuantile("at", [i / n for i in range(1, n)], 0.1 / n)})
    below, cuts = np.array(quantiles(docs.filter("none")), np.int64), np.array(quantiles(docs.filter("NOT none")), np.int64)

    @F.pandas_udf("int")
    def bucket(at: pd.Series, none: pd.Series) -> pd.Series:
        at = at.to_numpy(np.int64)
        return pd.Series(np.where(none, np.searchsorted(below, at, "right"), len(below) + 1 + np.searchsorted(cuts, at, "right")).astype(np.int32))

    with_bucket = docs.withColumn("bucket", bucket("at", "none"))
    tops = sorted((r["bucket"], r["top"]) for r in with_bucket.groupBy("bucket").agg(F.max("at").alias("top")).collect())
    size = len(below) + len(cuts) + 2
    top, host = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for i, (own, most) in enumerate(tops):
        top[own], host[own] = most, tops[(i + 1) % len(tops)][0]

    @F.pandas_udf("array<int>")
    def places(own: pd.Series, at: pd.Series) -> pd.Series:
        own = own.to_numpy()
        guest = at.to_numpy(np.int64) == top[own]
        return pd.Series([[b, -1 - int(h)] if g else [b] for b, g, h in zip(own, guest, host[own], strict=True)])

    rows = with_bucket.withColumn("place", F.explode(places("bucket", "at")))
    rows = rows.select("doc_id", "text", "at", (F.col("place") < 0).alias("guest"), F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("bucket"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc("at"), "text").drop("at")


def edit(text: str, after: str) -> str:
    h = len(text) // 2
    return text[: len(text) - h] + after[:h]


def _editor(samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []  # the last row of a batch waits for its successor

        def pieces():
            for b in batches:
                a = 0
                for lo, hi, _, _ in text_chunks(b.column("text"), 1 << 20):
                    a = hi
                    c = b.slice(lo, hi - lo)
                    yield list(zip(c.column("bucket").to_pylist(), c.column("guest").to_pylist(), c.column("doc_id").to_pylist(), c.column("text").to_pylist(), strict=True))
                if not a and len(b):
                    yield list(zip(*(b.column(k).to_pylist() for k in ("bucket", "guest", "doc_id", "text")), strict=True))

        for rows in pieces():
            rows = kept + rows
            kept = rows[-1:]
            own = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i + 1][0] == rows[i][0]]
            edited = [edit(rows[i][3], rows[i + 1][3]) for i in own]
            marks = of_texts([r[3] for r in rows] + edited, samples)  # together, as they share most terms
            marks, of_edited = marks[: len(rows)], marks[len(rows) :]
            at = np.array(own, np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([rows[i][2] for i in own], pa.int64()),
                    "n_chars": pa.array([len(rows[i][3]) for i in own], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                    "fingerprint": pa.array(hexed(marks[at]), pa.string()),
                    "edited_fingerprint": pa.array(hexed(of_edited), pa.string()),
                    "near_edited": pa.array(likeness(marks[at], of_edited)),
                    "near_next": pa.array(likeness(marks[at], marks[at + 1])),
                }
            )

    return run


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beside_next(spark.read.parquet(f"{sf_dir}/documents.parquet")).mapInArrow(_editor(SAMPLES), FINGERPRINTS)
