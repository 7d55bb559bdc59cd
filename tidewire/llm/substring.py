"""Removal of passages that repeat, by a log-structured index of window fingerprints.

Windows of ``window`` words are fingerprinted by winnowing: the least hash among a window's ``gram``-word grams, so equal
windows have equal fingerprints, and a long text has few. The index holds the texts it has seen as chunks, and runs: sorted
immutable tables of (fingerprint, chunk). ``append`` writes a batch as a run of its own and merge-joins it with the earlier runs,
without a shuffle: windows whose fingerprint neither history nor the rest of the batch has occur nowhere else. The others, those of
earlier batches included, are verified over all their words, by two hashes of about 60 and 32 bits; windows with an equal
are repeats. A word counts by a hash of 64 bits. The answer names what repeats in the batch and what the batch repeats in history. More than ``MOST_RUNS`` runs are
compacted into one; answers stand on checkpoints, so neither compaction nor ``drop`` takes them away.

Defined results: null text has no words; windows of repeated rows count as occurrences elsewhere; rows with a null id take part
and come back with it; empty tables give empty results; other columns are left alone. ``kept_sha256`` is of the kept words
joined by one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import repeats
from tidewire.llm.chunks import BucketedTable, chunked, each, joined
from tidewire.llm.common import CHECK_BASE, U, run_hash, slices, string_buffers, word_hash, word_spans
from tidewire.session import cut

WINDOW, GRAM, BATCHES, MOST_RUNS = 35, 8, 2, 4
TOKEN_BYTES = 7
SPANS = "chunk long, spans binary"


class Windows:
    """The windows of a run of texts: index of the first word, text, and place of the fingerprint."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
        self.start, self.end, self.first = word_spans(data, offsets)
        self.words = word_hash(data, self.start, self.end)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        at = np.arange(len(text))
        self.at = at[at + window <= self.first[1:][text]] if len(text) else at
        self.text = text[self.at]
        self.grams = run_hash(self.words, gram)
        self.place = repeats.window_minima(self.grams, window - gram + 1)[self.at]


def fingerprints(texts: DataFrame, at: int, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The fingerprints that winnowing selects in each chunk, once each, and whether the chunk has one twice; the text is column ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, rows in each(b):
                w = Windows(*string_buffers(rows.column(at)), window, gram)
                begin, _ = repeats.anchored(w.place, w.at, w.text)
                fp, times = np.unique(w.grams[w.place[begin]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), chunk)), pa.array(times > 1)], names=["fp", "chunk", "twice"])

    return texts.mapInArrow(run, "fp long, chunk long, twice boolean")


class _Wanted:
    """The windows of a chunk whose fingerprints are looked at, with their hashes."""

    def __init__(self, rows: pa.RecordBatch, at: int, fps: np.ndarray, window: int, gram: int, buckets: int):
        w = Windows(*string_buffers(rows.column(at)), window, gram)
        pick = np.isin(w.grams[w.place], fps.view(U)) if len(w.at) else np.empty(0, bool)
        self.at, self.text, self.first = w.at[pick], w.text[pick], w.first
        some = len(self.at) > 0
        token = run_hash(w.words, window)[self.at] if some else np.empty(0, U)
        check = run_hash(w.words, window, CHECK_BASE)[self.at] >> U(32) if some else np.empty(0, U)
        self.dealt = repeats.Dealt(token, check.astype(np.uint32), buckets)


def _fps(right: pa.Table) -> np.ndarray:
    return np.unique(np.frombuffer(joined(right.column("fps")), np.int64))


def _tokens(at: int, window: int, gram: int, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if len(right):
            for chunk, rows in each(left):
                parts.append(_Wanted(rows, at, _fps(right), window, gram, buckets).dealt.rows(chunk, TOKEN_BYTES))
        empty = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("token", pa.binary()), ("check", pa.binary()), ("times", pa.binary())])
        return pa.Table.from_batches([p.cast(empty) for p in parts], empty)

    return run


def _spans(at: int, window: int, gram: int, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """(row, first word, word after the last) of what repeated windows cover."""
        out: dict[str, list] = {"chunk": [], "spans": []}
        answers = right.filter(pa.compute.is_valid(right.column("states")))
        if len(answers):
            for chunk, rows in each(left):
                w = _Wanted(rows, at, _fps(right), window, gram, buckets)
                again = w.dealt.states(answers) > repeats.ALONE
                out["chunk"].append(chunk)
                out["spans"].append(_pressed(w.text[again], w.at[again] - w.first[w.text[again]], window))
        return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "spans": pa.array(out["spans"], pa.binary())})

    return run


def _pressed(text: np.ndarray, word: np.ndarray, window: int) -> bytes:
    spans = np.stack((text, word, word + window), 1).astype("<i8")
    return repeats.press(_union(spans).tobytes())


def _union(spans: np.ndarray) -> np.ndarray:
    """Ranges (row, start, end) joined where they overlap or touch."""
    big = np.int64(1) << 40
    start, end = repeats.merged(spans[:, 0] * big + spans[:, 1], spans[:, 0] * big + spans[:, 2])
    return np.stack((start // big, start % big, end - start // big * big), 1)


class FingerprintIndex:
    """Texts seen so far (chunks, with the text in column ``at``) and runs of their fingerprints in the shared folder."""

    def __init__(self, spark: SparkSession, at: int, window: int = WINDOW, gram: int = GRAM, base: str | None = None):
        self.spark, self.at, self.window, self.gram, self.base = spark, at, window, gram, base
        self.runs: list[BucketedTable] = []
        self.seen: list[DataFrame] = []

    def _write(self, rows: DataFrame) -> BucketedTable:
        run = BucketedTable(self.spark, "fingerprints", "fp", self.base)
        try:
            run.write(rows.repartition(run.buckets, "fp"))
        except Exception:
            run.drop()
            raise
        return run

    def texts(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.seen)

    def append(self, texts: DataFrame) -> DataFrame:
        """Add a batch of chunks, whose numbers must be new. Returns (chunk, spans) of all chunks, of this batch and earlier ones, with
        windows that this batch makes repeats."""
        earlier, new = [r.read() for r in self.runs], self._write(fingerprints(texts, self.at, self.window, self.gram))
        self.runs.append(new)
        self.seen.append(texts)
        batch = new.read()
        twice = batch.groupBy("fp").agg(F.count("*").alias("n"), F.bool_or("twice").alias("twice")).filter("n > 1 OR twice").select("fp")
        met = [batch.join(twice.hint("merge"), "fp", "left_semi")]
        for run in earlier:
            met += [batch.join(run.select("fp").hint("merge"), "fp", "left_semi"), run.join(batch.select("fp").hint("merge"), "fp", "left_semi")]
        looked_at = cut(reduce(DataFrame.unionByName, [m.select("chunk", "fp") for m in met]).mapInArrow(_gathered, "chunk long, fps binary"))
        if len(self.runs) > MOST_RUNS:
            self.compact()
        return self._verified(looked_at)

    def _verified(self, looked_at: DataFrame) -> DataFrame:
        buckets = repeats.buckets_of(looked_at)
        dealt = self.texts().groupBy("chunk")  # the shuffle of the texts serves both joins
        sent = dealt.cogroup(looked_at.groupBy("chunk")).applyInArrow(_tokens(self.at, self.window, self.gram, buckets), repeats.PACKED)
        told = repeats.answered(sent, TOKEN_BYTES).withColumn("fps", F.lit(None).cast("binary"))
        told = told.unionByName(looked_at.withColumns({"bucket": F.lit(None).cast("int"), "states": F.lit(None).cast("binary")}))
        return dealt.cogroup(told.groupBy("chunk")).applyInArrow(_spans(self.at, self.window, self.gram, buckets), SPANS)

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) > 1:
            merged, old = self._write(reduce(DataFrame.unionByName, [r.read() for r in self.runs])), self.runs
            self.runs = [merged]
            for run in old:
                run.drop()

    def drop(self) -> None:
        for run in self.runs:
            run.drop()
        self.runs = []


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, fp) rows with the fingerprints of a chunk together, as far as they come together."""
    for b in batches:
        chunk, fp = b.column("chunk").to_numpy(), b.column("fp").to_numpy()
        order = np.argsort(chunk, kind="stable")
        chunk, fp = chunk[order], fp[order]
        own, begin = np.unique(chunk, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(slices(fp, np.append(begin, len(fp))), pa.binary())], names=["chunk", "fps"])


def _applied(names: list[str], edit):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for _, rows in each(left):
            raw = [np.frombuffer(repeats.unpress(x), "<i8").reshape(-1, 3) for x in right.column("spans").to_pylist()]
            spans = _union(np.concatenate(raw)) if raw else np.empty((0, 3), np.int64)
            bounds = np.searchsorted(spans[:, 0], np.arange(len(rows) + 1))
            columns = edit(rows, [spans[a:b, 1:].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            parts.append(pa.RecordBatch.from_arrays(columns, names=names))
        return pa.Table.from_batches(parts)

    return run


def _text(v: pa.Scalar) -> bytes:
    return v.as_buffer().to_pybytes() if v.is_valid else b""


def kept_words(raw: bytes, spans: list) -> tuple[int, list[bytes]]:
    """Number of words, and the words outside the spans."""
    words = raw.split()
    out, at = [], 0
    for a, b in spans:
        out += words[at:a]
        at = b
    return len(words), out + words[at:]


def deduplicated(documents: DataFrame, edit, schema, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """``edit(rows, spans)`` of every chunk: its columns (by place) and, for each row, the word ranges to remove give the columns of
    ``schema``. The chunks are appended to an index in ``batches``; the index is dropped once used."""
    at = documents.columns.index("text")
    texts = chunked(documents)
    index = FingerprintIndex(documents.sparkSession, at, window, gram)
    try:
        found = [index.append(texts.filter(F.pmod(F.xxhash64("chunk"), F.lit(batches)) == k)) for k in range(batches)]
    finally:
        index.drop()
    spans = reduce(DataFrame.unionByName, found)
    return index.texts().groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(_applied(schema.names, edit), schema)


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    def edit(rows: pa.RecordBatch, spans: list) -> list[pa.Array]:
        done = [kept_words(_text(t), s) for t, s in zip(rows.column(1), spans, strict=True)]
        return [rows.column(0), pa.array([n for n, _ in done], pa.int64()), pa.array([n - len(k) for n, k in done], pa.int64()), pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for _, k in done], pa.string())]

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return deduplicated(documents, edit, schema)


def without_repeats(documents: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """The documents with repeated passages taken out of their text, and n_chars to match; a text without any stays as it is, blanks
    included, and null stays null. All columns are kept."""
    at = documents.columns.index("text")
    length = documents.columns.index("n_chars") if "n_chars" in documents.columns else None

    def edit(rows: pa.RecordBatch, spans: list) -> list[pa.Array]:
        columns = list(rows.columns)
        changed = {k: b" ".join(kept_words(_text(columns[at][k]), s)[1]).decode("utf-8", "replace") for k, s in enumerate(spans) if s}
        columns[at] = pa.array([changed.get(k, x) for k, x in enumerate(columns[at].to_pylist())], pa.string())
        if length is not None:
            columns[length] = pa.array([len(changed[k]) if k in changed else x for k, x in enumerate(columns[length].to_pylist())], columns[length].type)
        return columns

    return deduplicated(documents.withColumn("text", F.col("text").cast("string")), edit, documents.schema, window, batches=batches)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest([{'i': i, 's': sha1(array_to_string(ws[i:i + 34], ' '))} FOR i IN range(1, len(ws) - 33)], recursive := true) FROM d WHERE len(ws) >= 35),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY s) > 1),
c AS (SELECT doc_id, list_distinct(flatten(list([x FOR x IN range(i, i + 35)]))) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE [x FOR x, i IN ws IF NOT list_contains(gone, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id
"""
