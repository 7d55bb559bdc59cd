"""Language identification, words first: known words count by their log frequency in each language; an unseen
word falls back to its character n-grams, the longest length of which any is known, from five down to one.

The classifier is fitted on a sample bounded by ``per_language`` documents (expected) of each language, picked by
a hash of the id; all languages, words and n-grams of the sample are learned. The model holds an entry for each word or n-gram and
language that has it, so its size follows the sample, in proportion to the number of languages.
Prediction reads whole texts and nothing else.

Defined results: null text and text without a letter are ``und`` with score 0; so is all text when nothing was
learned. A row with a null id is predicted like any other and not held out. The score is the posterior of the
predicted language under equal priors; ties go to the language that sorts first. Empty tables give empty
results; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.chunks import ranges
from tidewire.llm.common import BYTE_BASE, U, give_back, mix, powers, text_chunks

PER_LANGUAGE, LONGEST, UNSEEN, BROADCAST_LANGUAGES = 3000, 5, 0.5, 100_000
CHUNK = 1 << 19  # bytes of text whose n-grams are held at once
UND = "und"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
_CODES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, and its lower case where that is one code point."""
    if not _CODES:
        letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for c in range(0x33500):
            x = chr(c)
            if x.isalpha():
                letter[c] = True
                y = x.lower()
                if len(y) == 1:
                    lower[c] = ord(y)
        _CODES.extend((letter, lower))
    return _CODES[0], _CODES[1]


class Words:
    """The words (runs of letters, lower-cased) of a run of texts, each with a blank before and after it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        letter, lower = _tables()
        begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        at = begins[offsets]
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        codes = np.insert(np.where(letter[codes], lower[codes], 32), at, 32)
        self.text_at = at + np.arange(len(at))
        is_letter = codes != 32
        self.start = np.flatnonzero(is_letter & ~np.concatenate(([False], is_letter[:-1])))
        self.end = np.flatnonzero(is_letter & ~np.concatenate((is_letter[1:], [False]))) + 1
        self.sums = np.zeros(len(codes) + 1, U)
        np.cumsum(mix(codes.astype(U) + U(0x51ED27)) * powers(BYTE_BASE, len(codes)), out=self.sums[1:])
        self.text = np.searchsorted(self.text_at, self.start, "right") - 1

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * powers(BYTE_BASE, len(self.sums), True)[start] + (end - start).astype(U))

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of the given words, blanks included (n > 1), and the place in ``which`` of each."""
        pad = 1 if n > 1 else 0
        a, b = self.start[which] - pad, self.end[which] + pad
        count = np.maximum(b - a - n + 1, 0)
        owner = np.repeat(np.arange(len(which)), count)
        first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + a[owner]
        return self.hash(first, first + n), owner


def _counts(lang_of: np.ndarray, key: np.ndarray, kind: int, weight: np.ndarray | None = None):
    order = np.lexsort((key, lang_of))
    k, g = key[order], lang_of[order]
    w = np.ones(len(k), np.int64) if weight is None else weight[order]
    at = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (g[1:] != g[:-1])))) if len(k) else np.empty(0, np.int64)
    return g[at], np.full(len(at), kind), k[at], np.add.reduceat(w, at) if len(at) else at


def _trainer(languages: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(languages)
        for batch in batches:
            lang = pa.compute.index_in(batch.column("lang"), names).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, data, offsets in text_chunks(batch.column("text"), CHUNK):
                w = Words(data, offsets)
                which = np.arange(len(w.start))
                parts = [_counts(lang[a:b][w.text], w.hash(w.start, w.end), 0)]
                for n in range(1, LONGEST + 1):
                    h, owner = w.grams(which, n)
                    parts.append(_counts(lang[a:b][w.text[owner]], h, n))
                g, kind, key, c = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(kind, pa.int32()), pa.array(key.view(np.int64)), pa.array(c, pa.int64())], names=["lang", "kind", "key", "n"])
        give_back()

    return count


class Model:
    """Log frequencies of words (kind 0) and n-grams (kind n): per kind, what a language gives a key that it doesn't have, and sorted keys
    with the languages that have them and how much more these give."""

    def __init__(self, languages: list[str], rows: dict[str, np.ndarray]):
        self.languages, self.tables = languages, {}
        for kind in range(LONGEST + 1):
            own = np.flatnonzero(rows["kind"] == kind)
            key, lang, n = rows["key"][own].view(np.uint64), rows["lang"][own], rows["n"][own]
            order = np.lexsort((lang, key))
            key, lang, n = key[order], lang[order], n[order]
            keys, begin = np.unique(key, return_index=True)
            total = np.bincount(lang, n, len(languages)) + UNSEEN * max(1, len(keys))
            more = np.log((n + UNSEEN) / UNSEEN).astype(np.float32)
            self.tables[kind] = keys, np.append(begin, len(key)), lang.astype(np.int32), more, np.log(UNSEEN / total)

    def find(self, kind: int, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the keys of its kind, or -1."""
        keys = self.tables[kind][0]
        if not len(keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, at, -1)

    def entries(self, kind: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For keys at the given places: how many languages have each, which, and how much more they give."""
        _, begin, lang, more, _ = self.tables[kind]
        size = begin[at + 1] - begin[at]
        i = ranges(begin[at], size)
        return size, lang[i], more[i]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed log frequencies (texts x languages), and whether each text has a letter."""
        w = Words(data, offsets)
        texts, langs = len(offsets) - 1, len(self.languages)
        has = np.bincount(w.text, minlength=texts)[:texts] > 0
        if not len(w.start) or not langs:
            return np.zeros((texts, langs)), has
        unique, first, at = np.unique(w.hash(w.start, w.end), return_index=True, return_inverse=True)
        kind = np.full(len(unique), -1)
        row = self.find(0, unique)
        known = np.flatnonzero(row >= 0)
        kind[known] = 0
        size, lang, more = self.entries(0, row[known])
        parts = [(np.repeat(known, size), lang, more)]
        left = np.flatnonzero(row < 0)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            h, owner = w.grams(first[left], n)
            got = self.find(n, h)
            owner, got = owner[got >= 0], got[got >= 0]
            hits = np.bincount(owner, minlength=len(left))
            size, lang, more = self.entries(n, got)
            word = np.repeat(owner, size)
            parts.append((left[word], lang, more / hits[word].astype(np.float32)))
            kind[left[hits > 0]] = n
            left = left[hits == 0]
        word, lang, more = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(word, kind="stable")
        lang, more = lang[order], more[order]
        begin = np.searchsorted(word[order], np.arange(len(unique) + 1))
        pair, times = np.unique(w.text * len(unique) + at, return_counts=True)  # a word of a text, and how often
        text, word = pair // len(unique), pair % len(unique)
        size = begin[word + 1] - begin[word]
        i = ranges(begin[word], size)
        out = np.bincount(np.repeat(text, size) * langs + lang[i], np.repeat(times, size) * more[i], texts * langs).reshape(texts, langs)
        for n in range(LONGEST + 1):
            out += np.bincount(text, times * (kind[word] == n), texts)[:, None] * self.tables[n][4][None, :]
        return out, has


def fit(documents: DataFrame, usable: Column, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the rows with text and lang that ``usable`` selects; it and the sample speak of doc_id."""
    docs = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & usable)
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n")).toArrow()
    languages = sorted(sizes["lang"].to_pylist())
    if not languages:
        return Model([], {k: np.empty(0, np.int64) for k in ("kind", "key", "lang", "n")})
    shares = documents.sparkSession.createDataFrame([(g, min(1.0, per_language / n)) for g, n in zip(sizes["lang"].to_pylist(), sizes["n"].to_pylist(), strict=True)], "lang string, share double")
    if len(languages) <= BROADCAST_LANGUAGES:  # else documents would be shuffled by their language, of which there are few
        shares = F.broadcast(shares)
    picked = docs.join(shares, "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    counts = picked.select("lang", "text").mapInArrow(_trainer(languages), "lang int, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).toArrow()
    return Model(languages, {c: counts[c].to_numpy().astype(np.int64) for c in ("kind", "key", "lang", "n")})


def _decide(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Place of the best language of each text (behind the last one: none) and its score."""
    best, score = np.full(len(texts), len(model.languages)), np.zeros(len(texts))
    for a, b, data, offsets in text_chunks(texts, CHUNK):
        s, has = model.scores(data, offsets)
        if model.languages and has.any():
            p = np.exp(s[has] - s[has].max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best[a:b][has], score[a:b][has] = p.argmax(1), p.max(1)
    return best, score


def _predictor(model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.value.languages, UND], object)
        for batch in batches:
            best, score = _decide(model.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])
        give_back()

    return predict


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predictor(shared), PREDICTED)


def recognised(documents: DataFrame, model: Model, least: float) -> DataFrame:
    """The documents with a language whose score is at least ``least``, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    name = "_".join(documents.columns) + "_text"  # which no column has
    texts = documents.withColumn(name, F.col("text").cast("string"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = _decide(shared.value, batch.column(name))
            yield batch.filter(pa.array((best < len(shared.value.languages)) & (score >= least))).drop_columns([name])
        give_back()

    return texts.mapInArrow(keep, documents.schema)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(documents, fit(documents, ~held_out()))
