"""From raw documents to packed training sequences.

``STAGES`` are applied one after the other, each to what the one before it kept; ``run`` writes each result as Parquet into the shared
folder and reads it again for the next. All stages but the last return the columns of documents.

1. language: documents without a recognisable language go.
2. near_duplicates: of each group of near duplicates the document with the smallest id stays.
3. passages: passages of 35 words or more that repeat are taken out of the texts; every document stays.
4. mixture: small sources are read up to 1.5 times, every source at least once.
5. packing: the pieces of the documents, packed into sequences of at most 2048 tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import jaccard, langid, mixing, packing, substring
from tidewire.session import checkpoint_dir

LEAST_SCORE = 0.5

#: SQL can't express the language model, the hashes of the mixture or the tokenizer; tests/llm/test_plain.py compares every stage and ``run`` with plain Python.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.recognised(docs, langid.fit(docs, ~langid.held_out()), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, marks=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("passages", passages), ("mixture", mixture), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
