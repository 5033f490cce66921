"""Corpus pipeline: each stage reads, as Parquet, what its predecessor kept.

language_id      drops documents without a language: no letter, or a posterior below 0.5
exact_dedup      keeps one document of each group of equal texts
minhash          keeps one document of each component of near copies (5 words, 0.8)
decontamination  drops documents that hold a window of a benchmark item
byte_bpe         encodes and decodes what is left: doc_id, n_tokens, ids_sha256, decoded_sha256

Null or empty texts have no language and go at the first stage; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitext.llm import shared
from bitext.llm.bpe import round_trip
from bitext.llm.decontam import drop_leaks
from bitext.llm.exact_dedup import exact_dedup
from bitext.llm.langid import keep_identified
from bitext.llm.minhash import near_dedup


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs, shingle=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, shared.table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("minhash", near_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", bpe_stage),
]

#: Language ID, sketches and BPE have no SQL form; the tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
