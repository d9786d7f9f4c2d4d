"""The corpus pipeline: five stages over ``documents``, each reading what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesgrove.llm import decontaminate, exact_dedup, langid, mixing, simhash
from seriesgrove.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or like no learned language; null texts go too."""
    return langid.keep(docs).select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: the longest original, then the smallest doc_id, null last; a null text equals an empty one, an empty table stays empty."""
    return exact_dedup.keep(spark, docs).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest doc_id (null last), of each component of five-word similarity 0.8 or more.

    Null and empty texts are one empty shingle and so near copies of each other; of
    repeated rows one stays; an empty table stays empty.
    """
    return simhash.keep(spark, docs).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none, an empty benchmark drops nothing."""
    return decontaminate.keep(spark, docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document and the slot it begins at.

    A null text has size 0 and takes 0 words, a null source is a source of its own,
    repeated rows count separately, an empty table gives an empty result.
    """
    return mixing.mix(spark, docs).select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontaminate", benchmark_leaks),
    ("mix", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Hyperdimensional language ID and near-copy components have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None
