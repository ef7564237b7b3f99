"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination and mixing over the table ``documents``.

Every stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and read again as the docs of the
next one. All stages but the last return the columns of ``documents``; the last adds the sampling columns.

Defined cases: null and empty texts have too few words and go in the first stage; null languages and sources are
categories of their own; repeated rows and exact copies share all decisions up to near-dedup, which keeps one of them
(ties between copies go by the smallest id); very long texts are taken whole; an empty table gives an empty table; other
columns of ``docs`` are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.llm import decontamination, linededup, mixing, neardup, quality
from foldlog.llm.common import read_table, shared_dir, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the compression bands keep."""
    return quality.quality(docs, COLUMNS).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines taken out of the texts; documents of which nothing but white space is left go."""
    left = linededup.without_recurring_lines(docs.select(*COLUMNS), dropped_col="n_dropped")
    left = left.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.one_of_each_class(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontamination.find_benchmark_text(docs, read_table(spark, sf_dir, "benchmark"), COLUMNS)
    return found.where(F.size("hit_words") == 0).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with tempered shares of sources, languages and topics; ``weight`` is the inverse probability."""
    mixed = mixing.mix_documents(docs).where("sampled")
    return mixed.select(*COLUMNS, "topic", "tokens", "probability", (1 / F.col("probability")).alias("weight"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: The stages can't be expressed in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents`` through all stages."""
    shared_dir(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return docs
