"""The queries of this subpackage: each applies one operator to its whole table and returns the full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.llm import chat, decontamination, extraction, langid, licences, linededup, mixing, neardup, oracle, pii
from foldlog.llm import quality as rules
from foldlog.llm.common import read_table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(read_table(spark, sf_dir, "documents"))
    named = [F.coalesce(c, F.lit(mixing.NONE)).alias(c) for c in ("source", "lang")]
    return mixed.select("doc_id", *named, "topic", "tokens", "probability", "sampled")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_conversations(rows.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    turns = done.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "n_tokens_attached",
    )


def op3_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents"))


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(read_table(spark, sf_dir, "documents"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read_table(spark, sf_dir, "documents"))


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(read_table(spark, sf_dir, "documents"))


def op7_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(read_table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op9_log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.without_recurring_lines(docs, dropped_col="n_dropped")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontamination.contamination(docs, benchmark).drop("hit_chars")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_semi_markov_pii": op3_semi_markov_pii,
    "op4_dart_minhash": op4_dart_minhash,
    "op5_licence_scan": op5_licence_scan,
    "op6_compression_bands": op6_compression_bands,
    "op7_tree_scoring": op7_tree_scoring,
    "op8_language_id": op8_language_id,
    "op9_log_templates": op9_log_templates,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL = {
    "op1_mixing": mixing.mixing_sql(),
    "op2_chat_formatting": oracle.CHAT,
    "op4_dart_minhash": oracle.NEAR_DUPLICATES,
    "op5_licence_scan": oracle.licence_scan(),
    "op10_decontamination": oracle.DECONTAMINATION,
}
