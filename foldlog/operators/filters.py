"""Filters on keys, ages, slots and prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_matches(log: DataFrame, pattern: str) -> DataFrame:
    """Events whose key has the pattern anywhere, puts and deletes alike."""
    return log.where(F.col("key").rlike(pattern))


def key_matches_not(log: DataFrame, pattern: str) -> DataFrame:
    return log.where(~F.col("key").rlike(pattern))


def without_old_deletes(log: DataFrame, ts_ms: int) -> DataFrame:
    """All puts, and the deletes from ``ts_ms`` on."""
    return log.where((F.col("op") == "PUT") | (F.col("ts_ms") >= ts_ms))


def without_old_puts(log: DataFrame, pattern: str, ts_ms: int) -> DataFrame:
    """Everything but puts before ``ts_ms`` whose key has the pattern."""
    return log.where(~((F.col("op") == "PUT") & F.col("key").rlike(pattern) & (F.col("ts_ms") < ts_ms)))


def drop_while(df: DataFrame, condition: Column, order: str) -> DataFrame:
    """Without the longest prefix (along ``order``) in which the condition holds; later rows stay even if it holds."""
    first = df.agg(F.min(F.when(~F.coalesce(condition, F.lit(False)), F.col(order))).alias("__first"))
    return df.join(F.broadcast(first), F.col(order) >= F.col("__first")).drop("__first")


def undecided(accepted: DataFrame, latest_slot: int) -> DataFrame:
    return accepted.where(F.col("slot") > latest_slot)


def fresh(proposed: DataFrame, now_ms: int, window_ms: int) -> DataFrame:
    """Proposals that are not older than the window."""
    return proposed.where(F.col("ts_ms") >= now_ms - window_ms)


def after_hint(decisions: DataFrame, hint: int) -> DataFrame:
    return decisions.where(F.col("slot") > hint)


def segment_names(names: DataFrame) -> DataFrame:
    """Directories named by digits alone, in numeric order."""
    found = names.where(F.col("is_directory") & F.col("name").rlike("^[0-9]+$"))
    return found.select("name", F.col("name").cast("long").alias("seg")).orderBy("seg")
