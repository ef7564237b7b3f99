"""Key lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlog.operators import filters


def live(log: DataFrame) -> DataFrame:
    """Keys whose last event is a put."""
    last = log.groupBy("key").agg(F.max_by("op", "seq").alias("op"))
    return last.where("op = 'PUT'").select("key")


def live_matching(log: DataFrame, pattern: str) -> DataFrame:
    """The same, with only the events that match taking part."""
    return live(filters.key_matches(log, pattern))


def with_old_puts(log: DataFrame, pattern: str, ts_ms: int) -> DataFrame:
    """Keys with a matching put before ``ts_ms``; later deletes don't take them off."""
    old = (F.col("op") == "PUT") & F.col("key").rlike(pattern) & (F.col("ts_ms") < ts_ms)
    return log.where(old).select("key").distinct()


def of_segment(events: DataFrame, seg: int) -> DataFrame:
    return events.where(F.col("seg") == seg).select("key").distinct()
