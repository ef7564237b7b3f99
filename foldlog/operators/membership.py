"""Members: who is known, resolved, silent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(members: DataFrame, config: DataFrame) -> DataFrame:
    """What a new configuration asks for: ``drop`` paths no longer in it, ``resolve`` those missing or without reference."""
    gone = members.join(config.select("path"), "path", "left_anti").select("path", F.lit("drop").alias("action"))
    known = members.select("path", "ref")
    open_ = config.select("path").join(known, "path", "left").where(F.col("ref").isNull()).select("path", F.lit("resolve").alias("action"))
    return gone.unionByName(open_)


def active(members: DataFrame) -> DataFrame:
    return members.where(F.col("ref").isNotNull())


def dead(members: DataFrame, now_ms: int, allowed: int, interval_ms: int) -> DataFrame:
    """Members not seen for more than the allowed number of intervals and half of one."""
    return members.where(now_ms - F.col("last_seen") > allowed * interval_ms + interval_ms // 2)


def ages(pings: DataFrame, now_ms: int) -> DataFrame:
    """Time since the last ping of each member, and its round trip."""
    last = pings.groupBy("path").agg(F.max("ts_ms").alias("last_seen"), F.max_by("round_trip", F.struct("ts_ms", "seq")).alias("round_trip"))
    return last.withColumn("age_ms", F.lit(now_ms) - F.col("last_seen"))


def random_remote(members: DataFrame, local: str, seed: int) -> DataFrame:
    """One active member other than the local one."""
    return active(members).where(F.col("path") != local).orderBy(F.rand(seed)).limit(1)
