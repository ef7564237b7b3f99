"""Schemas of an event log, and canonical logs over the driver's tables.

A log is a DataFrame with seq (unique, gaps allowed), ts_ms, op ('PUT' or 'DELETE'), key and body. Order is always by
seq: timestamps need not follow it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlog.sources.shared import ship

PUT, DELETE = "PUT", "DELETE"

EVENT = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts_ms", T.LongType(), False),
    T.StructField("op", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("body", T.BinaryType()),
])
MANIFEST = T.StructType([
    T.StructField("seg", T.LongType(), False),
    T.StructField("n", T.LongType()),
    T.StructField("min_seq", T.LongType()),
    T.StructField("max_seq", T.LongType()),
    T.StructField("applied", T.BooleanType()),
    T.StructField("internally_compacted", T.BooleanType()),
    T.StructField("is_live", T.BooleanType()),
])


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str, first: int = 1) -> DataFrame:
    """The table events as a log: errors delete their user's key. With ``first`` 0 seq is the files' own column."""
    e = table(spark, sf_dir, "events")
    seq = F.col("event_id") + first if first else F.col("event_id")
    return e.select(
        seq.alias("seq"), epoch_ms(F.col("ts")).alias("ts_ms"),
        F.when(F.col("event_type") == "error", DELETE).otherwise(PUT).alias("op"),
        F.col("user_id").cast("string").alias("key"), F.col("props").alias("body"), "value",
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table orders as a log, in which time doesn't follow the sequence: finished orders delete the customer's key."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_orderkey") + 1).alias("seq"), epoch_ms(F.col("o_orderdate")).alias("ts_ms"),
        F.when(F.col("o_orderstatus") == "F", DELETE).otherwise(PUT).alias("op"),
        F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("body"),
    )


def replica(log: DataFrame, r: int) -> DataFrame:
    """A replica with holes: every seventh event is missing."""
    return log.where(F.col("seq") % 7 != r)


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded votes in the order of their arrival: acceptor, slot, ballot (which acceptors share) and arrival."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 5).alias("acceptor"), F.expr("event_id div 16").alias("slot"), F.expr("user_id div 5 % 2").alias("ballot"), F.col("event_id").alias("arrival"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded votes for proposals: acceptor, slot, ballot (ordered field by field) and command."""
    e = table(spark, sf_dir, "events")
    ballot = F.struct((F.col("user_id") % 8).alias("seq"), F.col("event_type").alias("leader"), F.col("event_id").alias("vote"))
    return e.select(
        (F.col("user_id") % 5).alias("acceptor"), F.expr("event_id div 4").alias("slot"), ballot.alias("ballot"),
        F.concat_ws(":", F.col("event_type"), F.col("user_id").cast("string")).alias("command"), epoch_ms(F.col("ts")).alias("ts_ms"),
    )
