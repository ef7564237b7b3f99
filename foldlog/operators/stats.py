"""Counts, rates and averages of what was recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlog.operators import ordered


def replay_report(results: DataFrame, status: str = "status", ok="200") -> DataFrame:
    """One row a status: count, and its share; all but ``ok`` count as errors."""
    counted = results.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("__all"), F.sum(F.when(F.col(status) != ok, F.col("n")).otherwise(0)).alias("__bad"))
    return counted.join(F.broadcast(total)).select(status, "n", F.round(F.col("n") / F.col("__all"), 4).alias("share"), F.round(F.col("__bad") / F.col("__all"), 4).alias("error_rate"))


def batch_report(results: DataFrame, size: int, ok: int = 200) -> DataFrame:
    """One row a batch of ``size`` results (seq, status, ms) in the order of seq: ``batch`` (from 0), ``n``, ``average_ms``
    (cut to an integer), ``error_rate`` and ``per_second``: results over the sum of their durations (null if that is 0)."""
    rows = ordered.row_numbers(results.select("seq", "status", "ms")).withColumn("batch", F.call_function("div", F.col("rn") - 1, F.lit(size)).cast("long"))
    summed = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms"), F.count_if(F.col("status") != ok).alias("bad"))
    rate = F.when(F.col("ms") > 0, F.round(1000 * F.col("n") / F.col("ms"), 4))
    return summed.select("batch", "n", F.call_function("div", F.col("ms"), F.col("n")).alias("average_ms"), F.round(F.col("bad") / F.col("n"), 4).alias("error_rate"), rate.alias("per_second"))


def weighted_average(df: DataFrame, value: str, order: str = "seq") -> DataFrame:
    """The running average in which the i-th value weighs i, exact: ``numerator`` over ``denominator``."""
    rows = ordered.row_numbers(df.select(order, value), "n", order)
    weighed = F.col("n").cast("decimal(19,0)") * F.col(value).cast("decimal(18,0)")
    summed = ordered.running_sum(rows, weighed, "numerator", order=order)
    n = F.col("n").cast("decimal(19,0)")
    return summed.select(order, F.col("numerator").cast("decimal(38,0)").alias("numerator"), F.call_function("div", n * (n + 1), F.lit(2)).cast("long").alias("denominator"))


def truncated_average(values: Column) -> Column:
    """The same over an ordered array of integers, cut to an integer after every step."""
    step = lambda acc, x: F.struct(
        (acc["n"] + 1).cast("long").alias("n"),
        F.call_function("div", acc["average"] * acc["n"] + 2 * x, acc["n"] + 2).cast("long").alias("average"),
    )
    return F.aggregate(values, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("average")), step, lambda acc: acc["average"])


def longest(df: DataFrame, value: str, order: str = "seq") -> DataFrame:
    """Last and longest duration."""
    return df.agg(F.max_by(value, order).alias("last"), F.max(value).alias("longest"))


def metric_map(rows: DataFrame) -> DataFrame:
    """Metrics of each bean as a map of attribute to value; an attribute's error stands as its value."""
    value = F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), F.col("error"))).otherwise(F.col("value"))
    pairs = rows.groupBy("bean", "attribute").agg(F.max(value).alias("v"))
    return pairs.groupBy("bean").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "v")))).alias("metrics"))
