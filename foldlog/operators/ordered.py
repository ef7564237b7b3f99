"""Positions and running sums along the sequence, without one task for the whole log.

The sequence is cut into buckets of equal width. As it is unique, a bucket has at most as many rows as it is wide, so a
window within buckets is bounded. Only the buckets' totals, one row each, go through a single ordered window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16


def running_sum(df: DataFrame, value: Column, name: str, inclusive: bool = True, order: str = "seq", width: int = WIDTH) -> DataFrame:
    """``name``: the sum of ``value`` over all rows up to this one (or before it)."""
    cut = df.withColumn("__bucket", F.floor(F.col(order) / width)).withColumn("__value", value)
    totals = cut.groupBy("__bucket").agg(F.sum("__value").alias("__total"))
    ahead = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__bucket", F.coalesce(F.sum("__total").over(ahead), F.lit(0)).alias("__base"))
    upto = Window.partitionBy("__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    within = cut.withColumn("__sum", F.coalesce(F.sum("__value").over(upto), F.lit(0)))
    return within.join(bases, "__bucket").withColumn(name, F.col("__sum") + F.col("__base")).drop("__bucket", "__value", "__sum", "__base")


def row_numbers(df: DataFrame, name: str = "rn", order: str = "seq", width: int = WIDTH) -> DataFrame:
    """``name``: 1, 2, ... along the order."""
    return running_sum(df, F.lit(1), name, order=order, width=width).withColumn(name, F.col(name).cast("long"))


def neighbours(df: DataFrame, order: str = "seq", width: int = WIDTH) -> DataFrame:
    """``next_<order>``: the following value, also across buckets."""
    cut = df.withColumn("__bucket", F.floor(F.col(order) / width))
    firsts = cut.groupBy("__bucket").agg(F.min(order).alias("__first"))
    firsts = firsts.select("__bucket", F.lead("__first").over(Window.orderBy("__bucket")).alias("__after"))
    within = cut.withColumn("__next", F.lead(order).over(Window.partitionBy("__bucket").orderBy(order)))
    return within.join(firsts, "__bucket").withColumn(f"next_{order}", F.coalesce("__next", "__after")).drop("__bucket", "__next", "__after")
