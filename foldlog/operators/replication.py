"""Replicas of a log: gaps, contiguous prefixes, differences, catching up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlog.operators import ordered


def gaps(log: DataFrame) -> DataFrame:
    """Missing runs between events: first and last missing sequence."""
    after = ordered.neighbours(log.select("seq"))
    return after.where(F.col("next_seq") - F.col("seq") > 1).select((F.col("seq") + 1).alias("gap_start"), (F.col("next_seq") - 1).alias("gap_end"))


def contiguous_prefix(arrived: DataFrame, next_seq: int) -> DataFrame:
    """Of the events that arrived (repeats: the first arrival counts), those that follow ``next_seq`` without a gap."""
    waiting = arrived.where(F.col("seq") >= next_seq)
    first = waiting.groupBy("seq").agg(F.min_by(F.struct(*[c for c in arrived.columns if c != "seq"]), "arrival").alias("e"))
    run = ordered.row_numbers(first).where(F.col("seq") - F.col("rn") == next_seq - 1)
    return run.select("seq", "e.*")


def divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Events in only one of two replicas, by sequence and request; time is not compared."""
    cols = ["seq", "op", "key", "body"]
    left = a.select(*cols).exceptAll(b.select(*cols)).withColumn("side", F.lit("a"))
    right = b.select(*cols).exceptAll(a.select(*cols)).withColumn("side", F.lit("b"))
    return left.unionByName(right)


def catch_up_fold(outcomes: Column, window: int = 1, threshold: int = 500, most: int = 1000) -> Column:
    """Window and threshold after an ordered array of outcomes.

    A complete answer doubles the window up to the threshold and then adds 2, to ``most``; a failure halves the
    threshold and starts again with 1, unless the window is 1 already. Other outcomes change nothing.
    """
    w, s = lambda acc: acc["window"], lambda acc: acc["threshold"]
    grown = lambda acc: F.least(F.when(w(acc) < s(acc), F.least(w(acc) * 2, s(acc))).otherwise(w(acc) + 2), F.lit(most))
    shape = lambda a, b: F.struct(a.cast("int").alias("window"), b.cast("int").alias("threshold"))
    return F.aggregate(
        outcomes,
        shape(F.lit(window), F.lit(threshold)),
        lambda acc, o: F.when(o == "COMPLETE", shape(grown(acc), s(acc)))
        .when((o == "FAILED") & (w(acc) > 1), shape(F.lit(1), F.greatest(F.floor(w(acc) / 2), F.lit(1))))
        .otherwise(acc),
    )


def catch_up(outcomes: DataFrame, partition: str = "node", order: str = "step", **options) -> DataFrame:
    """The state of each node after its outcomes. A node's outcomes are folded in one task."""
    listed = outcomes.groupBy(partition).agg(F.array_sort(F.collect_list(F.struct(order, "outcome"))).alias("o"))
    return listed.select(partition, catch_up_fold(F.transform("o", lambda x: x["outcome"]), **options).alias("s")).select(partition, "s.*")


def catch_up_timeout_ms(window: Column, base_ms: int = 1000, event_ms: int = 10) -> Column:
    """How long to wait for an answer of so many events."""
    return (base_ms + window * event_ms).cast("long")


def lag_of_replicas(replicas: DataFrame) -> DataFrame:
    """How far each replica (column ``replica``) is behind the one that is furthest."""
    last = replicas.groupBy("replica").agg(F.max("seq").alias("max_seq"), F.count(F.lit(1)).alias("n"))
    return last.withColumn("behind", F.max("max_seq").over(Window.partitionBy(F.lit(1))) - F.col("max_seq"))
