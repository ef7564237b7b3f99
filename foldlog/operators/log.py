"""Scans of a log by sequence: ranges, tails, early stops and subranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlog.operators import ordered


def scan(log: DataFrame) -> DataFrame:
    """All events in order."""
    return log.orderBy("seq")


def seq_range(log: DataFrame, start: int, end: int) -> DataFrame:
    """Events with start <= seq <= end; the bounds reach the Parquet reader if ``seq`` is a column of the files."""
    return log.where(F.col("seq").between(start, end))


def point(log: DataFrame, seq: int) -> DataFrame:
    return log.where(F.col("seq") == seq)


def bounds(log: DataFrame) -> DataFrame:
    """One row: smallest, largest and next sequence, and the number of events. An empty log starts at 1."""
    return log.agg(
        F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"),
        (F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"), F.count(F.lit(1)).alias("n"),
    )


def tail(log: DataFrame, k: int) -> DataFrame:
    """The last k sequence numbers before the largest, and the largest: k + 1 events if none is missing.

    The largest is read first, so that the range can be pushed to the reader.
    """
    last = log.agg(F.max("seq")).first()[0]
    return log.limit(0) if last is None else seq_range(log, last - k, last)


def tail_count(log: DataFrame, k: int) -> DataFrame:
    """The last k events."""
    return log.orderBy(F.desc("seq")).limit(k)


def first_of_range(log: DataFrame, start: int, end: int, n: int) -> DataFrame:
    return seq_range(log, start, end).orderBy("seq").limit(n)


def range_while(log: DataFrame, start: int, end: int, cost: Column, budget: float) -> DataFrame:
    """Events of a range as long as the costs (not negative) of those before stay under the budget."""
    part = seq_range(log, start, end)
    return ordered.running_sum(part, cost, "__before", inclusive=False).where(F.col("__before") < budget).drop("__before")


def fold(log: DataFrame, zero, step: Callable, more: Callable | None = None, schema: str = "result string", by: str = "key") -> DataFrame:
    """Any fold of the events of each key in sequence order, ended before an event for whose accumulator ``more`` fails.

    An arbitrary fold has no partial form: the rows of a key stream through one task in order, without being held. Prefer
    the aggregates of this package wherever they say the same.
    """
    names = log.columns
    at, result = names.index(by), schema.split()[0]
    kind = dict(log.dtypes)[by]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        key, acc, on, begun = None, zero, True, False
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                if not begun or row[at] != key:
                    if begun:
                        done.append((key, acc))
                    key, acc, on, begun = row[at], zero, True, True
                if on and more is not None and not more(acc):
                    on = False
                if on:
                    acc = step(acc, dict(zip(names, row, strict=True)))
            yield pd.DataFrame(done, columns=[by, result])
        yield pd.DataFrame([(key, acc)] if begun else [], columns=[by, result])

    return log.repartition(by).sortWithinPartitions(by, "seq").mapInPandas(run, f"`{by}` {kind}, {schema}")


def offset_range(index: DataFrame, start: int, end: int) -> DataFrame:
    """One row: offsets of the first and last record of a range; (0, -1) if it has none."""
    inside = index.where(F.col("seq").between(start, end))
    return inside.agg(F.coalesce(F.min("offset"), F.lit(0)).alias("first_offset"), F.coalesce(F.max("offset"), F.lit(-1)).alias("last_offset"))


def record_offsets(log: DataFrame) -> DataFrame:
    """seq and byte offset of each record in the framed file format: 12 bytes of frame, 28 of fields, key and body."""
    size = F.lit(40) + F.octet_length("key") + F.when(F.col("op") == "PUT", F.coalesce(F.octet_length("body"), F.lit(0))).otherwise(0)
    return ordered.running_sum(log.select("seq", "op", "key", "body"), size, "offset", inclusive=False).select("seq", F.col("offset").cast("long").alias("offset"))


def subrange_events(log: DataFrame, requests: DataFrame) -> DataFrame:
    """The events that answer each request (start, end, limit; null: none): start, end, limit and the event."""
    status = subrange_status(log, requests).where("n_events > 0").select("start", "end", "limit", "range_start", "range_end")
    inside = F.col("seq").between(F.col("range_start"), F.col("range_end"))
    return log.join(F.broadcast(status), inside).select("start", "end", "limit", *log.columns)


def subrange_status(log: DataFrame, requests: DataFrame) -> DataFrame:
    """How the log answers requests (start, end, limit; null: none): status, range and number of events.

    EMPTY if nothing can be in the range; PARTIAL if the log ends before it; COMPLETE otherwise. With a limit under
    the width of the range the first ``limit`` events are given and the range ends with the last of them.
    """
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    asked = requests.select("start", "end", "limit").distinct().crossJoin(F.broadcast(last)).withColumn("e", F.least("end", "last"))
    none = (F.coalesce("limit", F.lit(1)) <= 0) | (F.col("end") < F.col("start")) | (F.col("end") <= 0) | (F.col("start") > F.col("last"))
    asked = asked.withColumns({"none": none, "whole": F.col("limit").isNull() | (F.col("limit") > F.col("e") - F.col("start"))})
    asked = asked.withColumn("ask", F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("start", "end", "limit")]))
    # Requests are few (they are broadcast): each sees how many events lie in it, and where its limit falls among them.
    inside = ordered.row_numbers(log.select("seq")).join(F.broadcast(asked.select("ask", "start", "e", "limit")), F.col("seq").between(F.col("start"), F.col("e")))
    counts = inside.groupBy("ask").agg(F.count(F.lit(1)).alias("found"), F.min("rn").alias("first"))
    within = inside.join(F.broadcast(counts.select("ask", "first")), "ask").where(F.col("rn") < F.col("first") + F.col("limit"))
    cut = within.groupBy("ask").agg(F.max("seq").alias("last_given"), F.count(F.lit(1)).alias("given"))
    out = asked.join(counts.select("ask", "found"), "ask", "left").join(cut, "ask", "left")
    found, given = F.coalesce("found", F.lit(0)), F.coalesce("given", F.lit(0))
    short = ~F.col("whole") & (given < F.col("limit"))
    partial = (F.col("whole") | short) & (F.col("e") < F.col("end"))
    end = F.when(F.col("whole") | short, F.col("e")).otherwise(F.coalesce("last_given", "e"))
    return out.select(
        "start", "end", "limit",
        F.when(F.col("none"), "EMPTY").when(partial, "PARTIAL").otherwise("COMPLETE").alias("status"),
        F.when(~F.col("none"), F.col("start")).alias("range_start"), F.when(~F.col("none"), end).alias("range_end"),
        F.when(F.col("none"), 0).when(F.col("whole"), found).otherwise(given).cast("long").alias("n_events"),
    )
