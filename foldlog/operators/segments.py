"""Segments: layout by event count, manifest, append checks, merging of small neighbours, repair of interrupted swaps."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldlog.operators import ordered


def layout(log: DataFrame, per_segment: int) -> DataFrame:
    """``seg``: 1 for the first ``per_segment`` events, 2 for the next, and so on."""
    numbered = ordered.row_numbers(log, "__rn")
    return numbered.withColumn("seg", (F.floor((F.col("__rn") - 1) / per_segment) + 1).cast("long")).drop("__rn")


def manifest(events: DataFrame, live: str = "max") -> DataFrame:
    """One row a segment; the segment of the highest number is live."""
    rows = events.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))
    last = rows.agg(F.max("seg").alias("__last"))
    flagged = rows.join(F.broadcast(last)).withColumn("is_live", F.col("seg") == F.col("__last")).drop("__last")
    return flagged.withColumns({"applied": F.lit(False), "internally_compacted": F.lit(False)})


def segment_bytes(events: DataFrame) -> DataFrame:
    """Bytes of each segment in the framed file format."""
    body = F.when(F.col("op") == "PUT", F.coalesce(F.octet_length("body"), F.lit(0))).otherwise(0)
    return events.groupBy("seg").agg(F.sum(F.lit(40) + F.octet_length("key") + body).cast("long").alias("bytes"))


def internal_candidates(rows: DataFrame) -> DataFrame:
    """Read-only segments that were not compacted within themselves."""
    return rows.where(~F.col("is_live") & ~F.col("internally_compacted"))


def unapplied(rows: DataFrame) -> DataFrame:
    """Read-only segments that were not applied to earlier ones."""
    return rows.where(~F.col("is_live") & ~F.col("applied"))


def check_append(log: DataFrame, batch: DataFrame) -> DataFrame:
    """The events of a batch that may not be appended: below the next sequence, or a sequence given twice."""
    last = log.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("__next"))
    counted = batch.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("seq")))
    return counted.join(F.broadcast(last), (F.col("seq") < F.col("__next")) | (F.col("__n") > 1)).drop("__next", "__n")


def append(log: DataFrame, batch: DataFrame, path: str) -> None:
    """Append a batch to the log kept at ``path``; raises if an event may not be appended."""
    refused = check_append(log, batch).select("seq").orderBy("seq").limit(1).collect()
    if refused:
        raise ValueError(f"sequence {refused[0]['seq']} is below the next one or given twice")
    batch.write.mode("append").parquet(path)


def merge_plan(rows: DataFrame, most: int) -> DataFrame:
    """``into`` for each segment: neighbours are merged from the left while both are applied and fit in ``most`` events.

    Works on the manifest, one row for very many events: its rows stream through one task in order. They are shuffled to
    it, so that what makes them runs in tasks of its own.
    """

    def run(batches: Iterator) -> Iterator:
        name, total, open_ = None, 0, False
        for batch in batches:
            into = []
            for r in batch.itertuples(index=False):
                if open_ and r.applied and total + r.n <= most:
                    total += int(r.n)
                else:
                    name, total, open_ = int(r.seg), int(r.n), bool(r.applied)
                into.append(name)
            yield batch.assign(into=into)[["seg", "n", "into"]]

    ordered_rows = rows.select("seg", "n", "applied").repartition(1).sortWithinPartitions("seg")
    return ordered_rows.mapInPandas(run, "seg long, n long, into long")


def merged(rows: DataFrame, most: int) -> DataFrame:
    """The manifest after merging: a merged segment keeps the name of its first part; flags hold if they hold for all parts."""
    plan = merge_plan(rows, most).select("seg", "into")
    return rows.join(plan, "seg").groupBy(F.col("into").alias("seg")).agg(
        F.sum("n").alias("n"), F.min("min_seq").alias("min_seq"), F.max("max_seq").alias("max_seq"), F.count(F.lit(1)).alias("parts"),
        F.bool_and("applied").alias("applied"), F.bool_and(F.col("applied") & F.col("internally_compacted")).alias("internally_compacted"),
    )


def union(left: DataFrame, right: DataFrame, seg: int) -> DataFrame:
    """Events of two segments as one."""
    return left.unionByName(right).withColumn("seg", F.lit(seg).cast("long"))


def repair_plan(names: DataFrame) -> DataFrame:
    """What to do after an interrupted swap, for each base name, from the suffixes found beside it.

    Base and ``compacting``: drop ``compacting``. ``temp`` and ``compacting``: promote ``compacting``, drop ``temp``.
    Base and ``temp``: drop ``temp``.
    """
    base = F.regexp_extract("name", r"^([^.]+)", 1)
    suffix = F.regexp_extract("name", r"^[^.]+\.(.*)$", 1)
    seen = names.groupBy(base.alias("base")).agg(*[F.max(suffix == s).alias(a) for s, a in (("", "plain"), ("temp", "temp"), ("compacting", "compacting"))])
    action = (
        F.when(F.col("plain") & F.col("compacting"), "drop compacting")
        .when(F.col("temp") & F.col("compacting"), "promote compacting")
        .when(F.col("plain") & F.col("temp"), "drop temp")
        .otherwise("none")
    )
    return seen.select("base", action.alias("action"))
