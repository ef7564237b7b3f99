"""Compaction of a single log and of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MS_A_HOUR = 3_600_000


def delete_cutoff(now_ms: int, max_age_hours: float) -> int:
    """Deletes before this time count as expired in segments."""
    return int(now_ms - max_age_hours * MS_A_HOUR)


def single_cutoff(now_ms: int, max_age_ms: int) -> int:
    """Deletes up to this time count as expired in a single log; 0 (none) without an age."""
    return now_ms - max_age_ms if max_age_ms > 0 else 0


def single_log(log: DataFrame, cutoff_ms: int = 0) -> DataFrame:
    """The last event of each key, without deletes up to the cutoff."""
    names = [c for c in log.columns if c != "key"]
    last = log.groupBy("key").agg(F.max_by(F.struct(*names), "seq").alias("e")).select("key", "e.*").select(*log.columns)
    return last.where(~((F.col("op") == "DELETE") & (F.col("ts_ms") <= cutoff_ms)))


def internal(events: DataFrame) -> DataFrame:
    """The last event of each key within each segment."""
    names = [c for c in events.columns if c not in ("seg", "key")]
    return events.groupBy("seg", "key").agg(F.max_by(F.struct(*names), "seq").alias("e")).select("seg", "key", "e.*").select(*events.columns)


def against(events: DataFrame, seg: int, cutoff_ms: int, manifest: DataFrame | None = None) -> DataFrame:
    """Segments before ``seg`` without the keys that ``seg`` has, and without deletes older than the cutoff.

    ``seg`` must be compacted within itself: with a manifest this is checked (:func:`check_internal`), without one its
    rows are taken as they are.
    """
    if manifest is not None:
        check_internal(manifest, seg)
    keys = events.where(F.col("seg") == seg).select("key").distinct()
    earlier = events.where(F.col("seg") < seg).join(keys, "key", "left_anti").select(*events.columns)
    return earlier.where(~((F.col("op") == "DELETE") & (F.col("ts_ms") < cutoff_ms)))


def check_internal(rows: DataFrame, seg: int) -> None:
    """Raise if the segment isn't compacted within itself by the manifest."""
    if rows.where((F.col("seg") == seg) & ~F.col("internally_compacted")).limit(1).count():
        raise ValueError(f"segment {seg} is not compacted within itself")


def segmented(events: DataFrame, cutoff_ms: int, live_seg: int | None = None, applied: DataFrame | None = None) -> DataFrame:
    """All read-only segments compacted within themselves and against each other; the live one stays as it is.

    An event survives if it is the last of its key over all read-only segments (by segment, then sequence). A delete
    before the cutoff goes too if a later segment (one not in ``applied``, a list of seg) still was to be applied.
    """
    segs = events.select("seg").distinct()
    live = segs.agg(F.max("seg").alias("__live")) if live_seg is None else events.sparkSession.range(1).select(F.lit(live_seg).cast("long").alias("__live"))
    marked = events.join(F.broadcast(live))
    read_only = marked.where(F.col("seg") < F.col("__live")).drop("__live")
    names = [c for c in events.columns if c != "key"]
    last = read_only.groupBy("key").agg(F.max_by(F.struct(*names), F.struct("seg", "seq")).alias("e")).select("key", "e.*").select(*events.columns)
    waiting = segs.join(F.broadcast(live), F.col("seg") < F.col("__live")).select("seg")
    waiting = waiting if applied is None else waiting.join(applied.select("seg"), "seg", "left_anti")
    latest = waiting.agg(F.max("seg").alias("__latest"))
    expired = (F.col("op") == "DELETE") & (F.col("ts_ms") < cutoff_ms) & (F.col("seg") < F.coalesce("__latest", F.lit(-1)))
    kept = last.join(F.broadcast(latest)).where(~expired).drop("__latest")
    return kept.unionByName(marked.where(F.col("seg") >= F.col("__live")).drop("__live"))
