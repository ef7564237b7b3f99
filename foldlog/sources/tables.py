"""Logs as Parquet tables: plain, or in folders by segment. Also lists of members and keys as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.operators import compaction, segments
from foldlog.schema import EVENT

PER_SEGMENT = 1_000_000


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def is_segmented(spark: SparkSession, path: str) -> bool:
    """Whether the table at a path is laid out by segment."""
    return "seg" in spark.read.parquet(path).columns


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write(log: DataFrame, path: str) -> None:
    """Write a log sorted by sequence, so that row groups can be skipped by range; an existing path raises."""
    log.drop("seg").repartitionByRange("seq").sortWithinPartitions("seq").write.mode("errorifexists").parquet(path)


def write_segmented(log: DataFrame, path: str, per_segment: int = PER_SEGMENT) -> None:
    """Write a log in folders of ``per_segment`` events."""
    laid = segments.layout(log.drop("seg"), per_segment)
    laid.repartition("seg").sortWithinPartitions("seq").write.mode("errorifexists").partitionBy("seg").parquet(path)


def init_segmented(spark: SparkSession, path: str) -> None:
    """An empty table laid out by segment."""
    if _exists(spark, path):
        raise FileExistsError(path)
    empty = spark.createDataFrame([], EVENT).withColumn("seg", F.lit(1).cast("long"))
    empty.write.parquet(path)


def convert(spark: SparkSession, source: str, target: str, per_segment: int | None) -> None:
    """Copy a log to the segmented layout (with a size) or to the plain one (without)."""
    log = read(spark, source)
    write_segmented(log, target, per_segment) if per_segment else write(log, target)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _names(path: str, seg: int) -> tuple[str, str, str]:
    """A segment's folder, and those of a replacement being written and of a segment being replaced: readers skip these."""
    return f"{path}/seg={seg}", f"{path}/.{seg}.compacting", f"{path}/.{seg}.temp"


def delete_segment(spark: SparkSession, path: str, seg: int) -> None:
    """Remove a segment and its flags; a missing one is no error."""
    fs, at = _files(spark, path)
    fs.delete(at(_names(path, seg)[0]), True)


def replace_segment(spark: SparkSession, path: str, seg: int, events: DataFrame) -> None:
    """Put ``events`` in the place of a segment: written beside it, then two renames that :func:`repair` can finish.

    Flags don't pass over to the replacement.
    """
    fs, at = _files(spark, path)
    base, compacting, temp = _names(path, seg)
    events.drop("seg").repartitionByRange("seq").sortWithinPartitions("seq").write.mode("overwrite").parquet(compacting)
    fs.rename(at(base), at(temp))
    fs.rename(at(compacting), at(base))
    fs.delete(at(temp), True)


def repair(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Finish or undo replacements that were interrupted; what was done, by segment. A listing of folders, not of events."""
    fs, at = _files(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(at(path))]
    names = [n.removeprefix("seg=").removeprefix(".") for n in found if n.startswith("seg=") or n.endswith((".compacting", ".temp"))]
    plan = segments.repair_plan(spark.createDataFrame([(n,) for n in names], "name string")).where("action != 'none'").orderBy("base")
    done = [(r["base"], r["action"]) for r in plan.collect()]
    for seg, action in done:
        base, compacting, temp = _names(path, int(seg))
        if action == "promote compacting":
            fs.rename(at(compacting), at(base))
        fs.delete(at(compacting if action == "drop compacting" else temp), True)
    return done


def set_flag(spark: SparkSession, path: str, seg: int, flag: str) -> None:
    """Keep a segment's flag (``applied`` or ``internally_compacted``): an empty file in its folder that readers skip."""
    fs, at = _files(spark, path)
    fs.create(at(f"{_names(path, seg)[0]}/_{flag}"), True).close()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a segmented log with the flags that its folders keep."""
    fs, at = _files(spark, path)
    rows = segments.manifest(read(spark, path))
    for flag in ("applied", "internally_compacted"):
        kept = [int(s.getPath().getParent().getName().removeprefix("seg=")) for s in fs.globStatus(at(f"{path}/seg=*/_{flag}")) or []]
        rows = rows.withColumn(flag, F.col("seg").isin(kept))
    return rows


def compact_segments(spark: SparkSession, path: str) -> list[int]:
    """Compact within themselves, in place, the read-only segments that weren't yet; their numbers. ``applied`` stays."""
    repair(spark, path)
    due = segments.internal_candidates(manifest(spark, path)).select("seg", "applied").orderBy("seg").collect()
    for seg, applied in due:
        replace_segment(spark, path, seg, compaction.internal(read(spark, path).where(F.col("seg") == seg)))
        for flag in ["applied"] * applied + ["internally_compacted"]:
            set_flag(spark, path, seg, flag)
    return [r["seg"] for r in due]


def filtered(spark: SparkSession, source: str, target: str, keep) -> None:
    """Copy what ``keep`` leaves of a log; the layout stays that of the source."""
    log = keep(read(spark, source))
    if "seg" in log.columns:
        log.repartition("seg").sortWithinPartitions("seq").write.mode("errorifexists").partitionBy("seg").parquet(target)
    else:
        write(log, target)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """Member paths of a text file, without lines that begin with #."""
    lines = spark.read.text(path).select(F.trim("value").alias("path"))
    return lines.where((F.col("path") != "") & ~F.col("path").startswith("#"))


def write_keys(keys: DataFrame, path: str) -> None:
    keys.select("key").write.mode("errorifexists").text(path)


def bytes_on_disk(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of all files below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))
