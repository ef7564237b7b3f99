"""Framed record files and their indexes.

Files are read through Spark's own binary source, so any store that Spark can read will do, one file a task. Frames
vary in length: a file is cut into records in one pass over its bytes, checksums and fields are column expressions.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.functions import codec

HEADER = struct.Struct(">iq")
INDEX_WIDTH = 24


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data, at = memoryview(content.as_buffer()), 0
            places, records = [], []
            while at + HEADER.size <= len(data):
                size = HEADER.size + max(0, HEADER.unpack_from(data, at)[0])
                places.append(at)
                records.append(bytes(data[at : at + size]))
                at += size
                if len(records) == 4096 or at + HEADER.size > len(data):
                    yield pa.RecordBatch.from_pydict({"path": [path] * len(places), "offset": pa.array(places, pa.int64()), "record": pa.array(records, pa.binary())})
                    places, records = [], []


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """path, offset and bytes of each record."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_frames, "path string, offset long, record binary")


def read_events(spark: SparkSession, path: str, verify: bool = True, strict: bool = True) -> DataFrame:
    """The events of record files. With ``verify`` a record whose checksum doesn't hold raises."""
    records = read_frames(spark, path)
    good = F.when(codec.frame_is_whole(F.col("record")), F.col("record"))
    broken = F.raise_error(F.concat(F.lit("checksum of the record at "), F.col("path"), F.lit(":"), F.col("offset").cast("string"))).cast("binary")
    record = good.otherwise(broken) if verify else F.col("record")
    events = records.select("offset", record.alias("record")).select("offset", codec.event(F.substring("record", F.lit(13), F.octet_length("record")), strict).alias("e"))
    return events.select("e.*", "offset")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """seq and offset of index files; a row whose checksum doesn't hold raises."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    n = F.floor(F.octet_length("content") / INDEX_WIDTH)
    rows = F.transform(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.substring("content", i * INDEX_WIDTH + 1, F.lit(INDEX_WIDTH)))
    entries = files.select("path", F.explode(rows).alias("row")).select("path", codec.index_entry(F.col("row")).alias("x"))
    checked = F.when(F.col("x.whole"), F.col("x.seq")).otherwise(F.raise_error(F.concat(F.lit("checksum of an index row in "), F.col("path"))).cast("long"))
    return entries.select(checked.alias("seq"), F.col("x.offset").alias("offset"))


def framed(log: DataFrame) -> DataFrame:
    """``record`` and ``index_row`` of each event, given its ``offset``."""
    data = codec.payload(F.col("seq"), F.col("ts_ms"), F.col("op"), F.col("key"), F.col("body"))
    return log.select("seq", "offset", codec.frame(data).alias("record"), codec.index_row(F.col("seq"), F.col("offset")).alias("index_row"))


def write_events(log: DataFrame, folder: str, seg_col: str = "seg") -> None:
    """Write each segment as ``<folder>/<seg>/data`` and ``index``. The folder has to be one that all executors share.

    A segment's events stream in order through the task that writes its files; files are put in place by a rename.
    """
    data = codec.payload(F.col("seq"), F.col("ts_ms"), F.col("op"), F.col("key"), F.col("body"))
    rows = log.select(F.col(seg_col).cast("long").alias("seg"), "seq", codec.frame(data).alias("record"))

    def put(partition) -> None:
        from foldlog.functions.checksum import fnv1a64_of

        open_seg, files, at = None, (), 0

        def close() -> None:
            for f in files:
                f.close()
                os.replace(f.name, f.name.removesuffix(".part"))

        for row in partition:
            if row["seg"] != open_seg:
                close()
                os.makedirs(f"{folder}/{row['seg']}", exist_ok=True)
                open_seg, at = row["seg"], 0
                files = tuple(open(f"{folder}/{open_seg}/{name}.part", "wb") for name in ("data", "index"))  # noqa: SIM115
            rest = struct.pack(">qq", row["seq"], at)
            files[0].write(row["record"])
            files[1].write(struct.pack(">q", fnv1a64_of(bytes(8) + rest)) + rest)
            at += len(row["record"])
        close()

    rows.repartition("seg").sortWithinPartitions("seg", "seq").foreachPartition(put)


def missing_from_index(data: DataFrame, index: DataFrame) -> DataFrame:
    """Records (seq, offset) written after the last one in the index: what a repair has to add."""
    last = index.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("__last"))
    return data.join(F.broadcast(last), F.col("seq") > F.col("__last")).select("seq", "offset")
