"""The folder that driver and executors share, and tables kept there for the length of a job."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Folders written by the functions under :func:`tidy` that run just now, innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session without one (tests) gets a temporary folder."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not known:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(known)
    return known


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions that write tables on the way to their result: what the result doesn't read is deleted at the end."""

    @functools.wraps(f)
    def run(*args, **options) -> DataFrame:
        _open.append([])
        try:
            out = f(*args, **options)
        finally:
            mine = _open.pop()
        read = "\n".join(out.inputFiles()) if mine else ""
        for path in mine:
            if os.path.basename(path) in read:
                if _open:  # the function that called this one may be done with it at its own end
                    _open[-1].append(path)
            else:
                removed(out.sparkSession, path)
        return out

    return run


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless their PYTHONPATH has it: its functions run there by name."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    if getattr(context, "_package_shipped", False):
        return
    context._package_shipped = True
    if str(root) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        base = Path(tempfile.mkdtemp(prefix="package-")) / "package"
        context.addPyFile(shutil.make_archive(str(base), "zip", root, Path(__file__).resolve().parents[1].name))
