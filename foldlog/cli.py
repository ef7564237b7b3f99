"""Command line over logs kept as Parquet tables: python -m foldlog.cli COMMAND ..."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldlog.functions import text
from foldlog.operators import compaction, filters, keys
from foldlog.operators import log as scans
from foldlog.sources import tables

WEEK_MS = 7 * 24 * 3_600_000


def _show(log: DataFrame) -> None:
    for row in log.orderBy("seq").select(text.event_line().alias("line")).toLocalIterator():
        print(row["line"])


def _compact(log: DataFrame, now_ms: int, age_ms: int) -> DataFrame:
    """A single log by its own rule, a segmented one segment against segment."""
    if "seg" in log.columns:
        return compaction.segmented(log, now_ms - age_ms)
    return compaction.single_log(log, compaction.single_cutoff(now_ms, age_ms))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="foldlog", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, *arguments: str, **options) -> None:
        p = sub.add_parser(name)
        for a in arguments:
            whole = a.endswith(":int")
            p.add_argument(a.removesuffix(":int"), type=int if whole else str)
        for o, default in options.items():
            p.add_argument("--" + o.replace("_", "-"), type=type(default), default=default)
        p.set_defaults(run=run)

    keep = lambda f: lambda spark, a: tables.filtered(spark, a.source, a.target, lambda log: f(log, a))
    listed = lambda f: lambda spark, a: tables.write_keys(f(tables.read(spark, a.source), a), a.target)
    command("is-segmented", lambda spark, a: print(tables.is_segmented(spark, a.source)), "source")
    command("next-seq", lambda spark, a: print(scans.bounds(tables.read(spark, a.source)).first()["next_seq"]), "source")
    command("range", lambda spark, a: _show(scans.seq_range(tables.read(spark, a.source), a.start, a.end)), "start:int", "end:int", "source")
    command("tail", lambda spark, a: _show(scans.tail(tables.read(spark, a.source), a.n)), "source", n=20)
    command("compact", lambda spark, a: tables.filtered(spark, a.source, a.target, lambda log: _compact(log, a.now, a.age)), "source", "target", now=int(time.time() * 1000), age=WEEK_MS)
    command("key-filter", keep(lambda log, a: filters.key_matches(log, a.pattern)), "pattern", "source", "target")
    command("key-filter-not", keep(lambda log, a: filters.key_matches_not(log, a.pattern)), "pattern", "source", "target")
    command("key-filter-deletes-not-older-than", keep(lambda log, a: filters.without_old_deletes(log, a.ts)), "ts:int", "source", "target")
    command("key-filter-puts-not-older-than", keep(lambda log, a: filters.without_old_puts(log, a.pattern, a.ts)), "pattern", "ts:int", "source", "target")
    command("key-list", listed(lambda log, a: keys.live(log)), "source", "target")
    command("key-list-filter", listed(lambda log, a: keys.live_matching(log, a.pattern)), "pattern", "source", "target")
    command("key-list-filter-puts-older-than", listed(lambda log, a: keys.with_old_puts(log, a.pattern, a.ts)), "pattern", "ts:int", "source", "target")
    command("convert-to-segmented", lambda spark, a: tables.convert(spark, a.source, a.target, a.size), "source", "target", size=tables.PER_SEGMENT)
    command("convert-to-single", lambda spark, a: tables.convert(spark, a.source, a.target, None), "source", "target")
    command("init-segmented", lambda spark, a: tables.init_segmented(spark, a.target), "target")
    command("compact-segments", lambda spark, a: print(*tables.compact_segments(spark, a.source)), "source")
    command("status", _status, "source")
    return top


def _status(spark: SparkSession, a) -> None:
    """Bounds of a log, its bytes, and its segments."""
    log = tables.read(spark, a.source)
    print(scans.bounds(log).first().asDict() | tables.bytes_on_disk(spark, a.source).first().asDict())
    if "seg" in log.columns:
        for row in tables.manifest(spark, a.source).orderBy("seg").toLocalIterator():
            print(row.asDict())


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    chosen = parser().parse_args(args)
    chosen.run(spark or SparkSession.builder.getOrCreate(), chosen)


if __name__ == "__main__":
    main()
