"""State from a log: the last write of each key wins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_writes(log: DataFrame) -> DataFrame:
    """The last event of each key. Partial sums make one row a key before the shuffle, so hot keys don't matter."""
    last = log.groupBy("key").agg(F.max_by(F.struct("op", "ts_ms", "body"), "seq").alias("e"), F.max("seq").alias("seq"))
    return last.select("key", "seq", "e.op", "e.ts_ms", "e.body")


def live_state(log: DataFrame, key: Column | None = None, body: Column | None = None) -> DataFrame:
    """Live keys with sequence and body; ``key`` and ``body`` decode them to what the caller works with."""
    rows = last_writes(log).where("op = 'PUT'")
    return rows.select((F.col("key") if key is None else key).alias("key"), "seq", (F.col("body") if body is None else body).alias("body"))


def merge_state(state: DataFrame, events: DataFrame) -> DataFrame:
    """State (key, seq, op, ts_ms, body; tombstones included) with later events: higher or equal sequences win."""
    cols = ["key", "seq", "op", "ts_ms", "body"]
    both = state.select(*cols, F.lit(0).alias("later")).unionByName(events.select(*cols, F.lit(1).alias("later")))
    last = both.groupBy("key").agg(F.max_by(F.struct(*cols[1:]), F.struct("seq", "later")).alias("e"))
    return last.select("key", "e.*")


def get(state: DataFrame, key: str) -> DataFrame:
    return state.where(F.col("key") == key)


class RequestHandler(Protocol):
    """What a caller applies events with."""

    def handle_put(self, seq: int, key: str, body) -> None: ...

    def handle_delete(self, seq: int, key: str) -> None: ...


def apply_handler(log: DataFrame, handler: Callable[[], RequestHandler], partitions: int | None = None) -> DataFrame:
    """Run a handler over the last event of each key, in parallel; errors become rows, they don't end the job."""
    last = last_writes(log)
    last = last.repartition(partitions, "key") if partitions else last

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        own = handler()
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                error = None
                try:
                    own.handle_put(int(r.seq), r.key, r.body) if r.op == "PUT" else own.handle_delete(int(r.seq), r.key)
                except Exception as e:  # a handler's failure is a result
                    error = f"{type(e).__name__}: {e}"
                out.append((r.key, int(r.seq), "error" if error else "ok", error))
            yield pd.DataFrame(out, columns=["key", "seq", "status", "error"])

    return last.mapInPandas(run, "key string, seq long, status string, error string")


def replay_counts(results: DataFrame) -> DataFrame:
    """How many events were applied and failed."""
    return results.agg(F.count_if(F.col("status") == "ok").alias("applied"), F.count_if(F.col("status") == "error").alias("failed"))
