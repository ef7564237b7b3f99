"""Ordered delivery as a stream: out-of-order events are held back until what is before them has come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Input: kind 'event' (a decision), 'part' (an event of a subrange) or 'range' (its end, in seq).
INPUT = "log string, arrival long, kind string, seq long, op string, key string, body string"
OUTPUT = "log string, position long, seq long, op string, key string, body string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Bridge(StatefulProcessor):
    """State of one log: the next sequence, how many events went out, and the events held back.

    An event below the next sequence, or one already held, is dropped: the first to come counts. A subrange moves the
    next sequence past its end, whatever it lacks, since compaction may have removed events for good.
    """

    def __init__(self, first_seq: int = 1):
        self.first_seq = first_seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "next long, sent long")
        self.held = handle.getMapState("held", "seq long", "op string, key string, body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        following, sent = map(int, self.at.get()) if self.at.exists() else (self.first_seq, 0)
        out: list[tuple] = []

        def emit(seq: int, op, k, body) -> None:
            nonlocal sent
            sent += 1
            out.append((key[0], sent, seq, op, k, body))

        whole = pd.concat(list(rows), ignore_index=True).sort_values("arrival", kind="stable")
        for r in whole.itertuples(index=False):
            seq = int(r.seq)
            if r.kind == "range":
                if seq >= following:
                    following = seq + 1
                    for old in [s for (s,) in self.held.keys() if s < following]:
                        self.held.removeKey((old,))
            elif seq < following:
                continue
            elif r.kind == "part":
                emit(seq, r.op, r.key, r.body)
                following = seq + 1
                continue  # what is held waits for the end of the range: the range may have left it out
            elif not self.held.containsKey((seq,)):
                self.held.updateValue((seq,), (r.op, r.key, r.body))
            while self.held.containsKey((following,)):
                emit(following, *self.held.getValue((following,)))
                self.held.removeKey((following,))
                following += 1
        self.at.update((following, sent))
        yield pd.DataFrame(out, columns=["log", "position", "seq", "op", "key", "body"])

    def close(self) -> None:
        pass


def ordered_delivery(stream: DataFrame, first_seq: int = 1) -> DataFrame:
    """Events of each log in order. Needs the RocksDB state store (``use_state_store``)."""
    return stream.groupBy("log").transformWithStateInPandas(Bridge(first_seq), OUTPUT, "Append", "None")


def use_state_store(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def live_apply(spark, log_path: str, state_path: str):
    """A function for ``foreachBatch``: appends the batch to the log first, then writes the next version of the state.

    Versions are folders by batch id; the latest complete one is the state. A batch that is run again writes the same
    version again, and its log folder is overwritten, so nothing is applied twice.
    """
    from foldlog.operators import state as S

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("seq", F.lit(0).cast("long").alias("ts_ms"), "op", "key", "body")
        rows.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
        events = spark.read.parquet(f"{log_path}/batch={batch_id}")
        before = spark.read.parquet(f"{state_path}/version={batch_id - 1}") if batch_id else S.last_writes(events.limit(0))
        S.merge_state(before, events).write.mode("overwrite").parquet(f"{state_path}/version={batch_id}")

    return apply
