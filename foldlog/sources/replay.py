"""Replaying a log to a service through a transport that the caller supplies."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

#: method, url, body -> status
Transport = Callable[[str, str, bytes | None], int]


def replay(log: DataFrame, host: str, transport: Callable[[], Transport], workers: int = 8, pause_s: float = 0.02, backend: str = "backend") -> DataFrame:
    """One result a request: seq, status (0 for an error of the transport) and milliseconds.

    Events of a key stay in order: keys are dealt out to the workers, each of which makes its own transport.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        send = transport()
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                began = time.monotonic()
                try:
                    body = r.body if r.op == "PUT" else None
                    status = int(send(r.op, f"{host}/{backend}/{r.key}", body.encode() if isinstance(body, str) else body))
                except OSError:
                    status = 0
                out.append((int(r.seq), status, int(1000 * (time.monotonic() - began))))
                time.sleep(pause_s)
            yield pd.DataFrame(out, columns=["seq", "status", "ms"])

    dealt = log.select("seq", "op", "key", "body").repartition(workers, "key").sortWithinPartitions("seq")
    return dealt.mapInPandas(run, "seq long, status int, ms long")
