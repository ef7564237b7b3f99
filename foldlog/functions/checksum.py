"""FNV-1a in 64 bits, as a column expression and as an Arrow batch function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of FNV-1a: the offset basis and the prime, which is 2^40 + 435.
BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3
_LOW = 0xFFFFFFFF


def fnv1a64(data: Column) -> Column:
    """Signed checksum of a binary column. The state is kept in two halves of 32 bits, so nothing overflows."""
    places = F.sequence(F.lit(1), F.greatest(F.octet_length(data), F.lit(1)))
    octets = F.transform(places, lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    start = F.struct(F.lit(BASIS >> 32).cast("long").alias("hi"), F.lit(BASIS & _LOW).cast("long").alias("lo"))

    def step(state: Column, octet: Column) -> Column:
        x = state["lo"].bitwiseXOR(octet)
        low = x * 435
        high = state["hi"] * 435 + F.shiftrightunsigned(low, 32) + F.shiftleft(x, 8)
        return F.struct(high.bitwiseAND(F.lit(_LOW)).alias("hi"), low.bitwiseAND(F.lit(_LOW)).alias("lo"))

    full = F.aggregate(octets, start, step, lambda s: F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"]))
    basis = F.lit(BASIS - (1 << 64)).cast("long")
    return F.when(F.octet_length(data) == 0, basis).when(data.isNotNull(), full)


def fnv1a64_of(data: bytes) -> int:
    """Signed checksum of bytes."""
    h = BASIS
    for octet in data:
        h = ((h ^ octet) * PRIME) & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


def fnv1a64_batch(values: pd.Series) -> pd.Series:
    """Checksums of a batch: one numpy step for each byte position, over all rows that are so long."""
    known = values.notna().to_numpy()
    rows = [bytes(v) for v in values[known]]
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    sizes = np.array([len(rows[i]) for i in order], np.int64)
    flat = np.frombuffer(b"".join(rows[i] for i in order), np.uint8).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    h = np.full(len(rows), BASIS, np.uint64)
    for at in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -at, side="left"))  # rows longer than at
        h[:n] = (h[:n] ^ flat[starts[:n] + at]) * np.uint64(PRIME)
    out = np.empty(len(rows), np.int64)
    out[order] = h.view(np.int64)
    result = pd.Series(pd.array([None] * len(values), dtype="Int64"), index=values.index)
    result[known] = out
    return result


def fnv1a64_arrow(data: Column) -> Column:
    """The same checksum for long bodies, by a pandas function."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield fnv1a64_batch(values)

    return run(data)
