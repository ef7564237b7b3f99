"""Events as bytes: payload, framed record and index row, all big-endian."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldlog.functions.checksum import fnv1a64

PUT_CODE, DELETE_CODE = 1, 2


def _i64(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x.cast("long")), 16, "0"))


def _i32(x: Column) -> Column:
    return F.unhex(F.lpad(F.right(F.hex(x.cast("long")), F.lit(8)), 8, "0"))


def _read(data: Column, at: Column | int, width: int) -> Column:
    """A signed number of 4 or 8 bytes at an offset."""
    start = (F.lit(at) if isinstance(at, int) else at) + 1
    unsigned = F.hex(F.substring(data, start.cast("int"), F.lit(width)))
    if width == 8:
        return F.conv(unsigned, 16, -10).cast("long")
    plain = F.conv(unsigned, 16, 10).cast("long")
    return F.when(plain >= 1 << 31, plain - (1 << 32)).otherwise(plain)


def payload(seq: Column, ts_ms: Column, op: Column, key: Column, body: Column) -> Column:
    """seq, ts, type, key length, body length, key, body. A delete has no body."""
    key = F.coalesce(key.cast("binary"), F.lit(b""))
    body = F.when(op == "PUT", F.coalesce(body.cast("binary"), F.lit(b""))).otherwise(F.lit(b""))
    code = F.when(op == "PUT", PUT_CODE).otherwise(DELETE_CODE)
    return F.concat(_i64(seq), _i64(ts_ms), _i32(code), _i32(F.octet_length(key)), _i32(F.octet_length(body)), key, body)


def event(data: Column, strict: bool = True) -> Column:
    """A payload as struct of seq, ts_ms, op, key, body. An unknown type raises, or (not strict) reads as a delete."""
    code, keys, bodies = _read(data, 16, 4), _read(data, 20, 4), _read(data, 24, 4)
    other = F.raise_error(F.concat(F.lit("unknown event type "), code.cast("string"))).cast("string") if strict else F.lit("DELETE")
    op = F.when(code == PUT_CODE, "PUT").when(code == DELETE_CODE, "DELETE").otherwise(other)
    body = F.substring(data, (keys + 29).cast("int"), bodies.cast("int"))
    return F.struct(
        _read(data, 0, 8).alias("seq"), _read(data, 8, 8).alias("ts_ms"), op.alias("op"),
        F.substring(data, F.lit(29), keys.cast("int")).cast("string").alias("key"), F.when(code == PUT_CODE, body).alias("body"),
    )


def frame(data: Column) -> Column:
    """A payload with its length and checksum in front."""
    return F.concat(_i32(F.octet_length(data)), _i64(fnv1a64(data)), data)


def frame_is_whole(record: Column) -> Column:
    """Whether length and checksum of a framed record agree with its payload."""
    data = F.substring(record, F.lit(13), F.octet_length(record))
    return (_read(record, 0, 4) == F.octet_length(data)) & (_read(record, 4, 8) == fnv1a64(data))


def index_row(seq: Column, offset: Column) -> Column:
    """Checksum, seq, offset; the checksum is that of the row with zeroes in its place."""
    rest = F.concat(_i64(seq), _i64(offset))
    return F.concat(_i64(fnv1a64(F.concat(F.lit(bytes(8)), rest))), rest)


def index_entry(row: Column) -> Column:
    """An index row as struct of seq, offset and whether its checksum holds."""
    rest = F.substring(row, F.lit(9), F.lit(16))
    whole = _read(row, 0, 8) == fnv1a64(F.concat(F.lit(bytes(8)), rest))
    return F.struct(_read(row, 8, 8).alias("seq"), _read(row, 16, 8).alias("offset"), whole.alias("whole"))
