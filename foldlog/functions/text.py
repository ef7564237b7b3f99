"""Names, addresses, formats and results as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of node addresses.
SYSTEM, PORT, PATH = "log-system", 2552, "/user/log"


def full_address(name: Column, system: str = SYSTEM, port: int = PORT, path: str = PATH) -> Column:
    """The address of a short node name, ``host`` or ``host:port``, with an optional ``system@`` and path.

    Full addresses and local paths stay as they are; what can't be read is null.
    """
    shape = r"^(?:([A-Za-z0-9_-]+)@)?([A-Za-z0-9_.-]+)(?::([0-9]+))?(/[^\s]*)?$"
    part = lambda i, default: F.when(F.regexp_extract(name, shape, i) == "", default).otherwise(F.regexp_extract(name, shape, i))
    built = F.concat(F.lit("akka://"), part(1, system), F.lit("@"), F.regexp_extract(name, shape, 2), F.lit(":"), part(3, str(port)), part(4, path))
    return F.when(name.rlike(r"^akka(\.[a-z.]+)?://\S+$") | name.rlike(r"^/\S+$"), name).when(name.rlike(shape), built)


def with_transport(address: Column, secure: bool = False) -> Column:
    """The address with its transport named in the scheme."""
    return F.regexp_replace(address, "^akka://", "akka.ssl.tcp://" if secure else "akka.tcp://")


def base_name(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def event_line(template: str = "%d %d %s %s") -> Column:
    """An event as a line of text."""
    return F.format_string(template, F.col("seq"), F.col("ts_ms"), F.col("op"), F.col("key"))


def replay_url(host: str, key: Column, backend: str = "backend") -> Column:
    return F.concat(F.lit(f"{host}/{backend}/"), key)


def metric_name(system: Column, host: Column, port: Column, path: Column, kind: Column) -> Column:
    """The object name of a metric."""
    local = F.concat(F.lit("path="), path, F.lit(",node="), F.concat(system, F.lit("-"), host, F.lit("-"), port.cast("string")), F.lit(",name="), kind)
    return F.concat(F.lit("metrics:"), local)


def result(value: Column, error: Column) -> Column:
    """A result as struct of status (``ok``, ``none`` or ``error``), value and error."""
    status = F.when(error.isNotNull(), "error").when(value.isNull(), "none").otherwise("ok")
    return F.struct(status.alias("status"), F.when(error.isNull(), value).alias("value"), error.alias("error"))


def as_number(value: Column, kind: str = "int", strict: bool = True) -> Column:
    """A configuration value as a number: raises, or (not strict) gives null, if it is none."""
    return value.cast(kind) if strict else value.try_cast(kind)
