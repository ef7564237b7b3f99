"""Helpers shared by the operators on text: table access, words, and a batched text mapper."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from foldlog.sources.shared import shared_dir, ship, tidy, written  # noqa: F401  (the operators take them from here)

#: A word of the licence and benchmark operators, once A-Z is lower-cased: a run of these characters.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of UTF-8 after lower-casing A-Z, with everything that separates words turned into a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)

#: Rows handed to a text function at once, so that Python objects of one slice are freed before the next.
SLICE_ROWS = 512

#: Most bytes of an Arrow batch sent to a text function, unless the session says otherwise. Spark's default, 10,000 rows,
#: lets a batch hold all texts of a task: a growing buffer in the JVM and one more in the Python worker, for each core.
BATCH_BYTES = 4 << 20

#: Bytes up to which a table is broadcast; beyond them the join shuffles.
BROADCAST_BYTES = 8 << 20

#: Bits, a power of two, of the bitmap that tells which rows a join with more than that can match: 2^20 words at most.
LIKELY_BITS = 1 << 26


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased where it matters: other letters may be lower-cased too, but none of them becomes a-z.

    ``lower`` is several times faster than ``translate``; only for two letters does it give ASCII ones.
    """
    special = text.contains("\u0130") | text.contains("\u212a")
    return F.when(special, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def word_string(text: Column, exact: bool = True) -> Column:
    """Words of a text, A-Z lower-cased, single spaces between them; empty for null.

    With ``exact`` false other letters may be lower-cased too (``ascii_lower``): their words' places stay the same.
    """
    text = F.coalesce(text, F.lit(""))
    lowered = F.translate(text, UPPER, LOWER) if exact else ascii_lower(text)
    return F.trim(F.regexp_replace(lowered, WORD_GAP, " "))


def is_small(df: DataFrame, row_bytes: int | Column = 64, most: int | None = None) -> bool:
    """Whether a table has few enough bytes to be broadcast. ``row_bytes``: a bound for each row, or its bytes."""
    most = BROADCAST_BYTES if most is None else most
    if isinstance(row_bytes, int):
        return df.limit(most // row_bytes + 1).count() <= most // row_bytes
    return (df.agg(F.sum(row_bytes + 64)).first()[0] or 0) <= most


def sized(df: DataFrame, row_bytes: int | Column = 64, most: int | None = None) -> DataFrame:
    """The same table, broadcast if it has few bytes (see is_small)."""
    return F.broadcast(df) if is_small(df, row_bytes, most) else df


def likely(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a column that is false where ``key`` is none of ``keys`` (its only column), and that column's name.

    All that is broadcast is a bitmap of LIKELY_BITS bits, as words of 64: where it is true an exact join has to follow,
    which then shuffles few other rows. The more keys, the less it tells apart; the result doesn't depend on that.
    """
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(LIKELY_BITS - 1))
    bit = lambda p: p.bitwiseAND(F.lit(63)).cast("int")
    word, mask, own, flag = unused(df, "word", "mask", "place", "likely")
    set_bit = F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("p")))
    made = keys.select(place(F.col(keys.columns[0])).alias("p")).groupBy(F.shiftright("p", 6).alias(word)).agg(F.bit_or(set_bit).alias(mask))
    joined = df.withColumn(own, place(key)).join(F.broadcast(made), F.shiftright(quoted(own), 6) == quoted(word), "left")
    found = F.call_function("shiftright", quoted(mask), bit(quoted(own))).bitwiseAND(F.lit(1)) == 1
    return joined.select(*[quoted(c) for c in df.columns], F.coalesce(found, F.lit(False)).alias(flag)), flag


def likely_rows(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Rows whose ``key`` may be one of ``keys`` (see likely)."""
    marked, flag = likely(df, key, keys)
    return marked.where(quoted(flag)).select(*[quoted(c) for c in df.columns])


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, changed where the table has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def components(spark: SparkSession, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Smallest label of each node's connected component. ``labels``: (node, label) of all nodes of ``edges`` (a, b).

    A label is a struct whose field ``node`` names the node it comes from.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other")
    both = written(spark, both.distinct(), "edges")
    while True:
        seen = both.join(sized(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), 64), "other").groupBy("node").agg(F.min("near").alias("near"))
        down = labels.join(sized(written(spark, seen, "seen"), 64), "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        down = written(spark, down, "labels")
        # Follow the new label one step further: the node it names may know a smaller one. Names are fewer than nodes.
        named = down.select(F.col("new.node").alias("name")).distinct()
        known = down.where(F.col("new.node") != F.col("node")).select(F.col("node").alias("name"), F.col("new").alias("further"))
        jump = down.join(sized(written(spark, known.join(named, "name", "left_semi"), "names"), 64), F.col("new.node") == F.col("name"), "left")
        after = written(spark, jump.select("node", F.least("new", F.coalesce("further", "new")).alias("next"), "label"), "labels")
        labels = after.select("node", F.col("next").alias("label"))
        if not after.where(F.col("next") != F.col("label")).limit(1).count():
            return labels


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to SLICE_ROWS rows and BATCH_BYTES bytes (one row at least) where the session has no setting."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", SLICE_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(most))


def map_texts(
    df: DataFrame,
    carry: Sequence[str],
    text_col: str,
    make: Callable[[], Callable[[list], Sequence[Sequence]]],
    out: T.StructType,
) -> DataFrame:
    """Apply a function on lists of texts, partition by partition, and add its output columns.

    ``make`` is called once in each task and gives a function from a list of texts (null: None) to one
    sequence for each field of ``out``. Columns in ``carry`` pass through unchanged, but for those whose
    names ``out`` also has: the new column takes their place.
    """
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    names = {f.name for f in out}
    keep = [c for c in dict.fromkeys(carry) if c not in names]
    fields = [df.schema[c] for c in keep]
    types = [to_arrow_type(f.dataType) for f in out]
    # Carried columns are addressed by position within tasks; their names there can't clash with anything. A text that is
    # carried as it is goes to Python once.
    at_text = next((i for i, c in enumerate(keep) if c == text_col and isinstance(fields[i].dataType, T.StringType)), len(keep))
    sent = [quoted(c).alias(f"c{i}") for i, c in enumerate(keep)]
    inner = df.select(*sent, *([quoted(text_col).cast("string").alias("text")] if at_text == len(keep) else []))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)] + list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            part = columns = arrays = None
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                columns = apply(part.column(at_text).to_pylist())
                arrays = [part.column(i) for i in range(len(keep))]
                arrays += [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
            del batch, part, columns, arrays  # before the next batch is read
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    made = inner.mapInArrow(run, schema)
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f.name) for f in out])


def rows_of(columns: int, results: list[tuple]) -> list[list]:
    """Turn a list of result tuples into columns, also when it is empty."""
    return [list(c) for c in zip(*results, strict=True)] if results else [[] for _ in range(columns)]
