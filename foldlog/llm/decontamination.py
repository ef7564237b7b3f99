"""Benchmark decontamination with one Aho-Corasick automaton over the words of all benchmark items.

Both sides are normalised alike (A-Z lower-cased, runs of other ASCII characters become one space), each item is
cut into windows of consecutive words, and the windows form one automaton. A text is scanned once; hits come back
as word positions and as character offsets of the original text.

The windows travel to the executors in a broadcast whose size is bounded: at most ``max_windows`` at a time. A
larger benchmark is taken in blocks, one scan of the documents after another within the same job, so nothing is
dropped at any size.

Defined cases: a null or empty text has no words and no hits; an item without words has no windows; an item with
fewer words than a window is one window; windows of an item without id are hits but name no item; repeated items
count once, repeated rows each keep their own result; an empty benchmark or an empty table gives no hits; input
columns named like an output column are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlog.llm.common import WORD_BYTES, map_texts, quoted, rows_of, shared_dir, unused, word_string, written

WINDOW_WORDS = 10
MAX_WINDOWS = 50_000

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", SPANS),
    T.StructField("hit_chars", SPANS),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
])
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

_automata: dict[str, ahocorasick.Automaton] = {}


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW_WORDS) -> DataFrame:
    """One row for each distinct window: its words and the sorted ids (as strings) of the items that have it."""
    words = F.filter(F.split(word_string(quoted(text_col)), " "), lambda w: w != "")
    items = benchmark.select(quoted(id_col).cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    windows = items.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, size), " "))).alias("window"))
    return windows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _automaton(block) -> ahocorasick.Automaton:
    """The automaton of a block, built once in each Python worker."""
    key, windows = block.value
    if key not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton()
        for window, items in windows:
            made.add_word(" " + window.encode("utf-8").decode("latin-1") + " ", (window.count(" ") + 1, items))
        made.make_automaton()
        _automata[key] = made
    return _automata[key]


def _joined(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _scan(text: str | None, automaton: ahocorasick.Automaton) -> tuple:
    words = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
    if not words:
        return 0, [], [], []
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    spans, items, seen, gaps = [], set(), 0, 0
    for end, (n, ids) in automaton.iter(line):
        gaps += line.count(" ", seen, end + 1)
        seen = end + 1
        last = gaps - 1  # one past the window's last word: a space stands before each word, one after the last
        spans.append((last - n, last))
        items.update(ids)
    if not spans:
        return len(words), [], [], []
    spans = _joined(spans)
    places = [m.span() for m in WORD.finditer(text)]
    return len(words), spans, [(places[a][0], places[b - 1][1]) for a, b in spans], sorted(items)


def find_benchmark_text(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW_WORDS,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """Documents with ``n_words``, ``hit_words`` (word spans, end exclusive), ``hit_chars`` (the same places as
    offsets of the original text, in code points) and ``hit_items`` (sorted ids). ``carry`` names the columns kept."""
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, item_col, item_text_col, size)
    blocks = max(1, -(-windows.count() // max_windows))
    if blocks > 1:
        shared_dir(spark)
        windows = written(spark, windows, "windows")
    (seen,) = unused(docs, "earlier")
    out = None
    for k in range(blocks):
        mine = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k) if blocks > 1 else windows
        rows = [(r["window"], list(r["items"])) for r in mine.collect()]
        if not rows:
            continue
        block = spark.sparkContext.broadcast((f"{id(rows)}-{k}-{hash(tuple(w for w, _ in rows))}", rows))

        def make(block=block):
            automaton = _automaton(block)
            return lambda texts: rows_of(4, [_scan(t, automaton) for t in texts])

        if out is None:
            out = map_texts(docs, [*carry, text_col] if blocks > 1 else carry, text_col, make, FOUND)
        else:
            earlier = out.withColumn(seen, F.struct("hit_words", "hit_chars", "hit_items"))
            out = map_texts(earlier, [*carry, text_col, seen], text_col, make, FOUND)
            for name in ("hit_words", "hit_chars"):
                out = out.withColumn(name, F.array_sort(F.array_union(f"{seen}.{name}", name)))
            out = out.withColumn("hit_items", F.sort_array(F.array_union(f"{seen}.hit_items", "hit_items"))).drop(seen)
    if out is None:  # no windows at all
        block = spark.sparkContext.broadcast(None)

        def count():
            return lambda texts: rows_of(4, [(len((t or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()), [], [], []) for t in texts])

        return map_texts(docs, carry, text_col, count, FOUND)
    names = {f.name for f in FOUND}
    return out.select(*[quoted(c) for c in dict.fromkeys(carry) if c not in names], *[F.col(f.name) for f in FOUND])


def n_hit_words(spans: F.Column) -> F.Column:
    """Words covered by spans that may overlap (blocks of a large benchmark): each word counts once."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("to"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"),
        F.greatest(a["to"], s["end"]).alias("to"),
    )
    return F.aggregate(F.array_sort(spans), start, step, lambda a: a["n"]).cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, carry: Sequence[str] = ("doc_id",), **options) -> DataFrame:
    """The digest of :func:`find_benchmark_text`: counts, a hash of the items and the verdict."""
    found = find_benchmark_text(docs, benchmark, carry, **options)
    names = {f.name for f in FOUND} | {"n_hit", "n_items", "items_sha256", "contaminated"}
    return found.select(
        *[quoted(c) for c in dict.fromkeys(carry) if c not in names],
        "n_words",
        n_hit_words(F.col("hit_words")).alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
        "hit_chars",
    )
