"""Quality rules: counts of a text, and compression bands that reject repetitive or incompressible documents.

A text's zstandard ratio (compressed bytes over bytes) is compared with limits for its length, over the whole text and
over all its chunks of CHUNK_BYTES, the last one of whatever is left. Short pieces compress less than long ones, so each
length has limits of its own; chunks outside theirs may hold CHUNKS_OUTSIDE of the text's bytes.

Defined cases: null and empty texts have no words and fail; texts of any length are taken whole; repeated rows get
equal results; a ratio on a limit is inside; an empty table gives an empty table; input columns named like an output
column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foldlog.llm.common import map_texts, rows_of

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = b"#*$%&|<>"
LEVEL = 3
CHUNK_BYTES = 4096
#: Up to so many bytes: lowest and highest ratio of a whole text.
BANDS = ((256, 0.40, 1.10), (1024, 0.28, 0.90), (4096, 0.20, 0.80), (16384, 0.15, 0.75), (1 << 62, 0.12, 0.72))
#: The same for one chunk (a frame's header alone is some 10 bytes), and the share of bytes that may lie in chunks outside.
CHUNK_BANDS, CHUNKS_OUTSIDE = ((32, 0.0, 20.0), (128, 0.20, 1.45), (512, 0.20, 1.10), (2048, 0.18, 0.90), (CHUNK_BYTES, 0.15, 0.80)), 0.3

OUT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("ratio", T.DoubleType()),
    T.StructField("chunks_outside", T.DoubleType()),
])

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def repeated_words(words: list[bytes], width: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``width`` words that stand at two or more places."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    if len(numbers) == len(words):
        return 0
    ids = (ids + np.uint64(1)) * _P
    ids ^= ids >> np.uint64(29)
    keys = np.zeros(n, np.uint64)
    for i in range(width):
        keys = keys * _Q + ids[i : i + n]
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def outside(ratio: float, size: int, bands=BANDS) -> bool:
    low, high = next((low, high) for most, low, high in bands if size <= most)
    return not low <= ratio <= high


def measured(text: str | None, compressor: zstandard.ZstdCompressor) -> tuple:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    gaps = len(data) - len(data.translate(None, b" \t\n\v\f\r"))
    with_word = [x for x in data.split(b"\n") if x.strip()]
    repeated = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * n
    ratio = len(compressor.compress(data)) / len(data) if data else 0.0
    chunks = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
    bad = sum(len(x) for x in chunks if outside(len(compressor.compress(x)) / len(x), len(x), CHUNK_BANDS))
    share = bad / len(data) if data else 0.0
    kept = not failed and not outside(ratio, len(data)) and share <= CHUNKS_OUTSIDE
    return (n, len(text or "") - gaps, len(data) - len(data.translate(None, SYMBOLS)), len(with_word) - len(set(with_word)),
            repeated, failed, kept, ratio, share)


def quality(docs: DataFrame, carry: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Counts, ``base_failed``, ``kept``, ``ratio`` and ``chunks_outside`` for each document."""

    def make():
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        return lambda texts: rows_of(len(OUT), [measured(t, compressor) for t in texts])

    return map_texts(docs, carry, text_col, make, OUT)
