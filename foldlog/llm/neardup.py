"""Near-duplicate classes by DartMinHash signatures, banding and exact verification.

Elements are shingles of five words; an element's weight is how often the text has it (weighting ``count``; with
``set`` every weight is 1). Every element owns regions of (weight x rank); hashed darts fall into them as a Poisson
process along the rank, so two texts see the same darts in what they share. Of the darts that fall below an element's
weight the earliest of each coordinate is kept: equal coordinates estimate the weighted Jaccard similarity, the sum of
the smaller weights over the sum of the larger ones. A text throws about k ln k + 2k darts whatever its size.

Flow: one pass over the texts gives each document a digest of its words (equal digests: exact copies) and a
signature. Distinct digests are banded. In a bucket of up to SMALL members all pairs are candidates; in a larger one
every member is paired with a hub, the member closest to most, verified and joined into components. Members of buckets that hold several
components even then are compared by an exact prefix-filter join over their elements, rarest first, so no pair of them
is left out. Candidates are verified by exact weighted similarity; classes are connected components. Classes are what is
returned, not links: within a group of copies these would be all pairs.

Nothing whole goes through one task or the driver: groups are aggregated before they are joined, hot keys only take
part in joins that the engine can split, and components are found by passing smallest labels along edges.

Defined cases: null and empty texts have no words and each such row is a class of its own; texts of one to four
words have one shingle; very long texts are hashed in blocks; a class is named by its smallest id (null ids only if
all its ids are null); ties between ids go by the text; repeated rows are exact copies; an empty table gives an empty
table; other columns are unused, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlog.llm.common import WORD_BYTES, components, map_texts, quoted, rows_of, shared_dir, sized, tidy, unused, written

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
COORDS = BANDS * ROWS
SMALL = 8
#: Size of the bitmap that tells which texts verification needs: one megabyte, whatever the input.
BITS = 1 << 23
#: Estimated similarity under which a candidate isn't verified: four standard deviations below the threshold.
ESTIMATE_SLACK = 4.0

_BLOCK = 1 << 20
_U = np.uint64
_POWERS = np.random.default_rng(7).integers(1, 1 << 63, 1 << 12, dtype=np.uint64) | _U(1)
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[32] = 0
_FOLD = _U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(spaced: bytes) -> np.ndarray:
    """A hash of each word of a text whose separators are spaces. Long texts go block by block, cut at spaces."""
    parts, at = [], 0
    while at < len(spaced):
        to = len(spaced) if at + _BLOCK >= len(spaced) else (spaced.rfind(b" ", at, at + _BLOCK) + 1 or spaced.find(b" ", at) + 1 or len(spaced))
        to = to if to > at else (spaced.find(b" ", at) + 1 or len(spaced))
        a = np.frombuffer(spaced, np.uint8, to - at, at)
        inside = a != 32
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = np.flatnonzero(first)
        if len(starts):
            offset = np.arange(len(a), dtype=np.int64)
            offset[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(a))))
            terms = _BYTES[a] * _POWERS[offset & 4095]
            parts.append(mixed(np.add.reduceat(terms, starts)))
        at = to
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def elements(text: str | None, weighting: str = "count") -> tuple[bytes | None, np.ndarray, np.ndarray]:
    """Digest of the words, the sorted distinct element ids, and their weights."""
    spaced = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES)
    words = _word_hashes(spaced)
    if not len(words):
        return None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    digest = hashlib.blake2b(b" ".join(spaced.split()), digest_size=16).digest()
    width = min(SHINGLE_WORDS, len(words))
    keys = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        keys = keys * _FOLD + words[i : len(words) - width + 1 + i]
    ids, counts = np.unique(mixed(keys), return_counts=True)
    return digest, ids, counts if weighting == "count" else np.ones_like(counts)


def expanded(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sorted ids with one of its own for each unit of weight: the shared ones of two texts sum up the smaller weights."""
    if weights.max(initial=0) <= 1:
        return ids
    copy = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
    return np.unique(np.where(copy == 0, np.repeat(ids, weights), mixed(np.repeat(ids, weights) + copy.astype(np.uint64) * _U(0xD1342543DE82EF95))))


def signature(ids: np.ndarray, weights: np.ndarray | None = None, k: int = COORDS) -> np.ndarray:
    """Keys (uint64) of the earliest dart of each of ``k`` coordinates. ``weights``: 1 for each element if not given."""
    total = float(len(ids)) if weights is None else float(weights.sum())
    limit = (k * math.log(k) + 2 * k) / total
    while True:
        ranks, keys = _darts(ids, weights, limit)
        spot = (mixed(keys ^ _U(0xA5A5A5A5A5A5A5A5)) % _U(k)).astype(np.int64)
        order = np.argsort(-ranks, kind="stable")
        best = np.full(k, -1, np.int64)
        best[spot[order]] = order  # the last one written is the earliest
        if (best >= 0).all():
            return keys[best]
        limit *= 2


def _darts(ids: np.ndarray, weights: np.ndarray | None, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """All darts up to a rank: ranks and keys. The weights of an element are cut into slabs [0,1), [1,2), [2,4), ..."""
    ranks, keys = [], []
    top = 1.0 if weights is None else float(weights.max())
    low, slab = 0.0, 0
    while low < top:
        high = 1.0 if slab == 0 else 2.0 * low
        mine = ids if weights is None else ids[weights > low]
        bound = None if weights is None else weights[weights > low]
        seeds = mixed(mine ^ mixed(np.array([slab + 1], np.uint64)))
        wide = high - low
        for at, (rank, key, who) in _arrivals(seeds, wide, limit):
            if bound is not None:
                height = low + wide * (mixed(key ^ _U(0x0F0F0F0F0F0F0F0F)) >> _U(11)).astype(np.float64) / float(1 << 53)
                keep = height < bound[who]
                rank, key = rank[keep], key[keep]
            ranks.append(rank)
            keys.append(key)
        low, slab = high, slab + 1
    return np.concatenate(ranks), np.concatenate(keys)


def _arrivals(seeds: np.ndarray, wide: float, limit: float):
    """Poisson arrivals of each seed up to ``limit``: (round, (rank, key, index of the seed))."""
    who, base, at = np.arange(len(seeds)), np.zeros(len(seeds)), 0
    floor = math.exp(-limit * wide)
    while len(who):
        step = 1 if limit * wide < 0.7 else min(64 + int(limit * wide), max(1, 200_000 // len(who)))
        drawn = mixed(seeds[who][:, None] + (np.arange(at + 1, at + step + 1, dtype=np.uint64) * _FOLD)[None, :])
        u = ((drawn >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)
        if step == 1:  # most have no dart at all: no logarithm is needed to see that
            some = u[:, 0] >= floor
            who, base, drawn, u = who[some], base[some], drawn[some], u[some]
        gaps = -np.log(u) / wide
        gaps[:, 0] += base
        rank = np.cumsum(gaps, axis=1)
        row, col = np.nonzero(rank <= limit)
        yield at, (rank[row, col], drawn[row, col], who[row])
        on = rank[:, -1] <= limit
        who, base, at = who[on], rank[on, -1], at + step


DIGEST = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType())])
SETS = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType()))])


def digests(docs: DataFrame, id_col: str, text_col: str, weighting: str) -> DataFrame:
    """For each row: id, digest of the words and signature (16 bits a coordinate). Both null without words."""

    def one(text):
        digest, ids, weights = elements(text, weighting)
        if digest is None:
            return None, None
        return digest, signature(ids, weights if weights.max() > 1 else None).astype(">u2").tobytes()

    return map_texts(docs, [id_col], text_col, lambda: lambda texts: rows_of(2, [one(t) for t in texts]), DIGEST)


def element_sets(docs: DataFrame, text_col: str, weighting: str) -> DataFrame:
    """For each row: digest and elements, one for each unit of weight."""

    def one(text):
        digest, ids, weights = elements(text, weighting)
        return digest, expanded(ids, weights).view(np.int64)

    return map_texts(docs, [], text_col, lambda: lambda texts: rows_of(2, [one(t) for t in texts]), SETS)


def _band_keys(sig: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(sig, b * (2 * ROWS) + 1, F.lit(2 * ROWS))))


def _pairs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Some candidate pairs (a, b) of members (node, key), and the members of buckets over SMALL (node, key).

    A large bucket's hub is the member with the most company over all its large buckets: within a group of near copies
    that is a text close to most of them. Sizes and hubs are aggregated, with partial sums, and joined back, so no bucket
    has to fit in a task.
    """
    spark = members.sparkSession
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = written(spark, members.join(sized(written(spark, sizes, "buckets"), 48), "key"), "placed")
    listed = placed.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("all"))
    first = listed.select("all", F.posexplode("all").alias("i", "a"))
    within = first.select("a", F.explode(F.slice("all", F.col("i") + 2, SMALL)).alias("b"))
    large = placed.where(F.col("n") > SMALL).select("node", "key", "n")
    company = written(spark, large.groupBy("node").agg(F.sum("n").alias("company")), "company")
    hubs = large.join(sized(company, 48), "node").groupBy("key").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("hub"))
    star = large.join(sized(written(spark, hubs, "hubs"), 48), "key").where("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    return within.unionByName(star).distinct(), large.select("node", "key")


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose signatures agree often enough to be worth verifying."""
    sigs = nodes.select("node", "sig")
    both = pairs.join(sigs.withColumnsRenamed({"node": "a", "sig": "sig_a"}), "a").join(sigs.withColumnsRenamed({"node": "b", "sig": "sig_b"}), "b")
    least = SIMILARITY - ESTIMATE_SLACK * math.sqrt(SIMILARITY * (1 - SIMILARITY) / COORDS)
    places = F.sequence(F.lit(0), F.lit(COORDS - 1))
    equal = F.size(F.filter(places, lambda i: F.substring("sig_a", i * 2 + 1, F.lit(2)) == F.substring("sig_b", i * 2 + 1, F.lit(2))))
    return both.where(equal >= least * COORDS).select("a", "b")


def likely_among(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id may be one of ``ids`` (its only column): a bitmap of BITS bits, at most, is all that is broadcast."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS)) + 1
    bucket, bits, own = unused(df, "bucket", "bits", "place")
    made = ids.select(place(F.col(ids.columns[0])).alias("p")).groupBy(F.bitmap_bucket_number("p").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(bits))
    at = F.bitmap_bit_position(quoted(own))
    octet = F.conv(F.hex(F.substring(quoted(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = df.withColumn(own, place(quoted(id_col))).join(F.broadcast(made), F.bitmap_bucket_number(quoted(own)) == quoted(bucket))
    bit = F.floor(octet / F.pow(F.lit(2), at % 8)) % 2
    return joined.where(bit == 1).select(*[quoted(c) for c in df.columns])


def _sets(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, weighting: str) -> DataFrame:
    """Elements (node, shingles) of the wanted nodes (node); only their texts are read whole."""
    known = written(docs.sparkSession, nodes.join(wanted, "node", "left_semi").select("node", "digest", "doc"), "wanted")
    texts = docs.select(quoted(id_col).alias("doc"), quoted(text_col).alias("text"))
    few = likely_among(texts, known.select("doc"), "doc")
    # Several texts may have the id (or no id): the digest tells which one is meant.
    sets = element_sets(few, "text", weighting).where(F.col("digest").isNotNull())
    return written(docs.sparkSession, sets.join(sized(known.select("digest", "node"), 64), "digest").dropDuplicates(["node"]).select("node", "shingles"), "shingles")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of at least the given exact similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _prefix_pairs(sets: DataFrame, joined: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) in different components that can be as similar as that: they share an element of their prefixes.

    With the elements in one order, rarest first, a set of n elements meets one no smaller among its first
    n - 2s/(1+s) n + 1, and one no larger among its first n - s n + 1. What a frame of many sets repeats comes last.
    Elements that one set alone has fill its prefix and join nothing. A pair is made only where enough elements are left
    on both sides for a match (positional filter): this holds at the first element that a match shares.
    """
    spark = sets.sparkSession
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("element"))
    counts = each.groupBy("element").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    listed = each.join(counts, "element").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "element"))).alias("all"))
    length = lambda share: (F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("all"))).cast("int")
    cut = listed.withColumns({"probed": length(similarity), "indexed": length(2 * similarity / (1 + similarity))}).where("probed > 0")
    names = joined.select("node", F.col("label.node").alias("name"))
    alone = (F.col("n") - F.size("all")).alias("alone")
    cut = cut.select("node", "n", "indexed", alone, F.slice("all", F.lit(1), F.col("probed")).alias("all")).join(names, "node", "left").withColumn("name", F.coalesce("name", "node"))
    first = cut.select("node", "n", "name", "indexed", "alone", F.posexplode("all").alias("i", "x"))
    left = (F.col("n") - F.col("alone") - F.col("i")).alias("left")
    first = written(spark, first.select("node", "n", "name", (F.col("i") < F.col("indexed")).alias("indexed"), left, "x.element"), "prefixes")
    some = first.groupBy("element").agg(F.min("name").alias("least"), F.max("name").alias("most"), F.max("indexed").alias("any")).where("least != most AND any").select("element")
    met = first.join(some, "element", "left_semi")
    large, small = met.select("element", *[F.col(c).alias(f"{c}_x") for c in ("node", "n", "name", "left")]), met.where("indexed").drop("indexed")
    enough = F.least("left", "left_x") >= F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("n_x")) - 1e-9
    both = large.join(small, "element").where((F.col("name_x") != F.col("name")) & (F.struct("n_x", "node_x") > F.struct("n", "node")) & (F.col("n") >= F.lit(similarity) * F.col("n_x") - 1e-9) & enough)
    return both.select(F.least("node", "node_x").alias("a"), F.greatest("node", "node_x").alias("b")).distinct()


@tidy
def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weighting: str = "count", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs``: its id, ``class_id`` (smallest id of its class) and ``representative``."""
    spark = docs.sparkSession
    shared_dir(spark)
    rows = written(spark, digests(docs, id_col, text_col, weighting).select(quoted(id_col).alias("doc"), "digest", "sig"), "digests")
    with_words = rows.where(F.col("digest").isNotNull())
    nodes = with_words.groupBy("digest").agg(F.min("doc").alias("doc"), F.first("sig").alias("sig"))
    nodes = written(spark, nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # once written, numbers stay
    labels = nodes.select("node", F.struct("doc", "node").alias("label"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        return _sets(wanted, docs, nodes, id_col, text_col, weighting)

    def links(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        likely = written(spark, _estimated(pairs, nodes), "candidates")
        sets = sets_of(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()) if sets is None else sets
        return written(spark, _verified(likely, sets, similarity), "links")

    def joined_by(edges: DataFrame) -> DataFrame:
        ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        return components(spark, edges, labels.join(ends, "node", "left_semi"))

    # One order for all buckets: a group meets few hubs, and often the same ones.
    pairs, large = _pairs(nodes.select("node", F.explode(_band_keys(F.col("sig"))).alias("key")))
    edges = links(pairs)
    joined = joined_by(edges)
    # Large buckets that hold several components so far: their members are compared by their elements.
    now = large.join(sized(joined.select("node", F.col("label.node").alias("name")), 48), "node", "left").withColumn("name", F.coalesce("name", "node"))
    several = now.groupBy("key").agg(F.min("name").alias("least"), F.max("name").alias("most")).where("least != most").select("key")
    left = written(spark, large.join(sized(written(spark, several, "several"), 32), "key", "left_semi").select("node").distinct(), "left")
    if left.limit(1).count():
        sets = sets_of(left)
        edges = edges.unionByName(links(_prefix_pairs(sets, joined, similarity), sets))
        joined = joined_by(edges)
    class_id = F.when(F.col("label").isNotNull(), F.col("label.doc")).otherwise(F.col("doc"))
    named = written(spark, nodes.select("digest", "doc", "node").join(sized(joined, 64), "node", "left").select("digest", class_id.alias("class_id")), "named")
    found = with_words.select("doc", "digest").join(sized(named, 64), "digest").select("doc", "class_id")
    # Rows without words are set aside: a join by the digest would bring them all together.
    alone = rows.where(F.col("digest").isNull()).select("doc", F.col("doc").alias("class_id"))
    return found.unionByName(alone).select(F.col("doc").alias(id_col), "class_id", F.col("doc").eqNullSafe(F.col("class_id")).alias("representative"))


@tidy
def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, and every row without words. All columns are kept.

    Rows of one id are told apart by nothing but their content: all of them stay if one is its class's
    representative, equal rows once.
    """
    spark = docs.sparkSession
    classes = written(spark, near_duplicate_classes(docs, id_col, text_col).toDF("id", "class_id", "representative"), "classes")
    stay = classes.groupBy("id").agg(F.max("representative").alias("stay"), F.count(F.lit(1)).alias("rows"))
    (own,) = unused(docs, "id")
    same = quoted(id_col).eqNullSafe(quoted(own))
    # What goes is joined, not what stays: these rows are fewer, and if a count shows that they are few no text is shuffled.
    left = docs.join(sized(stay.where(~F.col("stay")).select(F.col("id").alias(own)), 32), same, "left_anti")
    repeated = stay.where("stay AND rows > 1").select(F.col("id").alias(own))
    if repeated.limit(1).count():
        repeated = sized(repeated, 32)
        left = left.join(repeated, same, "left_anti").unionByName(left.join(repeated, same, "left_semi").dropDuplicates(docs.columns))
    return left
