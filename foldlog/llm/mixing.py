"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (a value of each marginal: source, language, topic). Raking multiplies the cells by
target over current share, one marginal after the other, until all marginals agree with their targets. The raked
share of a cell, against its tokens, calibrates the probability with which its documents are sampled; probabilities
that would pass 1 are held there and the rest raised so that the expected tokens meet the budget.

Only cells are iterated over: documents are read twice, for the sums and for the draw, and never shuffled. Cells are
few (a product of categories); up to CELLS_TOGETHER of them are raked in one partition, more stay distributed.

Defined cases: null categories form a category of their own; null and empty texts have no tokens and the probability
of their cell; a target without tokens is left out and the others rescaled; a value without target has share 0 and is
never sampled; the draw depends on id and seed alone, so repeated rows fall alike; very long texts count whole, as any
other row; cells of one rate are held at 1 together; targets that can't be met together give the last round's weights
and a warning; empty tables give empty tables; input columns named like an output column are replaced by it.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlog.llm.common import LOWER, UPPER, ascii_lower, quoted, shared_dir, tidy, unused, written

NONE = "(none)"
ROUNDS, ROUNDS_TOGETHER, TOLERANCE = 40, 5, 1e-10
#: Gap between a marginal and its target beyond which the last round's weights come with a warning.
OFF_TARGET = 1e-6
CELLS_TOGETHER = 20_000


def n_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


#: Words that speak for a topic (fixed values; ties go to the topic named first).
TOPICS = {
    "law": ("license", "copyright", "contract", "court", "warranty", "regulation"),
    "computing": ("software", "algorithm", "database", "computer", "server", "internet"),
    "science": ("experiment", "theory", "molecule", "physics", "species", "planet"),
    "health": ("patient", "disease", "medicine", "hospital", "therapy", "symptom"),
    "economy": ("market", "finance", "invest", "company", "inflation", "export"),
    "society": ("government", "election", "school", "history", "religion", "football"),
}
OTHER = "other"


def topic(text: Column) -> Column:
    """The topic of which a text has most words of TOPICS, anywhere within its words; ``other`` without any."""
    low = ascii_lower(F.coalesce(text, F.lit("")))
    counts = {t: reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words]) for t, words in TOPICS.items()}
    most = F.greatest(*counts.values())
    out = F.lit(OTHER)
    for t in reversed(TOPICS):
        out = F.when(counts[t] == most, F.lit(t)).otherwise(out)
    return F.when(most == 0, F.lit(OTHER)).otherwise(out)


def cells_of(docs: DataFrame, marginals: Sequence[str], tokens_col: str) -> DataFrame:
    """Tokens of each cell, null categories named."""
    keys = [F.coalesce(quoted(m).cast("string"), F.lit(NONE)).alias(m) for m in marginals]
    cells = docs.select(*keys, quoted(tokens_col).alias("__tokens")).groupBy(*marginals).agg(F.coalesce(F.sum("__tokens"), F.lit(0)).cast("double").alias("__tokens"))
    cells = written(docs.sparkSession, cells, "cells")
    return cells.coalesce(1) if cells.count() <= CELLS_TOGETHER else cells


def tempered(cells: DataFrame, marginal: str, power: float) -> Column:
    """Target share of a value: its tokens to a power under 1, which raises what is rare."""
    tokens = F.sum("__tokens").over(Window.partitionBy(marginal))
    return F.when(tokens > 0, F.pow(tokens, F.lit(power))).otherwise(0.0)


def _stated(marginal: str, shares: Mapping[str, float]) -> Column:
    out = F.lit(0.0)
    for value, share in shares.items():
        out = F.when(F.col(marginal) == value, F.lit(float(share))).otherwise(out)
    return out


def with_targets(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]]) -> DataFrame:
    """``target_<marginal>`` for each cell, scaled to sum 1 over the values that have tokens."""
    out = cells
    for m, wanted in targets.items():
        raw = tempered(cells, m, wanted) if isinstance(wanted, (int, float)) else _stated(m, wanted)
        out = out.withColumn(f"__raw_{m}", F.when(F.sum("__tokens").over(Window.partitionBy(m)) > 0, raw).otherwise(0.0))
        sums = out.groupBy(m).agg(F.max(f"__raw_{m}").alias("r")).agg(F.sum("r").alias(f"__all_{m}"))
        out = out.join(F.broadcast(sums)).withColumn(f"target_{m}", F.coalesce(F.try_divide(f"__raw_{m}", f"__all_{m}"), F.lit(0.0))).drop(f"__raw_{m}", f"__all_{m}")
    return out


def rake(cells: DataFrame, marginals: Sequence[str], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells with ``weight``: shares whose marginals meet the targets (which need not be reachable: then the last round's)."""
    spark = cells.sparkSession
    shared_dir(spark)
    now = cells.withColumn("weight", F.col("__tokens"))
    for k in range(0, rounds, ROUNDS_TOGETHER):
        for _ in range(min(ROUNDS_TOGETHER, rounds - k)):
            for m in marginals:
                held = F.sum("weight").over(Window.partitionBy(m))
                now = now.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"target_{m}") / held).otherwise(0.0))
        now = written(spark, now, "raked")
        off = F.lit(0.0)
        gaps = []
        for m in marginals:
            gaps.append(now.groupBy(m).agg(F.abs(F.sum("weight") - F.max(f"target_{m}")).alias("gap")).agg(F.max("gap").alias("gap")))
        most = gaps[0]
        for g in gaps[1:]:
            most = most.unionByName(g)
        off = most.agg(F.max("gap")).first()[0]
        now = now.coalesce(1) if now.count() <= CELLS_TOGETHER else now
        if off is None or off < tolerance:
            return now
    if off > OFF_TARGET:
        warnings.warn(f"after {rounds} rounds a marginal is off its target by {off:.3g}", stacklevel=2)
    return now


def calibrated(raked: DataFrame, budget: float) -> DataFrame:
    """``probability`` of each cell: weight over tokens times one factor, at most 1, expecting ``budget`` of all tokens."""
    rate = F.when(F.col("__tokens") > 0, F.col("weight") / F.col("__tokens")).otherwise(0.0)
    rated = raked.withColumn("rate", rate)
    # One row for each rate: in falling order the first ones may have to be held at 1.
    by_rate = rated.where("rate > 0").groupBy("rate").agg(F.sum("__tokens").alias("t"), F.sum("weight").alias("w"))
    falling = Window.orderBy(F.desc("rate"))
    before = F.coalesce(F.sum("t").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(falling.rowsBetween(0, Window.unboundedFollowing))
    total = rated.agg((F.sum("__tokens") * budget).alias("wanted"))
    tried = by_rate.select("rate", before.alias("held"), rest.alias("rest")).join(F.broadcast(total))
    tried = tried.withColumn("factor", F.greatest(F.lit(0.0), (F.col("wanted") - F.col("held")) / F.col("rest")))
    factor = tried.where("factor * rate <= 1").agg(F.max_by("factor", "rate").alias("factor"))
    p = F.when(F.col("rate") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.col("rate") * F.col("factor"), F.lit(1.0))))
    # Nine significant digits: the same in every engine, and no probability becomes 0.
    return rated.join(F.broadcast(factor)).withColumn("probability", F.format_string("%.8e", p).cast("double"))


def drawn(id_column: Column, seed: str) -> Column:
    """A number in [0, 1) from id and seed."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


@tidy
def mix(
    docs: DataFrame,
    targets: Mapping[str, float | Mapping[str, float]],
    budget: float = 0.5,
    tokens_col: str = "tokens",
    id_col: str = "doc_id",
    seed: str = "mix",
) -> DataFrame:
    """All rows of ``docs`` with ``probability`` and ``sampled``.

    ``targets``: for each marginal (a column) the share of each value, or a power to temper its tokens with.
    ``budget``: the share of all tokens to expect in the sample.
    """
    marginals = list(targets)
    raked = rake(with_targets(cells_of(docs, marginals, tokens_col), targets), marginals)
    *names, p = unused(docs, *[f"cell_{m}" for m in marginals], "cell_probability")
    cells = calibrated(raked, budget).select(*[quoted(m).alias(n) for m, n in zip(marginals, names, strict=True)], F.col("probability").alias(p))
    cells = written(docs.sparkSession, cells, "probabilities")
    on = [F.coalesce(quoted(m).cast("string"), F.lit(NONE)) == quoted(n) for m, n in zip(marginals, names, strict=True)]
    few = cells.count() <= CELLS_TOGETHER
    joined = docs.join(F.broadcast(cells) if few else cells, on)
    keep = [quoted(c) for c in docs.columns if c not in ("probability", "sampled")]
    return joined.select(*keep, quoted(p).alias("probability"), (drawn(quoted(id_col), seed) < quoted(p)).alias("sampled"))


#: What the query and the pipeline mix by.
TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
BUDGET = 0.5


def mix_documents(documents: DataFrame) -> DataFrame:
    """The table ``documents`` mixed by TARGETS. Its ``topic`` and ``tokens`` are taken from the text."""
    rows = documents.withColumns({"topic": topic(F.col("text")), "tokens": n_tokens(F.col("text"))})
    return mix(rows, TARGETS, BUDGET)


def mixing_sql(rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL, with every round written out."""
    lowered = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    counts = {t: "(" + " + ".join(f"contains({lowered}, '{w}')::INT" for w in words) + ")" for t, words in TOPICS.items()}
    most = f"greatest({', '.join(counts.values())})"
    topic_sql = f"CASE WHEN {most} = 0 THEN '{OTHER}' " + " ".join(f"WHEN {n} = {most} THEN '{t}'" for t, n in counts.items()) + " END"
    parts = [
        r"""docs AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
  {topic} AS topic,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents)""".replace("{topic}", topic_sql),
        "r0 AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS t, sum(tokens)::DOUBLE AS w FROM docs GROUP BY ALL)",
    ]
    for m, power in TARGETS.items():
        parts.append(f"x_{m} AS (SELECT {m}, sum(t) AS s, CASE WHEN sum(t) > 0 THEN pow(sum(t), {power}) ELSE 0 END AS raw FROM r0 GROUP BY 1)")
        parts.append(f"g_{m} AS (SELECT {m}, raw / sum(raw) OVER () AS g FROM x_{m})")
    n = 0
    for _ in range(rounds):
        for m in TARGETS:
            parts.append(f"r{n + 1} AS MATERIALIZED (SELECT r.source, r.lang, r.topic, t, CASE WHEN sum(w) OVER (PARTITION BY r.{m}) > 0 THEN w * g / sum(w) OVER (PARTITION BY r.{m}) ELSE 0 END AS w FROM r{n} r JOIN g_{m} USING ({m}))")
            n += 1
    parts += [
        f"rated AS (SELECT *, CASE WHEN t > 0 THEN w / t ELSE 0 END AS rate FROM r{n})",
        f"tried AS (SELECT rate, (SELECT sum(t) * {BUDGET} FROM rated) AS wanted, coalesce(sum(t) OVER (ORDER BY rate DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(w) OVER (ORDER BY rate DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM rated WHERE rate > 0)",
        "factor AS (SELECT arg_max(greatest(0, (wanted - held) / rest), rate) AS f FROM tried WHERE greatest(0, (wanted - held) / rest) * rate <= 1)",
        "p AS (SELECT source, lang, topic, format('{:.8e}', (CASE WHEN rate = 0 THEN 0 ELSE least(1, coalesce(rate * f, 1)) END)::DOUBLE)::DOUBLE AS probability FROM rated, factor)",
    ]
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, source, lang, topic, tokens, probability,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < probability AS sampled
FROM docs JOIN p USING (source, lang, topic)"""
