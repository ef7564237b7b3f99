import numpy as np
from foldlog.llm import mixing


def docs(spark):
    rng = np.random.default_rng(8)
    rows = [(i, ["a", "a", "a", "b", None][rng.integers(5)], ["x", "y"][rng.integers(2)], ["p", "q", "r"][rng.integers(3)], int(rng.integers(1, 60))) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long")


def test_raked_marginals_meet_the_targets(spark):
    targets = {"source": {"a": 0.2, "b": 0.5, mixing.NONE: 0.3}, "lang": {"x": 0.25, "y": 0.75}, "topic": 0.5}
    cells = mixing.with_targets(mixing.cells_of(docs(spark), list(targets), "tokens"), targets)
    raked = mixing.rake(cells, list(targets)).toPandas()
    assert abs(raked.weight.sum() - 1) < 1e-9
    for m, wanted in targets.items():
        held = raked.groupby(m).weight.sum()
        if isinstance(wanted, dict):
            assert all(abs(held[k] - v) < 1e-8 for k, v in wanted.items())
        else:
            t = raked.groupby(m)["__tokens"].sum() ** wanted
            assert np.allclose(held, t / t.sum())


def test_expected_tokens_meet_the_budget_with_probabilities_held_at_one(spark):
    targets = {"source": {"a": 0.1, "b": 0.6, mixing.NONE: 0.3}, "lang": {"x": 0.5, "y": 0.5}}
    for budget in (0.1, 0.6, 1.0):
        out = mixing.mix(docs(spark), targets, budget).toPandas()
        assert len(out) == 3000 and out.probability.between(0, 1).all()
        if budget < 1:
            assert abs((out.probability * out.tokens).sum() / out.tokens.sum() - budget) < 1e-3
            assert abs((out.sampled * out.tokens).sum() / out.tokens.sum() - budget) < 0.05
        else:
            assert out.sampled.all()


def test_targets_without_tokens_and_values_without_target(spark):
    out = mixing.mix(docs(spark), {"source": {"a": 1, "nowhere": 3}}, 0.3).toPandas()
    assert set(out[out.sampled].source) == {"a"} and (out[out.source != "a"].probability == 0).all()


def test_clashing_columns_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 3, "z"), (1, "a", 3, "z"), (None, None, None, None)], "doc_id long, source string, tokens long, probability string")
    rows = mixing.mix(df, {"source": 1.0}, 0.5).collect()
    assert len(rows) == 3 and rows[0].asDict().keys() == {"doc_id", "source", "tokens", "probability", "sampled"}
    assert mixing.mix(df.limit(0), {"source": 1.0}).count() == 0
