import random
import re
from collections import defaultdict

import corpus_pipeline
from foldlog.llm import quality
from tests.llm.test_decontamination import brute as brute_hits
from tests.llm.test_neardup import brute_classes

SF = "/root/testdata/sf0.001"


def base_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    spots = defaultdict(list)
    for i in range(len(words) - 7):
        spots[tuple(words[i : i + 8])].append(i)
    covered = {i + k for v in spots.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)

    measured = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for d, r in rows.items():
        assert tuple(measured[d])[1:7] == base_rules(r["text"])
    kept = stage["quality_rules"](spark, docs, SF)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {d for d, r in measured.items() if r["kept"]} and not any(measured[d]["base_failed"] for d in ids)

    lines = stage["line_dedup"](spark, kept, SF).collect()
    for r in lines:
        whole = iter(rows[r["doc_id"]]["text"].split("\n"))
        assert all(line in whole for line in r["text"].split("\n"))  # lines in their order, some gone
        assert r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in lines} <= ids and len(lines) >= 0.95 * len(ids)

    deduped = stage["near_dedup"](spark, kept, SF).collect()
    classes = brute_classes([(d, rows[d]["text"]) for d in sorted(ids)])
    assert {r["doc_id"] for r in deduped} == set(classes.values())

    clean = {r["doc_id"] for r in stage["decontaminate"](spark, kept, SF).collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute_hits([(d, rows[d]["text"]) for d in ids], items)
    assert clean == {d for d in ids if not hits[d][4]}


def test_stages_on_odd_rows(spark):
    rng = random.Random(3)
    prose = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(200))
    rows = [(1, prose, "en", "a", 1, "x"), (1, prose, "en", "a", 1, "x"), (2, prose, None, None, None, "y"), (None, None, None, "b", 3, "z"), (3, "", "en", "b", 0, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, flags string")
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, SF)
            assert out.columns[:5] == corpus_pipeline.COLUMNS, name
            ids = sorted(str(r["doc_id"]) for r in out.collect())
            wanted = {"quality_rules": ["1", "1", "2"], "near_dedup": ["1", "3", "None"]}.get(name, ["1", "1", "2", "3", "None"])
            assert (ids == wanted or name == "mix_sources") if some is docs else ids == [], name


def test_run_gives_a_weighted_sample(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert out and {r["doc_id"] for r in out} <= docs and len({r["doc_id"] for r in out}) == len(out)
    assert all(r["probability"] > 0 and abs(r["weight"] * r["probability"] - 1) < 1e-9 for r in out)


def test_compression_bands():
    import random

    import zstandard

    rng = random.Random(2)
    z = zstandard.ZstdCompressor(level=3)
    prose = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400))
    turned = " ".join(" ".join([rng.choice(["alpha", "beta", "gamma", "delta"]) + str(i)] * 6) for i in range(60))
    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(24)) for _ in range(300))
    for text in (prose, turned, noise, prose[:700], prose + noise[:3000], noise[:1500] + prose):  # the verdict by plain counting
        data = text.encode()
        size = lambda b: len(z.compress(b)) / len(b)
        inside = lambda b, bands: next(low <= size(b) <= high for most, low, high in bands if len(b) <= most)
        odd = sum(len(c) for c in (data[i : i + 4096] for i in range(0, len(data), 4096)) if not inside(c, quality.CHUNK_BANDS))
        wanted = not base_rules(text)[5] and inside(data, quality.BANDS) and odd <= 0.3 * len(data)
        assert quality.measured(text, z)[6] == wanted
    kept = {name: quality.measured(text, z)[6] for name, text in {"prose": prose, "turned": turned, "noise": noise, "empty": "", "null": None}.items()}
    assert kept == {"prose": True, "turned": False, "noise": False, "empty": False, "null": False}
