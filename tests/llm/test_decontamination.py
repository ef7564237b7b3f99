import hashlib
import random
import re

from pyspark.sql import types as T

from foldlog.llm import common, decontamination

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    out = {}
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for i in range(len(w)):
            for n in range(1, 11):
                if (ids := windows.get(tuple(w[i : i + n]))) and len(w[i : i + n]) == n:
                    hit.update(range(i, i + n))
                    found |= ids
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), sha, bool(hit))
    return out


def case(seed=5):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choices(["ab", "Ça", "x1", "the", "of", "Q"], k=n))
    items = [(i, say(rng.choice([3, 9, 10, 11, 14]))) for i in range(12)] + [(50, None), (51, "..."), (3, say(12))]
    docs = []
    for i in range(80):
        text = say(rng.randint(0, 30))
        if rng.random() < 0.5:
            text += " - " + (rng.choice(items)[1] or "").upper() + "; " + say(3)
        docs.append((i, text))
    return docs + [(900, None), (901, ""), (902, "?!")], items


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.contamination(d, b, **options).collect()
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows}


def test_equals_brute_force(spark):
    docs, items = case()
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_of_a_large_benchmark_give_the_same(spark):
    docs, items = case(6)
    assert run(spark, docs, items, max_windows=7) == brute(docs, items)


def test_offsets_point_into_the_original(spark):
    text = "x y, One  TWO-three. z"
    d = spark.createDataFrame([(1, text, "keep")], "doc_id long, text string, n_words string")
    b = spark.createDataFrame([(7, "one two THREE")], "item_id long, text string")
    row = decontamination.find_benchmark_text(d, b, carry=["doc_id", "n_words"]).first()
    assert [text[s["start"] : s["end"]] for s in row["hit_chars"]] == ["One  TWO-three"]
    assert row["n_words"] == 6 and row["hit_items"] == ["7"]


def test_empty_tables(spark):
    docs, items = case()
    assert all(v[1] == 0 and not v[4] for v in run(spark, docs, items[12:14]).values())
    d = spark.createDataFrame([], "doc_id long, text string")
    assert decontamination.contamination(d, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_a_carried_text_goes_to_python_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    sent, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *a, **k: sent.append(len(self.columns)) or plain(self, *a, **k))
    out = T.StructType([T.StructField("n", T.LongType())])
    made = common.map_texts(docs, ["doc_id", "text"], "text", lambda: lambda texts: [[len(t or "") for t in texts]], out)
    assert sent == [2]
    assert sorted(map(tuple, made.collect())) == [(1, "one two", 7), (2, None, 0)]
