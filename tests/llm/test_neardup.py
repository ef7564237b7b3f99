import random
import re
from collections import Counter

import numpy as np
import pytest
from foldlog.llm import neardup

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute_classes(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                n = (sets[i] & sets[j]).total()
                if n >= threshold * (sets[i].total() + sets[j].total() - n):
                    root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, passage = [], " ".join(rng.choices(vocabulary, k=60))
    say = lambda n: rng.choices(vocabulary, k=n)
    for _ in range(120):  # documents that share a passage but aren't alike
        rows.append(" ".join(say(45)) + " " + passage + " " + " ".join(say(45)))
    base = say(200)
    for _ in range(150):  # a large group of near copies
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(200)] = rng.choice(vocabulary)
        rows.append(" ".join(words))
    for _ in range(40):
        rows += [" ".join(say(rng.randint(1, 80)))] * rng.randint(1, 3)
    for _ in range(20):  # a shingle's copies count: repeated passages, once alike and once not
        part, more = say(rng.randint(5, 12)), say(rng.randint(5, 40))
        rows += [" ".join(part * k + more) for k in (3, 4, 20, 21)]
    rows += ["", None, "One two", "one, TWO!", "...", "a b c d e f g h i j"]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicate_classes(df).collect()}
    assert got == brute_classes(rows)


def framed(n=200, seed=5):
    """Texts of one frame, pairwise under the threshold, each with a near copy just above it."""
    rng = random.Random(seed)
    word = lambda: f"u{rng.randrange(10**9)}"
    frame, rows = [word() for _ in range(200)], []
    for _ in range(n):
        own = [word() for _ in range(29)]
        rows += [frame + own, frame + own[:7] + [word() for _ in range(22)]]
    rng.shuffle(rows)
    return [(i, " ".join(words)) for i, words in enumerate(rows)]


def test_near_copies_within_a_large_group_of_unlike_texts(spark):
    rows = framed()
    wanted = brute_classes(rows)
    assert len(set(wanted.values())) == len(rows) // 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicate_classes(df).collect()} == wanted


def test_recall_close_to_the_threshold(spark):
    """Pairs of 0.80 to 0.87 among texts of 0.69 to 0.78 that all share a passage."""
    rng = random.Random(12)
    word = lambda: f"u{rng.randrange(10**9)}"
    frame, rows = [word() for _ in range(200)], []
    for k in range(250):
        own = [word() for _ in range(29)]
        rows += [frame + own, frame + own[: 1 + k % 18] + [word() for _ in range(28 - k % 18)]]
    rows = [(i, " ".join(words)) for i, words in enumerate(rows)]
    wanted = brute_classes(rows)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    pairs = [i for i in range(0, 500, 2) if wanted[i] == wanted[i + 1]]
    assert len(pairs) > 180 and sum(got[i] == got[i + 1] for i in pairs) >= 0.99 * len(pairs)
    assert all(wanted[i] == wanted[got[i]] for i in got)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "p", "q", "r"), (2, "a b c d e f", "p", "q", "r")], "id long, text string, bits string, place string, `own` string")
    assert [r.asDict() for r in neardup.one_of_each_class(df, "id").collect()] == [{"id": 1, "text": "a b c d e f", "bits": "p", "place": "q", "own": "r"}]


def test_repeated_and_null_rows(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A b c, d e f", None), (None, "q r s", "y"), (None, None, "z"), (3, "", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    kept = neardup.one_of_each_class(df).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == [("1", "a b c d e f"), ("3", ""), ("None", "None"), ("None", "q r s")]
    assert kept[0].asDict().keys() == {"doc_id", "text", "class_id"}
    assert neardup.near_duplicate_classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("shared", [0.3, 0.6, 0.8])
def test_signatures_estimate_weighted_similarity(shared):
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(20):
        n = 400
        ids = rng.integers(1, 1 << 62, n, dtype=np.uint64)
        a, b = rng.uniform(0.2, 6.0, n), rng.uniform(0.2, 6.0, n)
        b = np.where(rng.random(n) < shared, a, b)
        truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        errors.append((neardup.signature(ids, a, 256) == neardup.signature(ids, b, 256)).mean() - truth)
    assert abs(np.mean(errors)) < 0.025


def test_signature_does_not_depend_on_order_or_size_class():
    ids = np.arange(1, 2000, dtype=np.uint64) * np.uint64(7919)
    one, two = neardup.signature(ids), neardup.signature(ids[::-1].copy())
    assert (one == two).all()
    assert (neardup.signature(ids[:3]) == neardup.signature(ids[:3][::-1].copy())).all()


def test_long_text_hashes_in_blocks(monkeypatch):
    words = [f"word{i % 977}x{i}" for i in range(5000)]
    text = " ".join(words)
    whole = neardup.elements(text)
    monkeypatch.setattr(neardup, "_BLOCK", 300)
    again = neardup.elements(text)
    assert whole[0] == again[0] and (whole[1] == again[1]).all() and (whole[2] == again[2]).all()


def test_weights_are_counts():
    _, once, one = neardup.elements("a b c d e f")
    _, ids, thrice = neardup.elements("a b c d e f a b c d e f a b c d e f")
    assert one.tolist() == [1, 1] and sorted(thrice.tolist()) == [2, 2, 2, 2, 3, 3]
    a, b = neardup.expanded(once, one), neardup.expanded(ids, thrice)
    assert len(a) == 2 and len(b) == 14 and len(np.intersect1d(a, b)) == 2
    assert neardup.elements("a b c d e f a b c d e f", "set")[2].max() == 1
