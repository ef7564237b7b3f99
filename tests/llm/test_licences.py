import random
import re
import textwrap

from foldlog.llm import licences

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(rows, templates=licences.TEMPLATES):
    out = {}
    for doc, text in rows:
        w = words_of(text)
        spots = [(i, label) for phrase, label in licences.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        base, more, best = {x for _, x in spots}, set(), 0.0
        blocks = [(0, set(words_of(line))) for line in (text or "").split("\n")]
        for half in {licences.window_words(t) // 2 for _, t in templates}:
            blocks += [(2 * half, set(w[at : at + 2 * half])) for at in range(0, max(1, len(w)), half)]
        for size, have in blocks:
            for label, t in templates:
                if size not in (0, licences.window_words(t)):
                    continue
                want = set(words_of(t))
                share = len(have & want) / len(want)
                if share >= 0.8:
                    more.add(label)
                    best = max(best, share)
        starts = [i for i, _ in spots]
        out[doc] = (len(w), len(spots), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if spots else best)
    return out


def corpus():
    rng = random.Random(4)
    notice = [t for _, t in licences.TEMPLATES]
    filler = ["the", "of", "license", "work", "version", "Ünder", "mit", "cc", "by", "copy", "software", "a"]
    rows = []
    for i in range(150):
        lines = [" ".join(rng.choices(filler, k=rng.randint(0, 12))) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.6:
            w = rng.choice(notice).split()
            for _ in range(rng.randint(0, 4)):
                w.pop(rng.randrange(len(w))) if len(w) > 2 else None
            rng.shuffle(w) if rng.random() < 0.2 else None
            lines.insert(0, " ".join(w))
        rows.append((i, rng.choice(["\n", "\n", " "]).join(lines)))
    rows += [(900, None), (901, ""), (902, "MIT license, mit License cc by cc-by"), (903, "...\n\n"), (904, "CC\nBY x apache license")]
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r[0]: tuple(r)[1:] for r in licences.scan(df).collect()}


def test_equals_brute_force(spark):
    rows = corpus()
    got, expected = run(spark, rows), brute(rows)
    assert {k: v for k, v in got.items() if v != expected[k]} == {} and len(got) == len(rows)


def test_notices_wrapped_at_any_column(spark):
    """Each notice within other words, hard-wrapped, with and without comment marks; other long texts get no label."""
    rng = random.Random(8)
    other = lambda n: [f"q{rng.randrange(900)}" for _ in range(n)]
    rows, wanted = [], {}
    for i, (label, notice) in enumerate(licences.TEMPLATES):
        for j, width in enumerate((20, 40, 72)):
            lines = textwrap.wrap(" ".join(other(rng.randint(0, 300)) + [notice] + other(rng.randint(0, 300))), width)
            rows.append((10 * i + j, "\n".join(rng.choice(("", " * ", "// ")) + x for x in lines)))
            wanted[10 * i + j] = label
    rows.append((999, "\n".join(" ".join(other(9)) for _ in range(2_000))))
    got = run(spark, rows)
    assert all(wanted[k] in got[k][5].split(",") for k in wanted) and got[999][4:] == ("", "", 0.0)
    assert got == brute(rows)


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(licences, "BROADCAST_ROWS", 0)
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_repeated_and_null_rows(spark):
    text = "Released under the MIT License."
    df = spark.createDataFrame([(1, text, 5), (1, text, 6), (None, text, 7), (None, None, 8)], "doc_id long, text string, words int")
    rows = sorted((str(r["doc_id"]), r["labels"], r["n_base"]) for r in licences.scan(df).collect())
    assert rows == [("1", "mit,mit-notice", 1), ("1", "mit,mit-notice", 1), ("None", "", 0), ("None", "mit,mit-notice", 1)]
    assert licences.scan(df.limit(0)).count() == 0
