import hashlib
import random

from pyspark.sql import functions as F

from foldlog.llm import chat

PART = f"array<{chat.PART}>"
SCHEMA = f"conv_id long, turn long, role string, parts {PART}, extra int"


def formatted(spark, rows):
    return {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}


def text(t):
    return ("text", t, None, None)


def test_parts_become_placeholders_in_order(spark):
    rows = [
        (1, 1, "assistant", [text("seen "), ("document", None, "d.pdf", 3)], 0),
        (1, 0, "user", [text("look "), ("image", None, "a.png", 256), text(" and "), ("audio", None, "b.wav", 10), text("<image:0>")], 0),
    ]
    r = formatted(spark, rows)[1]
    assert r["formatted"] == r"<s>[user]look <image:0> and <audio:1>\limage:0\g</s><s>[assistant]seen <document:2></s>"
    assert [tuple(a) for a in r["attachments"]] == [(0, "image", "a.png", 256, 256), (1, "audio", "b.wav", 10, 250), (2, "document", "d.pdf", 3, 1800)]
    assert r["n_tokens_attached"] == 2306
    (span,) = r["loss_spans"]
    assert r["formatted"][span["start"] : span["start"] + span["length"]] == "seen <document:2>"


def test_texts_come_back_whatever_they_hold(spark):
    rng = random.Random(7)
    pieces = ["</s>", "<s>[", "[INST]", "]", "\\", "\\l", "\\e", "<|im_end|>", "é", "\n", "user", "", "a", "😀", "\\\\g", ">"]
    say = lambda: "".join(rng.choices(pieces, k=rng.randint(0, 8)))
    convs = {c: [(t, rng.choice(["user", "assistant", "sys]tem", ""]), say()) for t in range(rng.randint(1, 6))] for c in range(60)}
    rows = [(c, t, role, [text(x)], 1) for c, turns in convs.items() for t, role, x in turns]
    rng.shuffle(rows)
    done = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    back = done.select("conv_id", "formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in back.collect():
        turns = convs[r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == [(role, x) for _, role, x in turns]
        assert r["loss"] == "".join(x for _, role, x in turns if role == "assistant")
        assert r["formatted"].count("<") == 2 * len(turns) and "[INST]" not in r["formatted"]
        assert len(r["loss_spans"]) == sum(role == "assistant" for _, role, _ in turns)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, 0, None, None, 0), (1, 1, "assistant", [text(None)], 0), (1, 1, "assistant", [text(None)], 0), (None, None, "user", [], 0), (2, 5, "user", [(None, "x", None, None)], 0)]
    got = formatted(spark, rows)
    assert got[1]["formatted"] == "<s>[]</s>" + 2 * "<s>[assistant]</s>" and got[None]["formatted"] == "<s>[user]</s>" and got[2]["formatted"] == "<s>[user]x</s>"
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversation(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], [text(f"turn {t} <")], 0) for t in range(1500)]
    r = formatted(spark, rows)[1]
    said = "".join(f"turn {t} <" for t in range(1500) if t % 2)
    held = "".join(r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"])
    assert hashlib.sha256(held.replace("\\l", "<").encode()).digest() == hashlib.sha256(said.encode()).digest()
