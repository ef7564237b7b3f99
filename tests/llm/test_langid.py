import zlib

import numpy as np
from foldlog.llm import langid


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(1)
    net = langid.ByteGru(["a", "b"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    data, labels = rng.integers(97, 103, (4, 6)).astype(np.uint8), np.array([0, 1, 1, 0])
    net.w = {k: v.astype(np.float32) for k, v in net.w.items()}
    _, grad = net.gradients(data, labels)
    for name, at in (("u", (0, 1, 2)), ("u", (1, 0, 20)), ("o", (3, 1)), ("x", (1, int(data[0, 2]), 17)), ("b", (0, 0, 9))):
        ends = []
        for step in (1e-2, -1e-2):
            net.w[name][at] += step
            ends.append(net.gradients(data, labels)[0])
            net.w[name][at] -= step
        assert abs((ends[0] - ends[1]) / 2e-2 - grad[name][at]) < 2e-3


def test_pooling_takes_every_byte_whatever_the_blocks(monkeypatch):
    net = langid.ByteGru(["a", "b", "c"])
    texts = ["é" * 700, "x", "ab cd " * 300, "q" * 64, "w" * 65]
    one = net.pooled(texts)
    monkeypatch.setattr(langid, "WINDOWS_TOGETHER", 3)
    assert np.allclose(one, net.pooled(texts), atol=1e-5)
    assert np.allclose(one.sum(axis=1), 1, atol=1e-4)
    alone = np.concatenate([net.pooled([t]) for t in texts])
    assert np.allclose(one, alone, atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in test} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert np.mean([r["lang_pred"] == r["lang"] for r in test]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_null_and_letterless_texts(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "12 !?", "en"), (3, "", None), (None, "hello there", None), (5, "bonjour", "fr")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["held_out"]) for r in langid.identify(df).collect()}
    assert [got[k][:2] for k in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[None][2] is False and got[None][0] in ("fr", "und")
    assert langid.identify(df.limit(0)).count() == 0
