"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time. It labels every byte of a text from the states of
both directions; a document's probabilities are the means over its bytes. Texts are read whole, in windows that run
through the network side by side; they overlap by MARGIN bytes at both ends, so that no byte is labelled from a state
without context, and each byte counts once.

Trained on a bounded sample: at most DOCS_A_LANGUAGE labelled documents of each language, each the smallest by a hash of
id and text in one of so many slots (the slot by another hash), and WINDOWS_A_DOC windows of each, cut on the executors.
Repeated rows, also of null or equal ids, count once. Prediction reads the text alone.

Defined cases: a null text, or one without letters, is ``und`` with score 0; without any labelled document everything
is ``und``; null ids are never held out; repeated rows get equal results; languages are as many as the labels have; of
equal probabilities the first language in order is taken; an empty table gives an empty table; input columns named like
an output column are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlog.llm.common import map_texts, quoted, shared_dir, sized, written

HIDDEN, WINDOW = 8, 64
#: Bytes that a window of prediction labels, and those before and after them that it only reads.
INNER, MARGIN = 112, 8
DOCS_A_LANGUAGE, WINDOWS_A_DOC = 250, 6
STEPS, BATCH, RATE = 260, 192, 0.02
WINDOWS_TOGETHER = 1024
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

#: Case and the kind of digits and signs say little about a language.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or b == 32 else 48 if 48 <= b <= 57 else 46 for b in range(256))


def _f32(x) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.float32)


class ByteGru:
    """Weights: byte tables (2 directions, 256, 3H), recurrent (2, H, 3H), output (2H, L)."""

    def __init__(self, languages: Sequence[str], seed: int = 13):
        rng = np.random.default_rng(seed)
        self.languages = list(languages)
        self.w = {
            "x": _f32(rng.normal(0, 0.3, (2, 256, 3 * HIDDEN))),
            "u": _f32(rng.normal(0, 0.3, (2, HIDDEN, 3 * HIDDEN))),
            "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "o": _f32(rng.normal(0, 0.3, (2 * HIDDEN, len(self.languages)))),
            "c": np.zeros(len(self.languages), np.float32),
        }

    def states(self, data: np.ndarray, kept: list | None = None) -> np.ndarray:
        """States after each byte: (steps, 2, rows, H), the second direction in its own order of reading."""
        w, h2 = self.w, 2 * HIDDEN
        rows, steps = data.shape
        h = np.zeros((2, rows, HIDDEN), np.float32)
        out = np.empty((steps, 2, rows, HIDDEN), np.float32)
        ux, un = w["u"][:, :, :h2], w["u"][:, :, h2:]
        table = w["x"] + w["b"]
        g = np.empty((2, rows, 3 * HIDDEN), np.float32)
        for t in range(steps):
            np.take(table[0], data[:, t], axis=0, out=g[0], mode="clip")
            np.take(table[1], data[:, steps - 1 - t], axis=0, out=g[1], mode="clip")
            zr = g[..., :h2] + np.matmul(h, ux)
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1.0
            zr *= 0.5
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            hn = np.matmul(h, un)
            n = np.tanh(g[..., h2:] + r * hn)
            if kept is not None:
                kept.append((h, z, r, n, hn))
            h = n + z * (h - n)
            out[t] = h
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(steps, rows, L): position by position, from both directions."""
        steps, _, rows, _ = states.shape
        logits = np.matmul(states[:, 0].reshape(-1, HIDDEN), self.w["o"][:HIDDEN]) + np.matmul(states[::-1, 1].reshape(-1, HIDDEN), self.w["o"][HIDDEN:]) + self.w["c"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.reshape(steps, rows, -1)

    def gradients(self, data: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions, and its gradients through time."""
        w, h2 = self.w, 2 * HIDDEN
        rows, steps = data.shape
        kept: list = []
        states = self.states(data, kept)
        p = self.probabilities(states)
        loss = float(-np.log(p[:, np.arange(rows), labels] + 1e-9).mean())
        p[:, np.arange(rows), labels] -= 1
        p /= rows * steps
        ahead = states[:, 0].reshape(-1, HIDDEN)
        back = states[::-1, 1].reshape(-1, HIDDEN)
        flat = p.reshape(-1, p.shape[2])
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["o"][:HIDDEN], grad["o"][HIDDEN:] = ahead.T @ flat, back.T @ flat
        grad["c"] = flat.sum(axis=0)
        dh = np.zeros((2, rows, HIDDEN), np.float32)
        ut = np.swapaxes(w["u"], 1, 2)
        for t in range(steps - 1, -1, -1):
            h, z, r, n, hn = kept[t]
            dh[0] += p[t] @ w["o"][:HIDDEN].T
            dh[1] += p[steps - 1 - t] @ w["o"][HIDDEN:].T
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            gates = np.concatenate([dz, dr, dn], axis=2)
            for d, at in ((0, t), (1, steps - 1 - t)):
                hot = np.zeros((256, rows), np.float32)
                hot[data[:, at], np.arange(rows)] = 1
                grad["x"][d] += hot @ gates[d]
            grad["b"] += gates.sum(axis=1, keepdims=True)
            inner = np.concatenate([dz, dr, dn * r], axis=2)
            grad["u"] += np.matmul(np.swapaxes(h, 1, 2), inner)
            dh = dh * z + np.matmul(inner, ut)
        return loss, grad

    def train(self, data: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 17) -> float:
        """Adam over random batches; languages are drawn evenly. Gives the mean loss of the last steps."""
        rng = np.random.default_rng(seed)
        share = 1.0 / np.bincount(labels, minlength=len(self.languages))[labels]
        share /= share.sum()
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        losses = []
        for i in range(1, steps + 1):
            pick = rng.choice(len(labels), BATCH, p=share)
            loss, grad = self.gradients(data[pick], labels[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = RATE * min(1.0, 2.0 * (1 - i / (steps + 1)))
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] = _f32(self.w[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-6))
        return float(np.mean(losses[-20:]))

    def pooled(self, texts: Sequence[str]) -> np.ndarray:
        """Mean probabilities of each text (which has at least one byte) over all its bytes."""
        total = np.zeros((len(texts), len(self.languages)))
        sizes = np.zeros(len(texts))
        held: list[tuple[int, np.ndarray, np.ndarray]] = []  # text, windows, bytes that count in each
        waiting = 0
        for i, text in enumerate(texts):
            data = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
            sizes[i] = len(data)
            n = -(-len(data) // INNER)
            padded = np.frombuffer(b" " * MARGIN + data.ljust(n * INNER + MARGIN), np.uint8)
            windows = np.lib.stride_tricks.sliding_window_view(padded, INNER + 2 * MARGIN)[::INNER]
            counts = np.full(n, INNER)
            counts[-1] = len(data) - (n - 1) * INNER
            for at in range(0, n, WINDOWS_TOGETHER):
                held.append((i, windows[at : at + WINDOWS_TOGETHER], counts[at : at + WINDOWS_TOGETHER]))
                waiting += len(held[-1][1])
                if waiting >= WINDOWS_TOGETHER:
                    self._add(held, total)
                    held, waiting = [], 0
        if held:
            self._add(held, total)
        return total / np.maximum(sizes, 1)[:, None]

    def _add(self, parts: list[tuple[int, np.ndarray, np.ndarray]], total: np.ndarray) -> None:
        data = np.concatenate([w for _, w, _ in parts])
        owner = np.repeat([i for i, _, _ in parts], [len(w) for _, w, _ in parts])
        counts = np.concatenate([n for _, _, n in parts])
        p = self.probabilities(self.states(data))[MARGIN : MARGIN + INNER]
        for k in np.flatnonzero(counts < INNER):
            p[counts[k] :, k] = 0
        np.add.at(total, owner, p.sum(axis=0, dtype=np.float64))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents to learn from: lang, slot, draw and ``windows`` (binary), at most DOCS_A_LANGUAGE of a language."""
    spark = docs.sparkSession
    shared_dir(spark)
    labelled = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), quoted(lang_col).alias("lang"))
    labelled = labelled.where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    labelled = labelled.select("lang", "text", F.pmod(F.hash("id", "text"), F.lit(DOCS_A_LANGUAGE)).alias("slot"), F.xxhash64("id", "text").alias("draw"))
    least = written(spark, labelled.groupBy("lang", "slot").agg(F.min("draw").alias("draw")), "drawn")
    chosen = labelled.join(sized(least, 128), ["lang", "slot", "draw"])
    data = F.encode("text", "UTF-8")
    room = F.greatest(F.octet_length("text") - WINDOW + 1, F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), F.when(F.octet_length("text") > WINDOW, WINDOWS_A_DOC - 1).otherwise(0)), lambda k: F.substring(data, (F.pmod(F.xxhash64("draw", k), room) + 1).cast("int"), F.lit(WINDOW)))
    return chosen.select("lang", "slot", "draw", cut.alias("windows")).groupBy("lang", "slot", "draw").agg(F.first("windows").alias("windows"))


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteGru | None:
    """A network trained on labelled documents that aren't held out; None if there are none."""
    rows = sorted(sampled(docs, id_col, text_col, lang_col).collect(), key=lambda r: (r["lang"], r["slot"], r["draw"]))
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    known = [(bytes(w).translate(_PLAIN).ljust(WINDOW), languages.index(r["lang"])) for r in rows for w in r["windows"]]
    net = ByteGru(languages)
    if len(languages) > 1:
        net.train(np.frombuffer(b"".join(w for w, _ in known), np.uint8).reshape(-1, WINDOW), np.array([k for _, k in known]))
    return net


def predict(docs: DataFrame, net: ByteGru | None, carry: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``lang_pred`` and ``score`` for each document, from its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        model = sent.value

        def apply(texts):
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if model is not None and t and LETTER.search(t)]
            if known:
                pooled = model.pooled([texts[i] for i in known])
                for i, p in zip(known, pooled, strict=True):
                    names[i], scores[i] = model.languages[int(p.argmax())], float(min(1.0, p.max()))
            return names, scores

        return apply

    return map_texts(docs, carry, text_col, make, OUT)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the labelled documents of ``docs`` and predict all of them: id, held_out, lang_pred, score."""
    net = trained(docs, id_col, text_col, lang_col)
    made = predict(docs.select(quoted(id_col), quoted(text_col)), net, [id_col], text_col)
    return made.select(quoted(id_col), held_out(quoted(id_col)).alias("held_out"), "lang_pred", "score")
