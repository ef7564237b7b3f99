"""Personal data: base patterns, and a semi-Markov conditional random field for what they miss.

Base spans come from four fixed patterns, scanned in linear time over whole texts.

The field labels segments, not words: features look at a whole candidate span (its shape, its digits, its checks, the
word before it), and bounded-entity dynamic programming chooses boundaries and kinds together. Entities have at most
MAX_WORDS words; a word can only be part of one if it holds a digit or an at sign, joins two that do, names a secret
just before one, or belongs to an address that is spelled out (jo at example dot com), so the program runs over
stretches of such words and the rest of a text is outside without further work.

The field is trained here, once in a process: by gradient ascent on the exact log-likelihood of segmentations, over
sentences drawn from a seeded generator (GENERATED of them). Training needs no documents and gives the same weights
everywhere. Secrets without any digit are not found.

Defined cases: null and empty texts have no spans; texts of any length are taken whole, long stretches in windows that
overlap by far more than an entity; base spans are always kept, added spans never overlap them or each other; of
segmentations of equal score the first found is taken; repeated rows get equal results; an empty table gives an empty
table; input columns named like an output column are replaced by it.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foldlog.llm.common import map_texts, rows_of

#: Kinds in the order of all listings; the last ones are the field's own: secrets, and national numbers of persons.
KINDS = ("email", "ip", "card", "phone", "secret", "id")
BASE_KINDS = KINDS[:4]
MAX_WORDS = 8
#: Words of a stretch decoded at once, and words on both sides that are decoded with them: far more than MAX_WORDS.
WINDOW, MARGIN = 192, 32
GENERATED, EPOCHS, RATE = 900, 10, 0.3
#: An added span needs at least so great a share of the probability of its stretch.
CERTAIN = 0.9

OUT = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType()), T.StructField("n_spans", T.LongType())]
)

# The base patterns. Possessive repetition and the look-behind change no match: a failing start inside a run of
# digits fails wherever in the run it is, so only the run's beginning has to be tried.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterable[Span]:
    done, before = 0, 0
    for m in _AT.finditer(text):
        # The local part is the longest run before the sign that no earlier match and no earlier sign has.
        before = max(done, text.rfind("@", before, m.start()) + 1, before)
        run = text[before : m.start()]
        start = before + len(run.rstrip(_LOCAL))
        before = m.start()
        if start < m.start():
            yield "email", start, m.end()
            done = m.end()


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind as listed and then by start."""
    out = list(emails(text)) if "@" in text else []
    found = _IP.finditer(text) if text.count(".") > 2 else ()
    out += [("ip", *m.span()) for m in found if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    found = _PHONE.finditer(text) if "+" in text else ()
    out += [("phone", *m.span()) for m in found if 9 <= len(_digits(m[0])) <= 15]
    return out


# ---- the field -------------------------------------------------------------------------------------------------

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TRIGGER = re.compile(r"[0-9@]")
_SPACES = " \t\n\v\f\r"
_EDGE = "\"'()[]{}<>,;:!?."
_HEX = re.compile(r"[0-9a-fA-F]{12,}")
_KEYED = re.compile(r"(?i)[\w.-]*(password|passwd|pwd|secret|token|api_?key|access_?key|auth|credential)[\w.-]*[\"']?\s*[=:]\s*[\"']?[^\s\"']{6,}")
_JOIN = frozenset(("=", ":", "-", "at", "dot", "(at)", "[at]", "(dot)", "[dot]"))
_DOT, _AT_SIGN = r"(?: dot | ?[\[(]dot[\])] ?)", r"(?: at | ?[\[(]at[\])] ?)"
_SPELLED = re.compile(rf"(?i)[\w+-]+(?:{_DOT}[\w+-]+)*{_AT_SIGN}[\w-]+(?:{_DOT}[\w-]+)+")
#: Prefixes by which common services mark their keys.
_PREFIXED = re.compile(r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|sk_test_|rk_live_|AIza|ya29\.|AKIA|ASIA)[\w.-]{14,}")
_NATIONAL = re.compile(r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}|[A-CEGHJ-PR-TW-Z][A-Z] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]")
_CUES = {
    "email": ("mail", "email", "e-mail", "contact", "write", "courriel"),
    "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "mastercard", "credit", "carte", "karte"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon"),
    "secret": ("password", "token", "key", "secret", "passwd", "pwd", "auth"),
    "id": ("ssn", "nino", "insurance", "security", "social"),
}


def span_features(words: Sequence[str], i: int, j: int) -> list[str]:
    """Features of the words i to j - 1 taken as one segment."""
    s = " ".join(words[i:j]).strip(_EDGE.replace("(", "").replace("+", ""))
    d = _digits(s)
    n, letters = len(d), sum(c.isalpha() for c in s)
    before = words[i - 1].lower().strip(_EDGE + "=") if i else ""
    out = [f"words={j - i}", f"digits={min(n, 20) // 2}", f"letters={min(letters, 8) // 3}"]
    if "@" in s:
        out.append("at")
        if re.fullmatch(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+", s):
            out.append("email-shape")
        elif re.fullmatch(r"[\w.%+-]+ ?@ ?[\w-]+( ?\. ?[\w-]+)+", s):
            out.append("spaced-email")
    if _SPELLED.fullmatch(s):
        out.append("spelled-email")
    if _NATIONAL.fullmatch(s):
        out.append("national")
    parts = s.split(".")
    if len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts):
        out.append("ip-shape" if all(map(_octet, parts)) else "four-parts")
    if n and not letters:
        out.append("numeric")
        if 13 <= n <= 19:
            out.append("luhn" if luhn(d) else "no-luhn")
            if re.fullmatch(r"[0-9]{4}([ .-]?[0-9]{4}){2,3}[ .-]?[0-9]{1,4}|[0-9]{13,19}", s):
                out.append("card-shape")
        if s.startswith("+"):
            out.append("plus")
        if re.fullmatch(r"\+?[0-9]{0,3}[ .-]?(\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})", s):
            out.append("phone-shape")
        if re.fullmatch(r"\(?0[0-9]{1,4}\)?([ -][0-9]{2,4}){2,4}|\(?0[0-9]{2,4}\)?[ -][0-9]{5,8}", s) and 9 <= n <= 11:
            out.append("national-phone")
        if re.fullmatch(r"[0-9]{1,4}([/.:-][0-9]{1,4}){1,2}", s):
            out.append("date-like")
    if _KEYED.fullmatch(s):
        out.append("keyed")
    if j - i == 1 and letters and n >= 3:
        if _PREFIXED.fullmatch(s):
            out.append("key-prefix")
        elif _HEX.fullmatch(s) and 4 * n > len(s):
            out.append("hex")
        elif len(s) >= 16 and s.isascii() and re.fullmatch(r"[A-Za-z0-9_+/=-]+", s):
            classes = sum(any(f(c) for c in s) for f in (str.islower, str.isupper, str.isdigit))
            out.append(f"dense={classes}")
    for kind, cues in _CUES.items():
        if before in cues:
            out.append(f"cue={kind}")
    if not s or (j - i > 1 and not (_TRIGGER.search(words[i]) and _TRIGGER.search(words[j - 1])) and not _KEYED.search(s) and "spelled-email" not in out):
        out.append("loose-ends")
    return out


class SemiMarkovField:
    """Weights for (label, feature) of segments and for neighbouring labels. Label 0 is outside, one word a segment."""

    labels = ("O", *KINDS)

    def __init__(self):
        self.number: dict[str, int] = {}
        self.w = np.zeros((len(self.labels), 0))
        self.t = np.zeros((len(self.labels), len(self.labels)))

    def _ids(self, features: list[str], grow: bool) -> list[int]:
        if grow:
            for f in features:
                self.number.setdefault(f, len(self.number))
            if self.w.shape[1] < len(self.number):
                self.w = np.hstack([self.w, np.zeros((len(self.labels), len(self.number) - self.w.shape[1]))])
        return [self.number[f] for f in features if f in self.number]

    def segments(self, words: Sequence[str], grow: bool = False) -> dict[tuple[int, int], list[int]]:
        n = len(words)
        return {(i, j): self._ids(["bias", *span_features(words, i, j)], grow) for i in range(n) for j in range(i + 1, min(n, i + MAX_WORDS) + 1)}

    def _scores(self, segments) -> dict[tuple[int, int], np.ndarray]:
        out = {}
        for (i, j), ids in segments.items():
            out[i, j] = self.w[:, ids].sum(axis=1)
            if j > i + 1:
                out[i, j][0] = -np.inf
        return out

    def _forward(self, n: int, scores) -> tuple[np.ndarray, np.ndarray]:
        """Log sums of all segmentations up to a place by their last label, and the same after the move to a next label."""
        k = len(self.labels)
        a, left = np.full((n + 1, k), -np.inf), np.zeros((n + 1, k))
        for j in range(1, n + 1):
            a[j] = _logsum(np.array([left[i] + scores[i, j] for i in range(max(0, j - MAX_WORDS), j)]), 0)
            left[j] = _logsum(a[j][:, None] + self.t, 0)
        return a, left

    def _backward(self, n: int, scores) -> tuple[np.ndarray, np.ndarray]:
        """Log sums of what follows a place by the label before it, and by the label of the segment that begins there."""
        k = len(self.labels)
        b, right = np.zeros((n + 1, k)), np.full((n + 1, k), -np.inf)
        for i in range(n - 1, -1, -1):
            right[i] = _logsum(np.array([scores[i, j] + b[j] for j in range(i + 1, min(n, i + MAX_WORDS) + 1)]), 0)
            b[i] = _logsum(self.t + right[i][None, :], 1)
        return b, right

    def marginals(self, n: int, scores) -> tuple[float, dict[tuple[int, int], np.ndarray], np.ndarray]:
        """Log of the partition sum, probabilities of all labelled segments, expected label transitions."""
        (a, left), (b, right) = self._forward(n, scores), self._backward(n, scores)
        z = float(_logsum(a[n], 0))
        at = np.array(list(scores))
        p = np.exp(left[at[:, 0]] + np.array(list(scores.values())) + b[at[:, 1]] - z)
        moves = np.exp(a[1:n, :, None] + self.t + right[1:n, None, :] - z).sum(axis=0)
        return z, dict(zip(scores, p, strict=True)), moves

    def train(self, sentences: Sequence[tuple[list[str], list[tuple[int, int, int]]]], epochs: int = EPOCHS, rate: float = RATE, ridge: float = 1e-4) -> float:
        """Gradient ascent (with AdaGrad steps) on the log-likelihood; gives its last mean."""
        ready = [(len(words), self.segments(words, grow=True), gold) for words, gold in sentences]
        seen_w, seen_t = np.full_like(self.w, 1e-2), np.full_like(self.t, 1e-2)
        mean = 0.0
        for _ in range(epochs):
            mean = 0.0
            for n, segments, gold in ready:
                scores = self._scores(segments)
                z, seg, moves = self.marginals(n, scores)
                gw, gt = np.zeros_like(self.w), -moves
                for at, p in seg.items():
                    gw[:, segments[at]] -= p[:, None]
                last, gained = None, 0.0
                for i, j, y in gold:
                    gw[y, segments[i, j]] += 1
                    gained += scores[i, j][y] + (self.t[last, y] if last is not None else 0.0)
                    if last is not None:
                        gt[last, y] += 1
                    last = y
                mean += (gained - z) / len(ready)
                gw -= ridge * self.w
                seen_w += gw * gw
                seen_t += gt * gt
                self.w += rate * gw / np.sqrt(seen_w)
                self.t += rate * gt / np.sqrt(seen_t)
        return mean

    def decode(self, words: Sequence[str]) -> list[tuple[int, int, int, float]]:
        """The best segmentation's entities: first word, end, label, and their probability."""
        n, k = len(words), len(self.labels)
        scores = self._scores(self.segments(words))
        best, back = np.full((n + 1, k), -np.inf), {}
        for j in range(1, n + 1):
            for i in range(max(0, j - MAX_WORDS), j):
                step = np.zeros((1, k)) if i == 0 else best[i][:, None] + self.t
                total = step.max(axis=0) + scores[i, j]
                for y in np.flatnonzero(total > best[j]):
                    best[j, y] = total[y]
                    back[j, int(y)] = (i, int(step[:, y].argmax()) if i else 0)
        j, y, found = n, int(best[n].argmax()), []
        while j:
            i, before = back[j, y]
            if y:
                found.append((i, j, y))
            j, y = i, before
        if not found:
            return []
        _, seg, _ = self.marginals(n, scores)
        return [(i, j, y, float(seg[i, j][y])) for i, j, y in reversed(found)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def generated(n: int = GENERATED, seed: int = 29) -> list[tuple[list[str], list[tuple[int, int, int]]]]:
    """Labelled stretches of words: entities in their usual and unusual forms, and numbers that are none."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choices(string.digits, k=k))
    name = lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 8)))

    def card() -> str:
        d = "4" + num(14)
        d += next(c for c in string.digits if luhn(d + c))
        sep = rng.choice(["", "", " ", "-", "."])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        inland = rng.choice([f"0{num(2)} {num(4)} {num(4)}", f"0{num(4)} {num(6)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"0{num(3)} {num(3)} {num(4)}"])
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {a} {b} {c}", inland, inland])

    def email() -> str:
        a, h = name() + rng.choice(["", ".", "_"]) + rng.choice(["", num(2)]), f"{name()}.{rng.choice(['com', 'org', 'net'])}"
        at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) ")])
        spelled = dot.join(name() for _ in range(rng.randint(1, 2))) + at + name() + dot + rng.choice(["com", "org", "net"])
        return rng.choice([f"{a or 'x'}@{h}", f"{name()}@{h}", f"{name()} @ {h}", spelled])

    def secret() -> str:
        value = rng.choice(["".join(rng.choices("0123456789abcdef", k=rng.choice([18, 32, 40]))), "".join(rng.choices(string.ascii_letters + string.digits, k=24))])
        key = rng.choice(["password", "token", "api_key", "secret", "pwd", "DB_PASSWORD", "AWS_SECRET_ACCESS_KEY", "client_secret", "auth_token"])
        some = "".join(rng.choices(string.ascii_letters + string.digits, k=rng.choice([20, 36])))
        phrase = "".join(rng.choices(string.ascii_letters + string.digits + "&!$/+", k=rng.randint(8, 14))) + num(1)
        slashed = "".join(rng.choices(string.ascii_letters + string.digits + "/+", k=39)) + num(1)
        value = rng.choice([value, value, phrase, slashed])
        named = rng.choice(["ghp_", "gho_", "glpat-", "sk-", "sk_live_", "xoxb-", "AIza"]) + some
        return rng.choice([f"{key}={value}", f'{key} = "{value}"', f"{key}: {value}", "AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16)), named])

    def person() -> str:
        nino = "".join(rng.choices("ABCEGHJKLMNPRSTWXYZ", k=2)) + rng.choice([" ", ""]).join(["", num(2), num(2), num(2), rng.choice("ABCD")])
        return rng.choice([f"{num(3)}-{num(2)}-{num(4)}", f"{num(3)}-{num(2)}-{num(4)}", nino])

    def other() -> str:
        return rng.choice([
            num(rng.randint(1, 8)), f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(2)}:{num(2)}", f"{num(1)}.{num(2)}.{num(1)}", f"${num(3)}.{num(2)}",
            f"{num(2)}%", f"v{num(1)}.{num(1)}", name() + num(2), f"{num(3)},{num(3)},{num(3)}", f"@{name()}", num(rng.randint(10, 12)), "1" + num(15), f"{num(4)} {num(4)}", "300.4.5." + num(3),
            "".join(rng.choices("0123456789abcdef", k=8)), f"{name()}-{num(3)}", f"({num(4)})", f"{num(1)} {num(2)} {num(1)} {num(3)}",
            f"{num(4)}-{num(4)}", f"{num(2)}-{num(3)}-{num(3)}", f"{num(5)}-{num(4)}", f"{name()} at {num(2)}", f"{name()}={num(3)}", f"{name()}: {num(5)}", f"ISBN {num(3)}-{num(1)}-{num(4)}-{num(4)}-{num(1)}",
        ])

    makers = {1: email, 2: lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), 3: card, 4: phone, 5: secret, 6: person}
    out = []
    for _ in range(n):
        words: list[str] = []
        gold: list[tuple[int, int, int]] = []

        def add(text: str, y: int, words=words, gold=gold) -> None:
            for k, w in enumerate(parts := text.split(" ")):
                if y == 0:
                    gold.append((len(words), len(words) + 1, 0))
                elif k == 0:
                    gold.append((len(words), len(words) + len(parts), y))
                words.append(w)

        add(name(), 0)
        for _ in range(rng.randint(1, 3)):
            y = rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 5, 6])
            if y and rng.random() < 0.2:
                add(rng.choice(_CUES[KINDS[y - 1]]), 0)
            text = makers[y]() if y else other()
            add(text + (rng.choice(["", "", ".", ","]) if "=" not in text else ""), y)
            if rng.random() < 0.5:
                add(name(), 0)
        out.append((words, gold))
    return out


@functools.cache
def trained() -> SemiMarkovField:
    made = SemiMarkovField()
    made.train(generated())
    return made


def _words_before(text: str, low: int, high: int, n: int) -> list[tuple[int, int]]:
    """The last ``n`` words of a part of a text, however far they stand from its end."""
    found: list[tuple[int, int]] = []
    while len(found) < n:
        while high > low and text[high - 1] in _SPACES:
            high -= 1
        if high <= low:
            break
        start = max(low, *(text.rfind(c, low, high) + 1 for c in _SPACES))
        found.append((start, high))
        high = start
    return found[::-1]


def _triggers(text: str) -> Iterable[tuple[int, int]]:
    """Words that may be part of an entity, in order."""
    spelled: list[tuple[int, int]] = []
    if " dot " in (low := text.lower()) or "[dot]" in low or "(dot)" in low:
        for m in _SPELLED.finditer(text):
            first = _words_before(text, 0, m.start() + 1, 1)[0][0]
            place = max(first, spelled[-1][1] if spelled else 0)
            while place < m.end() and (w := _WORD.search(text, place)) is not None and w.start() < m.end():
                spelled.append(w.span())
                place = w.end()
    at = 0
    for start, end in [*spelled, (len(text) + 1, len(text) + 1)]:
        while (m := _TRIGGER.search(text, at)) is not None and m.start() < start:
            begins = max(at, *(text.rfind(c, at, m.start()) + 1 for c in _SPACES))
            w = _WORD.match(text, begins)
            at = w.end()
            yield w.span()
        if at <= start < len(text):
            at = end
            yield start, end


def stretches(text: str) -> Iterable[list[tuple[int, int]]]:
    """Word places of stretches: words with a trigger, those that join them, and one to three words before."""
    held: list[tuple[int, int]] = []
    last = 0
    for start, end in _triggers(text):
        earlier = _words_before(text, last, start, 3)
        between = [text[a:b].lower() for a, b in earlier]
        if held and (not earlier or all(x in _JOIN for x in between) and len(between) < 3):
            held += earlier
        else:
            if held:
                yield held
            keep = 3 if between and between[-1] in _JOIN else 1
            held = earlier[-keep:]
        held.append((start, end))
        last = end
    if held:
        yield held


def _merged(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(e, ends[-1])
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def added_spans(text: str, field: SemiMarkovField, base: Sequence[Span], known: dict) -> list[Span]:
    """Entities of the field that overlap no base span, in order. ``known`` keeps results of equal stretches."""
    out: list[Span] = []
    starts, ends = _merged((s, e) for _, s, e in base)

    def within(a: int, b: int) -> bool:
        k = bisect_right(starts, a) - 1
        return k >= 0 and b <= ends[k]

    def apart(a: int, b: int) -> bool:
        k = bisect_right(ends, a)
        return k == len(starts) or b <= starts[k]

    for places in stretches(text):
        done = 0  # words up to here belong to entities found
        for lo in range(0, len(places), WINDOW):  # an entity is taken from the window it begins in, where it lies whole
            first = max(0, lo - MARGIN)
            part = places[first : lo + WINDOW + MARGIN]
            words = [text[a:b] for a, b in part]
            if starts and all(within(a, b) for (a, b), w in zip(part, words, strict=True) if _TRIGGER.search(w)):
                continue
            key = tuple(words)
            if key not in known:
                if len(known) > 20_000:
                    known.clear()
                known[key] = field.decode(words)
            for i, j, y, p in known[key]:
                if not lo <= first + i < lo + WINDOW or first + i < done:
                    continue
                done = first + j
                start, end = part[i][0], part[j - 1][1]
                piece = text[start:end]
                inner = piece.strip(_EDGE) if y != 4 else piece.rstrip(_EDGE).lstrip(_EDGE.replace("(", ""))
                start += piece.find(inner) if inner else 0
                end = start + len(inner)
                if p >= CERTAIN and start < end and apart(start, end):
                    out.append((field.labels[y], start, end))
    return out


def listed(spans: Iterable[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def find_pii(docs: DataFrame, carry: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Counts and hash of the base spans, and all spans as ``kind:start:end``, offsets in code points."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def make():
        field, known = sent.value, {}

        def one(text):
            text = text or ""
            base = base_spans(text)
            more = added_spans(text, field, base, known)
            counts = [sum(k == b[0] for b in base) for k in BASE_KINDS]
            return (*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more), len(base) + len(more))

        return lambda texts: rows_of(len(OUT), [one(t) for t in texts])

    return map_texts(docs, carry, text_col, make, OUT)
