"""Personal data: base patterns and a character-level BiLSTM-CRF.

The base patterns find what is written as it should be.  A bidirectional LSTM
over character classes with a linear-chain CRF on top, trained here from
labelled spans (``train_tagger`` made the weights in ``tagger.npz``), adds what
is written otherwise.  A span that the model may add
holds ``@``, or is a number: groups of digits with three characters at most
between them, ten digits or four groups in all.  So only the text around such
places is decoded, in windows that overlap by half; a number is shorter than
that overlap.  An address that a window's edge cuts is read again in a wider
window, until it is whole, so no length or position is lost; spans that several
windows propose are reconciled over the whole text by the set of non-overlapping
spans with the greatest total score.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_small_batches

KINDS = ["email", "ip", "card", "phone"]
TAGS = ["O", *(f"{x}-{k}" for k in KINDS for x in "BI")]
#: Of training: characters of a window, and from one to the next.
WINDOW, STRIDE = 160, 80
#: Of decoding: characters read on each side of a trigger, and of a window at most.
REACH, PIECE = 128, 512
#: Least score (log-odds against no span, summed over its characters) to add a span.
LEAST_SCORE = 6.0

# Base patterns: fixed values.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # no match begins within a run of digits, so these go unread
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    """Matches of EMAIL; around each @ only, as a name has no other end."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and _NAME[min(ord(text[start - 1]), 128)]:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            yield m.start(), m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


_NAME = [chr(c).isalnum() and c < 128 or chr(c) in "._%+-" for c in range(129)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, in that order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if any(map(text.__contains__, "0123456789")):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out)


# ---------------------------------------------------------------- the model

#: Characters with a class of their own; others go by kind.
OWN = "@.-_+()% \n:=\"',/0"
CLASSES = len(OWN) + 6


def _class(c: int) -> int:
    ch = chr(c)
    if ch in OWN and ch != "0":
        return OWN.index(ch)
    if "0" <= ch <= "9":
        return OWN.index("0")
    n = len(OWN)
    return n if "a" <= ch <= "z" else n + 1 if "A" <= ch <= "Z" else n + 2 if c < 128 else n + 3


_CLASS = np.array([_class(c) for c in range(129)], np.int8)
PAD = CLASSES - 1


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(codes, 128)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """A BiLSTM over character classes and a CRF over ``TAGS``, in numpy."""

    def __init__(self, hidden: int = 32, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        normal = lambda *shape: (rng.standard_normal(shape) * 0.25).astype(np.float32)
        self.p = {"out": normal(2 * hidden, len(TAGS)), "bias": np.zeros(len(TAGS), np.float32), "trans": np.zeros((len(TAGS), len(TAGS)), np.float32)}
        for d in "fb":
            b = np.zeros(4 * hidden, np.float32)
            b[hidden : 2 * hidden] = 1.0  # gates start by remembering
            self.p |= {f"x{d}": normal(CLASSES, 4 * hidden), f"h{d}": normal(hidden, 4 * hidden), f"b{d}": b}

    def _run(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        p, n = self.p, self.hidden
        steps = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        h = c = np.zeros((len(x), n), np.float32)
        out = np.zeros((len(x), x.shape[1], n), np.float32)
        for t in steps:
            z = p[f"x{d}"][x[:, t]] + h @ p[f"h{d}"] + p[f"b{d}"]
            i, f, o, g = _sigmoid(z[:, :n]), _sigmoid(z[:, n : 2 * n]), _sigmoid(z[:, 2 * n : 3 * n]), np.tanh(z[:, 3 * n :])
            before, before_h = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, before, before_h, tc))
        return out

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        both = np.concatenate([self._run(x, d, None if keep is None else keep.setdefault(d, [])) for d in "fb"], axis=2)
        if keep is not None:
            keep["both"] = both
        return both @ self.p["out"] + self.p["bias"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of a window, and its gradients."""
        p, n, keep = self.p, self.hidden, {}
        e = self.emissions(x, keep).astype(np.float64)
        trans = p["trans"].astype(np.float64)
        rows, steps = x.shape
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, steps):
            alpha[:, t] = e[:, t] + _logsum(alpha[:, t - 1, :, None] + trans, 1)
        for t in range(steps - 2, -1, -1):
            beta[:, t] = _logsum(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _logsum(alpha[:, -1], 1)
        de = np.exp(alpha + beta - z[:, None, None])
        pairs = np.zeros_like(trans)
        for t in range(1, steps):
            pairs += np.exp(alpha[:, t - 1, :, None] + trans + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(axis=0)
        at, along = np.arange(rows)[:, None], np.arange(steps)
        loss = float((z - e[at, along, y].sum(axis=1) - trans[y[:, :-1], y[:, 1:]].sum(axis=1)).mean())
        de[at, along, y] -= 1
        pairs -= np.bincount((y[:, :-1] * len(TAGS) + y[:, 1:]).ravel(), minlength=pairs.size).reshape(pairs.shape)
        de = (de / rows).astype(np.float32)
        both = keep["both"]
        g = {"trans": (pairs / rows).astype(np.float32), "out": both.reshape(-1, 2 * n).T @ de.reshape(-1, len(TAGS)), "bias": de.sum(axis=(0, 1))}
        dboth, one = de @ p["out"].T, np.eye(CLASSES, dtype=np.float32)[x]
        for d, own in (("f", dboth[:, :, :n]), ("b", dboth[:, :, n:])):
            dx, dh, db = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"h{d}"]), np.zeros_like(p[f"b{d}"])
            back_h = back_c = np.zeros((rows, n), np.float32)
            for t, i, f, o, gate, before, before_h, tc in reversed(keep[d]):
                h = own[:, t] + back_h
                c = back_c + h * o * (1 - tc * tc)
                dz = np.concatenate([c * gate * i * (1 - i), c * before * f * (1 - f), h * tc * o * (1 - o), c * i * (1 - gate * gate)], axis=1)
                dx += one[:, t].T @ dz
                dh += before_h.T @ dz
                db += dz.sum(axis=0)
                back_h, back_c = dz @ p[f"h{d}"].T, c * f
            g |= {f"x{d}": dx, f"h{d}": dh, f"b{d}": db}
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 96, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam over shuffled batches, the rate falling to nothing; the mean loss
        of each epoch."""
        rng, step, losses = np.random.default_rng(seed), 0, []
        steps = epochs * -(-len(x) // batch)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for _ in range(epochs):
            order, total = rng.permutation(len(x)), []
            for a in range(0, len(x), batch):
                step += 1
                now = rate * (1 + math.cos(math.pi * step / (steps + 1))) / 2
                loss, g = self.gradients(x[order[a : a + batch]], y[order[a : a + batch]])
                norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
                for k, w in g.items():
                    w = w * min(1.0, 5.0 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * w
                    v[k] = 0.999 * v[k] + 0.001 * w * w
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                total.append(loss)
            losses.append(float(np.mean(total)))
        return losses

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (Viterbi) of each window, and the emissions."""
        e, trans = self.emissions(x), self.p["trans"]
        rows, steps = x.shape
        best, came = e[:, 0], np.zeros((rows, steps, len(TAGS)), np.int8)
        for t in range(1, steps):
            total = best[:, :, None] + trans
            came[:, t] = total.argmax(axis=1)
            best = total.max(axis=1) + e[:, t]
        tags = np.zeros((rows, steps), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = came[np.arange(rows), t, tags[:, t]]
        return tags, e


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


# ------------------------------------------------- labelled spans to train on


def _example(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A text with labelled spans, and with numbers that are none."""
    pick = lambda options: options[rng.integers(len(options))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(pick("abcdefghijklmnoprstuvéü") for _ in range(rng.integers(1, 9)))

    def email() -> str:
        if rng.random() < 0.3:  # a long one
            name, host = [word() for _ in range(rng.integers(2, 11))], [word() for _ in range(rng.integers(1, 8))]
            return pick([".", ".", "_", "-"]).join(name) + pick(["@", " @ ", " @ ", "(@)"]) + ".".join([*host, pick(["com", "org", "example.com", "net"])])
        name = word() + pick(["", ".", "_", "+", "."]) + pick([digits(2), word()])
        return name + pick(["@", "@", "@", " @ ", "(@)"]) + word() + pick(["", digits(1)]) + pick([".", ".", " . "]) + pick(["com", "org", "example.com", "net"])

    def ip() -> str:
        return pick([".", ".", ".", " . ", "-"]).join(str(rng.integers(0, 256)) for _ in range(4))

    def card() -> str:
        body = pick(["4", "5", "34"]) + digits(14)
        body = body[:15]
        body += next(c for c in "0123456789" if luhn(body + c))
        return pick(["", "", " ", "-", "."]).join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{digits(2)} {a} {b} {c}"])

    def table() -> str:
        return pick([" ", " ", ", ", "  ", "\n", "\t"]).join(digits(rng.integers(1, pick([2, 4, 6]))).lstrip("0") or "0" for _ in range(rng.integers(4, 14)))

    def none() -> str:
        hexed = "".join(pick("0123456789abcdef") for _ in range(rng.integers(12, 41)))
        return pick([digits(rng.integers(1, 9)), f"{rng.integers(1900, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", f"{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}", f"{digits(2)}%", f'token = "{hexed}"', f"password={hexed}", f"AKIA{hexed[:16].upper()}", f"@{word()}", f"{digits(2)}.{digits(3)},{digits(2)}",
            f"{digits(1)}.{digits(1)}.{digits(1)}-{digits(1)}", f"v{digits(1)}.{digits(2)}.{digits(1)}", f"{rng.integers(10, 29)}-{rng.integers(10, 13)}-{rng.integers(1900, 2030)}", f"{digits(4)}-{digits(4)}",
            f"{digits(1)}-{digits(2)}-{digits(2)}", f"{digits(3)}-{digits(4)}", f"{digits(2)} {digits(3)}", f"{word()}-{digits(3)}-{digits(4)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{word()} @ {word()}", table(), table(), table(),
            f"{digits(2)}:{digits(2)}:{digits(2)} {digits(3)} {digits(5)}"])

    text, spans = "", []
    for _ in range(rng.integers(8, 22)):
        text += pick([" ", " ", " ", " ", ", ", ". ", "\n"]) if text else ""
        r = rng.random()
        if r < 0.16:
            kind = int(rng.integers(4))
            value = (email, ip, card, phone)[kind]()
            spans.append((len(text), kind, len(text) + len(value)))
            text += value
        else:
            text += none() if r < 0.28 else word().capitalize() if r < 0.4 else word()
    return text, spans


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of classes and tags around the labelled spans of ``n`` texts."""
    rng, xs, ys = np.random.default_rng(seed), [], []
    for _ in range(n):
        text, spans = _example(rng)
        tags = np.zeros(len(text), np.int64)
        for a, kind, b in spans:
            tags[a:b] = 2 + 2 * kind
            tags[a] = 1 + 2 * kind
        x = classes(text)
        for a in range(0, max(1, len(text) - STRIDE), STRIDE):
            own = x[a : a + WINDOW]
            row, tag = np.full(WINDOW, PAD), np.zeros(WINDOW, np.int64)
            row[: len(own)], tag[: len(own)] = own, tags[a : a + WINDOW]
            xs.append(row)
            ys.append(tag)
    return np.array(xs), np.array(ys)


#: Made by ``python -m gridloom.llm.train_tagger``.
WEIGHTS = Path(__file__).with_name("tagger.npz")


@functools.cache
def trained() -> Tagger:
    """The tagger with the weights of ``WEIGHTS``, read on the driver and sent
    with the tasks (some 30,000 numbers)."""
    with np.load(WEIGHTS) as stored:
        model = Tagger(hidden=len(stored["hf"]))
        model.p = {k: stored[k].astype(np.float32) for k in model.p}
    return model


# ------------------------------------------------------------ global decoding

#: Groups of digits with little between them, of which a number is made; a group
#: of more digits than any number has stands between two runs.
_RUN = re.compile(r"(?<![0-9])[0-9]{1,19}(?![0-9])(?:[\s.()+-]{1,3}[0-9]{1,19}(?![0-9]))*")
_NUMBER = re.compile(rf"[+(]{{0,2}}{_RUN.pattern}\)?")
_GROUP = re.compile("[0-9]+")
_FOUR = re.compile(r"[0-9]+(?:\s?[.-]\s?[0-9]+){3}")


def _triggers(text: str) -> list[tuple[int, int]]:
    """Each ``@``, and the runs of digits that can hold a number: ten digits, or
    the four groups of an address."""
    out = [(m.start(), m.end()) for m in re.finditer("@", text)]
    for m in _RUN.finditer(text):
        groups = _GROUP.findall(m.group())
        if len(groups) >= 4 or sum(map(len, groups)) >= 10:
            out.append(m.span())
    return out


def _windows(text: str) -> list[tuple[int, int]]:
    """What to decode: ``REACH`` around each trigger, long ones in windows of
    ``PIECE`` that overlap by half."""
    out = []
    for a, b in _merged([(max(0, a - REACH), min(len(text), b + REACH)) for a, b in _triggers(text)]):
        out += [(c, min(b, c + PIECE)) for c in range(a, max(a + 1, b - PIECE // 2), PIECE // 2)]
    return out


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Their union, as ranges that don't meet."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _batches(todo: list[tuple[int, int, int]], cells: int):
    """``todo`` by length, in parts of ``cells`` characters, padding included."""
    todo = sorted(todo, key=lambda w: w[2] - w[1])
    while todo:
        n = 1
        while n < len(todo) and (n + 1) * (todo[n][2] - todo[n][1]) <= cells:
            n += 1
        yield todo[:n]
        todo = todo[n:]


def model_spans(texts: list[str], model: Tagger, cells: int = 1 << 15) -> list[list[tuple[int, int, int]]]:
    """The spans that the model proposes in each text, reconciled over it."""
    todo = [(k, a, b) for k, text in enumerate(texts) for a, b in _windows(text)]
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    sought: dict[int, list[tuple[int, int]]] = {}  # what the windows of ``todo`` shall have whole
    reach = REACH
    while todo:
        whole: dict[int, list[tuple[int, int]]] = {}
        cut: dict[int, list[tuple[int, int]]] = {}
        for part in _batches(todo, cells):
            x = np.full((len(part), part[-1][2] - part[-1][1]), PAD)
            for row, (k, a, b) in zip(x, part, strict=True):
                row[: b - a] = classes(texts[k][a:b])
            tags, e = model.decode(x)
            margin = e - e[:, :, :1]
            for i in np.flatnonzero(tags.any(axis=1)):
                k, start, stop = part[i]
                for first, end, kind in _tagged(tags[i].tolist()):
                    a, b = start + first, min(start + end, stop)
                    if a >= stop:
                        continue
                    left, right = a == start > 0, b == stop < len(texts[k])
                    if kind == 0:
                        if left or right:
                            cut.setdefault(k, []).append((a, b))
                            continue
                        whole.setdefault(k, []).append((a, b))
                    for c, d in _values(texts[k], a, b, kind):
                        if (left and c == a) or (right and d == b):
                            continue  # numbers are short, so another window has it whole
                        score = float(margin[i, np.arange(c - start, d - start), tags[i, c - start : d - start]].sum())
                        if score >= LEAST_SCORE:
                            found[k].append((c, d, kind, score))
        # what no window had whole is read again with more on both sides, twice
        # as much each time; then other spans at the new edges don't matter
        todo, first_time, before, sought = [], reach == REACH, sought, {}
        for k, spans in cut.items():
            have = _furthest(whole.get(k, []))
            touched = _touching(before.get(k, []))
            sought[k] = [s for s in _merged(spans) if not have(*s) and (first_time or touched(*s))]
            wide = [(max(0, a - reach), min(len(texts[k]), b + reach)) for a, b in sought[k]]
            todo += [(k, a, b) for a, b in (_merged(wide) if reach >= 8 * REACH else wide)]
        reach *= 2
    return [_best(spans) for spans in found]


def _touching(ranges: list[tuple[int, int]]):
    """Whether one of ``ranges``, which don't meet, has a part in another range."""
    return lambda a, b: (i := bisect_left(ranges, (b,))) > 0 and ranges[i - 1][1] > a


def _tagged(tags: list[int]):
    """``(start, end, kind)`` of each run of one span's tags."""
    t = 0
    while t < len(tags):
        tag, first = tags[t], t
        t += 1
        if tag:
            kind = (tag - 1) // 2
            while t < len(tags) and tags[t] == 2 + 2 * kind:
                t += 1
            yield first, t, kind


def _furthest(spans: list[tuple[int, int]]):
    """Whether one of ``spans`` covers a range."""
    starts, ends = [], []
    for a, b in sorted(spans):
        starts.append(a)
        ends.append(max(b, ends[-1]) if ends else b)
    return lambda a, b: (i := bisect_right(starts, a)) > 0 and ends[i - 1] >= b


_WORD = re.compile(r"\S+")


def _address(text: str, start: int, end: int) -> tuple[int, int]:
    """An e-mail span less the words before and after that nothing joins to its
    first ``@``: spaces stand only around ``@`` and dots."""
    words = [m.span() for m in _WORD.finditer(text, start, end)]
    i = j = next((n for n, (a, b) in enumerate(words) if "@" in text[a:b]), -1)
    if i < 0:
        return start, end
    while i and (text[words[i][0]] in "@(." or text[slice(*words[i - 1])] == "."):
        i -= 1
    while j + 1 < len(words) and (text[words[j][1] - 1] in "@)" or text[slice(*words[j])] == "." or text[words[j + 1][0]] == "."):
        j += 1
    return words[i][0], words[j][1]


def _values(text: str, start: int, end: int, kind: int) -> list[tuple[int, int]]:
    """The plausible values in a span: an address less what isn't joined to it,
    the span itself, or those of several numbers that the model ran together."""
    if kind == 0:
        start, end = _address(text, start, end)
    if kind == 0 or _plausible(text[start:end], kind):
        return [(start, end)] if _plausible(text[start:end], kind) else []
    words, out, i = [m.span() for m in _WORD.finditer(text, start, end)], [], 0
    while i < len(words):
        # no value has more words than it has digits
        j = next((j for j in range(i, min(i + 24, len(words))) if _plausible(text[words[i][0] : words[j][1]], kind)), None)
        if j is not None:
            out.append((words[i][0], words[j][1]))
        i = i + 1 if j is None else j + 1
    return out


def _plausible(value: str, kind: int) -> bool:
    """Holds what no value of its kind lacks."""
    if kind == 0:
        return "@" in value and "." in value
    if not _NUMBER.fullmatch(value):
        return False
    n = len(_digits(value))
    if kind == 1:
        return n <= 12 and _FOUR.fullmatch(value) is not None
    if kind == 2:
        return 14 <= n <= 19 and luhn(_digits(value))
    return 10 <= n <= 15 and (value.startswith(("+", "(", "00")) or "-" in value or "." in value)


def _best(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The non-overlapping spans of the greatest total score (over the text)."""
    best: dict[tuple[int, int, int], float] = {}
    for a, b, kind, score in spans:
        best[a, b, kind] = max(score, best.get((a, b, kind), score))
    order = sorted(best, key=lambda s: (s[1], s[0], s[2]))
    totals, chosen = [0.0], [[]]
    ends = [s[1] for s in order]
    for i, s in enumerate(order):
        j = bisect_right(ends, s[0], 0, i)
        with_it = totals[j] + best[s]
        totals.append(max(totals[i], with_it))
        chosen.append((j, s) if with_it > totals[i] else None)
    out, i = [], len(order)
    while i > 0:
        if chosen[i]:
            out.append(chosen[i][1])
            i = chosen[i][0]
        else:
            i -= 1
    return [(a, kind, b) for a, b, kind in reversed(out)]


def all_spans(texts: list[str], model: Tagger) -> list[tuple[list, list]]:
    """For each text its base spans and all spans: the base ones, and those of
    the model that touch none of them."""
    out = []
    for text, proposed in zip(texts, model_spans(texts, model), strict=True):
        base = base_spans(text)
        if proposed and base:
            touched = _touching(_merged([(a, b) for a, _, b in base]))
            proposed = [s for s in proposed if not touched(s[0], s[2])]
        out.append((base, sorted(base + proposed)))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """One row for each row of ``docs``: the id, the base spans counted by kind,
    ``base_sha256`` of ``kind:start:end`` of each (by start, then kind,
    comma-joined; code points, end exclusive) and ``spans``, so written, of
    base and model.

    Null text is empty: no spans.  Texts of any length are read whole, as are
    spans.  Null or repeated ids change nothing; further columns are not read.
    Empty input: no rows.
    """
    in_small_batches(docs.sparkSession)
    model = model or trained()

    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for base, spans in all_spans([t or "" for t in texts], model):
            counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
            rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    got = F.pandas_udf(find, RESULT)(F.col(text_col).cast("string"))
    return docs.select(F.col(id_col).alias("doc_id"), got.alias("_found")).select("doc_id", "_found.*")


def redacted(text: Column, model: Tagger | None = None) -> Column:
    """``text`` with each span replaced by its kind in brackets; of spans that
    overlap, all they cover by the kind of the first.  Null stays null."""
    model = model or trained()

    def redact(texts: pd.Series) -> pd.Series:
        out = []
        for text, (_, spans) in zip(texts, all_spans([t or "" for t in texts], model), strict=True):
            parts, end = [], 0
            for a, kind, b in spans:
                if a >= end:
                    parts += [text[end:a], f"[{KINDS[kind].upper()}]"]
                end = max(end, b)
            out.append(text if text is None else "".join([*parts, text[end:]]))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(redact, "string")(text.cast("string"))
