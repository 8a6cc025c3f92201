"""Secret scans: base patterns, and guess costs of values in credential context.

The base patterns find assignments to well-known names, access keys and long
hexadecimal strings.  The method goes by what a value would take to guess: a
dynamic program cuts it into words, dates, repeats, keyboard walks and
brute-force spans at the least total cost, and a value that stands in a
credential context and costs ``LEAST_BITS`` or more is a secret too: the cost
alone decides.

Words come from a list by rank, which callers give; from the same list a model
of letter triples says how well a run of letters reads, so that a word of the
language that is not in the list costs less than random letters.  What divides
the parts of a name costs little after its first time, so names made of words
stay below the threshold.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_small_batches

KINDS = ["assign", "access", "hex", "guess"]
#: Guesses, as a power of two, above which a value is no password that one makes up.
LEAST_BITS = 53.0

# Base patterns: fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Names of credentials that the base pattern lacks, and values after them.
CONTEXT_NAMES = ("pwd", "passphrase", "credential", "auth", "bearer", "private", "access", "signature", "session", "pin", "pass", *NAMES)
#: What stands before a value without a separator: a name and "is", or "bearer".
SPOKEN = re.compile(
    r"(?<![A-Za-z0-9])(?:pwd|passphrase|credentials?|auth|authorization|bearer|private[_-]?key|access[_-]?key|signature|session[_-]?(?:id|key)|pin|pass|password|passwd|secret|token|api[_-]?key)"
    r"""["']?(?:\x20+is(?=\x20)|(?<=bearer)(?=\x20))""",
    re.IGNORECASE | re.ASCII,
)

#: Separators with a value, and names of any length that stand before them.
SEPARATOR = re.compile("=>|:=|[:=]")
BARE = re.compile(r"""[^\s"'`]{8,}""")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
NAME = re.compile(r"_(?:pwd|passphrase|credentials?|auth|authorization|bearer|private_?key|access_?key|signature|session_?(?:id|key)|pin|pass|password|passwd|secret|token|api_?key)_")

#: Words that passwords are made of, the most common first.
WORDS = (
    "password letmein welcome admin login master dragon monkey shadow sunshine princess football baseball secret token key test demo user root example default changeme hello "
    "love money summer winter spring autumn monday friday january february march april june july august september october november december the and for you this that with "
    "pass word public private server client secure access service system database backup temp sample dummy none null true false value string your here"
).split()
#: Words of one or two letters, as parts of names.
SHORT = frozenset("a of to in on by is my at or id it no an as do if me so up us we db io ip js os ui url".split())
LEET = str.maketrans("013457@$!", "oieastasi")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)")


def _alphabet(value: str) -> float:
    """Bits of one character of the classes that ``value`` draws on."""
    if not value.strip("0123456789"):
        return math.log2(10)
    if not value.strip("0123456789abcdef"):
        return 4.0
    size = 10 * any(map(str.isdigit, value)) + 26 * any(map(str.islower, value)) + 26 * any(map(str.isupper, value))
    return math.log2(size + 32 * (not value.isalnum()) or 1)


#: Bits that tell the kind of a span; that begin a run of letters or digits; of
#: a short word; of a mark at its first time and later.
KIND, LETTERS, SHORT_WORD, MARK, AGAIN = 0.5, 2.0, 4.0, 5.0, 1.0
DIGIT = math.log2(10)
LONGEST_UNIT = 8


class Guesser:
    """Guess costs by a list of words, the most common first."""

    def __init__(self, words: list[str] = WORDS):
        self.rank: dict[str, int] = {}
        for w in [*WORDS, *words]:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))
        counts = np.full((27, 27, 26), 0.05)  # letters after the two before; 26: none
        for w in self.rank:
            at = [26, 26, *(ord(c) - 97 for c in w if "a" <= c <= "z")]
            for x, y, z in zip(at, at[1:], at[2:], strict=False):
                counts[x, y, z] += 1
        self.letters = np.log2(counts.sum(axis=2, keepdims=True) / counts).tolist()

    def letter(self, lower: str, i: int, first: bool = False) -> float:
        """Bits of the letter at ``i`` after the two characters before it."""
        at = lambda j: ord(lower[j]) - 97 if j >= 0 and "a" <= lower[j] <= "z" else 26
        x, y = (26, 26) if first else (at(i - 2), at(i - 1))
        return self.letters[x][y][at(i)]

    def word(self, value: str) -> float | None:
        """Bits of a known word, in any case and with digits for letters."""
        lower = value.lower()
        plain = lower.translate(LEET)
        rank = self.rank.get(lower) or self.rank.get(plain)
        if lower in SHORT:
            return SHORT_WORD + (value != lower)
        if not rank or len(value) < 3:
            return None
        return math.log2(rank) + (value != lower) + 2 * (lower not in self.rank)

    def spans(self, value: str) -> list[list[tuple[int, float]]]:
        """Words, dates and keyboard walks by where they end: (start, bits)."""
        n, lower = len(value), value.lower()
        out: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        letter = [c.isascii() and c.isalpha() for c in value] + [False]
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if j < i + 3 and (letter[j] or (i and letter[i - 1])):  # a short word is a part by itself
                    continue
                bits = self.word(value[i:j])
                if bits is not None:
                    out[j].append((i, bits))
            if m := DATE.match(value, i):
                out[m.end()].append((i, math.log2(365 * 120) if m.end() - i > 4 else math.log2(120)))
        i = 0
        while i < n:  # neighbours on a row of keys, one way or the other
            j, way = i, 0
            while j + 1 < n and (a := PLACE.get(lower[j])) and (b := PLACE.get(lower[j + 1])) and a[0] == b[0] and abs(d := b[1] - a[1]) == 1 and way in (0, d):
                way, j = d, j + 1
            if j - i >= 2:
                for end in range(i + 3, j + 2):
                    out[end].append((i, math.log2(94) + 1 + math.log2(end - i)))
            i = max(j, i + 1)
        return out

    def bits(self, value: str) -> float:
        """Log2 of the guesses for the cheapest cut of ``value`` into spans.

        One pass over its ends: ``best[j]`` is the least cost of the first ``j``
        characters, and ``run[j]`` if they end in a run of letters, or of digits.
        A mark costs less once it has occurred.  A unit may be told to repeat
        once, or as often as it does.
        """
        n, lower, per = len(value), value.lower(), _alphabet(value)
        spans, caps = self.spans(value), value.isupper()
        best, run, seen = [0.0] + [math.inf] * n, [math.inf] * (n + 1), set()
        repeats = [[0] * (n + 1) for _ in range(LONGEST_UNIT + 1)]
        for j in range(1, n + 1):
            c = value[j - 1]
            if c.isascii() and c.isalpha():
                after = j > 1 and value[j - 2].isascii() and value[j - 2].isalpha() and (c.islower() or caps)
                going = run[j - 1] + self.letter(lower, j - 1) if after else math.inf
                run[j] = min(going, best[j - 1] + LETTERS + self.letter(lower, j - 1, True))
            elif c.isascii() and c.isdigit():
                before = run[j - 1] if j > 1 and value[j - 2].isascii() and value[j - 2].isdigit() else math.inf
                run[j] = min(before, best[j - 1] + LETTERS) + DIGIT
            elif c.isascii():
                best[j] = best[j - 1] + (AGAIN if c in seen else MARK)
                seen.add(c)
            best[j] = min(best[j], best[j - 1] + per, run[j])
            for i, bits in spans[j]:
                best[j] = min(best[j], best[i] + bits + KIND)
            for unit in range(1, min(LONGEST_UNIT, j // 2) + 1):
                if value[j - unit : j] == value[j - 2 * unit : j - unit]:
                    times = repeats[unit][j] = repeats[unit][j - unit] + 1
                    best[j] = min(best[j], best[j - unit] + KIND, best[j - times * unit] + KIND + math.log2(times))
        return best[n]


def vocabulary_words(tokenizer_path: str) -> list[str]:
    """The words of a public byte-level vocabulary by its order, which goes by
    how often they occur: tokens of a space and three letters or more."""
    from tokenizers import Tokenizer

    space = "\u0120"  # how such vocabularies write a space
    ids = Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=False)
    words = (t[1:].lower() for t in sorted(ids, key=ids.get) if t[0] == space)
    return list(dict.fromkeys(w for w in words if len(w) >= 3 and w.isascii() and w.isalpha()))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, in that order."""
    out = []
    lower = text.lower()
    if any(map(lower.__contains__, NAMES)):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def all_spans(text: str, guesser: Guesser) -> tuple[list, list]:
    """The base spans; and those with the guessed values that touch none."""
    base = base_spans(text)
    lower = text.lower()
    if not any(map(lower.__contains__, CONTEXT_NAMES)):
        return base, base
    values = dict(filter(None, (_value(text, m.end()) for m in SPOKEN.finditer(text)))) | dict(_set_values(text))
    ends, reach = [], -1  # of base spans by start, how far they and all before them reach
    for _, _, e in base:
        reach = max(reach, e)
        ends.append(reach)
    starts, more, done = [s for s, _, _ in base], [], 0
    for a, b in sorted(values.items()):
        i = bisect_left(starts, b)
        if a < done or b - a < 8 or (i and ends[i - 1] > a):
            continue
        if guesser.bits(text[a:b]) >= LEAST_BITS:
            more.append((a, 3, b))
            done = b
    return base, sorted(base + more)


_PAIRS = {")": "(", "]": "[", "}": "{", ">": "<"}


def _value(text: str, at: int) -> tuple[int, int] | None:
    """The value after ``at`` and spaces: in quotes to the same quote on that
    line, else to white space or a quote, less the marks that end a sentence or
    close what opens before it."""
    while at < len(text) and text[at] == " ":
        at += 1
    if text[at : at + 1] in ("'", '"', "`"):
        end, line = text.find(text[at], at + 1), text.find("\n", at + 1)
        at += 1
        if end >= 0 and not 0 <= line < end:
            return (at, end) if end - at >= 8 else None
    m = BARE.match(text, at)
    if not m:
        return None
    value = m.group()
    while value and (value[-1] in ".,:;!?" or value.count(_PAIRS.get(value[-1], value[-1])) < value.count(value[-1])):
        value = value[:-1]
    return (at, at + len(value)) if len(value) >= 8 else None


def _set_values(text: str):
    """Values after a separator whose name has a credential's among its parts,
    which ``_``, ``-`` or an inner capital divide.  From the separator to the
    left, so names don't overlap and the whole is linear."""
    at = 0
    while m := SEPARATOR.search(text, at):
        b = m.start()
        while b > at and text[b - 1] == " ":
            b -= 1
        b -= b > at and text[b - 1] in "\"'"
        a = b
        while a > at and text[a - 1] in _IN_NAME:
            a -= 1
        name, at = text[a:b], m.end()
        parts = "_".join(NAME_PART.findall(name)).lower()
        if NAME.search(f"_{parts}_") or NAME.search("_" + name.lower().replace("-", "_") + "_"):
            v = _value(text, at)
            if v and text[slice(*v)].lower() != "bearer":
                yield v
                at = v[1]


_IN_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-")


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: list[str] = WORDS) -> DataFrame:
    """One row for each row of ``docs``: the id, the base spans counted by kind,
    ``base_sha256`` of ``kind:start:end`` of each (by start, then kind,
    comma-joined; code points, end exclusive) and ``spans``, so written, of the
    base patterns and the guessed values.  ``words`` are those known to
    guessers, the most common first.

    Null text is empty: no spans.  Texts and values of any length are read
    whole.  Null or repeated ids change nothing; further columns are not read.
    Empty input: no rows.
    """
    in_small_batches(docs.sparkSession)
    guesser = Guesser(words)

    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, spans = all_spans(text or "", guesser)
            counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    got = F.pandas_udf(find, RESULT)(F.col(text_col).cast("string"))
    return docs.select(F.col(id_col).alias("doc_id"), got.alias("_found")).select("doc_id", "_found.*")
