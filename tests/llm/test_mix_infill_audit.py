"""Mixing, fill-in-the-middle and the filter audit against brute force and odd
rows; SQL compares their queries in ``test_operators``."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.errors import InvalidParameters
from gridloom.llm import audit, infill, mixing
from gridloom.llm.shared import saved

DOCS = "doc_id long, text string, source string"


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


# ---------------------------------------------------------------------- mixing


def mixed_by_force(rows, weights=(3, 1, 2), share=1.5, times=2):
    """Rows (id, source, size) -> (targets by source, words taken by row)."""
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for _, t, n in rows if t == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full = share * sum(own.values()), set()
    while True:
        left, w = budget - sum(times * own[s] for s in full), sum(weight[s] for s in names if s not in full) or 1
        new = {s for s in names if s not in full and left * weight[s] / w > times * own[s]}
        if not new:
            break
        full |= new
    target = {s: float(times * own[s]) if s in full else left * weight[s] / w for s in names}
    seen, queue = Counter(), defaultdict(list)
    for row in rows:
        d, s, n = row
        key = f"1:{'null' if d is None else d}:{n}:{seen[row]}"
        queue[s].append((int(hashlib.sha256(key.encode()).hexdigest()[:15], 16), n, (*row, seen[row])))
        seen[row] += 1
    entries = []
    for i, s in enumerate(names):
        until = 0
        for turn in range(times):
            for h, n, row in sorted(queue[s], key=lambda q: q[:2]):
                until += n
                entries.append((until / weight[s], i, turn, h, row))
    taken, spent = Counter(), 0
    for *_, row in sorted(entries, key=lambda e: e[:4]):
        spent += row[2]
        if spent > budget:
            break
        taken[row] += row[2]
    return target, {row: taken[row] for *_, row in entries}


def some_documents(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "", "b", None, "\U0001f600", "￿", "z"])
        rows.append((i, " ".join("w" * rng.randrange(1, 200)) if rng.random() < 0.95 else None, source))
    return rows + [rows[0]] * 50 + [(None, "no id", "b"), (None, "no id", "b"), (7, "", "c"), (9, None, "d")]


def sizes(rows):
    return [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in rows]


@pytest.mark.parametrize(("bits", "limit"), [(None, 1_000_000), (0, 2), (6, 2)])
def test_mixing_equals_brute_force(spark, monkeypatch, bits, limit):
    monkeypatch.setattr(mixing.queued, "__defaults__", (1, bits, limit))
    rows = some_documents()
    target, taken = mixed_by_force(sizes(rows))
    got = mixing.mixed(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.source: r.target for r in got} == pytest.approx(target)
    assert Counter((r.doc_id, r.source, r.size, r.taken) for r in got) == Counter((*row[:3], n) for row, n in taken.items())


def test_mixing_comes_near_its_targets(spark):
    got = mixing.mixed(frame(spark, some_documents(3000))).collect()
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 200 for s in target)  # the longest document
    assert sum(taken.values()) <= 1.5 * sum(r.size for r in got)


def test_mixing_is_the_same_again(spark):
    rows = some_documents()
    once, again = (Counter(mixing.mixed(frame(spark, rows[::step], parts=p)).collect()) for p, step in ((2, 1), (5, -1)))
    assert once == again


def test_mixing_edges(spark):
    assert mixing.mixed(frame(spark, [])).collect() == []
    only = mixing.mixed(frame(spark, [(1, None, None), (2, " \n", "x")])).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in only} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
    long = "word " * 300_000
    got = {r.doc_id: r for r in mixing.mixed(frame(spark, [(1, long, "x"), (2, "a b", "y"), (3, "a b", "y")])).collect()}
    assert got[1].size == 300_000 and got[2].target == 8.0 and got[2].taken == 4
    clash = frame(spark, [(1, "a b c", "x", 5, 6)], DOCS + ", size int, copies int")
    assert mixing.mixed(clash).first().size == 3
    with pytest.raises(InvalidParameters):
        mixing.mixed(clash, share=3.0)


def test_the_mix_itself_is_in_order(spark):
    counted = saved(mixing.word_counts(frame(spark, some_documents())), "counts")
    sources = mixing.targets(counted)
    queue = mixing.queued(counted, sources)
    mix, last = mixing.mix(queue, 5000.0)
    times = [r.finish for r in mix.orderBy(*mixing.ORDER).collect()]
    assert times == sorted(times) and times[-1] == last.finish
    assert 5000 - 200 <= mix.agg(F.sum("size")).first()[0] <= 5000


# ----------------------------------------------------------- fill-in-the-middle

TEXTS = ["", "a", "é", "日本語のテキスト", "x" * 5000, "😀" * 3000, "plain words and more\nlines\n", "<P>", "a<S>b", "a<M", "<", "ends with <S", "> starts", "\u0000nul"]


def infilled_by_force(doc_id, text):
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:low], text[low:high], text[high:]
    if h[3] % 100 < 20:
        return n, "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_infill_equals_brute_force(spark, chunk):
    rng = random.Random(chunk)
    texts = TEXTS + ["".join(rng.choices("ab \né日😀<PSM>", k=rng.randrange(300))) for _ in range(200)]
    rows = [(i * 37, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, None), (5, None), (74, "twice"), (74, "twice")]
    made = infill.fill_in_middle(frame(spark, rows, "doc_id long, text string"), chunk=chunk)
    got = Counter((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in made.collect())
    assert got == Counter((d, *infilled_by_force(d, t or "")) for d, t in rows)
    back = made.select("text", infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(r.text == r.back for r in back)


def test_infill_very_long_text_empty_table_and_clashing_names(spark):
    long = "aé😀\n" * 700_000
    row = infill.fill_in_middle(frame(spark, [(3, long, 1)], "doc_id long, text string, n int")).first()
    assert (row.n, row.form, row.prefix_units, row.middle_units, row.output) == infilled_by_force(3, long)
    assert infill.fill_in_middle(frame(spark, [], "doc_id long, text string")).collect() == []


def units_by_force(text, unit):
    pattern = {"code_point": r".", "word": r"[ \t\n\v\f\r]*[^ \t\n\v\f\r]+[ \t\n\v\f\r]*|[ \t\n\v\f\r]+", "line": r"[^\n]*\n|[^\n]+"}[unit]
    return re.findall(pattern, text, re.S)


@pytest.mark.parametrize("unit", sorted(infill.UNITS))
def test_chunks_count_units_and_find_their_places(unit):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab é日 \n😀", k=rng.randrange(60))) for _ in range(80)]
    if unit == "word":  # blanks at the front belong to the first word
        texts = [t.lstrip() for t in texts]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    for size, slab in ((1, 3), (5, 20), (4096, 1 << 22)):
        chunks = infill.Chunks(data, offsets, unit, size, slab)
        parts = [units_by_force(t, unit) for t in texts]
        assert chunks.units.tolist() == [len(p) for p in parts]
        for share in (0, 0.3, 1):
            ranks = np.array([int(share * len(p)) for p in parts])
            assert chunks.places(ranks).tolist() == [len("".join(p[:k]).encode()) for p, k in zip(parts, ranks, strict=True)]


@pytest.mark.parametrize("sentinels", [("<P>", "<P>", "<M>"), ("", "b", "c"), ("ab", "bc", "cd"), ("aa", "b", "c")])
def test_infill_refuses_sentinels_that_can_be_misread(spark, sentinels):
    with pytest.raises(InvalidParameters):
        infill.fill_in_middle(frame(spark, [(1, "a")], "doc_id long, text string"), sentinels=sentinels)


# ----------------------------------------------------------------------- audit


def audited_by_force(rows, labels):
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    good, toxic = ({d for d, *flags in labels if flags[i] == 1 and d is not None} for i in (0, 1))
    judged = defaultdict(list)
    for d, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and t in first and d > first[t]}
        judged[s or ""].append((d, {f for f in fails if fails[f]}))
    out = []
    for part, docs in judged.items():
        steps, total = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for i, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = [x for x in docs if f in x[1]]
                steps.append((part, "".join(order), i + 1, len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in docs), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)))
                total[f] += len(gone)
        out += [(*r, total[r[1][r[2] - 1]]) for r in steps]
    return sorted(out)


def audited_rows():
    rng = random.Random(5)
    rows = []
    for i in range(150):
        many = rng.choice([3, 400])
        words = rng.choices([f"w{k}" for k in range(rng.choice([5, 5000]))], k=many) + rng.choice([[], ["#"], ["ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3]])
        rows.append((i, " ".join(words), rng.choice(["a", "b", None, ""])))
    copies = [(1000 + i, rng.choice(rows)[1], rng.choice(["a", "c"])) for i in range(60)]
    return rows + copies + copies[:5] + [(None, rows[0][1], "a"), (None, None, None), (2000, None, "a"), (2001, "", "a"), (None, "no id", "d")]


LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 1060, 3)] + [(3, 1, 1), (6, None, None), (None, 1, 1)]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_audit_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(audit, "BROADCAST_TEXTS", limit)
    monkeypatch.setattr(audit.failures, "__defaults__", (*audit.failures.__defaults__[:3], limit))
    rows = audited_rows()
    got = audit.filter_audit(frame(spark, rows), frame(spark, LABELS, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == audited_by_force(rows, LABELS)


def test_audit_edges(spark):
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(frame(spark, []), none).collect() == []
    one = audit.filter_audit(frame(spark, [(1, "x " * 200_000, "s", 3)], DOCS + ", mask int"), none).collect()
    assert len(one) == 600 and {r.kept for r in one if r.step == 5} == {0}  # words that repeat
    assert all(r.shapley == (120 if r.filter_order[r.step - 1] == "B" else 0) for r in one)
