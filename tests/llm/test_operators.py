"""The operators against brute force, SQL and planted cases."""

import base64
import hashlib
import io
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, licenses, near_dedup, packing, pii, quality, queries, secrets, sharding, shared, tokens, warc
from gridloom.llm.shared import WordHash

SCHEMA = "doc_id long, text string"


def frame(spark, rows, schema=SCHEMA, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def listed(text):
    return set(filter(None, text.split(",")))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, same_rows):
    same_rows(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name])


# ------------------------------------------------------------------ near-dedup


def components_by_force(rows, percent=75):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b])
            if a < b and i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def near_copies(n, seed=0):
    """Groups of copies that drift, with passages that all share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    common = [word() for _ in range(60)]
    rows = []
    for g in range(n // 12):
        base = [word() for _ in range(rng.choice([4, 30, 140]))]
        if g % 3 == 0:
            base = common + base
        for _ in range(12):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
            if rng.random() < 0.3:
                base = own
    return rows


def test_near_dedup_equals_brute_force(spark):
    rows = near_copies(240)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == components_by_force(rows)


def test_near_dedup_large_group_and_shuffled_joins(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.choice([0, 3, 5, 6, 7])):
            own[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows), broadcast_rows=0).collect()}
    assert got == components_by_force(rows)


def test_near_dedup_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (4, "A  b\n", "x"), (None, "a b", "x"), (6, "a b", None), (6, "a b", None), (7, "only here", "x"), (None, "zz", "x")]
    got = near_dedup.near_duplicates(frame(spark, rows, "doc_id long, text string, component_id string"))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert rows_of(got) == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (None, 1, 3, False), (6, 1, 3, False), (6, 1, 3, False), (7, 1, 7, True), (None, 1, None, True)], key=repr
    )
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    twice = near_dedup.near_duplicates(frame(spark, [(5, "a b"), (5, "c d"), (9, "c d"), (3, "a b")]))
    assert {r.component_id for r in twice.collect()} == {3}  # id 5 stands for both texts


def test_components_of_a_long_path(spark):
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in near_dedup.components(path).collect()} == {0}


# -------------------------------------------------------------------- licences


def dice_by_force(text, percent=75):
    """Templates with the best coefficient of any run of bigrams, all compared."""
    def grams(t):
        words = re.findall("[a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        return list(zip(words, words[1:], strict=False))

    own, out = grams(text or ""), {}
    for k, (name, t) in enumerate(licenses.TEMPLATES):
        g = set(grams(t))
        for i in range(len(own)):
            for j in range(i, min(len(own), i + 2 * len(g))):
                c = len(g & set(own[i : j + 1]))
                if 200 * c >= percent * (j - i + 1 + len(g)):
                    out[k] = max(out.get(k, (0,)), (round(2 * c / (j - i + 1 + len(g)), 6), len(g), name))
    return out


def expected_licences(text):
    got = dice_by_force(text)
    best = min(got.values(), key=lambda x: (-x[0], -x[1], x[2])) if got else (0.0, 0, None)
    return len(got), best[2], best[0], ",".join(sorted({n for _, _, n in got.values()}))


def test_licences_equal_brute_force(spark):
    rng = random.Random(11)
    texts = [None, "", "under the sea", "Released under the MIT License.", "Released under the\nMIT License.", "x\nlicensed under the APACHE license version 2.0\ny", "Released under the MIT License. " * 9]
    for name, t in licenses.TEMPLATES:
        w = t.split()
        drop = [x for x in w if rng.random() > 0.08]
        more = [y for x in w for y in ([x, "extra"] if rng.random() < 0.06 else [x])]
        texts += [" ".join(drop), "so " + " ".join(more) + " it is", " ".join(w[: len(w) * 2 // 3]), "\n * ".join(w)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_matches, r.license, r.dice, r.licenses) for r in licenses.licenses(frame(spark, [(*r, "x") for r in rows], SCHEMA + ", template string")).collect()}
    assert got == {i: expected_licences(t) for i, t in rows}
    assert sum(n > 0 for n, *_ in got.values()) > 60


def test_licences_edges(spark):
    rows = [(1, "Licensed under CC BY-NC 4.0."), (1, "Released under the MIT License."), (2, None), (None, "Released under the MIT License."), (None, "nothing")]
    got = {r.doc_id: (r.n_matches, r.license, r.licenses) for r in licenses.licenses(frame(spark, rows)).collect()}
    assert got == {1: (3, "CC-BY-NC-4.0", "CC-BY-4.0,CC-BY-NC-4.0,MIT"), 2: (0, None, ""), None: (1, "MIT", "MIT")}
    assert licenses.licenses(frame(spark, [])).count() == 0


def test_licences_in_very_long_texts(spark):
    notice = "Released under the\nMIT License.\n"
    rows = [(1, notice * 5000), (2, "Released under the\n" + "=" * 4000 + "\nMIT License.\n"), (3, "word " * 300_000 + notice)]
    got = {r.doc_id: (r.license, r.dice) for r in licenses.licenses(frame(spark, rows)).collect()}
    assert got == {1: ("MIT", 1.0), 2: ("MIT", 1.0), 3: ("MIT", 1.0)}


def test_licence_bounds_lose_nothing():
    for _, _, n, least, most, _ in licenses.template_rows(licenses.TEMPLATES, 75):
        assert 200 * min(n, least - 1) < 75 * (n + least - 1) and 200 * min(n, most + 1) < 75 * (n + most + 1)


# ------------------------------------------------------------------------- PII


def test_licences_wrapped_or_within_text(spark):
    prose = " ".join(f"w{i}" for i in range(3000))
    notices = {name: text for name, text in licenses.TEMPLATES if len(text) > 100}
    wrapped = {name: re.sub(r"((?:\S+ ){7}\S+) ", r"\1\n * ", text) for name, text in notices.items()}
    rows, want = [(0, prose)], {0: ""}
    for i, (name, text) in enumerate(sorted(notices.items())):
        rows += [(10 * i + 1, f"{prose}\n{wrapped[name]}\n{prose}"), (10 * i + 2, f"{prose} {text} {prose}")]
        want |= {10 * i + 1: name, 10 * i + 2: name}
    got = {r.doc_id: r.licenses for r in licenses.licenses(frame(spark, rows)).collect()}
    assert all(n in got[i].split(",") for i, n in want.items() if n) and got[0] == ""


@pytest.fixture(scope="module")
def model():
    return pii.trained()


def test_tagger_on_held_out_spans(model):
    """Spans that the base patterns miss, by kind: recall and precision."""
    rng = np.random.default_rng(12345)
    texts, spans = zip(*(pii._example(rng) for _ in range(300)), strict=True)
    missed, found, added = np.zeros(4), np.zeros(4), np.zeros(4)
    for true, (base, every) in zip(spans, pii.all_spans(list(texts), model), strict=True):
        free = {s for s in true if not any(a < s[2] and s[0] < b for a, _, b in base)}
        new = set(every) - set(base)
        for s in free:
            missed[s[1]] += 1
            found[s[1]] += s in new
        for s in new:
            added[s[1]] += 1
    assert missed.min() >= 40
    assert (found / missed).min() >= 0.9 and (found / added).min() >= 0.9


def test_tagger_by_form(model):
    def found(values):
        texts = [f"please write {v} and then go on" for v in values]
        return sum(t[a:b] == v for t, v, (_, spans) in zip(texts, values, pii.all_spans(texts, model), strict=True) for a, _, b in spans)

    rng = random.Random(6)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    assert found([f"{digits(3)}-{digits(3)}-{digits(4)}" for _ in range(100)]) >= 90
    assert found([f"jane.doe{i} @ mail{i} . net" for i in range(50)]) >= 45
    assert found([f"{rng.randrange(256)}-{rng.randrange(256)}-{rng.randrange(256)}-{rng.randrange(256)}" for _ in range(100)]) >= 80
    assert pii.all_spans(["version 1.2.3-4 of 2021-10-12", "call 911 or 12-10-2021"], model) == [([], []), ([], [])]


def test_dense_numbers_are_read_quickly(model):
    rng = random.Random(1)
    table = "\n".join(" ".join(str(rng.randrange(1000)) for _ in range(8)) for _ in range(2000))
    for text in ("".join(rng.choices("0123456789", k=100_000)), "7 " * 30_000, table):
        began = time.perf_counter()
        spans = pii.model_spans([text], model)[0]
        assert time.perf_counter() - began < 10 and len(spans) < 20  # a second or two; machines differ
    hidden = table + "\ncall (212) 555-0187 today\n" + table
    assert [hidden[a:b] for a, _, b in pii.model_spans([hidden], model)[0] if hidden[a] == "("] == ["(212) 555-0187"]


def test_windows_give_what_one_decode_of_the_whole_gives(model, monkeypatch):
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(60):
        parts = [pii._example(rng)[0] for _ in range(6)]
        texts.append((" word" * 40).join(parts))
    by_window = pii.model_spans(texts, model)
    monkeypatch.setattr(pii, "_windows", lambda text: [(0, len(text))])
    whole = pii.model_spans(texts, model)
    same = sum(len(set(a) & set(b)) for a, b in zip(by_window, whole, strict=True))
    assert same >= 0.98 * sum(map(len, whole)) and same >= 0.98 * sum(map(len, by_window))


def test_tagger_gradients():
    small = pii.Tagger(hidden=3, seed=1)
    x, y = pii.labelled(2, 5)
    x, y = x[:3, :9], y[:3, :9]
    _, g = small.gradients(x, y)
    for name, at in (("out", (1, 2)), ("trans", (0, 1)), ("xf", (5, 4)), ("hb", (1, 7)), ("bf", (2,))):
        old, losses = small.p[name][at], []
        for step in (1e-2, -1e-2):
            small.p[name][at] = old + step
            losses.append(small.gradients(x, y)[0])
        small.p[name][at] = old
        assert abs((losses[0] - losses[1]) / 2e-2 - g[name][at]) < 2e-2


def base_by_force(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    sound = lambda d: sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m.group())) <= 19 and sound(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out)


def test_pii_base_equals_brute_force(spark, model):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("01234579+-() .@ab%é\n", k=rng.choice([0, 5, 80, 900])))) for i in range(300)]
    rows += [(1000, "a@b@c.de.f x@y..z @q.r a.b@c"), (1001, "4111 1111 1111 1111 and 10.0.0.255 1.2.3.4.5.6.7.8 256.1.1.1"), (1002, None), (None, "me@here.org"), (None, "me@here.org")]
    got = pii.personal_data(frame(spark, [(*r, 1) for r in rows], SCHEMA + ", spans int"), model=model).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        base = base_by_force(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert listed(pii.written(base)) <= listed(r.spans)
    assert pii.personal_data(frame(spark, []), model=model).count() == 0


def test_pii_model_adds_and_leaves_clean_text_alone(model):
    text = "word " * 300 + "call (212) 555-0187 today " + "word " * 100
    assert [text[a:b] for a, _, b in pii.all_spans([text], model)[0][1]] == ["(212) 555-0187"]
    assert pii.all_spans(["The year 2021 had 365 days, 12.5 % of them wet.\n" * 20, ""], model) == [([], []), ([], [])]


@pytest.mark.parametrize("value", ["an.example.name @ mail.example.com", "firstname.lastname @ mail.department.example.com", "the.first.and.the.last.name.of.all @ mail.of.a.department.in.some.example.com", "firstname.lastname.of.the.long.department.name.and.more.of.it @ mail.department.of.something.else.example.longer.ex.com"])
def test_pii_long_spans_at_every_offset(model, value):
    assert 32 <= len(value) <= 120
    texts = ["word " * 20 + "q" * (o % 9) + " ab" * (o // 9) + " " + value + " today " + "word " * 60 for o in range(64)]
    for text, spans in zip(texts, pii.model_spans(texts, model), strict=True):
        assert [text[a:b] for a, _, b in spans] == [value]


def test_pii_splits_numbers_that_run_together(model):
    spans = pii.model_spans(["word and so on, 4465758382889437 4465758382889437 some words after"], model)[0]
    assert spans == [(16, 2, 32), (33, 2, 49)]


def test_pii_reads_dense_text_once_or_a_few_times(model):
    text = "".join(random.Random(1).choices("0123456789. -abc@", k=6000))
    assert all(0 <= a < b <= len(text) for a, _, b in pii.model_spans([text, "", "@"], model)[0])


def test_redaction(spark, model):
    got = frame(spark, [(1, "a me@x.org b 10.1.2.3"), (2, None)]).withColumn("text", pii.redacted(F.col("text"), model))
    assert dict(tuple(r) for r in got.collect()) == {1: "a [EMAIL] b [IP]", 2: None}


def test_viterbi_equals_all_tag_sequences():
    tagger = pii.Tagger(hidden=3, seed=4)
    tagger.p["trans"] = np.random.default_rng(2).standard_normal((len(pii.TAGS), len(pii.TAGS))).astype(np.float32)
    x = np.random.default_rng(3).integers(0, pii.CLASSES, (3, 4))
    tags, e = tagger.decode(x)
    for row, scores in zip(tags, e, strict=True):
        total = lambda y: sum(scores[t, k] for t, k in enumerate(y)) + sum(tagger.p["trans"][a, b] for a, b in itertools.pairwise(y))
        best = max(itertools.product(range(len(pii.TAGS)), repeat=4), key=total)
        assert total(row.tolist()) == pytest.approx(total(best), abs=1e-4)


def test_reconciliation_equals_all_subsets():
    rng = random.Random(15)
    for _ in range(60):
        spans = [(a, a + rng.randrange(1, 9), rng.randrange(4), rng.randrange(1, 50) / 4) for a in (rng.randrange(20) for _ in range(rng.randrange(0, 8)))]
        apart = lambda own: all(x[1] <= y[0] for x, y in itertools.pairwise(sorted(own)))
        best = max(sum(s[3] for s in own) for n in range(len(spans) + 1) for own in itertools.combinations(spans, n) if apart(own))
        chosen = pii._best(spans)
        score = {}
        for a, b, kind, value in spans:
            score[a, kind, b] = max(value, score.get((a, kind, b), 0))
        assert apart([(a, b) for a, _, b in chosen]) and sum(score[s] for s in chosen) == best


def test_long_runs_take_linear_time(guesser):
    for text in ("1" * 400_000, "1." * 200_000, "@" * 200_000, "+1(" * 100_000, "a.b@c" * 50_000):
        began = time.perf_counter()
        pii.base_spans(text)
        assert time.perf_counter() - began < 5
    for text in ("token " * 50_000, "password = " * 40_000, "auth" + " " * 200_000 + "is", "pwd=" + "a1" * 2_000):
        began = time.perf_counter()
        secrets.all_spans(text, guesser)
        assert time.perf_counter() - began < 8


def test_reconciliation_takes_the_best_set():
    assert pii._best([(0, 10, 0, 3.0), (8, 12, 1, 4.0), (12, 20, 2, 1.0), (0, 8, 3, 2.0), (8, 12, 1, 2.0)]) == [(0, 3, 8), (8, 1, 12), (12, 2, 20)]


# ---------------------------------------------------------------------- tokens


@pytest.mark.parametrize("high", [1, 2, 300, 50257, 2**31, 2**60, 2**64 - 1])
def test_simple8b_round_trip(high):
    rng = np.random.default_rng(high % 97)
    for n in (0, 1, 59, 60, 61, 500):
        ids = np.array([int(rng.integers(0, 2**63)) * 2 % high if high > 2**62 else int(rng.integers(0, high)) for _ in range(n)], np.uint64)
        assert (tokens.decode(tokens.encode(ids), n) == ids).all()
    mixed = np.array([0] * 100 + [2**60, 2**64 - 1, 5] + [1] * 61 + [2**63], np.uint64)
    assert (tokens.decode(tokens.encode(mixed), len(mixed)) == mixed).all()


def test_token_file_blocks(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_IDS", 64)
    rng, stream = np.random.default_rng(0), io.BytesIO()
    writer = tokens.Writer(stream)
    docs = [(i if i % 5 else None, rng.integers(0, 50257, int(rng.integers(0, 200))).astype(np.uint32)) for i in range(40)]
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    back = list(tokens.read_documents(stream.getvalue()))
    assert [d for d, _ in back] == [d for d, _ in docs] and all((a == b).all() for (_, a), (_, b) in zip(docs, back, strict=True))
    with pytest.raises(ValueError):
        list(tokens.read_documents(b"x" * 100))


def test_tokens_words_are_coded_once(monkeypatch):
    """Words with marks or line ends about them are not coded again, and the ids
    are the library's, also where the cache is small and texts go by blocks."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder, sent = tokens.CachedTokenizer(path), []
    coded = coder._coded
    monkeypatch.setattr(coder, "_coded", lambda pieces: coded([sent.append(p) or p for p in pieces]))
    words = ["".join(c) for c in itertools.product("qxzv", repeat=4)]
    coder.ids([" ".join(["a", *(w + m for w in words for m in ("", ".", ",", "!?", ":"))])])
    assert len(sent) < len(words) + 10
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 9)
    coder, rng = tokens.CachedTokenizer(path, limit=1 << 16), random.Random(5)
    odd = ["a", "Bc", "é", "1", "½", "'s", "n't", ".", "...", "_", "(", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\u3000", "e\u0301", "日", "×", "<|endoftext|>", "😀"]
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 14))) for _ in range(2000)]
    for text, ids in zip(texts, coder.ids(texts), strict=True):
        assert coder.tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist()


def test_tokens_equal_the_tokenizer(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    odd = ["a  b", " x", "x ", "\n\n a \n b", "don't 's it <|endoftext|> ok", "a <|endoftext|> b", "<|endoftext|>", " \t x", "日本 語 ", "", "a  b", "é  c"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(odd)] + [(None, "null id"), (7, None), (7, None)]
    got = tokens.read_tokens(tokens.write_tokens(frame(spark, rows), tokens.shared_folder(spark, "t"), path)).collect()
    start = 0
    for r, (d, t) in zip(sorted(got, key=lambda r: r.start), sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        assert r.doc_id == d and r.start == start and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        if d != 7:
            assert r.ids == [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        start += r.n_tokens
    assert tokens.round_trip(frame(spark, []), path).count() == 0


# --------------------------------------------------------------------- quality


def counts_by_force(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


def test_quality_counts_equal_brute_force():
    rng, words = random.Random(1), WordHash()
    for _ in range(300):
        text = "".join(rng.choices(["a", "b", "é", " ", "\n", "\t", " ", "\x1c", "#", "|", "日"], k=rng.choice([0, 1, 9, 120])))
        assert quality.text_statistics(text, words)[0] == counts_by_force(text)
    assert quality.text_statistics(None, words)[0] == [0] * 5


def test_quality_verdict_and_edges(spark):
    rng = random.Random(2)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(120)) + "."

    def junk():
        words = prose().split()
        return rng.choice([" ".join(w + rng.choice(["***", "%%%"]) for w in words), " | ".join(words), "!! ".join(words).upper(), " ".join(w + " " + w for w in words)])

    rows = [(i, junk() if i % 6 == 0 else prose()) for i in range(1500)]
    labels = frame(spark, [(i, int(i % 6 != 0), "x") for i in range(1200)] + [(None, 1, "x"), (5, None, "x"), (9999, 1, "x")], "doc_id long, quality int, text string")
    verdict = quality.fit(frame(spark, rows), labels)
    more = [(5000, None), (5001, ""), (None, prose()), (5002, "same old words " * 60), (5002, "same old words " * 60)]
    got = {r.doc_id: r for r in quality.quality(frame(spark, rows + more), verdict).collect()}
    wrong = [i for i in range(1500) if i % 6 and not got[i].kept]
    assert len(wrong) <= 5 and not [i for i in wrong if i < 1200]  # of the good ones, none that it was fitted on
    junk_kept = sum(got[i].kept for i in range(0, 1500, 6))
    assert junk_kept < 0.1 * 250
    assert got[5000].base_failed and got[5001].base_failed and got[None].kept and got[5002].base_failed
    kept = quality.kept_documents(frame(spark, [(*r, "x") for r in rows + more], SCHEMA + ", _quality string"), verdict)
    assert kept.columns == ["doc_id", "text", "_quality"] and kept.count() == 1251 - len(wrong) + junk_kept
    none = quality.fit(frame(spark, rows), labels.limit(0))
    assert quality.quality(frame(spark, rows[:7]), none).filter("kept").count() == 7
    assert quality.quality(frame(spark, []), none).count() == 0


def test_quality_forests_see_repetition(spark, sf_dir):
    """Texts of ordinary characters that repeat words and lines more than good
    ones do, and half of the labels held out."""
    table = lambda name: spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{name}.parquet")
    rows = table("documents").join(table("labels"), "doc_id").orderBy("doc_id").collect()
    words = WordHash()
    counts, x = map(np.array, zip(*(quality.text_statistics(r.text, words) for r in rows), strict=True))
    good, passed = np.array([r.quality == 1 for r in rows]), (counts[:, 0] >= 50) & (100 * counts[:, 4] <= 50 * counts[:, 0])
    junk = []
    for r in [r for r, g, p in zip(rows, good, passed, strict=True) if g and p][:100]:
        own = r.text.split()[:300]
        made = " ".join(own + own[: len(own) // 4]) + "\nthis line stands here again" * 4
        c, f = quality.text_statistics(made, words)
        if c[0] >= 50 and 100 * c[4] <= 50 * c[0]:  # else the base rules see to it
            junk.append(f)
    assert len(junk) >= 80
    for half in (0, 1):
        own = np.arange(len(rows)) % 2 == half
        verdict = quality.fitted(x[own], good[own], passed[own])
        rejected = verdict.anomalies(x)
        assert verdict.anomalies(np.array(junk)).mean() >= 0.95
        assert rejected[~own & ~good & passed].mean() >= 0.9 and rejected[~own & good & passed].mean() <= 0.01


def test_isolation_forest_isolates():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(500, 3)), [[9, 9, 9]]])
    s = quality.IsolationForest.grown(x).scores(x)
    assert s.argmax() == 500 and s[500] > 0.7


# ------------------------------------------------------------------------ WARC


def test_warc_edges(spark):
    big = "é" * 700
    rows = [(1, "http://a b/ü\r\nX: y", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (2, "v", big), (6, "w", "")]
    got = rows_of(warc.round_trip(frame(spark, [(*r, 0) for r in rows], "page_id long, url string, html string, sha1 int")))
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = []
    for i, _, html in rows:
        revisit = html == big and i != 2
        want.append((i, len((html or "").encode()), sha(html), "revisit" if revisit else "response", 2 if revisit else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_warc_reader_verifies():
    good = [warc.record(i, "u", f"page {i}".encode() * 50_000) for i in range(3)]
    assert [r.payload for r in warc.records(io.BytesIO(b"".join(good)))] == [f"page {i}".encode() * 50_000 for i in range(3)]
    zipped = lambda raw: (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(raw) + z.flush()
    raw = zlib.decompress(warc.record(1, "u", b"payload"), 31)
    for bad in (raw.replace(b"payload", b"pAyload"), raw[:-1], raw + b"x", raw.replace(b"WARC/1.1", b"XXXX/1.1"), re.sub(rb"Content-Length: \d+\r\nWARC", b"WARC", raw).replace(b"Content-Length: ", b"X: ", 1)):
        with pytest.raises(warc.WarcError):
            list(warc.records(io.BytesIO(zipped(bad))))
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(good[0][:-20])))
    digest = warc._sha1(b"payload").removeprefix("sha1:")
    assert base64.b32decode(digest).hex() == hashlib.sha1(b"payload").hexdigest()


# --------------------------------------------------------------------- secrets


def secrets_by_force(text):
    name = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    out = [(m.start(), 0, m.end()) for m in re.finditer(name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24])


def test_secret_base_equals_brute_force(spark):
    rng = random.Random(4)
    pieces = ["password", "PASSWD", "api_key", "apikey", "toKen", "ſecret", "secret", "=", ":", " ", '"', "'", "abc123", "x", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef01", "é", "\n"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.choice([0, 3, 12, 60])))) for i in range(400)] + [(1000, None), (None, "token=abcdef1"), (None, "token=abcdef1")]
    got = secrets.secrets(frame(spark, [(*r, 1) for r in rows], SCHEMA + ", n_hex int")).collect()
    texts = dict(rows)
    for r in got:
        base = secrets_by_force(texts[r.doc_id] or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for _, k, _ in base) for kind in range(3)]
        assert r.base_sha256 == hashlib.sha256(secrets.written(base).encode()).hexdigest()
        assert listed(secrets.written(base)) <= listed(r.spans)
    assert len(got) == len(rows) and secrets.secrets(frame(spark, [])).count() == 0


@pytest.fixture(scope="module")
def guesser():
    import public_tokenizers

    return secrets.Guesser(secrets.vocabulary_words(public_tokenizers.path("byte_bpe_50k.json")))


def bits_by_force(g, value):
    """The least cost over all cuts of ``value``, each span costed by itself."""
    lower, per = value.lower(), secrets._alphabet(value)
    letter = [c.isascii() and c.isalpha() for c in value] + [False]

    def costs(i, j):
        span = value[i:j]
        yield per * (j - i)
        if span.isascii() and span.isalpha() and (span[1:].islower() or len(span) == 1 or value.isupper()):
            yield secrets.LETTERS + g.letter(lower, i, True) + sum(g.letter(lower, t) for t in range(i + 1, j))
        if span.isascii() and span.isdigit():
            yield secrets.LETTERS + math.log2(10) * len(span)
        if len(span) == 1 and span.isascii() and not span.isalnum():
            yield secrets.AGAIN if span in value[:i] else secrets.MARK
        low = span.lower()
        known = low if low in g.rank else low.translate(secrets.LEET)
        if low in secrets.SHORT and (j - i > 2 or not (letter[j] or (i and letter[i - 1]))):
            yield secrets.KIND + secrets.SHORT_WORD + (span != low)
        elif known in g.rank and j - i >= 3:
            yield secrets.KIND + math.log2(g.rank[known]) + (span != low) + 2 * (known != low)
        m = secrets.DATE.match(value, i)
        if m and m.end() == j:
            yield secrets.KIND + math.log2(365 * 120 if j - i > 4 else 120)
        for row in secrets.ROWS:
            whole = any(low in way for way in (row, row[::-1]))
            longer = i and any(value[i - 1 : i + 2].lower() in way for way in (row, row[::-1]))  # a walk begins where it does
            if j - i >= 3 and whole and not longer:
                yield secrets.KIND + math.log2(94) + 1 + math.log2(j - i)
        for unit in range(1, 9):
            if i >= unit and (j - i) % unit == 0 and span == value[i - unit : i] * ((j - i) // unit):
                times = (j - i) // unit
                further = i >= 2 * unit and value[i - 2 * unit : i - unit] == value[i - unit : i]
                if times == 1 or not further:
                    yield secrets.KIND + math.log2(times)

    def cheapest(i):
        if i == len(value):
            return 0.0
        return min(c + cheapest(j) for j in range(i + 1, len(value) + 1) for c in costs(i, j))

    return cheapest(0)


def test_guess_costs_equal_all_cuts(guesser):
    rng = random.Random(14)
    parts = ["pass", "P4ss", "love", "abab", "xx", "qwe", "123", "2024", "20240105", "Zq", "k", "-", "THE", "lkj", "of", "_", "7"]
    values = ["".join(rng.choices(parts, k=rng.randrange(1, 5)))[:9] for _ in range(60)] + ["aaaaaaaa", "Password", "CORRECT", "asdfgfds", "a-of-b", "is7of_a"]
    for v in values:
        assert guesser.bits(v) == pytest.approx(bits_by_force(guesser, v)), v


def test_guess_costs(guesser):
    bits = guesser.bits
    assert bits("password1") < bits("S3cretmonkey") < 40 < bits("xK9$mQ2v7Lp0w")
    assert max(map(bits, ("qwertyuiop", "2024-01-05", "aaaaaaaaaaaa", "abcabcabcabc"))) < 20 and bits("") == 0
    assert bits("a" * 5000) < 25 and bits("CorrectHorseBatteryStaple") < 70 < bits("CuzqpvtHrwzeBxtkqryStvple")


#: Values that are secrets, and ordinary ones after the same names.
SECRET_VALUES = [
    "qzxvkj-pwmrtn-bfghwx", "xkqv!zjwp#rtlm%bqgh", "correct-horse-battery-staple-zebra", "KXQVZ-JWPRT-LMBQG-HDFSN", "xK9,mQ2v7Lp0wZ4s", "xK9(mQ2)v7Lp0wZ4",
    "xK9mQ2v7Lp0wZ4", "q8Zt5Lw2Xc9Vb1Nm", "Zk4Qw9Xv2Lm7Tp", "qzkvxwjhgtbnmrd", "u7#kP2!vQz9d", "ghp_x8Jq2LmV0cT5nRw7Yb3KdZ", "purple7-Giraffe!tango_42-Lamp", "9f8a7c6e5d4b3a2918",
]
ORDINARY_VALUES = [
    "some-setting-of-a-service", "get_current_session_identifier", "Benutzername", "read-only-for-all-users", "required", "getPassword(user)", "config.settings.password", "your-password-here",
    "documentation", "changeme123", "password123!", "ThisIsMyPassword", "application_default_credentials", "${SECRET_TOKEN}", "https://example.com/login", "Zugangsdaten", "utilisateur",
    "AuthenticationManager", "user.session.token", "2024-01-05T10:00:00", "qwertyuiop1234", "sunshine2020", "localhost:8080", "basic-auth-with-session", "the_name_of_the_user", "identificador", "/etc/ssl/private/server.key",
]


def guessed(text, guesser):
    return [text[a:b] for a, k, b in secrets.all_spans(text, guesser)[1] if k == 3]


@pytest.mark.parametrize("setting", ["db_pwd = {} and so on", "passphrase: {}", 'userPwd="{}";', "{{auth => {}}}", "the pin is '{}'."])
def test_secrets_and_ordinary_values(guesser, setting):
    found = [v for v in SECRET_VALUES if guessed(setting.format(v), guesser) == [v]]
    added = [v for v in ORDINARY_VALUES if guessed(setting.format(v), guesser)]
    assert found == SECRET_VALUES and added == []


def test_values_in_quotes_are_read_whole(guesser):
    assert guessed('pwd = "walnut orbit fiction gravel mellow" # x', guesser) == ["walnut orbit fiction gravel mellow"]
    assert guessed("passphrase: 'correct horse battery staple zebra'", guesser) == ["correct horse battery staple zebra"]
    assert guessed('pwd = "xK9mQ2v7Lp0wZ4\nnext line', guesser) == ["xK9mQ2v7Lp0wZ4"]  # not closed on its line
    assert guessed("f(pwd=xK9mQ2v7Lp0wZ4), pwd: xK9(mQ2)v7Lp0wZ4.", guesser) == ["xK9mQ2v7Lp0wZ4", "xK9(mQ2)v7Lp0wZ4"]


def test_guessed_values_in_context(guesser):
    text = "db_pwd = xK9mQ2v7Lp0wZ4 and pwd = sunshine2020 and Authorization: Bearer q8Zt5Lw2Xc9Vb1Nm, not qK9mQ2v7Lp0wZ4. The pin is Zk4Qw9Xv2Lm7Tp, my passphrase:  'qzkvxwjhgtbnmrd'"
    assert guessed(text, guesser) == ["xK9mQ2v7Lp0wZ4", "q8Zt5Lw2Xc9Vb1Nm", "Zk4Qw9Xv2Lm7Tp", "qzkvxwjhgtbnmrd"]


@pytest.mark.parametrize("setting", ["db_pwd            =      {}", "token_for_the_new_billing_service_of_all = {}", "dbPwd = {}", "userPassphrase: {}", "signature_" + "of_" * 50 + "x={}"])
def test_guessed_values_after_any_name(guesser, setting):
    value = "xK9mQ2v7Lp0wZ4"
    text = "so " + setting.format(value) + " and tokenizer = qK9mQ2v7Lp0wZ4."
    assert guessed(text, guesser) == [value]


def test_guess_costs_count_all_of_a_value(guesser):
    assert guesser.bits("a" * 300 + "xK9mQ2v7Lp0wZ4") > guesser.bits("a" * 300) + 40
    assert guessed("db_pwd = " + "Password" * 40 + "xK9mQ2v7Lp0wZ4 ", guesser) == ["Password" * 40 + "xK9mQ2v7Lp0wZ4"]


# --------------------------------------------------------------------- packing


def packed_by_force(lengths, capacities):
    """Best fit, each opening tried out piece by piece; the cheaper of both ways."""
    down = lambda used: min(c for c in capacities if c >= used)
    results = []
    for joint in (True, False):
        bins, out, free, promised = [], [], list(lengths), []
        for n in lengths:
            fit = [(room, b) for b, (room, _) in enumerate(bins) if room >= n]
            first, second = (promised, free) if fit else (free, promised)
            (first if n in first else second).remove(n)
            if fit:
                b = min(fit)[1]
            else:
                tried = []
                for c in capacities if joint else [down(n)]:
                    taken = []
                    for m in free if c >= n else []:
                        if n + sum(taken) + m <= c:
                            taken.append(m)
                    if c >= n:
                        used = n + sum(taken)
                        tried.append((packing.cost(down(used)) / used, c, taken))
                _, size, taken = min(tried, key=lambda t: (t[0], -t[1]))
                for m in taken if joint else []:
                    free.remove(m)
                    promised.append(m)
                b = len(bins)
                bins.append((size, 0))
            room, used = bins[b]
            out.append((b, used))
            bins[b] = (room - n, used + n)
        final = [down(used) for _, used in bins]
        results.append((sum(map(packing.cost, final)), not joint, [(b, o, final[b]) for b, o in out]))
    return min(results)[2]


def total_cost(rows):
    return sum(packing.cost(c) for c in {b: c for b, _, c in rows}.values())


def test_packing_equals_brute_force():
    rng = random.Random(6)
    for _ in range(40):
        lengths = sorted((rng.choice([rng.randrange(1, 16384), rng.randrange(1, 900), 4096, 1100]) for _ in range(rng.randrange(1, 90))), reverse=True)
        assert packing.packed(lengths) == packed_by_force(lengths, packing.CAPACITIES)


def least_cost(lengths):
    """Of all ways to part the pieces into bins."""
    best = [float("inf")]

    def put(i, bins):
        if i == len(lengths):
            best[0] = min(best[0], sum(packing.cost(min(c for c in packing.CAPACITIES if c >= b)) for b in bins))
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= packing.CAPACITIES[-1]:
                put(i + 1, [*bins[:j], bins[j] + lengths[i], *bins[j + 1 :]])
        put(i + 1, [*bins, lengths[i]])

    put(0, [])
    return best[0]


def test_packing_is_near_the_optimum():
    rng, shares = random.Random(12), []
    for _ in range(60):
        lengths = sorted((rng.choice([rng.randrange(1, 9000), rng.randrange(1, 2000), 1100]) for _ in range(7)), reverse=True)
        shares.append(total_cost(packing.packed(lengths)) / least_cost(lengths))
    assert min(shares) >= 1 - 1e-9 and max(shares) < 1.35 and sum(shares) / len(shares) < 1.06


def test_packing_opens_larger_bins_and_makes_them_smaller():
    lengths = [1100] * 1000 + [300] * 7
    places, sizes, used = packing.placed(lengths, packing.CAPACITIES, packing.cheapest)
    assert sizes.count(8192) > 130  # of which seven long pieces fill 94 %
    got = packing.packed(lengths)
    final = {b: c for b, _, c in got}
    assert any(final[b] < sizes[b] for b in final)  # the last one holds less
    plain = packing.placed(lengths, packing.CAPACITIES, packing.smallest)[2]
    assert total_cost(got) < 0.65 * sum(packing.cost(min(c for c in packing.CAPACITIES if c >= u)) for u in plain)


def test_packing_query(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(0, 150), "x") for i in range(500)] + [(None, 3, "x"), (1000, None, "x"), (1001, -4, "x")] + [(7777, 40, "x")] * 300
    docs = frame(spark, rows, "doc_id long, n_tokens long, bin_id string")
    got = packing.pack(docs, capacities=(64, 32, 16), group_pieces=100).toPandas()
    bins = got.groupby("bin_id")
    assert (bins["length"].sum() <= bins["capacity"].first()).all() and got["length"].sum() == sum(max(n or 0, 0) for _, n, _ in rows)
    for _, b in bins:
        b = b.sort_values("offset")
        assert (b["offset"].to_numpy() == np.concatenate([[0], b["length"].cumsum().to_numpy()[:-1]])).all()
        assert b["length"].sum() > max((c for c in (0, 16, 32, 64) if c < b["capacity"].iloc[0]))
    again = packing.pack(docs.repartition(7), capacities=(16, 32, 64), group_pieces=100).toPandas()
    key = list(got.columns)
    assert got.sort_values(key).to_numpy().tolist().__repr__() == again.sort_values(key).to_numpy().tolist().__repr__()
    assert packing.pack(docs.limit(0)).count() == 0


# -------------------------------------------------------------------- sharding


def test_sharding(spark):
    rng = random.Random(8)
    rows = [(i, "é" * rng.randrange(5)) for i in range(997)] + [(None, "n"), (None, None)] + [(5000, "hot")] * 400
    df = frame(spark, [(*r, 1) for r in rows], SCHEMA + ", slot int")
    got = sharding.sharded(df).toPandas()
    assert len(got) == len(rows) and set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()
    counts = got["shard"].value_counts()
    assert counts.max() - counts.min() <= 1 and len(counts) == 16
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((str(None if np.isnan(d) else int(d)), int(n), int(c)) for d, n, c in zip(got["doc_id"], got["size"], got["text_crc32"], strict=True)) == want
    assert rows_of(sharding.sharded(df.repartition(5))) == rows_of(sharding.sharded(df))
    assert sharding.sharded(df.limit(0)).count() == 0


def test_sharding_walks_clockwise_and_moves_little(spark):
    docs = frame(spark, [(i, "x") for i in range(8000)])
    before = {r.doc_id: r.shard for r in sharding.sharded(docs).collect()}
    after = {r.doc_id: r.shard for r in sharding.sharded(docs, shards=17).collect()}
    moved = sum(before[i] != after[i] for i in before) / len(before)
    assert moved < 0.4  # dealing by remainder moves 94 %
    homes = [w[0] for w in sharding.ring(16)]
    cells = {r.doc_id: r.c for r in docs.select("doc_id", sharding.cell_of(F.col("doc_id")).alias("c")).collect()}
    room = [homes.count(s) for s in range(16)]
    assert sum(before[i] == homes[cells[i]] for i in before) / len(before) > 0.75 and min(room) > 0
    walk = sharding.ring(16)
    loads = [list(before.values()).count(s) for s in range(16)]
    assert all(sorted(w) == list(range(16)) for w in walk) and max(loads) - min(loads) <= 1


def shards_by_force(rows, shards):
    """Every document walks the ring by itself: home, or clockwise to the next
    shard with room, those that found their home full after all others."""
    md5 = lambda name: int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % sharding.CELLS
    nodes = sorted((md5(f"shard {s} node {v}"), s) for s in range(shards) for v in range(sharding.VIRTUAL_NODES))

    def clockwise(cell):
        after = [s for c, s in nodes if c >= cell] + [s for c, s in nodes if c < cell]
        return list(dict.fromkeys(after))

    docs = sorted((md5("null" if d is None else str(d)), d is not None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), d) for d, t in rows)
    homes = [clockwise(c)[0] for c, *_ in docs]
    order = sorted(range(shards), key=lambda s: (-homes.count(s), s))
    room = {s: len(docs) // shards + (order.index(s) < len(docs) % shards) for s in range(shards)}
    out, late = [], []
    for x, home in zip(docs, homes, strict=True):
        if room[home]:
            room[home] -= 1
            out.append((x[5], x[3], x[4], home))
        else:
            late.append(x)
    for x in late:
        s = next(s for s in clockwise(x[0]) if room[s])
        room[s] -= 1
        out.append((x[5], x[3], x[4], s))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_sharding_equals_a_walk_of_every_document(spark, shards):
    rng = random.Random(13)
    rows = [(i * 37, "é" * rng.randrange(9)) for i in range(700)] + [(None, "n"), (None, None), (None, "n")] + [(5000, "hot")] * 90 + [(i, None) for i in range(50)]
    got = sharding.sharded(frame(spark, rows), shards=shards).select("doc_id", "size", "text_crc32", "shard")
    assert rows_of(got) == shards_by_force(rows, shards)


def test_copies_are_numbered_in_blocks(spark, monkeypatch):
    from gridloom.llm import shared

    monkeypatch.setattr(shared, "BLOCK_COPIES", 7)
    got = shared.copies_numbered(frame(spark, [(1, 0), (2, 1), (3, 7), (4, 8), (5, 50)], "k int, n int").filter("n > 0"), F.lit(3), F.col("n") + 3, "i")
    assert rows_of(got.select("k", "i")) == sorted([(k, 3 + i) for k, n in ((2, 1), (3, 7), (4, 8), (5, 50)) for i in range(n)], key=repr)


# ------------------------------------------------------------- decontamination


def contaminated_by_force(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in [tuple(w[j : j + 10]) for j in range(len(w) - 9)] if len(w) >= 10 else [tuple(w)] if w else []:
            windows.setdefault(k, set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[k]
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [decontaminate.ITEM_WORDS, 0])
def test_decontamination_equals_brute_force(spark, limit):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 14, 40])))) for i in range(40)] + [(None, "x y z"), (3, "Äb cd"), (90, None), (2, "p q r")]
    docs = []
    for i in range(80):
        own = [rng.choice(["a", "b", "zz", "c!", "(D)"]) for _ in range(rng.choice([0, 4, 9, 10, 60]))]
        for _ in range(rng.choice([0, 1, 3])):
            cut = (items[rng.randrange(len(items))][1] or "").split()
            at = rng.randrange(len(cut) + 1)
            own += cut[at : at + rng.randrange(1, 30)] + ["zz"] * rng.randrange(2)
        docs.append((i, " ".join(own)))
    docs += [(900, None), (901, ""), (None, "X, y; Z äB x"), (902, "w ÄB"), (903, "Äb-CD"), (5, "p q r"), (5, "p q r")]
    got = decontaminate.contamination(frame(spark, [(*d, "k") for d in docs], SCHEMA + ", items_sha256 string"), frame(spark, items, "item_id long, text string"), item_words_limit=limit)
    assert rows_of(got) == contaminated_by_force(docs, items)
    clean = decontaminate.clean_documents(frame(spark, docs), frame(spark, items, "item_id long, text string"), item_words_limit=limit)
    bad = {r[0] for r in contaminated_by_force(docs, items) if r[-1]}
    assert rows_of(clean) == sorted([d for d in docs if d[0] not in bad], key=repr)
    nothing = decontaminate.contamination(frame(spark, docs), frame(spark, [], "item_id long, text string"), item_words_limit=limit)
    assert not nothing.filter("contaminated").count() and nothing.count() == len(docs)
    assert decontaminate.contamination(frame(spark, []), frame(spark, items, "item_id long, text string"), item_words_limit=limit).count() == 0


def test_decontamination_judges_each_row_by_itself(spark):
    docs = [(None, "p q r"), (None, "clean one"), (5, "p q r"), (5, "clean two"), (6, None)]
    for limit in (decontaminate.ITEM_WORDS, 0):
        clean = decontaminate.clean_documents(frame(spark, [(*d, "k") for d in docs], SCHEMA + ", _row string"), frame(spark, [(1, "p q r")], "item_id long, text string"), item_words_limit=limit)
        assert clean.columns == ["doc_id", "text", "_row"]
        assert rows_of(clean.drop("_row")) == sorted([docs[1], docs[3], docs[4]], key=repr)


def test_print_filter_lets_known_prints_pass_and_few_others(spark):
    rng = np.random.default_rng(5)
    known, strange = (rng.integers(0, 1 << 64, 3000, np.uint64) for _ in range(2))
    bits = 1 << 17
    rows = spark.createDataFrame([(int(v),) for v in known.view(np.int64)], "print long")
    made = decontaminate._filter_of(rows, bits)
    assert made.nbytes == bits // 8
    assert decontaminate._passing(known, made, bits).all()
    assert 0 < decontaminate._passing(strange, made, bits).mean() < 0.05
    assert not decontaminate._passing(known, decontaminate._filter_of(rows.limit(0), bits), bits).any()


def test_large_benchmark_with_a_frequent_passage(spark, monkeypatch):
    # every document holds the passage, so its prints are hot
    monkeypatch.setattr(shared, "HOT_ROWS", 20)
    passage = " ".join(f"p{i}" for i in range(14))
    docs = frame(spark, [(i, f"a{i} b{i} {passage} c{i} d{i}") for i in range(300)], "doc_id long, text string")
    items = frame(spark, [(7, passage), (8, f"x {passage} y"), (9, "nothing of this is in any document of the table at all")], "item_id long, text string")
    found = decontaminate.contamination(docs, items, item_words_limit=0).collect()
    assert len(found) == 300
    assert {(r.n_words, r.n_hit, r.n_items) for r in found} == {(18, 14, 2)}


def test_winnowing_keeps_a_hash_of_every_window():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 20, 300).astype(np.uint64)
    kept = set(decontaminate.kept_positions(grams, 6).tolist())
    assert all(kept & set(range(i, i + 6)) for i in range(295)) and len(kept) < 200


def test_scratch_goes_to_the_shared_folder(spark):
    from gridloom.llm.shared import qualified, shared_folder

    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    assert first.startswith(qualified(spark, named)) and first != second and first.startswith("file:")


# ------------------------------------------------------------- very long texts


def test_very_long_texts_alone(spark):
    """A few hundred kilobytes in one text, and what differs only at its end."""
    import public_tokenizers

    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choices(words, k=40_000))
    item = " ".join(f"bench{i}" for i in range(12))
    rows = [(1, long), (2, long + " ende"), (3, long + " " + item), (4, "short text"), (5, long)]
    docs = frame(spark, rows)
    near = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    assert [near[i].component_id for i in range(1, 6)] == [1, 1, 1, 4, 1]
    split = long.split()
    assert near[1].n_shingles == len({tuple(split[i : i + 5]) for i in range(40_000 - 4)})
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r.doc_id: r for r in tokens.round_trip(frame(spark, rows[:1] + rows[3:4]), path).collect()}
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids, 2]
    assert got[1].n_tokens == len(ids) and got[1].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.doc_id: r.n_words for r in quality.quality(docs, none).collect()} == {1: 40_000, 2: 40_001, 3: 40_012, 4: 2, 5: 40_000}
    assert {r.doc_id: r.size for r in sharding.sharded(docs).collect()} == {i: len(t) + 1 for i, t in rows}
    found = decontaminate.contamination(docs, spark.createDataFrame([("i", item)], "item_id string, text string")).collect()
    assert {r.doc_id: r.n_hit for r in found} == {1: 0, 2: 0, 3: 12, 4: 0, 5: 0}
