"""The pipeline, stage by stage, and the registered queries."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from gridloom.llm import decontaminate, near_dedup, packing, pii, quality
from gridloom.llm.shared import WordHash

from . import test_operators as ops

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What each stage got and gave, as Parquet."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stage_columns_and_run(spark, sf_dir, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "best_fit_packing"]
    assert all(after.columns == COLUMNS for _, after in stages[:-1])
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(stages[-1][1])


def test_stages_equal_their_operators(spark, sf_dir, stages):
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    docs, after = stages[0]
    assert ids(after) == ids(quality.quality(docs, quality.fit(docs, table("labels"))).filter("kept"))
    docs, after = stages[1]
    assert ids(after) == ids(near_dedup.near_duplicates(docs).filter("kept"))
    docs, after = stages[2]
    assert ids(after) == ids(decontaminate.contamination(docs, table("benchmark")).filter("NOT contaminated"))
    docs, after = stages[3]
    assert ids(after) == ids(docs)
    left = pii.personal_data(after).agg(F.sum(F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone"))).first()[0]
    assert left == 0 and after.filter("n_chars <> length(text)").count() == 0
    docs, after = stages[4]
    assert after.columns == packing.OUT and set(ids(after)) == set(ids(docs))
    assert after.agg(F.sum("length")).first()[0] == docs.agg(F.sum(F.octet_length("text") + 1)).first()[0]


def test_good_documents_stay(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    docs, after = stages[0]
    good = docs.filter(F.size(F.split("text", r"\s+")) >= 60).join(labels, "doc_id")
    assert after.join(good.select("doc_id"), "doc_id").count() >= 0.98 * good.count()


def test_stages_take_odd_rows(spark, sf_dir, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 80, "en", "s", 400), (2, "word " * 80, "en", "s", 400), (3, "x" * 200_000, None, None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_found", F.lit(1)).withColumn("_kept_id", F.lit(2))
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    for docs in (odd, odd.limit(0)):
        for where in (sf_dir, str(tmp_path)):
            for name, stage in corpus_pipeline.STAGES:
                got = stage(spark, docs, where)
                assert got.count() <= docs.count() * 100
                if name != "best_fit_packing":
                    assert got.columns == docs.columns


def pieces_by_force(docs):
    """The bins of (id, text) rows, all in one group."""
    pieces, largest = [], packing.CAPACITIES[-1]
    for d, t in docs:
        n = len((t or "").encode()) + 1
        pieces += [(d, k, k * largest, min(largest, n - k * largest)) for k in range(-(-n // largest))]
    pieces.sort(key=lambda p: (-p[3], p[0], p[2]))
    got = ops.packed_by_force([p[3] for p in pieces], packing.CAPACITIES)
    return sorted((*p, b, c, o) for p, (b, o, c) in zip(pieces, got, strict=True))


def anomalous_by_walk(verdict, x):
    return any(score_by_walk(f, x[quality.ASPECTS[a]]) > top + 1e-12 for a, (f, top) in verdict.forests.items())


def score_by_walk(forest, x):
    """Each tree walked node by node."""
    total = 0.0
    for feature, cut, depth in zip(forest.feature, forest.cut, forest.depth, strict=True):
        i = 0
        while feature[i] >= 0:
            i = 2 * i + 1 if x[feature[i]] < cut[i] else 2 * i + 2
        total += depth[i]
    return 2.0 ** (-total / len(forest.feature) / forest.average_path(forest.rows))


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(3, 8)))
    prose = lambda n: [word() for _ in range(n)]
    items = [(f"i{k}", " ".join(prose(14))) for k in range(6)]
    rows = []
    for i in range(60):
        own = prose(rng.choice([20, 90, 150]))
        if i % 7 == 0:
            own[40:40] = rng.choice(items)[1].split()[2:13]
        if i % 5 == 0:
            own.insert(30 % len(own), rng.choice(["me.and@mail.example.org", "10.1.2.33", "4111 1111 1111 1111", "+1 (212) 555-0187"]))
        if i % 9 == 0:
            own = [w + "##%%" for w in own]
        rows.append((i, " ".join(own)))
        if i % 4 == 0:
            rows.append((100 + i, " ".join([*own[:-2], word()])))
    rows += [(500, rows[1][1]), (500, rows[1][1]), (600, None), (601, "")]
    labels = [(i, int("##" not in (t or ""))) for i, t in rows if i < 90]
    table = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    table("documents", [(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table("labels", labels, "doc_id long, quality int")
    table("benchmark", items, "item_id string, text string")

    verdict = quality.fit(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = []
    for i, t in rows:
        n, *_, repeated = ops.counts_by_force(t)
        if n >= 50 and 100 * repeated <= 50 * n and not anomalous_by_walk(verdict, quality.text_statistics(t, WordHash())[1]):
            kept.append((i, t))
    assert 0 < len(kept) < len(rows)
    groups = ops.components_by_force(kept)
    single = {i: t for i, t in kept if groups[i][2]}
    assert len(single) < len(kept)
    clean = [(r[0], single[r[0]]) for r in ops.contaminated_by_force(sorted(single.items()), items) if not r[-1]]
    assert 0 < len(clean) < len(single)
    model, redacted = pii.trained(), []
    for i, t in clean:
        spans = ops.base_by_force(t)
        spans += [s for s in pii.model_spans([t], model)[0] if not any(a < s[2] and s[0] < b for a, _, b in spans)]
        parts, end = [], 0
        for a, kind, b in sorted(spans):
            if a >= end:
                parts += [t[end:a], f"[{pii.KINDS[kind].upper()}]"]
            end = max(end, b)
        redacted.append((i, "".join([*parts, t[end:]])))
    assert redacted != clean
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == pieces_by_force(redacted)


def test_one_row_of_each_group_stays(spark, sf_dir):
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(60))
    rows = [(7, text(1)), (7, text(1)), (None, text(1)), (None, text(2)), (None, text(2)), (3, text(3)), (4, text(3)), (9, None), (9, None), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, _key string")
    got = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert got.columns == docs.columns
    want = [(7, text(1)), (None, text(2)), (3, text(3)), (9, None), (None, None), (8, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)


def near_stage(spark, sf_dir, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()), key=repr)


@pytest.mark.parametrize("collide", [False, True])
def test_no_text_is_lost_to_another_of_its_id(spark, sf_dir, monkeypatch, collide):
    """``collide``: all documents get one key at first."""
    if collide:
        plain = corpus_pipeline._hash
        monkeypatch.setattr(corpus_pipeline, "_hash", lambda seed, *parts: F.lit(5).cast("long") if seed == 0 else plain(seed, *parts))
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, ""), (3, b), (4, None), (4, "")]
    want = [(1, a), (1, b), (3, ""), (4, None), (4, "")]
    assert near_stage(spark, sf_dir, rows) == sorted(want, key=repr) == near_stage(spark, sf_dir, rows[::-1])


def test_of_repeated_rows_the_same_stays_each_time(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, f"s{i % 4}") for i in range(20)]
    docs = lambda own: spark.createDataFrame(own, "doc_id long, text string, source string").repartition(4)
    once, again = (corpus_pipeline.near_duplicates(spark, docs(own), sf_dir).collect() for own in (rows, rows[::-1]))
    assert len(once) == 1 and once == again


def test_each_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_python_workers_get_small_batches(spark):
    """An executor holds a batch several times over for each task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{64 << 20}b")
    try:
        corpus_pipeline.personal_data(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), "")
        texts = spark.range(0, 40, 1, 1).select(F.expr("repeat('x', 200000)").alias("text"))
        sizes = [r.n for r in texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
    finally:
        spark.conf.set(name, before)
    assert sum(sizes) >= 8_000_000 and max(sizes) < 3 << 20
