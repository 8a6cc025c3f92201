"""Joins and weights of tables whose rows stand at the same places many times."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.enums import GeoRelationship
from gridloom.functions import geometry as G
from gridloom.operators import spatial_join
from gridloom.plans import catalog

TABLES = {"supplier": "s_suppkey", "customer": "c_custkey"}
#: A multiple of what the shapes' sizes go by, so copies have the same ones.
STEP = 42_000
COPIES = 3


@pytest.fixture(scope="module")
def repeated(spark, sf_dir, tmp_path_factory):
    """A folder with three copies of each row under other keys, and DuckDB over it."""
    folder, con = tmp_path_factory.mktemp("repeated"), duckdb.connect()
    for t, key in TABLES.items():
        con.sql(f"COPY (SELECT * REPLACE ({key} + i * {STEP} AS {key}) FROM '{sf_dir}/{t}.parquet', range({COPIES}) r(i)) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


def judged(df):
    """The rows of ``df``, and how many went to Python's functions for them."""
    rows = df.collect()

    def count(plan):
        inner = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan() if "QueryStage" in plan.nodeName() else None
        below = [inner] if inner is not None else [plan.children().apply(i) for i in range(plan.children().size())]
        own = plan.metrics().get("pythonNumRowsReceived").get().value() if plan.nodeName() == "ArrowEvalPython" else 0
        return own + sum(map(count, below))

    return rows, count(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("name", ["general_contains_points", "adj_near_points", "adj_binary", "adj_border_ratio", "general_intersects", "general_touches_points", "shapes_within", "adj_neighbours", "general_intersects_points", "adj_border_shares", "shapes_intersects", "shapes_touches", "shapes_contains", "distance_pairs"])
def test_equal_geometries_are_judged_once(spark, sf_dir, repeated, name):
    folder, con = repeated
    _, once = judged(catalog.QUERIES[name](spark, sf_dir))
    df = catalog.QUERIES[name](spark, folder)
    rows, often = judged(df)
    assert often <= max(once, spark.read.parquet(f"{sf_dir}/supplier.parquet").count())  # those with themselves, if no others meet
    expected = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(rows) == sorted(tuple(r[expected.columns.index(c)] for c in df.columns) for r in expected.fetchall())


def test_lists_of_a_place_hold_every_row(spark, monkeypatch):
    """Many rows at one place, equal rows, rows of a geometry alone, and columns that can't be compared."""
    rows = spark.range(60).select(F.floor(F.col("id") / 2).alias("id"), G.point(F.lit(1.0), F.col("id") % 3).alias("g"))
    square = spark.range(2).select(F.create_map(F.lit("k"), "id").alias("tags"), G.rectangle(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(1.5)).alias("g"))
    for most in (4, 1 << 12):
        monkeypatch.setattr(spatial_join, "LIST_ROWS", most)
        got = spatial_join.spatial_join(square, rows, "g", "g", GeoRelationship.CONTAINS)
        assert got.columns == ["tags", "g", "id", "g"]
        assert sorted((r[0]["k"], r[2]) for r in got.collect()) == sorted((k, i // 2) for k in range(2) for i in range(60) if i % 3 == 1)
        near = spatial_join.distance_join(rows.select("g"), square, "g", "g", 0.5)
        assert sorted(r.distance for r in near.collect()) == [0.0] * 80 + [0.5] * 40


def test_tiles_have_the_proportions_of_the_geometries(spark):
    """Boxes as high as all points together, each as wide as a thousandth of them."""
    points = spark.range(2000).select("id", G.point(F.col("id") * 1.0, F.col("id") % 25).alias("g"))
    a, b = spatial_join._sized(points, "g", F.lit(15.0)), spatial_join._sized(points, "g", None)
    tiling = spatial_join._tiling(spatial_join._summary(a, F.count("*")), spatial_join._summary(b, F.count("*")), True)
    dealt = spatial_join._dealt(b, "2", tiling, ">=")
    assert dealt.groupBy("_r", "_p", "_tx", "_ty").count().agg(F.max("count")).first()[0] < 100
    near = spatial_join.distance_join(points, points, "g", "g", 15.0).count()
    assert near == sum(abs(i - j) ** 2 + abs(i % 25 - j % 25) ** 2 <= 225 for i in range(2000) for j in range(max(0, i - 15), min(2000, i + 16)))


@pytest.mark.parametrize("name", ["adj_points", "adj_exp_centroid", "adj_exp_dist"])
def test_all_pairs_are_made_by_all_tasks_without_python(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.rdd.getNumPartitions() >= 4
    rows, to_python = judged(df)
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    assert len(rows) == n * n and to_python == 0
