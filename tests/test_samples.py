"""Projections, image tables and traffic samples by known values."""

import pytest
from pyspark.sql import functions as F

from gridloom.errors import InvalidParameters
from gridloom.functions import geometry as G
from gridloom.functions import projections
from gridloom.operators import adapter, datasets, traffic, weather
from gridloom.sources import readers, tiff


def _moved(spark, x, y, source, target):
    g = G.transform_crs(G.point(F.lit(x), F.lit(y)), source, target)
    r = spark.range(1).select(g.alias("g")).select(G.x_of(F.col("g")).alias("x"), G.y_of(F.col("g")).alias("y")).first()
    return r.x, r.y


def test_zone_of_a_known_tower(spark):
    assert _moved(spark, -79.387139, 43.642567, "EPSG:4326", "EPSG:32617") == pytest.approx((630084, 4833438), abs=2)


def test_origin_of_a_zone_and_its_southern_half(spark):
    assert _moved(spark, 9.0, 0.0, "EPSG:4326", "EPSG:32632") == pytest.approx((500000, 0), abs=1e-6)
    assert _moved(spark, 9.0, 0.0, "EPSG:4326", "EPSG:32732") == pytest.approx((500000, 10000000), abs=1e-6)


@pytest.mark.parametrize("code", ["EPSG:32618", "EPSG:32718", "EPSG:26918", "EPSG:2263", "EPSG:2154", "EPSG:3034", "EPSG:3347", "EPSG:3978", "EPSG:3857"])
def test_there_and_back(spark, code):
    x, y = _moved(spark, -73.9857, 40.7484, "EPSG:4326", code)
    assert (abs(x) > 1000) and _moved(spark, x, y, code, "EPSG:4326") == pytest.approx((-73.9857, 40.7484), abs=1e-8)


def test_origin_of_new_york(spark):
    v = projections.to_new_york_feet(G.vertex(F.lit(-74.0), F.lit(40.16666666666666)))
    r = spark.range(1).select(v.alias("v")).select("v.x", "v.y").first()
    assert (r.x, r.y) == pytest.approx((300000 / 0.3048006096012192, 0), abs=1e-4)


def test_conics_of_any_parameters(spark):
    # the worked example of the EPSG guidance: Texas, in US survey feet, on Clarke's ellipsoid of 1866
    foot = 1200 / 3937
    texas = projections.Conic(27 + 50 / 60, -99.0, 28 + 23 / 60, 30 + 17 / 60, 2e6 * foot, 0.0, foot, (6378206.4, 1 / 294.97870))
    assert _moved(spark, -96.0, 28.5, "EPSG:4326", texas) == pytest.approx((2963503.91, 254759.80), abs=0.02)
    assert _moved(spark, 2963503.91, 254759.80, texas, "EPSG:4326") == pytest.approx((-96.0, 28.5), abs=1e-7)
    # a cone of the south mirrors one of the north; one that touches; across the date line
    north, south = projections.Conic(40.0, 10.0, 30.0, 50.0), projections.Conic(-40.0, 10.0, -30.0, -50.0)
    x, y = _moved(spark, 14.0, 43.0, "EPSG:4326", north)
    assert _moved(spark, 14.0, -43.0, "EPSG:4326", south) == pytest.approx((x, -y), abs=1e-6)
    assert _moved(spark, x, -y, south, "EPSG:4326") == pytest.approx((14.0, -43.0), abs=1e-8)
    one = projections.Conic(45.0, 179.0, 45.0, 45.0)
    x, y = _moved(spark, -179.5, 45.0, "EPSG:4326", one)
    assert 0 < x < 200_000 and _moved(spark, x, y, one, "EPSG:4326") == pytest.approx((-179.5, 45.0), abs=1e-8)


def test_many_values_are_numbered_like_few(spark, monkeypatch):
    values = spark.range(0, 900, 3).selectExpr("cast(id AS string) AS v")
    few = {r.v: r.n for r in adapter.numbered(values, "v", "n").collect()}
    monkeypatch.setattr(adapter, "FEW_VALUES", 10)
    assert {r.v: r.n for r in adapter.numbered(values, "v", "n").collect()} == few == {v: k for k, v in enumerate(sorted(few))}


def test_columns_types_lists_and_frames(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string").coalesce(1)
    assert adapter.get_columns(df) == ["k", "s"]
    assert adapter.get_column_types(df) == [("k", "int"), ("s", "string")]
    assert [tuple(r) for r in adapter.get_all_rows(df)] == [(1, "a"), (2, None)]
    assert [tuple(r) for r in adapter.get_top_rows(df, 1)] == [(1, "a")]
    assert list(adapter.df_to_pandas(df)["k"]) == [1, 2] and list(adapter.df_to_pandas(df, ["s"]).columns) == ["s"]
    assert list(adapter.column_to_pandas(df, "k").to_numpy().ravel()) == [1, 2]
    assert adapter.df_to_list(df) == [[1, "a"], [2, None]] and adapter.df_to_list(df, ["s"]) == [["a"], [None]]
    assert adapter.column_to_list(df, "s") == ["a", None]


def test_unknown_system(spark):
    with pytest.raises(InvalidParameters):
        G.transform_crs(F.col("g"), "EPSG:4326", "EPSG:99999")


def test_planes(spark):
    planes = spark.createDataFrame([([1.0, 2.0, 0.0, 0.0],)], "data array<double>")
    got = traffic.with_planes(spark.range(3), planes, "data", 2).collect()
    assert [r.p_data for r in got] == [[0.5, 1.0, None, None]] * 3


def test_flows_of_both_ends(spark):
    flows = spark.createDataFrame([(0, 5, 1, 1, 1, 2, 3), (1, 5, 1, 1, 0, 1, 2), (0, 5, 0, 0, 2, 2, 9)], "k long, t long, h long, w long, to_h long, to_w long, n long")
    got = {tuple(r) for r in traffic.flow_channels(flows, 1).collect()}
    assert got == {(5, 1, 1, 5, 0, 3.0), (5, 1, 2, 3, 1, 3.0), (6, 1, 1, 1, 2, 2.0), (6, 0, 1, 7, 3, 2.0)}
    assert {len(r.flow) for r in traffic.local_flows(flows, 1).collect()} == {36}


def test_feature_without_callback(spark):
    with pytest.raises(InvalidParameters):
        datasets.image_features(spark.range(1), "id", "data", 3, 2, 2, {"red": 0, "green": 1, "blue": 2}, ["mine"])


def test_levels_of_a_dark_image(spark):
    levels = datasets.image_levels(F.array(*(F.lit(0.0) for _ in range(3))), 3, 0, 1, 2)
    assert spark.range(1).select(levels.alias("v")).first().v == [None]


def test_spatial_rdd(spark):
    df = spark.range(2).select(G.point(F.lit(1.0), F.col("id").cast("double")).alias("geometry"), "id")
    back = adapter.rdd_to_spatial_df(adapter.df_to_spatial_rdd(df, "geometry"), "id long")
    assert back.schema.names == ["geometry", "id"] and sorted(back.select("id", G.y_of(F.col("geometry"))).collect()) == [(0, 0.0), (1, 1.0)]


def test_pixel_and_one_hot_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,10,2,20\n3,30,4,40\n")
    (tmp_path / "y.csv").write_text("0,1,0\n1,0,0\n")
    assert sorted(r.data for r in readers.load_pixel_csv(str(tmp_path / "x.csv"), 1, 2, 2, spark).collect()) == [[1, 2, 10, 20], [3, 4, 30, 40]]
    assert sorted(r.label for r in readers.load_one_hot_csv(str(tmp_path / "y.csv"), spark).collect()) == [0, 1]


def test_image_table(spark, tmp_path):
    images = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "data array<double>").select(tiff.encoded(tiff.raster(F.lit(2), F.lit(2), F.lit(1), F.col("data"))).alias("c"))
    (tmp_path / "one.tif").write_bytes(bytes(images.first().c))
    (tmp_path / "list.csv").write_text(f"path,kind,a,b\n{tmp_path}/one.tif,wood,0.5,2\n{tmp_path}/gone.tif,wood,1,1\n")
    rows = readers.load_image_table(str(tmp_path / "list.csv"), f"{tmp_path}/*.tif", "path", "kind", spark=spark).collect()
    assert [(r.kind, r.a, r.b, r.data) for r in rows] == [("wood", 0.5, 2.0, [1.0, 2.0, 3.0, 4.0])]


def test_weather_variable_on_a_level(spark):
    rows = [("b", 10, 0.5, 850, 3.0), ("a", 10, 0.5, 850, 1.0), ("a", -10, 0.5, 850, None), ("a", 50, 0.5, 500, 9.0), (None, 10, 0.5, 850, 7.0), ("b", 10, 0.5, 850, 2.0)]
    df = spark.createDataFrame(rows, "time string, latitude int, longitude double, level int, t double")
    frames = weather.variable_frames(df, "temperature")
    assert sorted(map(tuple, frames.collect())) == [(0, 0, 0, None), (0, 1, 0, 1.0), (1, 1, 0, 3.0)]
    assert tuple(weather.field_shape(frames).first()) == (2, 2, 1)


def test_weather_without_rows(spark):
    df = spark.createDataFrame([], "time string, latitude int, longitude double, tp double")
    frames = weather.variable_frames(df, "total_precipitation")
    assert frames.count() == 0 and tuple(weather.field_shape(frames).first()) == (0, 0, 0)


def test_every_point_is_in_its_nearest_hexagon(spark):
    import math
    import random

    draw = random.Random(5)
    points = [(draw.uniform(40.5, 40.9), draw.uniform(-74.2, -73.7)) for _ in range(300)]
    got = adapter.hexagon_layer(spark.createDataFrame([*points, (None, 1.0)], "lat double, lon double"), "lat", "lon", 3000.0).collect()
    wide = math.cos(math.radians(got[0].mid_latitude))
    count = dict.fromkeys(((h.q, h.r) for h in got), 0)
    for y, x in points:
        near = min(got, key=lambda h: math.hypot((x - h.longitude) * wide, y - h.latitude))
        assert math.hypot((x - near.longitude) * wide, y - near.latitude) * adapter.DEGREE <= 3000.001
        count[near.q, near.r] += 1
    assert count == {(h.q, h.r): h.points for h in got}
    ys = [y for y, _ in points]
    assert got[0].mid_latitude == (min(ys) + max(ys)) / 2


def test_large_means_are_rounded_as_doubles(spark, tmp_path):
    """Red and near infrared cancel out in these pixels, so the index is beyond a long's millionths."""
    import duckdb

    from gridloom.functions import bands
    from gridloom.plans import catalog

    rows = [(k, [0.0] * 32 + [-v] * 16 + [v] * 16) for k, v in enumerate((0.375, 0.75, -0.75, 300.0))]
    spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = sorted(con.sql(catalog.ORACLE_SQL["mean_index_features"]).fetchall())
    assert expected[3][1] > 1e16
    assert sorted(map(tuple, catalog.QUERIES["mean_index_features"](spark, str(tmp_path)).collect())) == expected
    values = [-1e300, -2.5, -0.5, 0.5, 2.5, 2.0**53, 1e300, None]
    got = spark.createDataFrame([(values,)], "v array<double>").select(F.transform("v", bands.floored).alias("f")).first().f
    assert got == [-1e300, -3.0, -1.0, 0.0, 2.0, 2.0**53, 1e300, None]
