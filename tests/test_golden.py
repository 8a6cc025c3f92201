"""Golden values of small inputs, and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.enums import AdjacencyType, AggregationType, GeoFileType, GeoRelationship
from gridloom.errors import InvalidParameters, NoSession
from gridloom.functions import bands, geometry, temporal
from gridloom.operators import adapter, adjacency, datasets, grid, spatial_join, tensor
from gridloom.sources import readers, tiff, writers


def rects(spark, rows):
    df = spark.createDataFrame(rows, "cell_id int, x0 double, y0 double, x1 double, y1 double")
    return df.select("cell_id", geometry.rectangle(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias("geometry"))


def corners(cells):
    e = geometry.envelope(F.col("geometry"))
    return [tuple(r) for r in cells.orderBy("cell_id").select("cell_id", e["xmin"], e["ymin"], e["xmax"], e["ymax"]).collect()]


UNIT = [(0, 0.0, 0.0, 1.0, 1.0), (1, 1.0, 0.0, 2.0, 1.0), (2, 0.0, 1.0, 1.0, 2.0), (3, 1.0, 1.0, 2.0, 2.0)]


def test_grid_of_a_frame_and_of_a_box(spark):
    halves = rects(spark, [(0, 0.0, 0.0, 0.5, 1.0), (1, 0.5, 0.0, 2.0, 1.0)])
    assert corners(grid.generate_grid_cells(halves, 2, 1)) == UNIT[:2]
    assert corners(grid.generate_grid_cells([[0, 0], [2, 1]], 2, 1, spark=spark)) == UNIT[:2]
    assert corners(grid.generate_grid_cells([[0, 0], [2, 2]], 2, spark=spark)) == UNIT


def test_binary_adjacency(spark):
    got = adjacency.get_polygons_adjacency(rects(spark, UNIT), "cell_id", "geometry").collect()
    assert [r.binary_adjacency for r in got] == [[0, 1, 1, 1], [1, 0, 1, 1], [1, 1, 0, 1], [1, 1, 1, 0]]


def test_point_adjacency(spark):
    rows = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0), (3, 1.0, 1.0)], "point_id int, x double, y double")
    got = adjacency.get_points_adjacency(rows.withColumn("geometry", geometry.point(F.col("x"), F.col("y"))), "point_id", "geometry").collect()
    side, far = 0.6065306597126335, 0.36787944117144233
    assert got[0].exponential_distances == [1.0, side, side, far]
    assert got[3].exponential_distances == [far, side, side, 1.0]


def test_border_ratio_and_equal_points(spark):
    got = adjacency.get_polygons_adjacency(rects(spark, UNIT), "cell_id", "geometry", AdjacencyType.COMMON_BORDER_RATIO).first()
    assert got.common_border_ratios == [1.0, 0.25, 0.25, 0.0]
    same = spark.createDataFrame([(0,), (1,)], "point_id int").withColumn("geometry", geometry.point(F.lit(1.0), F.lit(1.0)))
    assert adjacency.get_points_adjacency(same, "point_id", "geometry").first().exponential_distances == [1.0, 1.0]


def test_join_aggregate_excludes_the_boundary(spark):
    cells = rects(spark, UNIT[:2]).withColumnRenamed("geometry", "geometry1")
    points = spark.createDataFrame([(0.5, 0.5, 2), (0.75, 0.5, 4), (1.0, 0.5, 9), (None, 0.5, 9)], "x double, y double, feature int")
    points = points.withColumn("geometry", geometry.point(F.col("x"), F.col("y")))
    got = spatial_join.aggregate_spatial_dfs(cells, points, "geometry1", "geometry", "cell_id", GeoRelationship.CONTAINS, ["feature"], [AggregationType.AVG], ["avg_feature"])
    assert [tuple(r) for r in got.collect()] == [(0, 3.0)]
    touched = spatial_join.spatial_join(cells, points, "geometry1", "geometry", GeoRelationship.TOUCHES)
    assert sorted(r.cell_id for r in touched.collect()) == [0, 1]


def test_general_polygons(spark):
    texts = ["POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))", "POINT (2 2)", "LINESTRING (0 0, 3 4)", "nothing", None, "POINT (1 x)"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("g", geometry.from_wkt(F.col("t")))
    got = rows.orderBy("i").select(F.col("g").isNull().alias("none"), geometry.length(F.col("g")).alias("length")).collect()
    assert [r.none for r in got] == [False, False, False, True, True, True]
    assert [r.length for r in got[:3]] == [24.0, 0.0, 5.0]
    ring = rows.filter("i = 0")
    inside = ring.select(geometry.area(F.col("g")), *(geometry.contains_point(F.col("g"), F.lit(x), F.lit(y)) for x, y in ((2.0, 2.0), (0.5, 0.5), (0.0, 2.0)))).first()
    assert list(inside) == [12.0, False, True, False]
    assert ring.select(geometry.from_wkt(geometry.to_wkt(F.col("g"))) == F.col("g")).first()[0]


def test_temporal(spark):
    rows = spark.createDataFrame([("2010-10-05 00:00:00",), ("2010-10-05 01:30:00",), ("bad",), (None,)], "t string")
    unix = temporal.get_unix_timestamp(rows, "t")
    assert unix.columns[-1] == "unix_t"
    steps = temporal.add_temporal_steps(unix, "unix_t", 3600)
    assert [r.temporal_steps for r in steps.collect()] == [0, 1, None, None]
    assert temporal.get_temporal_steps_count(steps, "temporal_steps") == 2
    assert temporal.get_temporal_steps_count(steps.limit(0), "temporal_steps") == 0
    assert temporal.trim_on_datetime(rows, "t", upper="2010-10-05 01:00:00").count() == 1
    with pytest.raises(InvalidParameters):
        temporal.trim_on_timestamp(unix, "unix_t")


def test_datetime_filter_reaches_the_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = temporal.trim_on_datetime(events, "ts", "2024-01-20 12:00:00", "2024-01-05 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_empty_grids(spark):
    none = spark.createDataFrame([], "lat double, lon double, t string")
    points = grid.add_spatial_points(none, "lat", "lon", "geometry")
    assert grid.get_st_grid_dataframe(points, "geometry", 4, 4, "t").count() == 0
    assert grid.get_spatial_grid_dataframe(points, "geometry", 4, 4).count() == 0


def test_bands_divide_by_zero(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 0.0, 4.0], 2)], "data array<double>, nBands int")
    assert bands.divide_bands(rows, 0, 1, name="v").first().v == [None, 0.5]
    assert bands.get_normalized_difference_index(rows, 1, 0).first().normalized_difference == [1.0, -0.33]
    assert bands.get_band_from_array_data(rows, 1, full=False).columns == ["band_value1"]
    assert bands.append_normalized_difference_index(rows, 0, 1).first().nBands == 3
    with pytest.raises(InvalidParameters):
        bands.get_band_from_array_data(rows, -1)


def test_tiff_round_trip_and_broken_files(spark, tmp_path):
    pixels = np.arange(24, dtype=float).reshape(2, 3, 4)
    assert (tiff.read_tiff(tiff.write_tiff(pixels)) == pixels).all()
    rows = spark.createDataFrame([("/a/x.tif", bytearray(tiff.write_tiff(pixels))), ("/a/y.tif", bytearray(b"no image"))], "path string, content binary")
    assert writers.write_geotiff_image_with_binary_data(rows, str(tmp_path / "out"), num_partitions=1).count() == 2
    assert readers.load_geotiff_image_as_array_data(str(tmp_path / "out"), spark=spark).count() == 2
    got = readers.load_geotiff_image_as_array_data(str(tmp_path / "out"), {"dropInvalid": "true"}, spark)
    assert got.columns == ["origin", "geometry", "height", "width", "data", "nBands"]
    assert got.select("height", "width", "nBands", "data").first() == (3, 4, 2, pixels.ravel().tolist())
    writers.write_geotiff_image_with_array_data(got, str(tmp_path / "again")).collect()
    assert readers.load_geotiff_image_as_array_data(str(tmp_path / "again"), spark=spark).first().data == pixels.ravel().tolist()


def test_geometry_files(spark, tmp_path):
    import struct

    (tmp_path / "a.wkt").write_text("POINT (1 2)\tx\nPOLYGON ((0 0, 1 0, 1 1, 0 0))\ty\n")
    got = readers.load_geo_data(str(tmp_path / "a.wkt"), GeoFileType.WKT_FILE, spark)
    assert [r.geometry.type for r in got.collect()] == ["POINT", "POLYGON"]
    wkb = struct.pack("<BIdd", 1, 1, 3.0, 4.0).hex()
    (tmp_path / "a.wkb").write_text(f"{wkb}\tx\n")
    assert readers.load_geo_data(str(tmp_path / "a.wkb"), GeoFileType.WKB_FILE, spark).select(geometry.x_of(F.col("geometry"))).first()[0] == 3.0
    feature = '{"type":"Feature","properties":{"name":"z"},"geometry":{"type":"Point","coordinates":[5,6]}}'
    (tmp_path / "a.json").write_text(f"{feature}\n{feature}\n")
    rows = readers.load_geo_data(str(tmp_path / "a.json"), GeoFileType.JSON_FILE, spark).collect()
    assert [r.properties["name"] for r in rows] == ["z", "z"] and rows[0].geometry.rings[0][0].y == 6.0
    (tmp_path / "b.json").write_text(f'{{"type":"FeatureCollection","features":[{feature}]}}')
    assert readers.load_geo_data(str(tmp_path / "b.json"), GeoFileType.JSON_FILE, spark).count() == 1
    body = struct.pack("<idd", 1, 7.0, 8.0)
    (tmp_path / "shp").mkdir()
    (tmp_path / "shp/a.shp").write_bytes(bytes(100) + struct.pack(">ii", 1, len(body) // 2) + body)
    field = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([3]) + bytes(15)
    (tmp_path / "shp/a.dbf").write_bytes(struct.pack("<BBBBIHH20x", 3, 1, 1, 1, 1, 32 + 32 + 1, 4) + field + b"\x0d" + b" abc")
    row = readers.load_geo_data(str(tmp_path / "shp"), GeoFileType.SHAPE_FILE, spark).first()
    assert row.properties == {"NAME": "abc"} and row.geometry.rings[0][0].x == 7.0


def test_wkb_dialects():
    import struct

    point, line = readers._wkb(struct.pack("<BIIdd", 1, 0x20000001, 4326, 3.0, 4.0)), struct.pack(">BII6d", 0, 0x80000002, 2, 1, 2, 9, 3, 4, 9)
    assert point == {"type": "POINT", "rings": [[{"x": 3.0, "y": 4.0}]]}
    assert [[v["x"], v["y"]] for v in readers._wkb(line)["rings"][0]] == [[1, 2], [3, 4]]
    assert [[v["x"], v["y"]] for v in readers._wkb(struct.pack("<BII8d", 1, 3002, 2, 1, 2, 9, 8, 3, 4, 9, 8))["rings"][0]] == [[1, 2], [3, 4]]
    ring = lambda *xy: struct.pack(f"<I{len(xy)}d", len(xy) // 2, *xy)
    square = struct.pack("<BII", 1, 3, 1) + ring(0, 0, 0, 2, 2, 2, 2, 0, 0, 0)  # clockwise
    multi = struct.pack("<BII", 1, 6, 2) + square + square
    got = readers._wkb(multi)
    assert got["type"] == "MULTIPOLYGON" and [readers._twice_area(r) for r in got["rings"]] == [8.0, 8.0]
    assert readers._wkb(b"") is None and readers._wkb(multi[:-3]) is None and readers._wkb(struct.pack("<BII", 1, 7, 0)) is None


def test_multi_kinds(spark):
    texts = ["MULTIPOLYGON (((0 0, 0 2, 2 2, 2 0, 0 0), (0.5 0.5, 1.5 0.5, 1.5 1.5, 0.5 1.5, 0.5 0.5)), ((5 5, 6 5, 6 6, 5 6, 5 5)))", "MULTIPOINT ((1 2), (3 4))", "MULTIPOINT (1 2, 3 4)", "MULTILINESTRING ((0 0, 3 4), (1 1, 1 2))"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("g", geometry.from_wkt(F.col("t")))
    g = F.col("g")
    many, *rest = rows.orderBy("i").select(geometry.area(g).alias("area"), geometry.length(g).alias("length"), F.size(g["rings"]).alias("n"), *(geometry.contains_point(g, F.lit(x), F.lit(y)).alias(n) for n, x, y in (("a", 0.2, 0.2), ("b", 1.0, 1.0), ("c", 5.5, 5.5)))).collect()
    assert (many.area, many.n, many.a, many.b, many.c) == (4.0, 3, True, False, True)
    assert [r.n for r in rest] == [2, 2, 2] and rest[2].length == 6.0
    assert rows.select((geometry.from_wkt(geometry.to_wkt(g)) == g).alias("same")).filter("NOT same").count() == 0


def test_shapefile_parts_and_deleted_rows(spark, tmp_path):
    import struct

    def polygon(*rings):
        points = [v for r in rings for v in r]
        starts = [sum(len(r) // 2 for r in rings[:i]) for i in range(len(rings))]
        return struct.pack(f"<i4d2i{len(rings)}i{len(points)}d", 5, 0, 0, 9, 9, len(rings), len(points) // 2, *starts, *points)

    outer, hole, other = (0, 0, 0, 4, 4, 4, 4, 0, 0, 0), (1, 1, 2, 1, 2, 2, 1, 2, 1, 1), (6, 6, 6, 7, 7, 7, 7, 6, 6, 6)
    bodies = [polygon(outer, other, hole), polygon(outer, hole), polygon(outer)]
    (tmp_path / "a.shp").write_bytes(bytes(100) + b"".join(struct.pack(">ii", i + 1, len(b) // 2) + b for i, b in enumerate(bodies)))
    field = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([3]) + bytes(15)
    (tmp_path / "a.dbf").write_bytes(struct.pack("<BBBBIHH20x", 3, 1, 1, 1, 3, 32 + 32 + 1, 4) + field + b"\x0d" + b" abc" + b" def" + b"*ghi")
    got = readers.load_geo_data(str(tmp_path), GeoFileType.SHAPE_FILE, spark)
    assert sorted(map(tuple, got.select(F.col("properties")["NAME"], "geometry.type", geometry.area(F.col("geometry"))).collect())) == [("abc", "MULTIPOLYGON", 16.0), ("def", "POLYGON", 15.0)]


def lzw(data):
    """TIFF's LZW, for the reader's test."""
    table, bits, out = {bytes([i]): i for i in range(256)}, [], bytearray()
    put = lambda code, width: bits.extend(f"{code:0{width}b}")
    put(256, 9)
    size, held = 258, b""
    width = lambda: 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    for i in range(len(data)):
        c = data[i : i + 1]
        if held + c in table:
            held += c
            continue
        put(table[held], width())
        table[held + c] = size
        size += 1
        if size == 4094:
            put(256, 12)
            table, size = {bytes([i]): i for i in range(256)}, 258
        held = c
    put(table[held], width())
    size += 1
    put(257, width())
    bits.extend("0" * (-len(bits) % 8))
    for i in range(0, len(bits), 8):
        out.append(int("".join(bits[i : i + 8]), 2))
    return bytes(out)


@pytest.mark.parametrize("compression", [1, 5, 8])
@pytest.mark.parametrize("predictor", [1, 2, 3])
@pytest.mark.parametrize("tiled", [False, True])
def test_tiff_layouts(compression, predictor, tiled):
    import struct
    import zlib

    kind = np.dtype("<f4") if predictor == 3 else np.dtype("<u2")
    pixels = (np.random.default_rng(0).integers(0, 60, (3, 37, 29)) * 7).astype(kind)
    rows, columns = (16, 16) if tiled else (10, 29)
    blocks = []
    for y in range(0, 37, rows):
        for x in range(0, 29, columns):
            part = pixels[:, y : y + rows, x : x + columns].transpose(1, 2, 0)
            if tiled:
                part = np.pad(part, ((0, rows - part.shape[0]), (0, columns - part.shape[1]), (0, 0)))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=kind.type(0))
            raw = np.ascontiguousarray(part).tobytes()
            if predictor == 3:
                by = np.ascontiguousarray(part).astype(">f4").view(np.uint8).reshape(part.shape[0], -1, 4).transpose(0, 2, 1).reshape(part.shape[0], -1, 3)
                raw = np.diff(by, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
            blocks.append({1: bytes, 5: lzw, 8: zlib.compress}[compression](raw))
    body, offsets = b"", []
    for b in blocks:
        offsets.append(8 + len(body))
        body += b
    tags = [(256, 4, [29]), (257, 4, [37]), (258, 3, [kind.itemsize * 8] * 3), (259, 3, [compression]), (277, 3, [3]), (284, 3, [1]), (317, 3, [predictor]), (339, 3, [3 if predictor == 3 else 1] * 3)]
    tags += [(322, 4, [16]), (323, 4, [16]), (324, 4, offsets), (325, 4, list(map(len, blocks)))] if tiled else [(273, 4, offsets), (278, 4, [10]), (279, 4, list(map(len, blocks)))]
    entries, extra, after = b"", b"", 8 + len(body)
    for tag, code, values in sorted(tags):
        packed = struct.pack(f"<{len(values)}{'H' if code == 3 else 'I'}", *values)
        place = packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack("<I", after + len(extra))
        extra += packed if len(packed) > 4 else b""
        entries += struct.pack("<HHI", tag, code, len(values)) + place
    data = b"II*\0" + struct.pack("<I", after + len(extra)) + body + extra + struct.pack("<H", len(tags)) + entries + bytes(4)
    assert (tiff.read_tiff(data) == pixels).all()


def test_raster_sink_modes_and_places(spark, tmp_path):
    rows = spark.createDataFrame([("/a/x.tif", 2, 2, 1, [1.0, 2.0, 3.0, 4.0]), ("/b/x.tif", 2, 2, 1, [5.0, 6.0, 7.0, 8.0])], "origin string, width int, height int, nBands int, data array<double>")
    placed = rows.withColumn("geometry", geometry.rectangle(*(F.lit(float(v)) for v in (10, 20, 14, 26))))
    out = str(tmp_path / "out")
    writers.write_geotiff_image_with_array_data(placed, out, geometry="geometry").collect()
    got = readers.load_geotiff_image_as_array_data(out, spark=spark)
    assert sorted(r.data[0] for r in got.collect()) == [1.0, 5.0]  # two files in spite of one name
    e = geometry.envelope(F.col("geometry"))
    assert got.select(e["xmin"], e["ymin"], e["xmax"], e["ymax"]).distinct().collect() == [(10.0, 20.0, 14.0, 26.0)]
    writers.write_geotiff_image_with_array_data(rows.limit(1), out, mode="append", extension=".tif").collect()
    assert readers.load_geotiff_image_as_binary_data(out, spark).count() == 3
    with pytest.raises(InvalidParameters):
        writers.write_geotiff_image_with_array_data(rows, out, mode="error")
    writers.write_geotiff_image_with_array_data(rows.limit(1), out).collect()
    assert readers.load_geotiff_image_as_binary_data(out, spark).count() == 1


def test_arrays_from_files(spark, tmp_path):
    frames = np.arange(24.0).reshape(4, 2, 3)
    np.save(tmp_path / "a.npy", frames)
    np.savez(tmp_path / "a.npz", flow=frames, volume=frames[:1])
    steps = readers.npy_frames(readers.load_npy(str(tmp_path / "a.npy"), spark))
    assert [r.frame for r in steps.orderBy("t").collect()] == frames.reshape(4, 6).tolist()
    assert readers.load_npz(str(tmp_path / "a.npz"), ["flow", "volume"], spark).count() == 2


def steps_of(spark, n, cells=4):
    return spark.range(n * cells).select(F.floor(F.col("id") / cells).alias("t"), (F.col("id") % cells).alias("c"), F.col("id").cast("double").alias("f"))


def test_sample_counts(spark):
    frames = tensor.frames(steps_of(spark, 744), "t", "c", ["f"])
    got = tensor.periodical_features(frames)
    assert got.count() == 72
    row = got.filter("t = 672").first()
    assert [len(row.x_closeness), len(row.x_period), len(row.x_trend), len(row.t_data)] == [3, 4, 4, 31]
    assert row.x_closeness[0][0] == 671 * 4 and row.x_trend[3][0] == 0 and row.y_data[0] == 672 * 4
    assert tensor.sequential_windows(frames, 24, 5, 744).count() == 744 - 29
    assert tensor.lead_time_pairs(frames, 48).count() == 744 - 48
    assert tensor.periodical_features(frames, len_trend=0).first().x_trend == []
    with pytest.raises(InvalidParameters):
        tensor.periodical_features(frames, 0, 0, 0)


def test_dense_fill_duplicates_and_constant(spark):
    rows = spark.createDataFrame([(0, 1, 5.0), (0, 1, 7.0)], "t int, c int, f double")
    dense = tensor.get_st_grid_array(rows, "t", "c", ["f"], 2, 1, 2)
    got = tensor.to_numpy(dense, ["t", "c"], ["f"], (2, 1, 2))
    assert got.shape == (2, 1, 2, 1) and got[0, 0, 1, 0] == 7.0 and math.isnan(got[1, 0, 0, 0])
    flat = tensor.normalized(tensor.get_st_array(rows, "t", "c", ["f"], 1, 2, 7.0), ["f"])
    assert [r.f for r in flat.collect()] == [None, None]


def test_labels_splits_and_ids(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "label string, x int")
    got = {r.image_data: r.label for r in datasets.classification_frame(rows.withColumnRenamed("label", "kind"), "x", "kind").collect()}
    assert got == {1: 1, 2: 0, 3: None}
    ids = adapter.add_row_id(spark.range(1000).select((999 - F.col("id")).alias("k")), "i", ["k"])
    assert all(r.k == r.i for r in ids.collect())
    split = datasets.split_train_validation_test(ids, "i", 0.2, 0.1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 700, "validation": 200, "test": 100}


def test_row_ids_keep_every_row_and_its_payload(spark, tmp_path):
    n = 2_000_000
    rows = spark.range(n, numPartitions=7).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("k"), F.concat(F.lit("p"), "id").alias("payload"), (F.col("id") % 3).alias("_part"))
    for key in ("k", "_part"):  # distinct keys, and three that hold a third of the rows each
        path = str(tmp_path / key)
        adapter.add_row_id(rows, "i", [key]).write.parquet(path)
        got = spark.read.parquet(path)
        assert got.columns == ["k", "payload", "_part", "i"]
        assert got.agg(F.count("*"), F.countDistinct("i"), F.min("i"), F.max("i"), F.countDistinct("payload")).first() == (n, n, 0, n - 1, n)
        before = got.alias("a").join(got.alias("b"), F.expr("b.i = a.i + 1")).filter(F.col(f"a.{key}") > F.col(f"b.{key}"))
        assert before.count() == 0
    assert adapter.add_row_id(rows.limit(0), "i", ["k"]).count() == 0


def test_lambert_feet(spark):
    at = spark.range(1).select(geometry.from_new_york_feet(geometry.vertex(F.lit(984250.0), F.lit(0.0))).alias("v")).first().v
    assert abs(at.x + 74.0) < 1e-4 and abs(at.y - 40.1666667) < 1e-3


def test_options_and_session():
    assert AdjacencyType.from_str("binary") is AdjacencyType.BINARY
    assert AggregationType.from_str("AVG") is AggregationType.AVG
    with pytest.raises(InvalidParameters):
        GeoFileType.from_str("xlsx")
    assert issubclass(NoSession, RuntimeError)


def test_streamed_grid(spark, sf_dir, tmp_path):
    from gridloom.streaming.grids import stream_grid_counts

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    counts = stream_grid_counts(stream, "value", "user_id", "ts", (0, 0, 100, 100), 4, 4, "6 hours")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("grid_counts").start()
    q.processAllAvailable()
    q.stop()
    inside = events.filter("value BETWEEN 0 AND 100 AND user_id BETWEEN 0 AND 100").count()
    assert spark.table("grid_counts").agg(F.sum("aggregated_feature")).first()[0] == inside
