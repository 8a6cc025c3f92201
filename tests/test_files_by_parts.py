"""NetCDF by slabs, .npy shards, exact splits, samples and windows by blocks."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.enums import GeoFileType
from gridloom.errors import InvalidParameters
from gridloom.operators import adapter, datasets, tensor, weather
from gridloom.scratch import qualified
from gridloom.sources import netcdf, readers, tiff, writers

HOURS = {"units": "hours since 1970-01-02 00:00:00"}


def written(folder, name, *args, **kwargs):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(netcdf.encoded(*args, **kwargs))
    return qualified_path(folder)


def qualified_path(folder):
    return f"file://{folder}"


def axes(times, lat=(10.0, 20.0, 30.0), lon=(0.0, 5.0)):
    return {"time": (np.array(times), HOURS), "latitude": (np.array(lat), {}), "longitude": (np.array(lon), {})}


@pytest.mark.parametrize("growing", [True, False])
def test_netcdf_rows_and_combination(spark, tmp_path, growing, monkeypatch):
    monkeypatch.setattr(netcdf, "SLAB", 100)  # two steps a slab
    data = np.arange(9 * 6, dtype=">i2").reshape(9, 3, 2)
    packed = {"scale_factor": 0.5, "add_offset": 100.0, "_FillValue": 7}
    written(tmp_path / "nc", "b.nc", axes(range(5, 9)), "t", data[5:], packed, growing)
    path = written(tmp_path / "nc", "a.nc", axes(range(5)), "t", data[:5], packed, growing)
    rows = netcdf.load_netcdf(path, "t", spark)
    got = {(r.time, r.latitude, r.longitude): r.t for r in rows.collect()}
    expected = {((24 + t) * 3600.0, 10.0 * (h + 1), 5.0 * w): None if data[t, h, w] == 7 else data[t, h, w] * 0.5 + 100 for t in range(9) for h in range(3) for w in range(2)}
    assert got == expected
    frames = {(r.t, r.h, r.w): r.value for r in weather.field_frames(rows, "t").collect()}
    assert frames == {(int(t / 3600) - 24, int(h / 10) - 1, int(w / 5)): v for (t, h, w), v in expected.items()}


def test_netcdf_version_1_written_by_hand(spark, tmp_path):
    """Two growing variables of short records, padded to four bytes, and one
    without an axis of values."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    none = struct.pack(">ii", 0, 0)

    def variable(own, ids, kind, size, begin):
        return name(own) + struct.pack(f">i{len(ids)}i", len(ids), *ids) + none + struct.pack(">iii", kind, size, begin)

    head = b"CDF\1" + struct.pack(">i", 3) + struct.pack(">ii", 10, 2) + name("t") + struct.pack(">i", 0) + name("x") + struct.pack(">i", 3) + none + struct.pack(">ii", 11, 2)
    size = len(head) + sum(len(variable(v, ids, 3, 8, 0)) for v, ids in (("a", [0, 1]), ("b", [0])))
    body = head + variable("a", [0, 1], 3, 8, size) + variable("b", [0], 3, 4, size + 8)
    for t in range(3):
        body += struct.pack(">3h", *(10 * t + i for i in range(3))) + b"\0\0" + struct.pack(">h", -t) + b"\0\0"
    (tmp_path / "one.nc").write_bytes(body)
    a = netcdf.load_netcdf(qualified_path(tmp_path), "a", spark).collect()
    assert {(r.t, r.x): r.a for r in a} == {(t, x): 10 * t + x for t in range(3) for x in range(3)}
    assert {r.t: r.b for r in netcdf.load_netcdf(qualified_path(tmp_path), "b", spark).collect()} == {0: 0, 1: -1, 2: -2}


def test_netcdf_refuses_what_it_is_not(spark, tmp_path):
    (tmp_path / "bad.nc").write_bytes(b"HDF something else")
    with pytest.raises(InvalidParameters):
        netcdf.load_netcdf(qualified_path(tmp_path), "t", spark)
    with pytest.raises(InvalidParameters):
        netcdf.load_netcdf(written(tmp_path / "good", "a.nc", axes([1]), "t", np.zeros((1, 3, 2))), "other", spark)


def test_netcdf_header_longer_than_the_first_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(netcdf, "HEAD", 16)
    path = written(tmp_path / "nc", "a.nc", axes([1, 2]), "t", np.ones((2, 3, 2)), {"note": "x" * 500})
    assert netcdf.load_netcdf(path, "t", spark).agg(F.sum("t")).first()[0] == 12


def test_npy_shards_are_the_whole_array(spark, tmp_path):
    dense = spark.range(10 * 3 * 2).select(F.floor(F.col("id") / 6).alias("t"), F.floor(F.col("id") / 2 % 3).alias("h"), (F.col("id") % 2).alias("w"), (F.col("id") * 1.5).alias("a"), (-F.col("id")).alias("b"))
    target = str(tmp_path / "out")
    files = writers.write_npy_shards(dense.repartition(5), {"t": 10, "h": 3, "w": 2}, ["a", "b"], target, steps=4).collect()
    assert len(files) == 3
    shards = [np.load(f) for f in sorted((tmp_path / "out").iterdir())]
    assert [s.shape for s in shards] == [(4, 3, 2, 2), (4, 3, 2, 2), (2, 3, 2, 2)]
    assert np.array_equal(np.concatenate(shards), tensor.to_numpy(dense, ["t", "h", "w"], ["a", "b"], (10, 3, 2)))
    assert readers.load_npy(qualified(spark, target), spark).count() == 3


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1000])
def test_shuffled_places_are_a_bijection(spark, n):
    rows = spark.range(n).select(datasets.shuffled_place(F.col("id"), F.lit(n), 3).alias("a"), datasets.shuffled_place(F.col("id"), F.lit(n), 4).alias("b")).collect()
    assert sorted(r.a for r in rows) == sorted(r.b for r in rows) == list(range(n))
    if n >= 100:
        moved = [r.a for r in rows]
        assert sum(i == x for i, x in enumerate(moved)) < 10 and moved != [r.b for r in rows]
        assert abs(np.corrcoef(range(n), moved)[0, 1]) < 0.3


@pytest.mark.parametrize("seed", [None, 11])
def test_split_sizes_are_exact(spark, seed):
    parts = dict(datasets.split_train_validation_test(spark.range(777), "id", 0.2, 0.1, seed).groupBy("split").count().collect())
    assert parts == {"train": 543, "validation": 156, "test": 78}


def test_sampled_rows_do_not_depend_on_partitions(spark):
    df = spark.range(5000).withColumn("k", F.when(F.col("id") % 10 > 0, F.col("id")))
    once = {r.id for r in adapter.sampled(df.repartition(7), ["id"], 0.2, 1).collect()}
    assert once == {r.id for r in adapter.sampled(df.repartition(2), ["id"], 0.2, 1).collect()} and 800 < len(once) < 1200
    assert adapter.sampled(df, ["id"], 0.0, 1).count() == 0 and adapter.sampled(df, ["id"], 1.0, 1).count() == 5000
    assert adapter.sampled(df, ["k"], 0.5, 3).filter("k IS NULL").count() in (0, 500)
    with pytest.raises(InvalidParameters):
        adapter.sampled(df, ["id"], 1.5, 1)


@pytest.mark.parametrize("block", [1, 4, 256])
def test_windows_by_blocks_equal_plain_ones(spark, monkeypatch, block):
    monkeypatch.setattr(tensor._gathered, "__defaults__", (block,))
    have = [t for t in range(40) if t != 23]
    steps = spark.createDataFrame([(t, [float(t), t + 0.5]) for t in have], "t long, frame array<double>").repartition(5)
    got = {r.t: (r.x_data, r.y_data) for r in tensor.sequential_windows(steps, 3, 2, 40).collect()}
    frames = lambda ts: [[float(t), t + 0.5] for t in ts if t in have]
    assert got == {t: (frames(range(t, t + 3)), frames(range(t + 3, t + 5))) for t in have if t < 35}
    got = {r.t: (r.x_closeness, r.x_trend, r.y_data) for r in tensor.periodical_features(steps, 2, 1, 1, 1, 5, 10).collect()}
    assert got == {t: (frames([t - 1, t - 2]), frames([t - 10]), [float(t), t + 0.5]) for t in have if t >= 10}


def shapefile(folder, n, index):
    """Points and squares, every seventh row deleted, in one file."""
    rng, records, places, rows = random.Random(3), [], [], []
    folder.mkdir()
    for i in range(n):
        x, y = rng.random(), rng.random()
        if i % 3:
            body = struct.pack("<idd", 1, x, y)
        else:
            ring = [(x, y), (x, y + 1), (x + 1, y + 1), (x + 1, y), (x, y)]
            body = struct.pack("<i4d3i", 5, x, y, x + 1, y + 1, 1, 5, 0) + b"".join(struct.pack("<dd", *v) for v in ring)
        places.append((50 + sum(map(len, records)) // 2, len(body) // 2))
        records.append(struct.pack(">ii", i + 1, len(body) // 2) + body)
        rows.append((b"*" if i % 7 == 0 else b" ") + f"{i:<6d}".encode())
    (folder / "a.shp").write_bytes(bytes(100) + b"".join(records))
    field = b"ID".ljust(11, b"\0") + b"N" + bytes(4) + bytes([6]) + bytes(15)
    (folder / "a.dbf").write_bytes(struct.pack("<BBBBIHH20x", 3, 1, 1, 1, n, 32 + 32 + 1, 7) + field + b"\x0d" + b"".join(rows))
    if index:
        (folder / "a.shx").write_bytes(bytes(100) + b"".join(struct.pack(">ii", *p) for p in places))
    return qualified_path(folder)


def test_shapefile_by_its_index_has_the_same_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "SHAPE_BYTES", 400)
    whole, parts = (readers.load_geo_data(shapefile(tmp_path / name, 60, name == "parts"), GeoFileType.SHAPE_FILE, spark) for name in ("whole", "parts"))
    key = lambda df: sorted((r.properties["ID"], r.geometry.type, r.geometry.rings) for r in df.collect())
    assert key(whole) == key(parts) and len(key(parts)) == 60 - 9
    tasks = parts.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert tasks > 1
    assert sum(r["count"] for r in readers._runs((tmp_path / "parts/a.shx").read_bytes(), 400)) == 60


def tiled(pixels, side, planar=1, large=False):
    """A deflated TIFF of tiles of unsigned 16-bit samples, of (band, row, column)."""
    bands, height, width = pixels.shape
    blocks = []
    for plane in range(bands if planar == 2 else 1):
        for y in range(0, height, side):
            for x in range(0, width, side):
                tile = np.zeros((side, side, 1 if planar == 2 else bands), "<u2")
                part = pixels[plane : plane + 1] if planar == 2 else pixels
                part = part[:, y : y + side, x : x + side].transpose(1, 2, 0)
                tile[: part.shape[0], : part.shape[1]] = part
                blocks.append(zlib.compress(tile.tobytes()))
    word, start = ("Q", 16) if large else ("I", 8)
    offsets = [start + sum(map(len, blocks[:i])) for i in range(len(blocks))]
    kinds, wide = {3: "H", 4: "I", 16: "Q"}, struct.calcsize("<" + word)
    tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [16] * bands), (259, 3, [8]), (277, 3, [bands]), (284, 3, [planar]), (322, 4, [side]), (323, 4, [side]), (324, 16 if large else 4, offsets), (325, 4, list(map(len, blocks)))]
    raw, at, entries = b"".join(blocks), start + sum(map(len, blocks)), b""
    for tag, kind, values in tags:
        held = struct.pack(f"<{len(values)}{kinds[kind]}", *values)
        if len(held) > wide:
            raw, held, at = raw + held, struct.pack("<" + word, at), at + len(held)
        entries += struct.pack(f"<HH{word}", tag, kind, len(values)) + held.ljust(wide, b"\0")
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if large else struct.pack("<2sHI", b"II", 42, at)
    return head + raw + struct.pack("<Q" if large else "<H", len(tags)) + entries + bytes(8)


@pytest.mark.parametrize(("planar", "large"), [(1, False), (2, False), (1, True)])
def test_windows_of_an_image_are_the_whole_of_it(spark, tmp_path, monkeypatch, planar, large):
    monkeypatch.setattr(readers, "WINDOW_BYTES", 20_000)
    pixels = np.random.default_rng(1).integers(0, 60_000, (3, 150, 130)).astype("<u2")
    content = tiled(pixels, 32, planar, large)
    assert np.array_equal(tiff.read_tiff(content), pixels)
    (tmp_path / "a.tiff").write_bytes(content)
    (tmp_path / "no.tiff").write_bytes(b"no image")
    rows = readers.load_geotiff_windows(qualified_path(tmp_path), spark).withColumn("task", F.spark_partition_id()).collect()
    whole = np.full(pixels.shape, -1.0)
    for r in rows:
        assert (r.nBands, r.imageHeight, r.imageWidth) == pixels.shape and r.origin.endswith("a.tiff")
        whole[r.band, r.y : r.y + r.height, r.x : r.x + r.width] = np.reshape(r.data, (r.height, r.width))
    assert np.array_equal(whole, pixels) and len(rows) == 3 * 25 and len({r.task for r in rows}) > 1
