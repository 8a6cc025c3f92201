"""Scans: tables, geometry files, rasters, arrays, labelled images."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..enums import GeoFileType
from ..errors import InvalidParameters
from ..functions import geometry as G
from ..session import get_session
from . import tiff
from .streams import opened


def load_parquet_data(path: str, spark: SparkSession | None = None) -> DataFrame:
    return get_session(spark).read.parquet(path)


def load_data(path: str, data_format: str, delimiter: str = ",", header: str = "false", spark: SparkSession | None = None) -> DataFrame:
    """Any format that Spark reads; columns of CSV stay texts."""
    return get_session(spark).read.format(data_format).option("delimiter", delimiter).option("header", header).load(path)


def load_geo_data(path: str, file_type: GeoFileType, spark: SparkSession | None = None) -> DataFrame:
    """``geometry`` and the attributes of a file or folder."""
    spark = get_session(spark)
    match GeoFileType(file_type):
        case GeoFileType.WKT_FILE:
            return _tsv(spark, path, G.from_wkt(F.col("_c0")))
        case GeoFileType.WKB_FILE:
            return _tsv(spark, path, from_wkb(F.unhex("_c0")))
        case GeoFileType.JSON_FILE:
            return _geojson(spark, path)
        case GeoFileType.SHAPE_FILE:
            return _shapefile(spark, path)
    raise InvalidParameters(f"no reader for {file_type}")


def _tsv(spark: SparkSession, path: str, geometry: Column) -> DataFrame:
    rows = spark.read.option("delimiter", "\t").csv(path)
    return rows.select(geometry.alias("geometry"), *rows.columns[1:])


_JSON = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def _geojson(spark: SparkSession, path: str) -> DataFrame:
    """One feature a line, read by line; or collections, a file each.  Which of
    both a file is shows in its lines: in the first form each is a feature."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file")).filter(F.length(F.trim("value")) > 0)
    feature = F.get_json_object("value", "$.type") == "Feature"
    by_file = lines.groupBy("file").agg(F.min(F.coalesce(feature, F.lit(False))).alias("by_line"))
    each = lines.filter(feature).select(F.from_json("value", _JSON).alias("f"), "file").join(by_file.filter("by_line"), "file").select("f")
    if not by_file.filter("NOT by_line").isEmpty():
        whole = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file")).join(by_file.filter("NOT by_line"), "file")
        features = F.from_json("value", f"struct<type:string,features:array<{_JSON}>>")["features"]
        each = each.unionByName(whole.select(F.explode(features).alias("f")))
    read = lambda depth: F.from_json("f.geometry.coordinates", "array<" * depth + "double" + ">" * depth)
    at = lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))
    ring = lambda r: F.transform(r, at)
    kind = F.upper("f.geometry.type")
    rings = (
        F.when(kind == "POINT", F.array(F.array(at(read(1)))))
        .when(kind == "LINESTRING", F.array(ring(read(2))))
        .when(kind == "MULTIPOINT", F.transform(read(2), lambda v: F.array(at(v))))
        .when(kind.isin("POLYGON", "MULTILINESTRING"), F.transform(read(3), ring))
        .when(kind == "MULTIPOLYGON", G.multipolygon(F.transform(read(4), lambda p: F.transform(p, ring)))["rings"])
    )
    geometry = F.when(rings.isNotNull(), F.struct(kind.alias("type"), rings.alias("rings")))
    return each.select(geometry.alias("geometry"), F.col("f.properties").alias("properties"))


_WKB_KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON"}


def _twice_area(ring: list[dict]) -> float:
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(ring, ring[1:], strict=False))


def _turned(ring: list[dict], shell: bool) -> list[dict]:
    """Shells counterclockwise, holes clockwise."""
    return ring[::-1] if (_twice_area(ring) < 0) == shell else ring


def _wkb(data: bytes | None) -> dict | None:
    """A geometry of well-known binary, plain (with dimensions by thousands) or
    extended (with flags for Z, M and a reference system); x and y are kept.
    None for empty or cut-off data and for collections."""
    if not data:
        return None
    try:
        return _Wkb(data).geometry()
    except (struct.error, KeyError):
        return None


class _Wkb:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        out = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return out

    def geometry(self) -> dict:
        order = "<" if self.take("B")[0] else ">"
        code = self.take(order + "I")[0]
        wide = bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:
            self.take(order + "I")  # the reference system
        code &= 0x0FFFFFFF
        size = 2 + (wide or {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000])
        kind = _WKB_KINDS[code % 1000]

        def vertices(n: int) -> list[dict]:
            values = self.take(f"{order}{size * n}d")
            return [{"x": values[i], "y": values[i + 1]} for i in range(0, size * n, size)]

        count = lambda: self.take(order + "I")[0]
        if kind == "POINT":
            rings = [vertices(1)]
        elif kind == "LINESTRING":
            rings = [vertices(count())]
        elif kind == "POLYGON":
            rings = [vertices(count()) for _ in range(count())]
        else:
            parts = [self.geometry()["rings"] for _ in range(count())]
            rings = [_turned(r, i == 0) if kind == "MULTIPOLYGON" else r for p in parts for i, r in enumerate(p)]
        return {"type": kind, "rings": rings}


def from_wkb(data: Column) -> Column:
    def parse(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_wkb(v) or {"type": None, "rings": None} for v in values], columns=["type", "rings"])

    got = F.pandas_udf(parse, G.GEOMETRY)(data)
    return F.when(got["type"].isNotNull(), got)


def _shapes(content: bytes) -> list[dict | None]:
    """The geometries of a .shp file: points, lines and polygons."""
    out, at = [], 100
    while at + 8 <= len(content):
        size = struct.unpack_from(">i", content, at + 4)[0] * 2
        record = content[at + 8 : at + 8 + size]
        at += 8 + size
        kind = struct.unpack_from("<i", record)[0]
        if kind in (1, 11, 21):
            x, y = struct.unpack_from("<2d", record, 4)
            out.append({"type": "POINT", "rings": [[{"x": x, "y": y}]]})
        elif kind in (3, 5, 13, 15, 23, 25):
            parts, points = struct.unpack_from("<2i", record, 36)
            starts = [*struct.unpack_from(f"<{parts}i", record, 44), points]
            xy = struct.unpack_from(f"<{2 * points}d", record, 44 + 4 * parts)
            rings = [[{"x": xy[2 * i], "y": xy[2 * i + 1]} for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
            out.append(_polygons(rings) if kind % 10 == 5 else {"type": "LINESTRING" if len(rings) == 1 else "MULTILINESTRING", "rings": rings})
        elif kind in (8, 18, 28):
            n = struct.unpack_from("<i", record, 36)[0]
            xy = struct.unpack_from(f"<{2 * n}d", record, 40)
            out.append({"type": "MULTIPOINT", "rings": [[{"x": xy[2 * i], "y": xy[2 * i + 1]}] for i in range(n)]})
        else:
            out.append(None)
    return out


def _polygons(rings: list[list[dict]]) -> dict:
    """Rings of a shapefile's polygon: clockwise ones are shells, the others
    holes of the shell that they lie in."""
    shells = [[r] for r in rings if _twice_area(r) <= 0] or [[r] for r in rings[:1]]
    for hole in (r for r in rings if _twice_area(r) > 0 and [r] not in shells):
        next((s for s in shells if _inside(hole[0], s[0])), shells[0]).append(hole)
    if len(shells) == 1:
        return {"type": "POLYGON", "rings": shells[0]}
    return {"type": "MULTIPOLYGON", "rings": [_turned(r, i == 0) for s in shells for i, r in enumerate(s)]}


def _inside(v: dict, ring: list[dict]) -> bool:
    odd = False
    for a, b in zip(ring, ring[1:], strict=False):
        if (a["y"] > v["y"]) != (b["y"] > v["y"]) and v["x"] < a["x"] + (v["y"] - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]):
            odd = not odd
    return odd


def _attributes(content: bytes) -> list[dict[str, str] | None]:
    """The rows of a .dbf file as texts; None for those marked as deleted."""
    n, head, size = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("latin-1"), content[at + 16]))
        at += 32
    out = []
    for i in range(n):
        row, place = {}, head + i * size + 1
        for name, width in fields:
            row[name] = content[place : place + width].decode("latin-1").strip()
            place += width
        out.append(None if content[head + i * size : head + i * size + 1] == b"*" else row)
    return out


#: Bytes of a .shp that one task reads, where the file has an index.
SHAPE_BYTES = 8 << 20


def _runs(index: bytes, most: int) -> list[dict[str, int]]:
    """The records of a .shx file in runs of ``most`` bytes, one at least, that
    stand one after another in the .shp."""
    places = np.frombuffer(index[100 : 100 + (len(index) - 100) // 8 * 8], ">i4").reshape(-1, 2).astype(np.int64) * 2
    out: list[dict[str, int]] = []
    for i, (begin, size) in enumerate(places.tolist()):
        end = begin + 8 + size
        last = out[-1] if out else None
        if last and last["end"] == begin and end - last["begin"] <= most:
            last["end"], last["count"] = end, last["count"] + 1
        else:
            out.append({"first": i, "count": 1, "begin": begin, "end": end})
    return out


def _attributes_of(path: str, first: int, count: int) -> list[dict[str, str] | None]:
    """Some rows of a .dbf file: where they are follows from their size."""
    with opened(path) as stream:
        n, head, size = struct.unpack("<IHH", stream.read_at(8, 4))
        count = max(0, min(count, n - first))
        top = stream.read_at(head, 0)
        return _attributes(top[:4] + struct.pack("<I", count) + top[8:] + stream.read_at(count * size, head + first * size))


def _paired(shapes: list[dict | None], attributes: list[dict[str, str] | None] | None) -> list[dict[str, object]]:
    attributes = [{}] * len(shapes) if attributes is None else attributes
    return [{"geometry": g, "properties": a} for g, a in zip(shapes, attributes, strict=False) if a is not None]


def _shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Each .shp with the .dbf beside it; ``geometry`` and ``properties``.

    With a .shx, which says where each record is, tasks read runs of records and
    the rows that belong to them; a file without one is a row and a task.
    """
    kind = f"array<struct<geometry:{G.GEOMETRY},properties:map<string,string>>>"
    stem = F.regexp_replace("path", r"\.[^.]+$", "").alias("stem")
    scan = lambda ext: spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").load(path)
    files = lambda ext: scan(ext).select(stem, F.col("content").alias(ext))
    paths = lambda ext: scan(ext).select(stem, F.col("path").alias(ext))

    def parse(shp: pd.Series, dbf: pd.Series) -> pd.Series:
        return pd.Series([_paired(_shapes(s), _attributes(d) if d else None) for s, d in zip(shp, dbf, strict=True)])

    def part(frame: pd.DataFrame) -> pd.Series:
        out = []
        for shp, dbf, first, count, begin, end in zip(*(frame[c] for c in ("shp", "dbf", "first", "count", "begin", "end")), strict=True):
            with opened(shp) as stream:
                shapes = _shapes(bytes(100) + stream.read_at(int(end - begin), int(begin)))
            out.append(_paired(shapes, _attributes_of(dbf, int(first), int(count)) if dbf else None))
        return pd.Series(out)

    whole = files("shp").join(files("shx").select("stem"), "stem", "left_anti").join(files("dbf"), "stem", "left")
    rows = whole.select(F.pandas_udf(parse, kind)("shp", "dbf").alias("r"))
    most = SHAPE_BYTES
    runs = F.pandas_udf(lambda index: index.map(lambda b: _runs(b, most)), "array<struct<first:long,count:long,begin:long,end:long>>")
    told = files("shx").select("stem", F.explode(runs("shx")).alias("run")).select("stem", "run.*")
    parts = told.join(paths("shp"), "stem").join(paths("dbf"), "stem", "left").repartition(spark.sparkContext.defaultParallelism, "stem", "first")
    read = F.pandas_udf(part, kind)
    rows = rows.unionByName(parts.select(read(F.struct("shp", "dbf", "first", "count", "begin", "end")).alias("r")))
    return rows.select(F.explode("r").alias("r")).select("r.geometry", "r.properties")


# ------------------------------------------------------------------- rasters


def load_geotiff_image_as_binary_data(path: str, spark: SparkSession | None = None, recursive: bool = False) -> DataFrame:
    """``path, modificationTime, length, content`` of each file."""
    return get_session(spark).read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)


def load_geotiff_image_as_array_data(path: str, options: dict[str, str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """``origin, geometry, height, width, data, nBands``.  The geometry is the
    image's rectangle: in its reference system if the file says where it lies,
    else in pixels.  Options: ``dropInvalid`` leaves out what can't be read;
    ``readFromCRS`` and ``readToCRS`` transform the geometry."""
    options = {k.lower(): str(v) for k, v in (options or {}).items()}
    rows = load_geotiff_image_as_binary_data(path, spark).select(F.col("path").alias("origin"), tiff.placed(F.col("content")).alias("r"))
    if options.get("dropinvalid", "").lower() == "true":
        rows = rows.filter("r.width IS NOT NULL")
    shape = G.rectangle(F.col("r.xmin"), F.col("r.ymin"), F.col("r.xmax"), F.col("r.ymax"))
    if options.get("readtocrs"):
        shape = G.transform_crs(shape, options.get("readfromcrs", "EPSG:4326"), options["readtocrs"])
    return rows.select("origin", shape.alias("geometry"), "r.height", "r.width", "r.data", F.col("r.nBands").alias("nBands"))


#: Bytes of pixels, as doubles, of the strips or tiles that a task reads at once.
WINDOW_BYTES = 8 << 20


def load_geotiff_windows(path: str, spark: SparkSession | None = None) -> DataFrame:
    """``origin, nBands, imageHeight, imageWidth, band, y, x, height, width, data``:
    a row for each band of each strip or tile of the images, so that one image
    is read by many tasks and never held whole.  A file that is no such image
    gives no rows."""
    session, most = get_session(spark), WINDOW_BYTES
    files = session.read.format("binaryFile").load(path).select("path")

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p in frame["path"]:
                try:
                    with opened(p) as stream:
                        image = tiff.Tiff(lambda n, at, stream=stream: stream.read_at(n, at))
                except tiff.UNREADABLE:
                    continue
                step = max(1, most // (8 * image.rows * image.columns * image.samples))
                firsts = list(range(0, len(image.offsets), step))
                yield pd.DataFrame({"path": p, "first": firsts, "count": [min(step, len(image.offsets) - f) for f in firsts]})

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, first, count in zip(frame["path"], frame["first"], frame["count"], strict=True):
                with opened(p) as stream:
                    image = tiff.Tiff(lambda n, at, stream=stream: stream.read_at(n, at))
                    for i in range(first, first + count):
                        band, y, x, pixels = image.block(i)
                        rows = [(p, image.bands, image.height, image.width, band + k, y, x, *one.shape, one.astype(float).ravel()) for k, one in enumerate(pixels)]
                        yield pd.DataFrame(rows, columns=["origin", "nBands", "imageHeight", "imageWidth", "band", "y", "x", "height", "width", "data"])

    parts = files.mapInPandas(told, "path string, first long, count long").repartition(session.sparkContext.defaultParallelism, "path", "first")
    return parts.mapInPandas(read, "origin string, nBands int, imageHeight int, imageWidth int, band int, y int, x int, height int, width int, data array<double>")


def load_npy(path: str, spark: SparkSession | None = None) -> DataFrame:
    """``origin, shape, data`` of .npy files, the data flat in C order."""

    def parse(content: pd.Series) -> pd.DataFrame:
        import io

        arrays = [np.load(io.BytesIO(c), allow_pickle=False) for c in content]
        return pd.DataFrame({"shape": [list(a.shape) for a in arrays], "data": [a.astype(np.float64).ravel() for a in arrays]})

    rows = get_session(spark).read.format("binaryFile").load(path)
    return rows.select(F.col("path").alias("origin"), F.pandas_udf(parse, "shape array<long>, data array<double>")("content").alias("a")).select("origin", "a.*")


def load_npz(path: str, names: list[str], spark: SparkSession | None = None) -> DataFrame:
    """``origin, name, shape, data`` of arrays in .npz files."""

    def parse(content: pd.Series) -> pd.Series:
        import io

        out = []
        for c in content:
            with np.load(io.BytesIO(c), allow_pickle=False) as z:
                out.append([{"name": n, "shape": list(z[n].shape), "data": z[n].astype(np.float64).ravel().tolist()} for n in names if n in z])
        return pd.Series(out)

    rows = get_session(spark).read.format("binaryFile").load(path)
    got = F.pandas_udf(parse, "array<struct<name:string,shape:array<long>,data:array<double>>>")("content")
    return rows.select(F.col("path").alias("origin"), F.explode(got).alias("a")).select("origin", "a.*")


def npy_frames(arrays: DataFrame) -> DataFrame:
    """``t, frame`` of arrays whose first axis is time."""
    steps = F.element_at("shape", 1)
    size = (F.size("data") / steps).cast("int")
    each = arrays.select("data", size.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), steps - 1)).alias("t"))
    return each.select("t", F.slice("data", (F.col("t") * F.col("n") + 1).cast("int"), F.col("n")).alias("frame"))


def labelled_by_folder(images: DataFrame, path_col: str = "path") -> DataFrame:
    """``images`` with ``category``, the name of the folder that holds the file."""
    return images.withColumn("category", F.element_at(F.split(path_col, "/"), -2))


def labelled_by_prefix(images: DataFrame, prefix: str | None = None, separator: str = "_", path_col: str = "path") -> DataFrame:
    """``images`` with ``category``: the file name up to the separator; with a
    prefix 1 for names that begin with it and 0 for others."""
    name = F.element_at(F.split(path_col, "/"), -1)
    return images.withColumn("category", F.startswith(name, F.lit(prefix)).cast("int") if prefix else F.split_part(name, F.lit(separator), F.lit(1)))


def bands_from_folders(folders: dict[str, str], mask_folder: str | None = None, mask_value: float = 255, spark: SparkSession | None = None) -> DataFrame:
    """``name, data, nBands, height, width`` of images whose bands are files in
    one folder each (joined on the file name without its first part), and
    ``label`` from a folder of masks."""

    def one(path: str) -> DataFrame:
        rows = load_geotiff_image_as_array_data(path, spark=spark)
        return rows.select(F.regexp_replace(F.element_at(F.split("origin", "/"), -1), "^[^_]+_", "").alias("name"), "height", "width", "data")

    out = None
    for path in folders.values():
        own = one(path)
        out = own if out is None else out.join(own.select("name", F.col("data").alias("_next")), "name").withColumn("data", F.concat("data", "_next")).drop("_next")
    out = out.withColumn("nBands", F.lit(len(folders)))
    if mask_folder:
        mask = one(mask_folder).select("name", F.transform("data", lambda v: F.when(v == mask_value, 1).otherwise(0)).alias("label"))
        out = out.join(mask, "name")
    return out


def load_image_table(csv_path: str, image_path: str, origin: str, label: str, features: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """``origin, data, nBands, height, width``, the label and the features (all
    other columns, as doubles) of images that a CSV file with a header lists; rows
    and files meet by their whole path, and a row without a file is left out."""
    session = get_session(spark)
    rows = session.read.option("header", "true").csv(csv_path)
    features = features if features is not None else [c for c in rows.columns if c not in (origin, label)]
    listed = rows.select(F.col(f"`{origin}`").alias("origin"), F.col(f"`{label}`").alias(label), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in features))
    images = load_geotiff_image_as_array_data(image_path, spark=session).select(_bare(F.col("origin")).alias("_path"), "data", "nBands", "height", "width")
    return listed.withColumn("_path", _bare(F.col("origin"))).join(images, "_path").drop("_path")


def _bare(path: Column) -> Column:
    """A path without the scheme of local files."""
    return F.regexp_replace(path, "^file:/+", "/")


def load_pixel_csv(path: str, height: int, width: int, n_bands: int, spark: SparkSession | None = None) -> DataFrame:
    """``data`` of a CSV file without a header: a line is an image, its pixels row
    by row with all bands of a pixel together; bands come out one after another."""
    from ..operators.datasets import channels_first

    lines = get_session(spark).read.text(path)
    return lines.select(channels_first(F.split("value", ",").cast("array<double>"), height, width, n_bands).alias("data"))


def load_one_hot_csv(path: str, spark: SparkSession | None = None) -> DataFrame:
    """``label`` of a CSV file without a header: the place of each line's greatest value."""
    values = F.split("value", ",").cast("array<double>")
    return get_session(spark).read.text(path).select((F.array_position(values, F.array_max(values)) - 1).alias("label"))
