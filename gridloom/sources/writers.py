"""Sinks for rasters, one file for each row; arrays in shards; geometries."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameters
from ..functions import geometry as G
from ..scratch import qualified, saved
from . import tiff


def write_geotiff_image_with_binary_data(
    df: DataFrame, destination: str, content: str = "content", path: str = "path", extension: str = ".tiff", num_partitions: int = 0, mode: str = "overwrite"
) -> DataFrame:
    """Writes each row's bytes to a file named like the last part of its path,
    and returns ``path, length`` of the files.

    Rows whose last parts are equal get the name with a hash of the whole path,
    so none replaces another.  ``mode``: ``overwrite`` empties the folder first,
    ``append`` adds to it, ``error`` stops if there are files.  Tasks write under
    a name of their own and move it, so repeating one leaves the same files.
    """
    spark = df.sparkSession
    target = qualified(spark, destination)
    _prepared(spark, target, mode)
    rows = df.select(F.col(path).cast("string").alias("origin"), F.col(content).alias("content"))
    stem = F.regexp_replace(F.element_at(F.split("origin", "/"), -1), "[.][^.]*$", "")
    rows = rows.withColumn("stem", stem)
    shared = saved(rows.select("stem", "origin").distinct().groupBy("stem").count().filter("count > 1").select("stem", F.lit(True).alias("shared")), "file-names")
    name = F.when(F.col("shared"), F.concat_ws("-", "stem", F.substring(F.md5("origin"), 1, 12))).otherwise(F.col("stem"))
    rows = rows.join(shared, "stem", "left").select(F.concat(name, F.lit(extension)).alias("name"), "content")
    rows = rows.coalesce(num_partitions) if num_partitions > 0 else rows

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", target))
        for frame in frames:
            out = []
            for name, data in zip(frame["name"], frame["content"], strict=True):
                held = f"{base}/_{uuid.uuid4().hex}"
                with system.open_output_stream(held, compression=None) as stream:
                    stream.write(data)
                system.move(held, f"{base}/{name}")
                out.append((f"{base}/{name}", len(data)))
            yield pd.DataFrame(out, columns=["path", "length"])

    return rows.mapInPandas(write, "path string, length long")


def _prepared(spark, target: str, mode: str) -> None:
    """The folder as ``mode`` wants it."""
    if mode not in ("overwrite", "append", "error"):
        raise InvalidParameters(f"no mode {mode!r}")
    place = spark._jvm.org.apache.hadoop.fs.Path(target)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(place) and len(system.listStatus(place)):
        if mode == "error":
            raise InvalidParameters(f"{target} has files")
        if mode == "overwrite":
            system.delete(place, True)
    system.mkdirs(place)


def write_geotiff_image_with_array_data(
    df: DataFrame, destination: str, origin: str = "origin", width: str = "width", height: str = "height", n_bands: str = "nBands", data: str = "data", extension: str = ".tiff", num_partitions: int = 0,
    geometry: str | None = None, from_crs: str | None = None, to_crs: str | None = None, mode: str = "overwrite",
) -> DataFrame:
    """Encodes each row's array and writes it like the function above; with
    ``geometry`` (transformed, if asked for) the file says where the image lies."""
    r = tiff.raster(F.col(width), F.col(height), F.col(n_bands), F.col(data))
    place = None
    if geometry is not None:
        g = F.col(geometry)
        place = G.envelope(G.transform_crs(g, from_crs, to_crs) if from_crs and to_crs else g)
    rows = df.select(F.col(origin).alias("path"), tiff.encoded(r, place).alias("content"))
    return write_geotiff_image_with_binary_data(rows, destination, "content", "path", extension, num_partitions, mode)


def write_geometries(df: DataFrame, geometry: str, destination: str, mode: str = "overwrite") -> None:
    """Geometries as WKT in the first column of tab-separated files."""
    rest = [c for c in df.columns if c != geometry]
    df.select(G.to_wkt(F.col(geometry)).alias(geometry), *rest).write.mode(mode).option("delimiter", "\t").csv(destination)


def write_npy_shards(dense: DataFrame, keys: dict[str, int], columns: list[str], destination: str, steps: int = 64, mode: str = "overwrite") -> DataFrame:
    """A dense table as .npy files of ``steps`` of the first key each, of shape
    (steps, the other keys' sizes, features); their order is that of their names.

    ``keys`` are the sizes by name.  Each file is made and written by one task,
    so nothing goes through the driver; returns ``path, length`` when run.
    """
    first, *rest = keys
    schema = "path string, content binary"
    sizes, n = list(keys.values()), len(str(keys[first] // steps))

    def shard(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(keys))
        number = int(frame[first].iloc[0]) // steps
        block = frame[columns].to_numpy(float).reshape(-1, *sizes[1:], len(columns))
        held = io.BytesIO()
        np.save(held, block)
        return pd.DataFrame({"path": [f"shard-{number:0{n}d}"], "content": [held.getvalue()]})

    made = dense.select(first, *rest, *columns).groupBy(F.floor(F.col(first) / steps).alias("_shard")).applyInPandas(shard, schema)
    return write_geotiff_image_with_binary_data(made, destination, extension=".npy", mode=mode)
