"""Fields of the atmosphere as frames: from rows of time, place and value to
steps, grid rows and grid columns, for the samples of ``tensor``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .adapter import numbered

#: Variable -> its name in tables of the reanalysis, and the pressure level, in
#: hPa, of those that are given on levels.  Fixed values.
VARIABLES = {
    "temperature": ("t", 850),
    "geopotential": ("z", 500),
    "total_precipitation": ("tp", None),
    "total_cloud_cover": ("tcc", None),
    "toa_incident_solar_radiation": ("tisr", None),
}


def field_frames(df: DataFrame, value: str, time: str = "time", latitude: str = "latitude", longitude: str = "longitude", level: str | None = None, at_level=None) -> DataFrame:
    """``t, h, w, value``, the value as a double: one channel on a grid.

    Steps, rows and columns are the times, latitudes and longitudes there are,
    ascending.  With ``level``, only rows of ``at_level`` count, and the axes are
    theirs.  Rows without a time or a place are left out; a missing value is
    null; of several rows for one cell the greatest value counts.
    """
    rows = df if level is None else df.filter(F.col(level) == F.lit(at_level))
    rows = rows.select(F.col(time).alias("_time"), F.col(latitude).alias("_latitude"), F.col(longitude).alias("_longitude"), F.col(value).cast("double").alias("value"))
    rows = rows.dropna(subset=["_time", "_latitude", "_longitude"])
    frames = rows.groupBy("_time", "_latitude", "_longitude").agg(F.max("value").alias("value"))
    for axis, name in (("_time", "t"), ("_latitude", "h"), ("_longitude", "w")):
        frames = frames.join(numbered(rows.select(axis).distinct(), axis, name), axis)
    return frames.select("t", "h", "w", "value")


def variable_frames(df: DataFrame, variable: str, level: str = "level") -> DataFrame:
    """The frames of one of ``VARIABLES``, in a table with ``time, latitude,
    longitude`` and, for those on levels, ``level``."""
    name, at_level = VARIABLES[variable]
    return field_frames(df, name, level=None if at_level is None else level, at_level=at_level)


def field_shape(frames: DataFrame) -> DataFrame:
    """One row: ``timesteps, height, width``; 0 each of no frames."""
    size = lambda c: F.coalesce(F.max(c) + 1, F.lit(0)).cast("long")
    return frames.agg(size("t").alias("timesteps"), size("h").alias("height"), size("w").alias("width"))
