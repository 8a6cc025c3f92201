"""Regular grids: cells, and aggregates of points by cell and time step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..enums import AggregationType
from ..errors import InvalidParameters
from ..functions import geometry as G
from ..functions.temporal import DEFAULT_FORMAT, unix_seconds
from ..session import get_session


def add_spatial_points(df: DataFrame, lat_column: str, lon_column: str, alias: str = "st_points") -> DataFrame:
    """Points with x = longitude and y = latitude."""
    return df.withColumn(alias, G.point(F.col(lon_column).cast("double"), F.col(lat_column).cast("double")))


def bounds(df: DataFrame, geometry: str) -> Column:
    """``struct<xmin, ymin, xmax, ymax>`` of all rows, as a scalar subquery."""
    e = G.envelope(F.col(geometry))
    return df.agg(F.struct(F.min(e["xmin"]).alias("xmin"), F.min(e["ymin"]).alias("ymin"), F.max(e["xmax"]).alias("xmax"), F.max(e["ymax"]).alias("ymax"))).scalar()


def _cells(spark: SparkSession, b: Column, px: int, py: int) -> DataFrame:
    ids = spark.range(px * py).select(F.col("id").cast("int").alias("cell_id"), b.alias("b"))
    col, row = F.col("cell_id") % px, F.floor(F.col("cell_id") / px)
    ix, iy = (F.col("b.xmax") - F.col("b.xmin")) / px, (F.col("b.ymax") - F.col("b.ymin")) / py
    x, y = F.col("b.xmin"), F.col("b.ymin")
    return ids.select("cell_id", (x + ix * col).alias("xmin"), (y + iy * row).alias("ymin"), (x + ix * (col + 1)).alias("xmax"), (y + iy * (row + 1)).alias("ymax"))


def generate_grid_cells(source: DataFrame | list[list[float]], partitions_x: int, partitions_y: int | None = None, geometry: str = "geometry", spark: SparkSession | None = None) -> DataFrame:
    """``cell_id, geometry`` of the cells of a grid, row by row from the bottom
    left, over the envelope of a DataFrame's geometries or over
    ``[[xmin, ymin], [xmax, ymax]]``."""
    px, py = partitions_x, partitions_y or partitions_x
    if px < 1 or py < 1:
        raise InvalidParameters("a grid has one column and one row at least")
    if isinstance(source, DataFrame):
        cells = _cells(source.sparkSession, bounds(source, geometry), px, py)
    else:
        (xmin, ymin), (xmax, ymax) = source
        names = ("xmin", "ymin", "xmax", "ymax")
        b = F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(names, (xmin, ymin, xmax, ymax), strict=True)))
        cells = _cells(get_session(spark), b, px, py)
    return cells.select("cell_id", G.rectangle(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))).alias("geometry"))


def get_grid_cell_polygons(df: DataFrame, geometry: str, partitions_x: int, partitions_y: int) -> DataFrame:
    """The cells over the envelope of ``df``, by ``cell_id``."""
    return generate_grid_cells(df, partitions_x, partitions_y, geometry).orderBy("cell_id")


def decimals(x: Column) -> Column:
    """Decimal places of a number as it is written, one at least."""
    digits = F.rtrim(F.split(x.cast("decimal(38,18)").cast("string"), "[.]")[1], F.lit("0"))
    return F.greatest(F.lit(1), F.length(digits))


def layout(df: DataFrame, geometry: str, px: int, py: int) -> Column:
    """``struct<x, y, ix, iy>`` of the grid over the points of ``df``: its lower
    left corner and the size of a cell, as a scalar subquery of one row.

    The grid is wider than the points by one unit of the last decimal of its
    lower bound, so the greatest point lies inside.
    """
    x, y = G.x_of(F.col(geometry)), G.y_of(F.col(geometry))
    b = df.agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))
    size = lambda lo, hi, n: (F.col(hi) - F.col(lo) + F.pow(F.lit(10.0), -decimals(F.col(lo)))) / n
    return b.select(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), size("x0", "x1", px).alias("ix"), size("y0", "y1", py).alias("iy"))).scalar()


def cell_of(x: Column, y: Column, at: Column, px: int) -> Column:
    """The cell of a point in a grid of that ``layout``."""
    return (F.floor((y - at["y"]) / at["iy"]) * px + F.floor((x - at["x"]) / at["ix"])).cast("int")


def aggregates(columns: list[str] | None, types: list[AggregationType] | None, aliases: list[str] | None) -> list[Column]:
    """One aggregate for each column: COUNT where no type is given; named
    ``<type>_<column>`` where no alias is."""
    columns = columns or []
    types = types or [AggregationType.COUNT] * len(columns)
    aliases = aliases or [f"{AggregationType(t).value}_{c}" for c, t in zip(columns, types, strict=False)]
    if not len(columns) == len(types) == len(aliases):
        raise InvalidParameters("give a type and an alias for each column")
    call = {AggregationType.COUNT: F.count, AggregationType.SUM: F.sum, AggregationType.AVG: F.avg, AggregationType.MIN: F.min, AggregationType.MAX: F.max}
    return [call[AggregationType(t)](c).alias(a) for c, t, a in zip(columns, types, aliases, strict=True)]


def _gridded(df: DataFrame, geometry: str, px: int, py: int) -> DataFrame:
    g = F.col(geometry)
    rows = df.filter(g.isNotNull()).withColumn("_grid", layout(df, geometry, px, py))
    return rows.withColumn("cell_id", cell_of(G.x_of(g), G.y_of(g), F.col("_grid"), px)).drop("_grid")


def get_st_grid_dataframe(
    df: DataFrame, geometry: str, partitions_x: int, partitions_y: int, col_date: str, step_duration_sec: int = 3600, date_format: str = DEFAULT_FORMAT,
    columns_to_aggregate: list[str] | None = None, column_aggregation_types: list[AggregationType] | None = None, column_alias_list: list[str] | None = None,
) -> DataFrame:
    """Aggregates by ``cell_id`` and ``_id_timestep`` (from the least time);
    without columns the count ``aggregated_feature``.  Rows without a point or a
    time belong to no cell.  One partial and one final aggregation; the bounds
    are scalar subqueries."""
    timed = df.withColumn("_seconds", unix_seconds(df, col_date, date_format))
    start = timed.agg(F.min("_seconds")).scalar()
    rows = _gridded(timed, geometry, partitions_x, partitions_y).filter("_seconds IS NOT NULL")
    rows = rows.withColumn("_id_timestep", F.floor((F.col("_seconds") - start) / step_duration_sec).cast("long"))
    own = aggregates(columns_to_aggregate, column_aggregation_types, column_alias_list) or [F.count("*").alias("aggregated_feature")]
    return rows.groupBy("cell_id", "_id_timestep").agg(*own)


def get_spatial_grid_dataframe(
    df: DataFrame, geometry: str, partitions_x: int, partitions_y: int,
    columns_to_aggregate: list[str] | None = None, column_aggregation_types: list[AggregationType] | None = None, column_alias_list: list[str] | None = None, ordered: bool = True,
) -> DataFrame:
    """Aggregates by ``cell_id``, in its order."""
    own = aggregates(columns_to_aggregate, column_aggregation_types, column_alias_list) or [F.count("*").alias("aggregated_feature")]
    out = _gridded(df, geometry, partitions_x, partitions_y).groupBy("cell_id").agg(*own)
    return out.orderBy("cell_id") if ordered else out
