"""Small helpers around DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameters
from ..functions import geometry as G
from ..scratch import saved


def add_row_id(df: DataFrame, column_name: str, order_by: list[str]) -> DataFrame:
    """``df`` with ids from 0 without gaps, in the order of ``order_by``.

    Rows are sorted by range over the cluster, numbered within their ranges and
    written once; ids and the counts of the ranges, one row each, come from
    those files, so both sides see the same ranges.  Equal keys are ordered,
    and spread over ranges, by a hash of the row.
    """
    names = _unused(df, "_part", "_at", "_tie", "_n", "_before")
    part, at, tie, n, before = names
    hashable = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    order = [*order_by, tie]
    rows = df.withColumn(tie, F.xxhash64(*(F.col(f"`{c}`") for c in hashable))).repartitionByRange(*order).sortWithinPartitions(*order).drop(tie)
    rows = rows.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    rows = saved(rows, "row-ids")
    counts = rows.groupBy(part).agg(F.count("*").alias(n))
    ahead = F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    offsets = counts.select(part, F.coalesce(ahead, F.lit(0)).alias(before))
    return rows.join(F.broadcast(offsets), part).withColumn(column_name, F.col(before) + F.col(at)).drop(part, at, before)


#: Values up to which one task numbers them, and their table may be broadcast.
FEW_VALUES = 100_000


def numbered(values: DataFrame, order_by: str, column_name: str) -> DataFrame:
    """``values``, all different, with their places in ascending order from 0: a
    window while they are at most ``FEW_VALUES`` (then marked for broadcast), else
    ``add_row_id``, which keeps no range of them in one task."""
    if values.count() > FEW_VALUES:
        return add_row_id(values, column_name, [order_by])
    place = F.row_number().over(Window.orderBy(order_by)) - 1
    return F.broadcast(values.withColumn(column_name, place.cast("long")))


def _unused(df: DataFrame, *names: str) -> list[str]:
    """The names, longer where ``df`` has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def sampled(df: DataFrame, keys: list[str], fraction: float, seed: int) -> DataFrame:
    """The rows whose keys' digest falls below ``fraction``: about that share,
    the same ones on every run and by any partitioning; rows of equal keys stay
    or go together.  Null keys count as the word null."""
    if not 0 <= fraction <= 1:
        raise InvalidParameters("a fraction is from 0 to 1")
    named = [F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]
    at = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *named)), 1, 12), 16, 10).cast("long")
    return df.filter(at < int(fraction * 16**12))


def print_schema(df: DataFrame) -> None:
    df.printSchema()


def display_top(df: DataFrame, n: int) -> None:
    df.show(n, truncate=False)


def get_all_rows(df: DataFrame) -> list[Row]:
    return df.collect()


def get_top_rows(df: DataFrame, n: int) -> list[Row]:
    return df.take(n)


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def get_columns(df: DataFrame) -> list[str]:
    return df.columns


def get_column_types(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def df_to_pandas(df: DataFrame, columns: list[str] | None = None):
    return (df.select(*columns) if columns else df).toPandas()


def df_to_list(df: DataFrame, columns: list[str] | None = None) -> list[list]:
    return df_to_pandas(df, columns).values.tolist()


def column_to_pandas(df: DataFrame, column: str):
    return df_to_pandas(df, [column])


def column_to_list(df: DataFrame, column: str) -> list:
    return df_to_pandas(df, [column])[column].tolist()


def df_to_rdd(df: DataFrame):
    """For code that still wants an RDD of rows."""
    return df.rdd


def rdd_to_df(rdd, schema) -> DataFrame:
    from ..session import get_session

    return get_session().createDataFrame(rdd, schema)


def df_to_spatial_rdd(df: DataFrame, geometry: str):
    """An RDD of ``(geometry, the other columns)``."""
    return df.rdd.map(lambda r: (r[geometry], tuple(v for k, v in r.asDict(False).items() if k != geometry)))


def rdd_to_spatial_df(rdd, columns: str = "") -> DataFrame:
    """``geometry`` and the other columns (a DDL text) of such an RDD."""
    schema = f"geometry {G.GEOMETRY}" + (f", {columns}" if columns else "")
    return rdd_to_df(rdd.map(lambda r: (r[0], *r[1])), schema)


def transform_crs(df: DataFrame, geometry: str, source: str, target: str) -> DataFrame:
    """``df`` with the geometry in another reference system."""
    return df.withColumn(geometry, G.transform_crs(F.col(geometry), source, target))


def rows_at(df: DataFrame, id_column: str, ids: list[int]) -> DataFrame:
    """The rows with these ids (see ``add_row_id``); ids beyond the last have none."""
    return df.filter(F.col(id_column).isin(ids))


def get_cells_df(df: DataFrame, col_data: str, col_id: str, col_feature: str, keep: list[str] | None = None) -> DataFrame:
    """The values of a flat array by place, as whole numbers without sign."""
    each = df.select(*(keep or []), F.posexplode(col_data).alias(col_id, "v"))
    return each.select(*(keep or []), col_id, F.abs(F.col("v").cast("int")).alias(col_feature))


def map_layer(polygons: DataFrame, cells: DataFrame, cell_id: str, feature: str, geometry: str = "geometry") -> DataFrame:
    """What a map of a feature draws: every polygon as GeoJSON, with its feature
    (0 if it has none) and the share of the greatest one (of 1 at least)."""
    most = cells.agg(F.greatest(F.lit(1.0), F.max(feature))).scalar()
    rows = polygons.join(cells.select(cell_id, F.col(feature).cast("double").alias("feature")), cell_id, "left").fillna(0.0, ["feature"])
    ring = F.transform(F.col(geometry)["rings"], lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"])))
    shape = F.to_json(F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")))
    return rows.select(cell_id, shape.alias("geojson"), "feature", (F.col("feature") / F.coalesce(most, F.lit(1.0))).alias("height"))


def st_map_layer(polygons: DataFrame, cells: DataFrame, timestep: int, temporal_id: str, cell_id: str, feature: str, geometry: str = "geometry") -> DataFrame:
    """The layer of one time step."""
    return map_layer(polygons, cells.filter(F.col(temporal_id) == timestep), cell_id, feature, geometry)


#: Metres of a degree of latitude, and of one of longitude at the equator.
DEGREE = 111_320.0


def hexagon_layer(df: DataFrame, latitude: str, longitude: str, radius: float = 1000.0, fraction: float = 1.0, seed: int | None = None) -> DataFrame:
    """What a map of hexagons draws: ``q, r, latitude, longitude, points`` of each
    hexagon that has points, and ``mid_latitude, mid_longitude``, the middle of
    the bounds of all rows, where the map looks.

    Hexagons stand on a corner, ``radius`` metres from centre to corner, on a
    plane that touches at that middle; (0, 0) lies on it.  Points are a sample of
    ``fraction`` of the rows; rows without a coordinate are none.
    """
    rows = df.select(F.col(latitude).cast("double").alias("y"), F.col(longitude).cast("double").alias("x")).dropna()
    middle = rows.agg(F.struct(((F.min("y") + F.max("y")) / 2).alias("y"), ((F.min("x") + F.max("x")) / 2).alias("x")).alias("m"))
    own = (rows.sample(fraction, seed) if fraction < 1 else rows).withColumn("m", middle.scalar())
    wide = F.lit(DEGREE) * F.cos(F.radians("m.y"))
    own = own.select("m", ((F.col("x") - F.col("m.x")) * wide / radius).alias("x"), ((F.col("y") - F.col("m.y")) * DEGREE / radius).alias("y"))
    # of the three coordinates, which add up to 0, the one most off gives way
    own = own.withColumns({"q": F.sqrt(F.lit(3.0)) / 3 * F.col("x") - F.col("y") / 3, "r": F.col("y") * 2 / 3})
    own = own.withColumn("s", -F.col("q") - F.col("r")).withColumns({f"n{c}": F.floor(F.col(c) + 0.5) for c in "qr"} | {"ns": F.floor(-F.col("q") - F.col("r") + 0.5)})
    off = {c: F.abs(F.col(f"n{c}") - F.col(c)) for c in "qrs"}
    worst_q = (off["q"] > off["r"]) & (off["q"] > off["s"])
    q = F.when(worst_q, -F.col("nr") - F.col("ns")).otherwise(F.col("nq"))
    r = F.when(~worst_q & (off["r"] > off["s"]), -F.col("nq") - F.col("ns")).otherwise(F.col("nr"))
    counted = own.groupBy(q.alias("q"), r.alias("r")).agg(F.count("*").alias("points"), F.first("m").alias("m"))
    east = F.sqrt(F.lit(3.0)) * (F.col("q") + F.col("r") / 2) * radius
    north = F.col("r") * 1.5 * radius
    return counted.select(
        "q", "r", (F.col("m.y") + north / DEGREE).alias("latitude"), (F.col("m.x") + F.try_divide(east, wide)).alias("longitude"), "points",
        F.col("m.y").alias("mid_latitude"), F.col("m.x").alias("mid_longitude"),
    )
