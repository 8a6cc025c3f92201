"""Adjacency of polygons and of points.

The forms for all pairs give each geometry a weight for every geometry, so their
size is the square of the count whatever the plan; they are for zones and grid
cells.  Where most weights are 0, geometries meet in a tiled join and the zeros
are filled in by id.  ``polygon_neighbours``, ``border_shares`` and
``near_weights`` give only the pairs that matter, from tiled joins, and are what
large inputs should use.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..enums import AdjacencyType, GeoRelationship
from ..errors import InvalidParameters
from ..functions import geometry as G
from ..functions.relate import common_length, distance_between
from .extent import diameter
from .spatial_join import distance_join, related_rows


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """To as many tasks as shuffles have: few rows, of which each gives many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _product(df: DataFrame, geo_id: str, **columns: Column) -> DataFrame:
    """``id, nbr_id`` of all pairs, with ``columns`` of the first (``<name>1``) and
    of the second (``<name>2``), made once a row."""
    side = lambda name, k: df.select(F.col(geo_id).alias(name), *(c.alias(f"{n}{k}") for n, c in columns.items()))
    return _dealt(side("id", 1)).crossJoin(F.broadcast(side("nbr_id", 2)))


def _arrays(pairs: DataFrame, name: str) -> DataFrame:
    """One array for each id, in the order of the neighbours' ids."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("nbr_id", "weight"))), lambda s: s["weight"])
    return pairs.groupBy("id").agg(each.alias(name)).orderBy("id")


def _weight(d: Column, bw: Column) -> Column:
    """exp(-d d / (bw bw)); equal places have weight 1."""
    return F.when(d == 0, 1.0).otherwise(F.exp(F.try_divide(-(d * d), bw * bw)))


def _decay(pairs: DataFrame, d: Column, bandwidth: Column) -> DataFrame:
    far = pairs.withColumns({"d": d, "bw": bandwidth})
    return far.select("id", "nbr_id", _weight(F.col("d"), F.col("bw")).alias("weight"))


def _places_apart(df: DataFrame, geo_id: str, place: Column) -> tuple[DataFrame, Column]:
    """All pairs, and the distance of their places."""
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    return _product(df, geo_id, x=place["x"], y=place["y"]), F.sqrt(dx * dx + dy * dy)


def _apart(df: DataFrame, geo_id: str, geometry: str) -> DataFrame:
    """``id, nbr_id, d``: all pairs with their distance, of points and rectangles
    by their envelopes, of others by their segments; null without a geometry."""
    g = F.col(geometry)
    rows = df.select(F.col(geo_id).alias("id"), g.alias("g"), (F.coalesce(g["type"] == "POINT", F.lit(False)) | G.is_rectangle(g)).alias("plain"))
    plain, other = rows.filter("plain"), rows.filter("NOT plain")
    e = G.envelope(F.col("g"))
    boxes = _product(plain, "id", **{c: e[c] for c in ("xmin", "ymin", "xmax", "ymax")})
    gap = lambda c: F.greatest(F.col(f"{c}min1") - F.col(f"{c}max2"), F.col(f"{c}min2") - F.col(f"{c}max1"), F.lit(0.0))
    x, y = gap("x"), gap("y")
    near = boxes.select("id", "nbr_id", F.sqrt(x * x + y * y).alias("d"))
    second = lambda some: some.select(F.col("id").alias("nbr_id"), F.col("g").alias("h"))
    mixed = [_dealt(a).crossJoin(second(b)).select("id", "nbr_id", distance_between(F.col("g"), F.col("h")).alias("d")) for a, b in ((other, rows), (plain, other))]
    return near.unionAll(mixed[0]).unionAll(mixed[1])


def _bandwidth(given: float | None, df: DataFrame, place: Column) -> Column:
    """The given one, or (for none or 0) the greatest distance of two places."""
    return F.lit(float(given)) if given else diameter(df, place)


def _filled(df: DataFrame, geo_id: str, near: DataFrame, zero: Column) -> DataFrame:
    """``near(id, nbr_id, weight)`` with ``zero`` for all other pairs of ids."""
    ids = df.select(F.col(geo_id).alias("id"))
    every = df.agg(F.sort_array(F.collect_set(geo_id))).scalar()
    of = _dealt(ids, "id").join(_dealt(near, "id").groupBy("id").agg(F.collect_list(F.struct("nbr_id", "weight")).alias("near")), "id", "left")
    some = of.select("id", F.explode("near").alias("n")).select("id", "n.nbr_id", "n.weight")
    others = F.array_except(every, F.coalesce(F.col("near.nbr_id"), F.array().cast(near.select(F.array("nbr_id")).schema[0].dataType)))
    return some.unionAll(of.select("id", F.explode(others).alias("nbr_id")).select("id", "nbr_id", zero.alias("weight")))


def polygon_weights(df: DataFrame, geo_id: str, geometry: str, adjacency_type: AdjacencyType = AdjacencyType.BINARY, bandwidth: float | None = None) -> DataFrame:
    """``id, nbr_id, weight`` for all pairs."""
    kind = AdjacencyType(adjacency_type)
    same = F.col("id") == F.col("nbr_id")
    match kind:
        case AdjacencyType.BINARY:
            near = polygon_neighbours(df, geo_id, geometry).withColumn("weight", F.lit(1).cast("long"))
            return _filled(df, geo_id, near, F.lit(0).cast("long"))
        case AdjacencyType.EXPONENTIAL_CENTROID_DISTANCE:
            return _decay(*_places_apart(df, geo_id, G.centroid(F.col(geometry))), _bandwidth(bandwidth, df, G.centroid(F.col(geometry))))
        case AdjacencyType.EXPONENTIAL_DISTANCE:
            different = df.select(F.lit(0).alias("id"), F.col(geometry).alias("g")).distinct()
            widest = F.lit(float(bandwidth)) if bandwidth else _apart(different, "id", "g").agg(F.max("d")).scalar()
            return _decay(_apart(df, geo_id, geometry), F.col("d"), widest)
        case AdjacencyType.COMMON_BORDER_RATIO:
            return _filled(df, geo_id, border_shares(df, geo_id, geometry), F.when(same, 1.0).otherwise(0.0))


ARRAY_NAMES = {
    AdjacencyType.BINARY: "binary_adjacency",
    AdjacencyType.EXPONENTIAL_CENTROID_DISTANCE: "exponential_centroid_distances",
    AdjacencyType.EXPONENTIAL_DISTANCE: "exponential_distances",
    AdjacencyType.COMMON_BORDER_RATIO: "common_border_ratios",
}


def get_polygons_adjacency(df: DataFrame, geo_id: str, geometry: str, adjacency_type: AdjacencyType = AdjacencyType.BINARY, bandwidth: float | None = None) -> DataFrame:
    """``id`` and its array of weights."""
    kind = AdjacencyType(adjacency_type)
    return _arrays(polygon_weights(df, geo_id, geometry, kind, bandwidth), ARRAY_NAMES[kind])


def point_weights(df: DataFrame, geo_id: str, geometry: str, bandwidth: float | None = None) -> DataFrame:
    """``id, nbr_id, weight`` for all pairs of points, each with itself too."""
    place = F.col(geometry)["rings"][0][0]
    return _decay(*_places_apart(df, geo_id, place), _bandwidth(bandwidth, df, place))


def get_points_adjacency(df: DataFrame, geo_id: str, geometry: str, bandwidth: float | None = None) -> DataFrame:
    return _arrays(point_weights(df, geo_id, geometry, bandwidth), "exponential_distances")


def _meeting(df: DataFrame, geo_id: str, geometry: str, **also: Callable[[Column, Column], Column]) -> DataFrame:
    """``id, g1, nbr_id, g2`` of polygons that share a point, each pair both ways
    and each polygon with itself."""
    a = df.select(F.col(geo_id).alias("id"), F.col(geometry).alias("g1"))
    b = df.select(F.col(geo_id).alias("nbr_id"), F.col(geometry).alias("g2"))
    return related_rows(a, b, "g1", "g2", GeoRelationship.INTERSECTS, **also)


def border_shares(df: DataFrame, geo_id: str, geometry: str) -> DataFrame:
    """``id, nbr_id, weight`` of polygons that share a point: the length of what
    they have in common (of a common area its boundary) over that of the first."""
    met = _meeting(df, geo_id, geometry, share=lambda g, h: F.try_divide(common_length(g, h), G.length(g)))
    return met.select("id", "nbr_id", F.when(F.col("id") == F.col("nbr_id"), 1.0).otherwise(F.col("share")).alias("weight"))


def near_weights(df: DataFrame, geo_id: str, geometry: str, bandwidth: float | None = None, least: float = 0.5) -> DataFrame:
    """``id, nbr_id, weight`` of the pairs of points whose exponential weight is
    at least ``least``: those of ``point_weights``, from a join within the radius
    at which the weight falls to it."""
    if not 0 < least <= 1:
        raise InvalidParameters("the least weight is above 0 and at most 1")
    a = df.select(F.col(geo_id).alias("id"), F.col(geometry).alias("g1"))
    b = df.select(F.col(geo_id).alias("nbr_id"), F.col(geometry).alias("g2"))
    bw = _bandwidth(bandwidth, df, F.col(geometry)["rings"][0][0])
    reach = math.sqrt(-math.log(least)) * (1 + 1e-9)  # beyond rounding; the weight itself decides
    met = distance_join(a, b, "g1", "g2", bw * reach, "d").withColumn("bw", bw)
    return met.select("id", "nbr_id", _weight(F.col("d"), F.col("bw")).alias("weight")).filter(F.col("weight") >= least)


def polygon_neighbours(df: DataFrame, geo_id: str, geometry: str) -> DataFrame:
    """``id, nbr_id`` of polygons that share a point, each pair both ways."""
    return _meeting(df, geo_id, geometry).filter("id <> nbr_id").select("id", "nbr_id")
