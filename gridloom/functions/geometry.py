"""Points and polygons as columns.

A geometry is ``struct<type, rings>``: a point has one ring of one vertex, a
line one ring, a polygon its shell and holes, closed (the last vertex is the
first).  MULTIPOINT and MULTILINESTRING have a ring for each part; the rings of
a MULTIPOLYGON are those of its polygons, shells counterclockwise and each
followed by its holes, clockwise.  All functions here are native expressions.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from .projections import Conic

VERTEX = "struct<x:double,y:double>"
GEOMETRY = f"struct<type:string,rings:array<array<{VERTEX}>>>"


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def point(x: Column, y: Column) -> Column:
    """Null if a coordinate is null."""
    made = F.struct(F.lit("POINT").alias("type"), F.array(F.array(vertex(x, y))).alias("rings"))
    return F.when(x.isNotNull() & y.isNotNull(), made)


def rectangle(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    corners = [(xmin, ymin), (xmin, ymax), (xmax, ymax), (xmax, ymin), (xmin, ymin)]
    return F.struct(F.lit("POLYGON").alias("type"), F.array(F.array(*(vertex(x, y) for x, y in corners))).alias("rings"))


def x_of(g: Column) -> Column:
    return g["rings"][0][0]["x"]


def y_of(g: Column) -> Column:
    return g["rings"][0][0]["y"]


def envelope(g: Column) -> Column:
    """``struct<xmin, ymin, xmax, ymax>``; null for a null or empty geometry."""
    xs = F.transform(F.flatten(g["rings"]), lambda v: v["x"])
    ys = F.transform(F.flatten(g["rings"]), lambda v: v["y"])
    names = ("xmin", "ymin", "xmax", "ymax")
    box = lambda *values: F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True)))
    return F.when(g["type"] == "POINT", box(x_of(g), y_of(g), x_of(g), y_of(g))).otherwise(box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def is_rectangle(g: Column) -> Column:
    """Whether a geometry is a rectangle with sides along the axes."""
    r = g["rings"][0]
    same = lambda axis, *pairs: [r[i][axis] == r[j][axis] for i, j in pairs]
    upright = same("x", (0, 1), (2, 3)) + same("y", (1, 2), (3, 0))
    flat = same("y", (0, 1), (2, 3)) + same("x", (1, 2), (3, 0))
    every = lambda tests: tests[0] & tests[1] & tests[2] & tests[3]
    wide = (r[0]["x"] != r[2]["x"]) & (r[0]["y"] != r[2]["y"])
    return F.coalesce(F.when((g["type"] == "POLYGON") & (F.size(g["rings"]) == 1) & (F.size(r) == 5), wide & (every(upright) | every(flat))), F.lit(False))


def edges(ring: Column) -> Column:
    """``struct<a, b>`` of each edge of a ring."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def all_edges(g: Column) -> Column:
    return F.flatten(F.transform(g["rings"], edges))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def length(g: Column) -> Column:
    """Of a line; of a polygon all its rings; 0 of a point."""
    return _sum(F.transform(all_edges(g), lambda e: F.sqrt((e["b"]["x"] - e["a"]["x"]) * (e["b"]["x"] - e["a"]["x"]) + (e["b"]["y"] - e["a"]["y"]) * (e["b"]["y"] - e["a"]["y"]))))


def _cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def _twice_area(r: Column) -> Column:
    """With the sign of the ring's direction: above 0 if counterclockwise."""
    return _sum(F.transform(edges(r), _cross))


def area(g: Column) -> Column:
    """The shells' less the holes'; 0 without rings that enclose anything."""
    by_ring = F.transform(g["rings"], lambda r: F.abs(_twice_area(r)) / 2)
    many = _sum(F.transform(g["rings"], _twice_area)) / 2
    return F.when(g["type"] == "MULTIPOLYGON", many).when(F.size(by_ring) > 0, 2 * by_ring[0] - _sum(by_ring))


def multipolygon(parts: Column) -> Column:
    """From polygons, each an array of its shell and holes, in any direction."""
    turned = lambda r, i: F.when((_twice_area(r) < 0) == (i == 0), F.reverse(r)).otherwise(r)
    return F.struct(F.lit("MULTIPOLYGON").alias("type"), F.flatten(F.transform(parts, lambda p: F.transform(p, turned))).alias("rings"))


def centroid(g: Column) -> Column:
    """A polygon's by area (of its shell); else the mean of the vertices."""
    shell = g["rings"][0]
    own = edges(shell)
    twice = _sum(F.transform(own, _cross))
    cx = F.try_divide(_sum(F.transform(own, lambda e: (e["a"]["x"] + e["b"]["x"]) * _cross(e))), 3 * twice)
    cy = F.try_divide(_sum(F.transform(own, lambda e: (e["a"]["y"] + e["b"]["y"]) * _cross(e))), 3 * twice)
    mx = _sum(F.transform(shell, lambda v: v["x"])) / F.size(shell)
    my = _sum(F.transform(shell, lambda v: v["y"])) / F.size(shell)
    return vertex(F.coalesce(cx, mx), F.coalesce(cy, my))


#: Of a polygon ``{g}`` and a point ``{x}, {y}``, in SQL: whether the point is on
#: the boundary; in the interior; in either.
_EDGES = "flatten(transform({g}.rings, r -> zip_with(slice(r, 1, greatest(size(r) - 1, 0)), slice(r, 2, greatest(size(r) - 1, 0)), (a, b) -> struct(a AS a, b AS b))))"
ON_BOUNDARY = (
    f"exists({_EDGES}, e -> (e.b.x - e.a.x) * ({{y}} - e.a.y) = (e.b.y - e.a.y) * ({{x}} - e.a.x)"
    " AND {x} BETWEEN least(e.a.x, e.b.x) AND greatest(e.a.x, e.b.x) AND {y} BETWEEN least(e.a.y, e.b.y) AND greatest(e.a.y, e.b.y))"
)
_CROSSINGS_ODD = f"size(filter({_EDGES}, e -> (e.a.y > {{y}}) <> (e.b.y > {{y}}) AND {{x}} < e.a.x + try_divide(({{y}} - e.a.y) * (e.b.x - e.a.x), e.b.y - e.a.y))) % 2 = 1"
CONTAINS_POINT = f"({_CROSSINGS_ODD} AND NOT {ON_BOUNDARY})"
COVERS_POINT = f"({_CROSSINGS_ODD} OR {ON_BOUNDARY})"


def contains_point(g: Column, x: Column, y: Column) -> Column:
    """Whether a polygon's interior holds the point; the boundary doesn't count."""
    flat = lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) == (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])
    between = lambda e, v, c: v.between(F.least(e["a"][c], e["b"][c]), F.greatest(e["a"][c], e["b"][c]))
    at = lambda e: e["a"]["x"] + F.try_divide((y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]), e["b"]["y"] - e["a"]["y"])
    odd = F.size(F.filter(all_edges(g), lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < at(e)))) % 2 == 1
    return odd & ~F.exists(all_edges(g), lambda e: flat(e) & between(e, x, "x") & between(e, y, "y"))


def distance(p: Column, q: Column) -> Column:
    """Between two vertices."""
    dx, dy = p["x"] - q["x"], p["y"] - q["y"]
    return F.sqrt(dx * dx + dy * dy)


def from_wkt(text: Column) -> Column:
    """POINT, LINESTRING, POLYGON and their MULTI kinds; null for anything else."""
    clean = F.upper(F.trim(text))
    kind = F.regexp_extract(clean, r"^((?:MULTI)?(?:POINT|LINESTRING|POLYGON))\s*\(", 1)
    body = F.regexp_replace(F.regexp_replace(clean, r"^[A-Z]+\s*\(+\s*", ""), r"\s*\)+$", "")
    numbers = lambda pair: F.split(F.trim(pair), r"\s+")
    to_vertex = lambda pair: F.struct(F.try_element_at(numbers(pair), F.lit(1)).try_cast("double").alias("x"), F.try_element_at(numbers(pair), F.lit(2)).try_cast("double").alias("y"))
    ring = lambda r: F.transform(F.split(r, ","), to_vertex)
    split_rings = lambda b: F.transform(F.split(b, r"\)\s*,\s*\("), ring)
    # the points of a MULTIPOINT stand with or without brackets
    points = F.transform(F.split(F.regexp_replace(body, r"[()]", " "), ","), lambda p: F.array(to_vertex(p)))
    parts = F.transform(F.split(body, r"\)\s*\)\s*,\s*\(\s*\("), split_rings)
    made = (
        F.when(kind == "MULTIPOLYGON", multipolygon(parts))
        .when(kind == "MULTIPOINT", F.struct(kind.alias("type"), points.alias("rings")))
        .when(kind != "", F.struct(kind.alias("type"), split_rings(body).alias("rings")))
    )
    return F.when(~F.exists(F.flatten(made["rings"]), lambda v: v["x"].isNull() | v["y"].isNull()), made)


def to_wkt(g: Column) -> Column:
    vertex_ = lambda v: F.concat(v["x"].cast("string"), F.lit(" "), v["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.concat_ws(", ", F.transform(r, vertex_)), F.lit(")"))
    rings = F.concat_ws(", ", F.transform(g["rings"], ring))
    # a counterclockwise ring begins the next polygon
    polygons = F.aggregate(
        g["rings"], F.lit(""), lambda s, r: F.concat(s, F.when(s == "", "(").when(_twice_area(r) > 0, "), (").otherwise(", "), ring(r)), lambda s: F.concat(s, F.lit(")"))
    )
    body = F.when(g["type"] == "MULTIPOLYGON", polygons).otherwise(rings)
    single = g["type"].isin("POINT", "LINESTRING")
    return F.when(single, F.concat(g["type"], F.lit(" "), rings)).otherwise(F.concat(g["type"], F.lit(" ("), body, F.lit(")")))


#: Radius of the sphere of EPSG:3857, in metres (a fixed value).
WEB_RADIUS = 6378137.0


def to_web_mercator(v: Column) -> Column:
    """EPSG:4326 (x = longitude) to EPSG:3857."""
    y = F.ln(F.tan(F.lit(0.7853981633974483) + F.radians(v["y"]) / 2)) * WEB_RADIUS
    return vertex(F.radians(v["x"]) * WEB_RADIUS, y)


def from_web_mercator(v: Column) -> Column:
    """EPSG:3857 to EPSG:4326."""
    y = 2 * F.atan(F.exp(v["y"] / WEB_RADIUS)) - F.lit(1.5707963267948966)
    return vertex(F.degrees(v["x"] / WEB_RADIUS), F.degrees(y))


def from_new_york_feet(v: Column) -> Column:
    """EPSG:2263 to longitude and latitude."""
    from .projections import CONICS, from_conic

    return from_conic(v, CONICS["epsg:2263"])


TRANSFORMS = {("epsg:4326", "epsg:3857"): to_web_mercator, ("epsg:3857", "epsg:4326"): from_web_mercator}


def transform_crs(g: Column, source: str | Conic, target: str | Conic) -> Column:
    """The geometry in another reference system, by way of longitude and
    latitude: EPSG:4326, 4269, 3857, the zones 326zz, 327zz and 269zz, the conics
    of ``projections.CONICS``, and any ``projections.Conic``.  All are taken for
    the same datum."""
    from ..errors import InvalidParameters
    from .projections import degrees_of, of_degrees

    source, target = (c.lower() if isinstance(c, str) else c for c in (source, target))
    if source == target:
        return g
    there, back = degrees_of(source), of_degrees(target)
    if there is None or back is None:
        raise InvalidParameters(f"no transform from {source} to {target}")
    ring = lambda r: F.transform(F.transform(r, there), back)
    return F.struct(g["type"].alias("type"), F.transform(g["rings"], ring).alias("rings"))
