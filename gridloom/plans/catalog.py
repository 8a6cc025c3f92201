"""The registered queries over the driver's tables and their DuckDB SQL.

Points are ``events`` (x = value, y = user_id) or ``lineitem``; rasters are
``embeddings`` (4 bands of 4 x 4 pixels); polygons are generated cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..enums import AdjacencyType, AggregationType, GeoFileType, GeoRelationship
from ..functions import bands as B
from ..functions import geometry as G
from ..functions import indices as I
from ..functions import temporal as T
from ..functions import projections, texture
from ..operators import adapter, adjacency, datasets, grid, spatial_join, tensor, traffic, weather
from ..operators.extent import greatest_distance
from ..scratch import shared_folder
from ..sources import netcdf, readers, tiff, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded so that the order of summation doesn't show."""
    c = F.col(c) if isinstance(c, str) else c
    return B.floored(c * 1e6 + 0.5) / 1e6


def exact(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``<column>_dec``: hundredths as decimals, whose sums and means
    don't depend on the order of the rows."""
    return df.withColumns({f"{c}_dec": F.col(c).cast("decimal(14,2)") for c in columns})


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _exact_sum(c: str) -> str:
    return f"(sum(round({c} * 100)::HUGEINT) / 100)::DOUBLE"


def _exact_mean(c: str) -> str:
    """The mean of hundredths to six places, halves up, in whole numbers."""
    return f"((20000 * sum(round({c} * 100)::HUGEINT) + count({c})) // (2 * count({c})) / 1e6)::DOUBLE"


# ----------------------------------------------------------------- temporal

query("date_reformat", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders")(
    lambda s, d: T.convert_date_format(table(s, d, "orders"), "o_orderdate", "dd/MM/yyyy", "day").select("o_orderkey", "day")
)
query("unix_time", "SELECT event_id, floor(epoch(ts))::BIGINT AS unix_ts FROM events")(lambda s, d: T.get_unix_timestamp(table(s, d, "events"), "ts").select("event_id", "unix_ts"))
query("unix_time_text", "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds FROM orders")(
    lambda s, d: T.get_unix_timestamp(table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("day")), "day", "yyyyMMdd", "seconds").select("o_orderkey", "seconds")
)
query("trim_timestamp", "SELECT event_id, value FROM events WHERE value BETWEEN 10.5 AND 50.25")(lambda s, d: T.trim_on_timestamp(table(s, d, "events"), "value", 50.25, 10.5).select("event_id", "value"))
query("trim_datetime", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:01'")(
    lambda s, d: T.trim_on_datetime(table(s, d, "events"), "ts", "2024-01-20 12:00:00", "2024-01-05 00:00:00").select("event_id")
)
query("temporal_steps", "SELECT event_id, (floor(epoch(ts))::BIGINT - min(floor(epoch(ts))::BIGINT) OVER ()) // 21600 AS step FROM events")(
    lambda s, d: T.add_temporal_steps(T.get_unix_timestamp(table(s, d, "events"), "ts", alias="u"), "u", 21600, "step").select("event_id", "step")
)
query("temporal_steps_count", "SELECT (max(floor(epoch(ts))::BIGINT) - min(floor(epoch(ts))::BIGINT)) // 21600 + 1 AS steps FROM events")(
    lambda s, d: T.add_temporal_steps(T.get_unix_timestamp(table(s, d, "events"), "ts", alias="u"), "u", 21600, "step").agg((F.max("step") + 1).alias("steps"))
)

# --------------------------------------------------------------------- grids


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.add_spatial_points(table(spark, sf_dir, "events"), "user_id", "value", "geometry")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.add_spatial_points(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "geometry")


def _grid_sql(source: str, x: str, y: str, px: int, py: int) -> str:
    """CTEs: p (points), b (bounds), c (points with their cell)."""
    return f"""WITH p AS (SELECT *, ({x})::DOUBLE AS x, ({y})::DOUBLE AS y FROM {source}),
b AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM p),
i AS (SELECT *, (x1 - x0 + pow(10.0, -length(split_part(x0::VARCHAR, '.', 2)))) / {px} AS ix,
  (y1 - y0 + pow(10.0, -length(split_part(y0::VARCHAR, '.', 2)))) / {py} AS iy FROM b),
c AS (SELECT p.*, (floor((y - y0) / iy) * {px} + floor((x - x0) / ix))::INTEGER AS cell_id FROM p, i)"""


_EVENTS = _grid_sql("events", "value", "user_id", 8, 8)
_STEPS = ", t AS (SELECT *, floor(epoch(ts))::BIGINT - (SELECT min(floor(epoch(ts))::BIGINT) FROM events) AS s FROM c)"
_ROUND = "floor({} * 1e6 + 0.5) / 1e6"
_ALL = list(AggregationType)
_VALUES, _NAMES = ["value", "value_dec", "value_dec", "value", "value"], ["n", "total", "mean", "low", "high"]

query("st_grid_count", f"{_EVENTS}{_STEPS} SELECT cell_id, s // 21600 AS _id_timestep, count(*) AS aggregated_feature FROM t GROUP BY ALL")(
    lambda s, d: grid.get_st_grid_dataframe(events(s, d), "geometry", 8, 8, "ts", 21600)
)


@query(
    "st_grid_multi_agg",
    f"{_EVENTS}{_STEPS} SELECT cell_id, s // 21600 AS _id_timestep, count(value) AS n, {_exact_sum('value')} AS total, {_exact_mean('value')} AS mean, min(value) AS low, max(value) AS high FROM t GROUP BY cell_id, s // 21600",
)
def st_grid_multi_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = exact(events(spark, sf_dir), "value")
    out = grid.get_st_grid_dataframe(own, "geometry", 8, 8, "ts", 21600, columns_to_aggregate=_VALUES, column_aggregation_types=_ALL, column_alias_list=_NAMES)
    return as_double(out, "total", "mean")


_ITEMS = _grid_sql("lineitem", "l_extendedprice", "l_quantity", 16, 10)
query("spatial_grid_count", f"{_ITEMS} SELECT cell_id, count(*) AS aggregated_feature FROM c GROUP BY ALL")(lambda s, d: grid.get_spatial_grid_dataframe(items(s, d), "geometry", 16, 10))


@query(
    "spatial_grid_multi_agg",
    f"{_ITEMS} SELECT cell_id, count(l_tax) AS n, {_exact_sum('l_discount')} AS total, {_exact_mean('l_tax')} AS mean, min(l_discount) AS low, max(l_tax) AS high FROM c GROUP BY cell_id",
)
def spatial_grid_multi_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    A = AggregationType
    own = exact(items(spark, sf_dir), "l_discount", "l_tax")
    out = grid.get_spatial_grid_dataframe(own, "geometry", 16, 10, ["l_tax", "l_discount_dec", "l_tax_dec", "l_discount", "l_tax"], [A.COUNT, A.SUM, A.AVG, A.MIN, A.MAX], _NAMES)
    return as_double(out, "total", "mean")


def _corners(cells: DataFrame) -> DataFrame:
    e = G.envelope(F.col("geometry"))
    return cells.select("cell_id", e["xmin"].alias("xmin"), e["ymin"].alias("ymin"), e["xmax"].alias("xmax"), e["ymax"].alias("ymax"))


def _cells_sql(box: str, px: int, py: int) -> str:
    """Cells of a box; ``box`` is a relation with x0, y0, x1, y1."""
    return f"""SELECT k::INTEGER AS cell_id, x0 + (x1 - x0) / {px} * (k % {px}) AS xmin, y0 + (y1 - y0) / {py} * (k // {px}) AS ymin,
  x0 + (x1 - x0) / {px} * (k % {px} + 1) AS xmax, y0 + (y1 - y0) / {py} * (k // {px} + 1) AS ymax FROM range({px * py}) r(k), {box}"""


_EVENT_BOX = "(SELECT min(value)::DOUBLE AS x0, min(user_id)::DOUBLE AS y0, max(value)::DOUBLE AS x1, max(user_id)::DOUBLE AS y1 FROM events)"
query("grid_cells_df", _cells_sql(_EVENT_BOX, 8, 6))(lambda s, d: _corners(grid.generate_grid_cells(events(s, d), 8, 6)))


def _boundary(df: DataFrame, x: str, y: str) -> list[list[float]]:
    """The corners of all rows' box: one row."""
    return [list(r) for r in df.agg(F.struct(F.min(x), F.min(y)), F.struct(F.max(x), F.max(y))).first()]


_ORDER_BOX = "(SELECT min(l_quantity)::DOUBLE AS x0, min(l_extendedprice)::DOUBLE AS y0, max(l_quantity)::DOUBLE AS x1, max(l_extendedprice)::DOUBLE AS y1 FROM lineitem)"
query("grid_cells_boundary", _cells_sql(_ORDER_BOX, 7, 3))(
    lambda s, d: _corners(grid.generate_grid_cells(_boundary(table(s, d, "lineitem"), "l_quantity", "l_extendedprice"), 7, 3, spark=s))
)
query("grid_cells_square", _cells_sql(_ORDER_BOX.replace("l_extendedprice", "l_discount"), 9, 9))(
    lambda s, d: _corners(grid.generate_grid_cells(_boundary(table(s, d, "lineitem"), "l_quantity", "l_discount"), 9, spark=s))
)
query("spatial_points", "SELECT event_id, value AS x, user_id::DOUBLE AS y FROM events")(lambda s, d: events(s, d).select("event_id", G.x_of(F.col("geometry")).alias("x"), G.y_of(F.col("geometry")).alias("y")))

# --------------------------------------------------------------- spatial joins

_INSIDE = "x > xmin AND x < xmax AND y > ymin AND y < ymax"
_EVENT_CELLS = f"p AS (SELECT *, value AS x, user_id::DOUBLE AS y, floor(epoch(ts))::BIGINT // 86400 AS day FROM events), g AS ({_cells_sql(_EVENT_BOX, 8, 8)})"


def _event_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = exact(events(spark, sf_dir), "value")
    cells = grid.generate_grid_cells(own, 8).withColumnRenamed("geometry", "cell")
    return cells, own.withColumn("day", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).cast("long"))


query("st_join_count", f"WITH {_EVENT_CELLS} SELECT day, cell_id, count(value) AS n FROM p JOIN g ON {_INSIDE} GROUP BY ALL")(
    lambda s, d: spatial_join.aggregate_st_dfs(*_event_cells(s, d), "cell", "geometry", "cell_id", "day", GeoRelationship.CONTAINS, ["value"], [AggregationType.COUNT], ["n"])
)


@query(
    "st_join_agg_all",
    f"WITH {_EVENT_CELLS} SELECT day, cell_id, count(value) AS n, {_exact_sum('value')} AS total, {_exact_mean('value')} AS mean, min(value) AS low, max(value) AS high FROM p JOIN g ON {_INSIDE} GROUP BY day, cell_id",
)
def st_join_agg_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial_join.aggregate_st_dfs(*_event_cells(spark, sf_dir), "cell", "geometry", "cell_id", "day", GeoRelationship.CONTAINS, _VALUES, _ALL, _NAMES)
    return as_double(out, "total", "mean")


query("spatial_join_agg", f"WITH {_EVENT_CELLS} SELECT cell_id, {_exact_mean('value')} AS mean FROM p JOIN g ON {_INSIDE} GROUP BY cell_id")(
    lambda s, d: spatial_join.aggregate_spatial_dfs(*_event_cells(s, d), "cell", "geometry", "cell_id", GeoRelationship.CONTAINS, ["value_dec"], [AggregationType.AVG], ["mean"]).withColumn("mean", F.col("mean").cast("double"))
)
query("points_in_grid", f"WITH p AS (SELECT event_id, value AS x, user_id::DOUBLE AS y FROM events), g AS ({_cells_sql(_EVENT_BOX, 10, 16)}) SELECT event_id, cell_id FROM p JOIN g ON {_INSIDE}")(
    lambda s, d: spatial_join.points_in_grid(events(s, d), "geometry", None, 10, 16).select("event_id", "cell_id")
)

# a box around each event, of a size that goes by its id, against the grid over all events
_TWO = f"""WITH a AS ({_cells_sql(_EVENT_BOX, 8, 8)}), b AS (SELECT event_id, value - r AS xmin, user_id - r AS ymin, value + r AS xmax, user_id + r AS ymax
  FROM (SELECT *, (event_id % 40)::DOUBLE / 4 AS r FROM events) WHERE r > 0) SELECT a.cell_id AS id1, b.event_id AS id2 FROM a, b WHERE """
_CLOSED = "a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax"
_OPEN = "a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax"


def _relation(kind: GeoRelationship) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = grid.generate_grid_cells(events(spark, sf_dir), 8).toDF("id1", "g1")
        r = (F.col("event_id") % 40).cast("double") / 4
        x, y = F.col("value"), F.col("user_id").cast("double")
        b = table(spark, sf_dir, "events").filter(r > 0).select(F.col("event_id").alias("id2"), G.rectangle(x - r, y - r, x + r, y + r).alias("g2"))
        if kind is GeoRelationship.WITHIN:
            return spatial_join.spatial_join(b, a, "g2", "g1", kind).select("id1", "id2")
        return spatial_join.spatial_join(a, b, "g1", "g2", kind).select("id1", "id2")

    return run


_HOLDS = "a.xmin <= b.xmin AND b.xmax <= a.xmax AND a.ymin <= b.ymin AND b.ymax <= a.ymax"
for _kind, _where in ((GeoRelationship.CONTAINS, _HOLDS), (GeoRelationship.WITHIN, _HOLDS), (GeoRelationship.INTERSECTS, _CLOSED), (GeoRelationship.TOUCHES, f"{_CLOSED} AND NOT ({_OPEN})")):
    query(f"rel_{_kind.value}", _TWO + _where)(_relation(_kind))


def _diamonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diamond around each supplier, of a size that goes by its nation."""
    r = (F.col("s_nationkey") % 5 + 1) * 16.0
    x, y = F.floor(F.col("s_acctbal") / 16).cast("double"), F.col("s_nationkey") * 16.0
    corners = [(x - r, y), (x, y + r), (x + r, y), (x, y - r), (x - r, y)]
    ring = F.array(*(G.vertex(px, py) for px, py in corners))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.struct(F.lit("POLYGON").alias("type"), F.array(ring).alias("rings")).alias("diamond"))


_DIAMONDS = "d AS (SELECT s_suppkey, floor(s_acctbal / 16)::DOUBLE AS cx, s_nationkey * 16.0::DOUBLE AS cy, (s_nationkey % 5 + 1) * 16.0::DOUBLE AS r FROM supplier)"
for _name, _kind, _test in (("contains", GeoRelationship.CONTAINS, "<"), ("intersects", GeoRelationship.INTERSECTS, "<="), ("touches", GeoRelationship.TOUCHES, "=")):
    query(
        f"general_{_name}_points",
        f"WITH {_DIAMONDS}, p AS (SELECT c_custkey, floor(c_acctbal / 16)::DOUBLE AS x, c_nationkey * 16.0::DOUBLE AS y FROM customer) SELECT s_suppkey, c_custkey FROM d, p WHERE abs(x - cx) + abs(y - cy) {_test} r",
    )(
        lambda s, d, kind=_kind: spatial_join.spatial_join(
            _diamonds(s, d), table(s, d, "customer").select("c_custkey", G.point(F.floor(F.col("c_acctbal") / 16).cast("double"), F.col("c_nationkey") * 16.0).alias("p")), "diamond", "p", kind
        ).select("s_suppkey", "c_custkey")
    )
query("general_intersects", f"WITH {_DIAMONDS} SELECT a.s_suppkey AS id, b.s_suppkey AS nbr_id FROM d a, d b WHERE a.s_suppkey <> b.s_suppkey AND abs(a.cx - b.cx) + abs(a.cy - b.cy) <= a.r + b.r")(
    lambda s, d: adjacency.polygon_neighbours(_diamonds(s, d), "s_suppkey", "diamond")
)

# polygons with notches, holes and parts, made of cells and slanted by a linear
# map, so that no rectangle is left; SQL compares their cells
_CELLS = {
    0: [(0, 0), (1, 0), (2, 0), (0, 1), (2, 1), (0, 2), (2, 2)],
    1: [(0, 0), (1, 0), (2, 0), (0, 1), (2, 1), (0, 2), (1, 2), (2, 2)],
    2: [(0, 0), (1, 0), (0, 1)],
    3: [(0, 0)],
    4: [(0, 0), (2, 2)],
}
_RINGS = {
    0: [[[(0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3)]]],
    1: [[[(0, 0), (3, 0), (3, 3), (0, 3)], [(1, 1), (2, 1), (2, 2), (1, 2)]]],
    2: [[[(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]]],
    3: [[[(0, 0), (1, 0), (1, 1), (0, 1)]]],
    4: [[[(0, 0), (1, 0), (1, 1), (0, 1)]], [[(2, 2), (3, 2), (3, 3), (2, 3)]]],
}


def _shaped(kind: Column, x: Column, y: Column, size: Column) -> Column:
    def corner(i: int, j: int) -> Column:
        cx, cy = x + i * size, y + j * size
        return G.vertex(2 * cx + cy, cy - cx)

    def polygon(parts: list[list[list[tuple[int, int]]]]) -> Column:
        rings = F.array(*(F.array(*(F.array(*(corner(*c) for c in [*r, r[0]])) for r in p)) for p in parts))
        return G.multipolygon(rings) if len(parts) > 1 else F.struct(F.lit("POLYGON").alias("type"), rings[0].alias("rings"))

    return F.coalesce(*(F.when(kind == k, polygon(parts)) for k, parts in _RINGS.items()))


def _shapes_of(spark: SparkSession, sf_dir: str, name: str, key: str, prefix: str, largest: int) -> DataFrame:
    k, n = F.col(key), F.col(f"{prefix}_nationkey")
    x, y = F.floor(F.col(f"{prefix}_acctbal") / 16).cast("double"), n * 4.0 + k % 4
    return table(spark, sf_dir, name).select(key, _shaped(k % 5, x, y, (k % largest + 1).cast("double")).alias(f"{prefix}_shape"))


def _cells_of(name: str, key: str, prefix: str, largest: int) -> str:
    listed = ", ".join(f"({k}, {i}, {j})" for k, cells in _CELLS.items() for i, j in cells)
    return f"""(SELECT {key} AS id, x + i * n + u AS x, y + j * n + v AS y FROM (SELECT {key}, {key} % 5 AS kind, floor({prefix}_acctbal / 16)::BIGINT AS x,
  {prefix}_nationkey * 4 + {key} % 4 AS y, {key} % {largest} + 1 AS n FROM {name}) JOIN (VALUES {listed}) c(kind, i, j) USING (kind), range({largest}) a(u), range({largest}) b(v) WHERE u < n AND v < n)"""


_SHAPE_CTES = f"""WITH a AS {_cells_of("supplier", "s_suppkey", "s", 7)}, b AS {_cells_of("customer", "c_custkey", "c", 3)},
na AS (SELECT id, count(*) AS n FROM a GROUP BY id), nb AS (SELECT id, count(*) AS n FROM b GROUP BY id),
common AS (SELECT a.id AS s_suppkey, b.id AS c_custkey, count(*) AS n FROM a JOIN b USING (x, y) GROUP BY ALL),
pa AS (SELECT DISTINCT id, x + dx AS x, y + dy AS y FROM a, range(2) p(dx), range(2) q(dy)), pb AS (SELECT DISTINCT id, x + dx AS x, y + dy AS y FROM b, range(2) p(dx), range(2) q(dy)),
met AS (SELECT DISTINCT pa.id AS s_suppkey, pb.id AS c_custkey FROM pa JOIN pb USING (x, y))
SELECT s_suppkey, c_custkey FROM """
_SHAPE_SQL = {
    GeoRelationship.CONTAINS: "common JOIN nb ON nb.id = c_custkey AND nb.n = common.n",
    GeoRelationship.WITHIN: "common JOIN na ON na.id = s_suppkey AND na.n = common.n",
    GeoRelationship.INTERSECTS: "met",
    GeoRelationship.TOUCHES: "met ANTI JOIN common USING (s_suppkey, c_custkey)",
}
for _kind, _rest in _SHAPE_SQL.items():
    query(f"shapes_{_kind.value}", _SHAPE_CTES + _rest)(
        lambda s, d, kind=_kind: spatial_join.spatial_join(
            _shapes_of(s, d, "supplier", "s_suppkey", "s", 7), _shapes_of(s, d, "customer", "c_custkey", "c", 3), "s_shape", "c_shape", kind
        ).select("s_suppkey", "c_custkey")
    )

# ------------------------------------------------------------------- adjacency



def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box around each supplier, wider or higher by its nation."""
    w, h = (F.col("s_nationkey") % 7 + 1) * 4.0, (F.col("s_nationkey") % 3 + 1) * 8.0
    x, y = F.floor(F.col("s_acctbal") / 16).cast("double"), F.col("s_nationkey") * 4.0
    return table(spark, sf_dir, "supplier").select("s_suppkey", G.rectangle(x, y, x + w, y + h).alias("box"))


_ADJ = """WITH a AS (SELECT s_suppkey, x AS xmin, y AS ymin, x + w AS xmax, y + h AS ymax, w, h FROM (SELECT s_suppkey, floor(s_acctbal / 16)::DOUBLE AS x,
  s_nationkey * 4.0::DOUBLE AS y, (s_nationkey % 7 + 1) * 4.0::DOUBLE AS w, (s_nationkey % 3 + 1) * 8.0::DOUBLE AS h FROM supplier)), b AS (SELECT * FROM a)
SELECT a.s_suppkey AS id, b.s_suppkey AS nbr_id, """
_CD = "sqrt(pow((a.xmin + a.xmax - b.xmin - b.xmax) / 2, 2) + pow((a.ymin + a.ymax - b.ymin - b.ymax) / 2, 2))"
_RD = "sqrt(pow(greatest(0, a.xmin - b.xmax, b.xmin - a.xmax), 2) + pow(greatest(0, a.ymin - b.ymax, b.ymin - a.ymax), 2))"
_IX, _IY = "(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin))", "(least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))"
_COMMON = f"(CASE WHEN {_IX} < 0 OR {_IY} < 0 THEN 0 WHEN {_IX} > 0 AND {_IY} > 0 THEN 2 * ({_IX} + {_IY}) ELSE {_IX} + {_IY} END)"
_SHARE = f"CASE WHEN a.s_suppkey = b.s_suppkey THEN 1.0::DOUBLE ELSE floor({_COMMON} / (2 * (a.w + a.h)) * 1e6 + 0.5) / 1e6 END AS weight"


def _adjacent(kind: AdjacencyType) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = adjacency.polygon_weights(_boxes(spark, sf_dir), "s_suppkey", "box", kind)
        return out if kind is AdjacencyType.BINARY else out.withColumn("weight", r6("weight"))

    return run


_DECAY = "FROM (SELECT id, nbr_id, floor(exp(-d * d / (max(d) OVER () * max(d) OVER ())) * 1e6 + 0.5) / 1e6 AS weight"
query("adj_binary", f"{_ADJ} (a.s_suppkey <> b.s_suppkey AND {_CLOSED})::BIGINT AS weight FROM a, b")(_adjacent(AdjacencyType.BINARY))
query("adj_exp_centroid", f"SELECT * {_DECAY} FROM ({_ADJ} {_CD} AS d FROM a, b))")(_adjacent(AdjacencyType.EXPONENTIAL_CENTROID_DISTANCE))
query("adj_exp_dist", f"SELECT * {_DECAY} FROM ({_ADJ} {_RD} AS d FROM a, b))")(_adjacent(AdjacencyType.EXPONENTIAL_DISTANCE))
query("adj_border_ratio", f"{_ADJ} {_SHARE} FROM a, b")(_adjacent(AdjacencyType.COMMON_BORDER_RATIO))
query("adj_border_shares", f"{_ADJ} {_SHARE} FROM a, b WHERE {_CLOSED}")(lambda s, d: adjacency.border_shares(_boxes(s, d), "s_suppkey", "box").withColumn("weight", r6("weight")))
query("adj_neighbours", f"{_ADJ[:-2]} FROM a, b WHERE a.s_suppkey <> b.s_suppkey AND {_CLOSED}")(lambda s, d: adjacency.polygon_neighbours(_boxes(s, d), "s_suppkey", "box"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.add_spatial_points(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal", "geometry").select("c_custkey", "geometry")


_PAIRS_D = "SELECT a.c_custkey AS id, b.c_custkey AS nbr_id, sqrt(pow(a.c_acctbal - b.c_acctbal, 2) + pow(a.c_nationkey - b.c_nationkey, 2)) AS d FROM customer a, customer b"
query("adj_near_points", f"SELECT id, nbr_id, floor(w * 1e6 + 0.5) / 1e6 AS weight FROM (SELECT id, nbr_id, exp(-d * d / (bw * bw)) AS w FROM (SELECT *, max(d) OVER () AS bw FROM ({_PAIRS_D}))) WHERE w >= 0.999999")(
    lambda s, d: adjacency.near_weights(_customers(s, d), "c_custkey", "geometry", least=0.999999).withColumn("weight", r6("weight"))
)
query("farthest_points", f"SELECT floor(max(d) * 1e6 + 0.5) / 1e6 AS d FROM ({_PAIRS_D})")(
    lambda s, d: greatest_distance(_customers(s, d), F.col("geometry")["rings"][0][0]).select(r6("d").alias("d"))
)
query(
    "distance_pairs",
    f"""{_ADJ[: _ADJ.index("SELECT a.s_suppkey")]}, d AS (SELECT s_suppkey, c_custkey, sqrt(pow(greatest(0, xmin - x, x - xmax), 2) + pow(greatest(0, ymin - y, y - ymax), 2)) AS d
  FROM a, (SELECT c_custkey, floor(c_acctbal / 16)::DOUBLE AS x, c_nationkey * 4.0::DOUBLE AS y FROM customer))
SELECT s_suppkey, c_custkey, floor(d * 1e6 + 0.5) / 1e6 AS d FROM d WHERE d <= 5""",
)(
    lambda s, d: spatial_join.distance_join(
        _boxes(s, d), table(s, d, "customer").select("c_custkey", G.point(F.floor(F.col("c_acctbal") / 16).cast("double"), F.col("c_nationkey") * 4.0).alias("p")), "box", "p", 5.0, "d"
    ).select("s_suppkey", "c_custkey", r6("d").alias("d"))
)
query(
    "adj_points",
    "SELECT id, nbr_id, floor(exp(-d * d / (bw * bw)) * 1e6 + 0.5) / 1e6 AS weight FROM (SELECT *, max(d) OVER () AS bw FROM (SELECT a.s_suppkey AS id, b.s_suppkey AS nbr_id, sqrt(pow(a.s_acctbal - b.s_acctbal, 2) + pow(a.s_nationkey - b.s_nationkey, 2)) AS d FROM supplier a, supplier b))",
)(lambda s, d: adjacency.point_weights(grid.add_spatial_points(table(s, d, "supplier"), "s_nationkey", "s_acctbal", "geometry"), "s_suppkey", "geometry").withColumn("weight", r6("weight")))

# --------------------------------------------------------------- raster bands

_R = "WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS d FROM embeddings), q AS (SELECT vec_id, list_transform(d, lambda x: floor(x * 200)) AS d FROM r) "


def rasters(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """``vec_id, data, nBands``; ``whole``: as small whole numbers."""
    value = (lambda x: F.floor(x.cast("double") * 200).cast("double")) if whole else (lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", value).alias("data"), F.lit(4).alias("nBands"), "label")


def _long(df: DataFrame, value: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(value).alias("pos", "value"))


def _long_sql(expression: str, source: str = "r") -> str:
    return f"{_R} SELECT vec_id, unnest(range(len(v)))::INTEGER AS pos, unnest(v) AS value FROM (SELECT vec_id, {expression} AS v FROM {source})"


def _b(i: int) -> str:
    return f"d[{16 * i + 1}:{16 * i + 16}]"


def _zip(f: str, i: int = 0, j: int = 1) -> str:
    """``f`` of x (band i) and y (band j), pixel by pixel."""
    return f"list_transform(range(1, 17), lambda k: {f.replace('x', f'd[{16 * i} + k]').replace('y', f'd[{16 * j} + k]')})"


def _bands(name: str, sql: str, op: Callable[..., DataFrame], *args, whole: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _long(op(rasters(spark, sf_dir, whole), *args, name="v"), "v")

    query(name, _long_sql(sql, "q" if whole else "r"))(run)


_R2 = "floor(({}) * 100 + 0.5) / 100"
_bands("band_get", _b(2), B.get_band_from_array_data, 2)
_bands("band_normalize", f"list_transform({_b(1)}, lambda v: floor(v / nullif(list_max({_b(1)}) / 255, 0)))", B.get_normalized_band, 1)
_bands("band_ndi", _zip(_R2.format("(y - x) / nullif(y + x, 0)")), B.get_normalized_difference_index, 0, 1)
_bands("band_mode", f"list_sort(list_filter(list_distinct({_b(0)}), lambda v: len(list_filter({_b(0)}, lambda w: w = v)) = list_max(list_transform(list_distinct({_b(0)}), lambda u: len(list_filter({_b(0)}, lambda w: w = u))))))", B.get_band_mode, 0, whole=True)
for _name, _op, _run in (("gt", ">", B.mask_band_on_greater_than), ("ge", ">=", B.mask_band_on_greater_than_equal), ("lt", "<", B.mask_band_on_less_than), ("le", "<=", B.mask_band_on_less_than_equal)):
    _bands(f"band_mask_{_name}", f"list_transform({_b(3)}, lambda v: (v {_op} 4)::INTEGER::DOUBLE)", _run, 3, 4.0, whole=True)
_bands("band_add", _zip("x + y"), B.add_bands, 0, 1)
_bands("band_sub", _zip("x - y"), B.subtract_bands, 0, 1)
_bands("band_mul", _zip("x * y"), B.multiply_bands, 0, 1)
_bands("band_div", _zip(_R2.format("x / nullif(y, 0)")), B.divide_bands, 0, 1)
_bands("band_factor", f"list_transform({_b(1)}, lambda v: v * 2.5::DOUBLE)", B.multiply_band_by_factor, 1, 2.5)
_bands("band_and", _zip("(x::INTEGER & y::INTEGER)::DOUBLE"), B.bitwise_and_of_bands, 0, 1, whole=True)
_bands("band_or", _zip("(x::INTEGER | y::INTEGER)::DOUBLE"), B.bitwise_or_of_bands, 0, 1, whole=True)
_bands("band_mod", f"list_transform({_b(1)}, lambda v: v % 7.0::DOUBLE)", B.get_modulas, 1, 7, whole=True)
_bands("band_sqrt", f"list_transform(list_transform({_b(1)}, lambda v: abs(v)), lambda v: {_R2.format('sqrt(v)')})", lambda df, i, name: B.get_square_root(df.withColumn("data", F.transform("data", lambda v: F.abs(v))), i, name=name), 1)
_bands("band_logical_diff", _zip("CASE WHEN x <> y THEN x ELSE 0.0::DOUBLE END"), B.logical_difference_of_bands, 0, 1, whole=True)
_bands("band_logical_over", _zip("CASE WHEN x <> 0 THEN x ELSE y END"), B.logical_over_of_bands, 0, 1, whole=True)
query("band_count", f"{_R} SELECT vec_id, len(list_filter({_b(0)}, lambda v: v = 3))::INTEGER AS n FROM q")(lambda s, d: B.get_occurrence_count(rasters(s, d, True), 0, 3, name="n").select("vec_id", "n"))
query("band_mean", f"{_R} SELECT vec_id, {_R2.format(f'list_sum({_b(1)}) / 16')} AS mean FROM q")(lambda s, d: B.get_band_mean(rasters(s, d, True), 1, name="mean").select("vec_id", "mean"))
query("band_append_ndi", _long_sql(f"list_concat(d, {_zip(_R2.format('(y - x) / nullif(y + x, 0)'))})"))(lambda s, d: _long(B.append_normalized_difference_index(rasters(s, d), 0, 1), "data"))


@query(
    "array_zscore",
    f"""{_R}, e AS (SELECT vec_id, unnest(range(64))::INTEGER AS pos, unnest(d) AS v FROM q),
m AS (SELECT vec_id, pos // 16 AS band, avg(v) AS mean, stddev_pop(v) AS std FROM e GROUP BY ALL)
SELECT e.vec_id, pos, floor((v - mean) / nullif(std, 0) * 1e6 + 0.5) / 1e6 AS value FROM e JOIN m ON e.vec_id = m.vec_id AND pos // 16 = band""",
)
def array_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(B.get_normalized_array_data(rasters(spark, sf_dir, True), name="v"), "v").withColumn("value", r6("value"))


# ---------------------------------------------------------- rasters as files


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = F.lit(4)
    return rasters(spark, sf_dir).select("vec_id", tiff.raster(four, four, four, F.col("data")).alias("r"))


query("raster_decode", _long_sql("d"))(lambda s, d: _long(_images(s, d).select("vec_id", tiff.decoded(tiff.encoded(F.col("r")))["data"].alias("v")), "v"))
query("raster_encode", "SELECT vec_id, 706::INTEGER AS bytes FROM embeddings")(lambda s, d: _images(s, d).select("vec_id", F.length(tiff.encoded(F.col("r"))).alias("bytes")))
query("raster_num_bands", "SELECT vec_id, 4::INTEGER AS n_bands FROM embeddings")(lambda s, d: _images(s, d).select("vec_id", tiff.decoded(tiff.encoded(F.col("r")))["nBands"].alias("n_bands")))
query("raster_band", _long_sql(_b(2)))(lambda s, d: _long(_images(s, d).select("vec_id", tiff.band_of(F.col("r"), 2).alias("v")), "v"))
query("raster_add_band", _long_sql(f"list_concat({_b(0)}, {_b(3)}, d[17:64])"))(
    lambda s, d: _long(_images(s, d).select("vec_id", tiff.with_band(F.col("r"), tiff.band_of(F.col("r"), 3), 1)["data"].alias("v")), "v")
)
query("raster_bands_selected", _long_sql(f"list_concat({_b(3)}, {_b(1)})"))(lambda s, d: _long(_images(s, d).select("vec_id", tiff.array_from_binary(tiff.encoded(F.col("r")), [3, 1]).alias("v")), "v"))



@query("geotiff_files", _long_sql("d"))
def geotiff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to files and read back."""
    four, folder = F.lit(4), shared_folder(spark, "geotiff")
    own = rasters(spark, sf_dir).select(F.concat(F.lit("/all/"), "vec_id").alias("origin"), four.alias("width"), four.alias("height"), "nBands", "data")
    writers.write_geotiff_image_with_array_data(own, folder).write.format("noop").mode("overwrite").save()
    name = F.regexp_extract("origin", "([0-9]+)[.]tiff$", 1).cast("long")
    return _long(readers.load_geotiff_image_as_array_data(folder, spark=spark).select(name.alias("vec_id"), F.col("data").alias("v")), "v")


@query("csv_table", "SELECT c_custkey::VARCHAR AS c_custkey, c_nationkey::VARCHAR AS c_nationkey FROM customer")
def csv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with another delimiter and read as texts."""
    folder = shared_folder(spark, "csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").write.option("header", "true").option("delimiter", ";").csv(folder)
    return readers.load_data(folder, "csv", ";", "true", spark)


def _image_files(images: DataFrame, folder: str, name: Column, data: Column, n_bands: int) -> None:
    four = F.lit(4)
    own = images.select(F.concat(F.lit("/"), name).alias("origin"), four.alias("width"), four.alias("height"), F.lit(n_bands).alias("nBands"), data.alias("data"))
    writers.write_geotiff_image_with_array_data(own, folder).write.format("noop").mode("overwrite").save()


def _image_id(path: str) -> Column:
    return F.regexp_extract(path, "([0-9]+)[.]?(?:tiff)?$", 1).cast("long").alias("vec_id")


@query("images_by_folder", "SELECT vec_id, CASE vec_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS category FROM embeddings")
def images_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, own = shared_folder(spark, "by-folder"), rasters(spark, sf_dir)
    for rest, name in enumerate(("even", "odd")):
        _image_files(own.filter(F.col("vec_id") % 2 == rest), f"{root}/{name}", F.col("vec_id").cast("string"), F.slice("data", 1, 16), 1)
    return readers.labelled_by_folder(readers.load_geotiff_image_as_binary_data(root, spark, recursive=True)).select(_image_id("path"), "category")


@query("images_by_prefix", "SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'water' ELSE 'land' END AS category, (vec_id % 3 = 0)::INTEGER AS is_water FROM embeddings")
def images_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "by-prefix")
    kind = F.when(F.col("vec_id") % 3 == 0, "water").otherwise("land")
    _image_files(rasters(spark, sf_dir), folder, F.concat_ws("_", kind, "vec_id"), F.slice("data", 1, 16), 1)
    named = readers.labelled_by_prefix(readers.load_geotiff_image_as_binary_data(folder, spark))
    return readers.labelled_by_prefix(named.withColumnRenamed("category", "own"), "water").select(_image_id("path"), F.col("own").alias("category"), F.col("category").alias("is_water"))


@query(
    "bands_from_folders",
    f"""{_R} SELECT vec_id, unnest(range(48))::INTEGER AS pos, unnest(list_concat({_b(0)}, {_b(3)}, list_transform({_b(1)}, lambda v: (v = 4)::INTEGER::DOUBLE))) AS value FROM q""",
)
def bands_from_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bands and a mask from a folder each; the mask's places come last."""
    root, own = shared_folder(spark, "bands"), rasters(spark, sf_dir, True)
    for name, i in (("red", 0), ("nir", 3), ("mask", 1)):
        _image_files(own, f"{root}/{name}", F.concat_ws("_", F.lit(name), "vec_id"), F.slice("data", 16 * i + 1, 16), 1)
    got = readers.bands_from_folders({n: f"{root}/{n}" for n in ("red", "nir")}, f"{root}/mask", 4, spark)
    return got.select(_image_id("name"), F.posexplode(F.concat("data", F.transform("label", lambda v: v.cast("double")))).alias("pos", "value"))


query("band_subset", _long_sql(f"list_concat({_b(2)}, {_b(0)})"))(lambda s, d: _long(rasters(s, d).select("vec_id", I.selected_bands(F.col("data"), 4, [2, 0]).alias("v")), "v"))
query("image_tensor", f"{_R} SELECT vec_id, b::INTEGER AS band, h::INTEGER AS h, w::INTEGER AS w, d[b * 16 + h * 4 + w + 1]::FLOAT AS value FROM q, range(4) x(b), range(4) y(h), range(4) z(w)")(
    lambda s, d: rasters(s, d, True)
    .select("vec_id", F.posexplode(datasets.image_tensor(F.col("data"), 4, 4, 4)).alias("band", "rows"))
    .select("vec_id", "band", F.posexplode("rows").alias("h", "row"))
    .select("vec_id", "band", "h", F.posexplode("row").alias("w", "value"))
)


@query("geotiff_windows", _long_sql("d"))
def geotiff_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to files and read strip by strip."""
    folder = shared_folder(spark, "windows")
    _image_files(rasters(spark, sf_dir), folder, F.col("vec_id").cast("string"), F.col("data"), 4)
    each = readers.load_geotiff_windows(folder, spark).select(_image_id("origin"), "band", "y", "x", "width", F.posexplode("data").alias("i", "value"))
    place = F.col("band") * 16 + (F.col("y") + F.floor(F.col("i") / F.col("width"))) * 4 + F.col("x") + F.col("i") % F.col("width")
    return each.select("vec_id", place.cast("int").alias("pos"), "value")


def _polygon_files(name: str, read: Callable[[SparkSession, str, DataFrame], DataFrame]) -> None:
    """Cells of the grid over all events, written and read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _corners(read(spark, shared_folder(spark, name), grid.generate_grid_cells(events(spark, sf_dir), 8, 6)))

    query(name, _cells_sql(_EVENT_BOX, 8, 6))(run)


def _by_wkt(spark: SparkSession, folder: str, cells: DataFrame) -> DataFrame:
    writers.write_geometries(cells, "geometry", folder)
    return readers.load_geo_data(folder, GeoFileType.WKT_FILE, spark).select(F.col("_c1").cast("int").alias("cell_id"), "geometry")


def _by_geojson(spark: SparkSession, folder: str, cells: DataFrame) -> DataFrame:
    ring = F.transform("geometry.rings", lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"])))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("cell_id").alias("properties"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"))
    cells.select(F.to_json(feature).alias("value")).write.text(folder)
    return readers.load_geo_data(folder, GeoFileType.JSON_FILE, spark).select(F.col("properties")["cell_id"].cast("int").alias("cell_id"), "geometry")


_polygon_files("wkt_files", _by_wkt)
_polygon_files("geojson_files", _by_geojson)

# ------------------------------------------------------ dense tables, samples

_STEPS_T, _SIDE_N = 120, 8


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.get_st_grid_dataframe(events(spark, sf_dir), "geometry", _SIDE_N, _SIDE_N, "ts", 21600)


_SPARSE = f"{_EVENTS}{_STEPS}, sparse AS (SELECT cell_id, s // 21600 AS t, count(*)::DOUBLE AS f FROM t GROUP BY ALL), dense AS (SELECT k // 64 AS t, k % 64 AS c, coalesce(f, 0.0) AS f FROM range({_STEPS_T * 64}) r(k) LEFT JOIN sparse ON sparse.t = k // 64 AND cell_id = k % 64)"


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.get_st_grid_array(_sparse(spark, sf_dir), "_id_timestep", "cell_id", ["aggregated_feature"], _STEPS_T, _SIDE_N, _SIDE_N, 0)


query("dense_st_grid", f"{_SPARSE} SELECT t AS _id_timestep, c // 8 AS h, c % 8 AS w, f AS aggregated_feature FROM dense")(lambda s, d: _dense(s, d).select("_id_timestep", "h", "w", "aggregated_feature"))
query("dense_st", f"{_SPARSE} SELECT t AS _id_timestep, c AS cell_id, f AS aggregated_feature FROM dense")(
    lambda s, d: tensor.get_st_array(_sparse(s, d), "_id_timestep", "cell_id", ["aggregated_feature"], _STEPS_T, 64, 0)
)


@query("npy_shards", f"{_SPARSE} SELECT t, c AS cell, f AS value FROM dense")
def npy_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to shards of 32 steps and read back; a shard's number is in its name."""
    folder = shared_folder(spark, "npy-shards")
    dense = _dense(spark, sf_dir)
    writers.write_npy_shards(dense, {"_id_timestep": _STEPS_T, "h": _SIDE_N, "w": _SIDE_N}, ["aggregated_feature"], folder, 32).write.format("noop").mode("overwrite").save()
    arrays = readers.load_npy(folder, spark)
    shard = F.regexp_extract("origin", "shard-([0-9]+)", 1).cast("long")
    each = arrays.select(shard.alias("s"), F.posexplode("data").alias("p", "value"))
    return each.select((F.col("s") * 32 + F.floor(F.col("p") / 64)).alias("t"), (F.col("p") % 64).cast("long").alias("cell"), "value")


@query("netcdf_fields", f"{_SPARSE} SELECT t, c // 8 AS h, c % 8 AS w, f AS value FROM dense")
def netcdf_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written as NetCDF files of 50 hours each, and combined again by
    their coordinates."""
    folder = shared_folder(spark, "netcdf")

    def file(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t", "h", "w"])
        steps = frame["t"].unique()
        data = frame["v"].to_numpy(float).reshape(len(steps), _SIDE_N, _SIDE_N)
        axes = {"time": (steps, {"units": "hours since 1900-01-01 00:00:00"}), "latitude": (np.arange(_SIDE_N) * 5.625, {}), "longitude": (np.arange(_SIDE_N) * 5.625, {})}
        return pd.DataFrame({"path": [f"part-{steps[0]}"], "content": [netcdf.encoded(axes, "v", data)]})

    frames = _dense(spark, sf_dir).select(F.col("_id_timestep").alias("t"), "h", "w", F.col("aggregated_feature").alias("v"))
    made = frames.groupBy(F.floor(F.col("t") / 50)).applyInPandas(file, "path string, content binary")
    writers.write_geotiff_image_with_binary_data(made, folder, extension=".nc").write.format("noop").mode("overwrite").save()
    return weather.field_frames(netcdf.load_netcdf(folder, "v", spark), "v")


_SPATIAL = f"{_EVENTS} SELECT k AS cell_id, coalesce(n, -1.0) AS aggregated_feature FROM range(64) r(k) LEFT JOIN (SELECT cell_id, count(*)::DOUBLE AS n FROM c GROUP BY ALL) ON cell_id = k"
query("dense_spatial", _SPATIAL)(lambda s, d: tensor.get_spatial_array(grid.get_spatial_grid_dataframe(events(s, d), "geometry", 8, 8), "cell_id", ["aggregated_feature"], 64, -1))
query("dense_spatial_grid", f"SELECT cell_id // 8 AS h, cell_id % 8 AS w, aggregated_feature FROM ({_SPATIAL})")(
    lambda s, d: tensor.get_spatial_grid_array(grid.get_spatial_grid_dataframe(events(s, d), "geometry", 8, 8), "cell_id", ["aggregated_feature"], 8, 8, -1).select("h", "w", "aggregated_feature")
)
query("min_max_info", f"{_SPARSE} SELECT max(f) - min(f) AS max_minus_min, max(f) + min(f) AS max_plus_min FROM dense")(lambda s, d: tensor.min_max(_dense(s, d), ["aggregated_feature"]))
query("norm_minmax", f"{_SPARSE}, m AS (SELECT min(f) AS lo, max(f) AS hi FROM dense) SELECT t AS _id_timestep, c AS cell_id, (2 * f - (hi + lo)) / (hi - lo) AS f FROM dense, m")(
    lambda s, d: tensor.normalized(_dense(s, d), ["aggregated_feature"]).select("_id_timestep", "cell_id", F.col("aggregated_feature").alias("f"))
)


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.frames(_dense(spark, sf_dir), "_id_timestep", "cell_id", ["aggregated_feature"])


@query("lead_time_pairs", f"{_SPARSE} SELECT a.t, a.c::INTEGER AS pos, a.f AS x, b.f AS y FROM dense a JOIN dense b ON b.t = a.t + 4 AND a.c = b.c")
def lead_time_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = tensor.lead_time_pairs(_frames(spark, sf_dir), 4)
    return pairs.select("t", F.posexplode(F.arrays_zip("x_data", "y_data")).alias("pos", "z")).select("t", "pos", F.col("z.x_data").alias("x"), F.col("z.y_data").alias("y"))


def _parts(samples: DataFrame, names: list[str]) -> DataFrame:
    parts = F.array(*(F.struct(F.lit(n).alias("part"), F.col(n).alias("frames")) for n in names))
    each = samples.select("t", F.explode(parts).alias("p")).select("t", "p.part", F.posexplode("p.frames").alias("i", "frame"))
    return each.select("t", "part", "i", F.posexplode("frame").alias("pos", "value"))


@query(
    "sequential_windows",
    f"{_SPARSE}, o AS (SELECT 'x_data' AS part, i, i AS o FROM range(6) r(i) UNION ALL SELECT 'y_data', i, i + 6 FROM range(3) r(i)) SELECT s.t, part, o.i::INTEGER AS i, c::INTEGER AS pos, f AS value FROM range({_STEPS_T - 9}) s(t), o JOIN dense d ON d.t = s.t + o.o",
)
def sequential_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(tensor.sequential_windows(_frames(spark, sf_dir), 6, 3, _STEPS_T), ["x_data", "y_data"])


@query(
    "periodical_features",
    f"""{_SPARSE}, o AS (SELECT 'x_closeness' AS part, i, -(i + 1) AS o FROM range(3) r(i) UNION ALL SELECT 'x_period', i, -4 * (i + 1) FROM range(3) r(i) UNION ALL SELECT 'x_trend', i, -28 * (i + 1) FROM range(2) r(i))
SELECT s.t, part, o.i::INTEGER AS i, c::INTEGER AS pos, f AS value FROM range(56, {_STEPS_T}) s(t), o JOIN dense d ON d.t = s.t + o.o""",
)
def periodical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tensor.periodical_features(_frames(spark, sf_dir), 3, 3, 2, 1, 4, 28)
    return _parts(got, ["x_closeness", "x_period", "x_trend"])


@query(
    "time_one_hot",
    "WITH s AS (SELECT event_id, floor(epoch(ts))::BIGINT // 3600 AS t FROM events) SELECT event_id, p::INTEGER AS pos, (CASE WHEN p < 24 THEN p = t % 24 ELSE p - 24 = (t // 24) % 7 END)::INTEGER::DOUBLE AS value FROM s, range(31) r(p)",
)
def time_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor(T.unix_seconds(table(spark, sf_dir, "events"), "ts") / 3600)
    return table(spark, sf_dir, "events").select("event_id", F.posexplode(tensor.time_one_hot(hour)).alias("pos", "value"))


@query(
    "neighbourhoods",
    f"{_SPARSE} SELECT a.t, a.c // 8 AS h, a.c % 8 AS w, p::INTEGER AS pos, coalesce(b.f, 0.0) AS value FROM dense a, range(9) r(p) LEFT JOIN dense b ON b.t = a.t AND b.c // 8 = a.c // 8 + p // 3 - 1 AND b.c % 8 = a.c % 8 + p % 3 - 1",
)
def neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tensor.neighbourhoods(_dense(spark, sf_dir), "_id_timestep", ["aggregated_feature"], 8, 8, 1)
    return got.select("t", "h", "w", F.posexplode("aggregated_feature").alias("pos", "value"))


# ------------------------------------------------- labels, masks, metrics

query("class_labels", "SELECT event_type AS label, (row_number() OVER (ORDER BY event_type) - 1)::INTEGER AS label_id FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)")(
    lambda s, d: datasets.class_labels(table(s, d, "events"), "event_type")
)
query("label_encode", "SELECT event_id AS image_data, (dense_rank() OVER (ORDER BY event_type) - 1)::INTEGER AS label, value FROM events")(
    lambda s, d: datasets.classification_frame(table(s, d, "events"), "event_id", "event_type", "value")
)
query("mask_threshold", f"{_R} SELECT vec_id, unnest(range(64))::INTEGER AS pos, unnest(list_transform(d, lambda v: (v >= 4)::INTEGER)) AS value FROM q")(
    lambda s, d: _long(datasets.segmentation_frame(rasters(s, d, True).select(F.col("vec_id").alias("k"), "data"), "k", "data", False, 4).toDF("vec_id", "v"), "v")
)


def _moved(value: str, by: str, turn: int, size: str) -> str:
    return f"({value} + ('0x' || substr(md5('7:{turn}:' || {by}), 1, 12))::BIGINT) % {size}"


def _permuted(source: str) -> str:
    """One turn of the shuffle of ``datasets.shuffled_place`` with seed 7."""
    pairs = f"(SELECT id, n, a, b, x // b AS l, x % b AS r FROM {source})"
    for turn in range(datasets.ROUNDS):
        l, r = (_moved("l", "r", turn, "a"), "r") if turn % 2 == 0 else ("l", _moved("r", "l", turn, "b"))
        pairs = f"(SELECT id, n, a, b, {l} AS l, {r} AS r FROM {pairs})"
    return f"SELECT id, n, a, b, l * b + r AS x FROM {pairs}"


query(
    "split_shuffled",
    f"""WITH RECURSIVE o AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS x, count(*) OVER () AS n FROM orders),
s AS (SELECT *, ceil(sqrt(n::DOUBLE))::BIGINT AS a, ceil(n / ceil(sqrt(n::DOUBLE)))::BIGINT AS b FROM o),
w AS ({_permuted("s")} UNION ALL {_permuted("w WHERE x >= n")})
SELECT id AS o_orderkey, CASE WHEN x < floor(0.7 * n) THEN 'train' WHEN x < floor(0.9 * n) THEN 'validation' ELSE 'test' END AS split FROM w WHERE x < n""",
)(lambda s, d: datasets.split_train_validation_test(adapter.add_row_id(table(s, d, "orders").select("o_orderkey"), "i", ["o_orderkey"]), "i", 0.2, 0.1, 7).drop("i"))
query("split_index", "SELECT o_orderkey, o_totalprice, CASE WHEN i < floor(0.7 * n) THEN 'train' WHEN i < floor(0.9 * n) THEN 'validation' ELSE 'test' END AS split FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)")(
    lambda s, d: datasets.split_train_validation_test(adapter.add_row_id(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "i", ["o_orderkey"]), "i", 0.2, 0.1).drop("i")
)
query("forecast_errors", f"SELECT {_ROUND.format('avg(pow(l_extendedprice - l_quantity * 1000, 2))')} AS mse, {_ROUND.format('avg(abs(l_extendedprice - l_quantity * 1000))')} AS mae, {_ROUND.format('sqrt(avg(pow(l_extendedprice - l_quantity * 1000, 2)))')} AS rmse FROM lineitem")(
    lambda s, d: datasets.forecast_errors(table(s, d, "lineitem").withColumn("p", F.col("l_quantity") * 1000), "p", "l_extendedprice").select(r6("mse").alias("mse"), r6("mae").alias("mae"), r6("rmse").alias("rmse"))
)
query("accuracy", f"{_R} SELECT {_ROUND.format('avg(CASE WHEN list_position(d[1:10], list_max(d[1:10])) - 1 = label THEN 100.0::DOUBLE ELSE 0.0 END)')} AS accuracy FROM r JOIN embeddings USING (vec_id)")(
    lambda s, d: datasets.accuracy(rasters(s, d).withColumn("p", datasets.arg_max(F.slice("data", 1, 10))), "p", "label").select(r6("accuracy").alias("accuracy"))
)
query("channel_stats", f"{_R} SELECT (pos // 16)::INTEGER AS band, {_ROUND.format('avg(v)')} AS mean, {_ROUND.format('stddev_pop(v)')} AS std FROM (SELECT unnest(range(64)) AS pos, unnest(d) AS v FROM q) GROUP BY pos // 16")(
    lambda s, d: datasets.channel_stats(rasters(s, d, True), "data", 4).withColumns({"mean": r6("mean"), "std": r6("std")})
)
query("channels_first", _long_sql("list_transform(range(64), lambda i: d[(i % 16) * 4 + i // 16 + 1])"))(lambda s, d: _long(rasters(s, d).withColumn("v", datasets.channels_first(F.col("data"), 4, 4, 4)), "v"))
query("mean_index_features", f"{_R} SELECT vec_id, floor(list_sum({_zip('(x - y) / (CASE WHEN x + y = 0 THEN 1e-12 ELSE x + y END)', 3, 2)}) / 16 * 1e6 + 0.5) / 1e6 AS ndvi FROM q")(
    lambda s, d: rasters(s, d, True).select("vec_id", r6(I.mean_index(I.spectral_index("ndvi", F.col("data"), 4, {"nir": 3, "red": 2}))).alias("ndvi"))
)

# ------------------------------------------------------- indices and textures

_PLACES = {"green": 0, "red": 1, "nir": 2, "swir1": 3, "swir2": 1}
_OVER = "({}) / (CASE WHEN {} = 0 THEN 1e-12 ELSE {} END)"


def _ndi_sql(i: int, j: int) -> str:
    return _zip(_OVER.format("x - y", "x + y", "x + y"), i, j)


def _index(name: str) -> Query:
    return lambda s, d: _long(rasters(s, d, True).select("vec_id", I.spectral_index(name, F.col("data"), 4, _PLACES).alias("v")), "v")


_AWEI = "list_transform(range(1, 17), lambda k: 4 * (d[k] - d[48 + k]) - (0.25::DOUBLE * d[32 + k] + 2.75::DOUBLE * d[16 + k]))"
for _name, _names in I.INDEX_BANDS.items():
    _i, _j = (_PLACES[b] for b in _names[:2])
    _sql = _AWEI if _name == "awei" else _zip(_OVER.format("x", "y", "y"), _i, _j) if _name == "rvi" else _ndi_sql(_i, _j)
    query(f"idx_{_name}", _long_sql(_sql, "q"))(_index(_name))


def _appended(value: Callable[[Column], Column]) -> Query:
    return lambda s, d: _long(rasters(s, d, True).select("vec_id", I.appended(F.col("data"), value(F.col("data"))).alias("v")), "v")


_one = lambda d, i: B.band(d, 4, i)
query("tf_append_ndi", _long_sql(f"list_concat(d, {_ndi_sql(0, 1)})", "q"))(_appended(lambda d: I.difference_index(_one(d, 0), _one(d, 1))))
query("tf_append_ratio", _long_sql(f"list_concat(d, {_zip(_OVER.format('x', 'y', 'y'), 0, 1)})", "q"))(_appended(lambda d: I.ratio_index(_one(d, 0), _one(d, 1))))
query("tf_append_awei", _long_sql(f"list_concat(d, {_AWEI})", "q"))(_appended(lambda d: I.awei(_one(d, 0), _one(d, 2), _one(d, 3), _one(d, 1))))

_GREY = "list_transform(range(1, 17), lambda k: floor(((128 + d[k]) * 299 + (128 + d[16 + k]) * 587 + (128 + d[32 + k]) * 114) / 1000 / 32)::INTEGER)"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 200).cast("double")).alias("d"))
    shifted = F.transform("d", lambda v: (v + 128))
    mixed = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: (F.element_at(shifted, k) * 299 + F.element_at(shifted, k + 16) * 587 + F.element_at(shifted, k + 32) * 114) / 1000)
    return whole.select("vec_id", I.digitized(mixed).alias("levels"))


query("digitize", _long_sql(_GREY, "q"))(lambda s, d: _long(_levels(s, d), "levels"))
_LUMA = "list_transform(range(1, 17), lambda k: round_even((0.299::DOUBLE * d[k] + 0.587::DOUBLE * d[16 + k]) + 0.114::DOUBLE * d[32 + k], 0) + 0.0)"
query("gray", _long_sql(_LUMA, "q"))(lambda s, d: _long(rasters(s, d, True).select("vec_id", I.gray(*(_one(F.col("data"), i) for i in range(3))).alias("v")), "v"))


@query(
    "glcm_features",
    f"""{_R}, e AS (SELECT vec_id, unnest(range(16)) AS p, unnest(v) AS v FROM (SELECT vec_id, {_GREY} AS v FROM q)),
g AS (SELECT a.vec_id, s.angle, a.v AS i, b.v AS j FROM e a JOIN (VALUES ('0', 0, 1), ('45', 1, 1), ('90', 1, 0)) s(angle, dr, dc) ON true
  JOIN e b ON b.vec_id = a.vec_id AND b.p // 4 = a.p // 4 + dr AND b.p % 4 = a.p % 4 + dc),
h AS (SELECT vec_id, angle, i, j FROM g UNION ALL SELECT vec_id, angle, j, i FROM g),
m AS (SELECT vec_id, angle, i, j, count(*) AS c FROM h GROUP BY vec_id, angle, i, j),
n AS (SELECT vec_id, angle, i, j, c / sum(c) OVER (PARTITION BY vec_id, angle) AS p FROM m),
f AS (SELECT vec_id, angle, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity,
  sum(p * p) AS asm, sum(p * i) AS m, sum(p * i * i) - sum(p * i) * sum(p * i) AS v, sum(p * i * j) AS c FROM n GROUP BY vec_id, angle)
SELECT vec_id, {", ".join(_ROUND.format(x) + " AS " + y for x, y in (("avg(contrast)", "contrast"), ("avg(dissimilarity)", "dissimilarity"), ("avg(homogeneity)", "homogeneity"),
  ("avg(asm) FILTER (angle <> '0')", "asm"), ("avg(sqrt(asm))", "energy"), ("avg(CASE WHEN v < 1e-15 THEN 1.0 ELSE (c - m * m) / v END)", "correlation")))} FROM f GROUP BY vec_id""",
)
def glcm_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = texture.glcm_features(_levels(spark, sf_dir), "vec_id", "levels", 4, 4)
    return got.withColumns({f: r6(f) for f in texture.FEATURES})


# ------------------------------------------------------------ adapter helpers

query("row_id", "SELECT c_custkey, c_name, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS id FROM customer")(
    lambda s, d: adapter.add_row_id(table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "id", ["c_acctbal", "c_custkey"])
)
query("row_id_items", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_quantity, l_shipdate) - 1 AS id FROM lineitem")(
    lambda s, d: adapter.add_row_id(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"), "id", ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"])
)
query("item_by_index", "SELECT o_orderkey, o_totalprice, i AS id FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i IN (0, 17, 1000000)")(
    lambda s, d: adapter.rows_at(adapter.add_row_id(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "id", ["o_orderkey"]), "id", [0, 17, 1000000])
)
query("top_rows", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")(
    lambda s, d: s.createDataFrame(adapter.get_top_rows(table(s, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey"), 20), table(s, d, "customer").select("c_custkey", "c_acctbal").schema)
)
query("drop_columns", "SELECT r_regionkey FROM region")(lambda s, d: adapter.drop_columns(table(s, d, "region"), [c for c in table(s, d, "region").columns if c != "r_regionkey"]))
query("sample_rows", f"SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5('42:' || o_orderkey), 1, 12))::BIGINT < {int(0.1 * 16**12)}")(
    lambda s, d: adapter.sampled(table(s, d, "orders"), ["o_orderkey"], 0.1, 42).select("o_orderkey")
)
query("cells_of_array", f"{_R} SELECT vec_id, unnest(range(64))::INTEGER AS cell, unnest(list_transform(d, lambda v: abs(v::INTEGER))) AS feature FROM q")(
    lambda s, d: adapter.get_cells_df(rasters(s, d, True), "data", "cell", "feature", keep=["vec_id"])
)


def _drawn(layer: DataFrame) -> DataFrame:
    """A layer with the corners of its polygons, read from their GeoJSON."""
    place = F.flatten(F.from_json(F.get_json_object("geojson", "$.coordinates"), "array<array<array<double>>>"))
    at = lambda i: F.transform(place, lambda v: v[i])
    corners = {f"{c}{end}": (F.array_min if end == "min" else F.array_max)(at(i)) for i, c in enumerate("xy") for end in ("min", "max")}
    return layer.withColumns(corners).drop("geojson")


@query(
    "map_layer",
    f"{_EVENTS}, n AS (SELECT cell_id, count(*)::DOUBLE AS f FROM c GROUP BY ALL), g AS ({_cells_sql(_EVENT_BOX, 8, 8)}) SELECT g.*, coalesce(f, 0.0) AS feature, coalesce(f, 0.0) / (SELECT greatest(1.0, max(f)) FROM n) AS height FROM g LEFT JOIN n ON n.cell_id = g.cell_id",
)
def map_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir)
    counts = grid.get_spatial_grid_dataframe(own, "geometry", 8, 8, ordered=False)
    return _drawn(adapter.map_layer(grid.generate_grid_cells(own, 8), counts, "cell_id", "aggregated_feature"))


@query("crs_round_trip", "SELECT s_suppkey, floor(s_acctbal / 100 * 1e6 + 0.5) / 1e6 AS lon, floor(s_nationkey::DOUBLE * 1e6 + 0.5) / 1e6 AS lat FROM supplier")
def crs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = G.to_web_mercator(G.vertex(F.col("s_acctbal") / 100, F.col("s_nationkey")))
    back = G.from_web_mercator(F.col("m"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", there.alias("m")).select("s_suppkey", back.alias("v")).select("s_suppkey", r6("v.x").alias("lon"), r6("v.y").alias("lat"))


@query("wkt_round_trip", "SELECT s_suppkey, s_acctbal AS x, s_nationkey::DOUBLE AS y FROM supplier")
def wkt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = G.to_wkt(G.point(F.col("s_acctbal"), F.col("s_nationkey").cast("double")))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("wkt")).select("s_suppkey", G.from_wkt(F.col("wkt")).alias("g"))
    return rows.select("s_suppkey", G.x_of(F.col("g")).alias("x"), G.y_of(F.col("g")).alias("y"))


# ------------------------------------------------------------ traffic samples

query("scaled_planes", _long_sql("list_transform(range(1, 65), lambda k: d[k] / nullif(list_max(d[(k - 1) // 16 * 16 + 1 : (k - 1) // 16 * 16 + 16]), 0))", "q"))(
    lambda s, d: _long(rasters(s, d, True).select("vec_id", traffic.scaled_planes(F.col("data"), 4).alias("v")), "v")
)


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trips between cells of 8 x 8, by their keys."""
    key, to = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 240) % 64
    trips = table(spark, sf_dir, "orders").select(
        (key % _STEPS_T).alias("t"), (F.floor(key / _STEPS_T) % 2).alias("k"), F.floor(F.col("o_custkey") % 64 / 8).alias("h"), (F.col("o_custkey") % 8).alias("w"), F.floor(to / 8).alias("to_h"), (to % 8).alias("to_w")
    )
    return trips.groupBy(*trips.columns).agg(F.count("*").alias("n"))


_FLOWS = f"""flows AS (SELECT o_orderkey % {_STEPS_T} AS t, o_orderkey // {_STEPS_T} % 2 AS k, o_custkey % 64 // 8 AS h, o_custkey % 8 AS w, o_orderkey // 240 % 64 // 8 AS to_h, o_orderkey // 240 % 8 AS to_w FROM orders),
near AS (SELECT * FROM flows WHERE abs(to_h - h) <= 1 AND abs(to_w - w) <= 1),
channels AS (SELECT t, h, w, pos::INTEGER AS pos, channel::INTEGER AS channel, count(*)::DOUBLE AS n FROM (
  SELECT t + k AS t, h, w, (to_h - h + 1) * 3 + to_w - w + 1 AS pos, 2 * k AS channel FROM near
  UNION ALL SELECT t + k, to_h, to_w, (h - to_h + 1) * 3 + w - to_w + 1, 2 * k + 1 FROM near) GROUP BY ALL)"""
query("flow_channels", f"WITH {_FLOWS} SELECT * FROM channels")(lambda s, d: traffic.flow_channels(_flows(s, d), 1))
_BACK = "CASE WHEN p < 3 THEN 4 * (3 - p) ELSE 5 - p END"
query("cell_history", f"{_SPARSE} SELECT s.t, c // 8 AS h, c % 8 AS w, p::INTEGER AS pos, f AS value FROM range(12, {_STEPS_T + 1}) s(t), range(5) r(p) JOIN dense d ON d.t = s.t - ({_BACK})")(
    lambda s, d: traffic.cell_history(_dense(s, d), "_id_timestep", ["aggregated_feature"], 4, 3, 2).select("t", "h", "w", F.posexplode("history").alias("pos", "value"))
)


@query(
    "forecast_samples",
    f"""{_SPARSE}, {_FLOWS}, past AS (SELECT s.t, c, sum((p + 1) * f) AS x FROM range(12, {_STEPS_T + 1}) s(t), range(5) r(p) JOIN dense d ON d.t = s.t - ({_BACK}) GROUP BY ALL),
near_by AS (SELECT a.t, a.c, sum((p + 1) * coalesce(b.f, 0)) AS image, sum((p + 6) * coalesce(b.f, 0)) AS x FROM dense a, range(9) r(p)
  LEFT JOIN dense b ON b.t = a.t AND b.c // 8 = a.c // 8 + p // 3 - 1 AND b.c % 8 = a.c % 8 + p % 3 - 1 GROUP BY ALL),
moved AS (SELECT t, h * 8 + w AS c, sum((pos * 4 + channel + 1) * n) AS flow FROM channels GROUP BY ALL),
o AS (SELECT 'short' AS part, 0 AS a, i, 2 - i AS back FROM range(2) r(i) UNION ALL SELECT 'long', a, i, (2 - a) * 4 + 1 - i FROM range(2) q(a), range(3) r(i))
SELECT s.t, p.c // 8 AS h, p.c % 8 AS w, part, a::INTEGER AS a, o.i::INTEGER AS i, p.x + n.x AS x, image, coalesce(flow, 0.0) AS flow, l.f AS label
FROM range(23, {_STEPS_T}) s(t), o JOIN past p ON p.t = s.t - back JOIN near_by n ON n.t = p.t AND n.c = p.c LEFT JOIN moved m ON m.t = p.t AND m.c = p.c JOIN dense l ON l.t = s.t AND l.c = p.c""",
)
def forecast_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays as sums of values times places, so that every place counts."""
    got = traffic.forecast_samples(_dense(spark, sf_dir), _flows(spark, sf_dir), "_id_timestep", ["aggregated_feature"], _STEPS_T, 8, 8, 4, 2, 2, 3, 3, 2, 1, 1)
    parts = F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).alias("s")) for p in ("short", "long")))
    each = got.select("t", "h", "w", F.element_at("label", 1).alias("label"), F.explode(parts).alias("p")).select("t", "h", "w", "label", "p.part", F.explode("p.s").alias("s"))
    weighed = lambda c: F.aggregate(F.transform(F.col(c), lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return each.select("t", "h", "w", "label", "part", "s.a", "s.i", *(weighed(f"s.{c}").alias(c) for c in ("x", "image", "flow")))


# ------------------------------------------------- image features, zones, layers

_SCALED = "list_transform(range(1, 49), lambda k: floor(d[k] / (list_max(d[1:48]) / 255.0::DOUBLE)))"
_NEAR = "SELECT a.vec_id, avg((a.v - b.v) * (a.v - b.v)) AS c FROM e a JOIN e b ON b.vec_id = a.vec_id AND b.p // 4 = a.p // 4 + {} AND b.p % 4 = a.p % 4 + {} GROUP BY a.vec_id"


@query(
    "image_features",
    f"""{_R}, m AS (SELECT vec_id, list_transform(d, lambda v: v + 128) AS d FROM q), z AS (SELECT vec_id, d, {_SCALED} AS s FROM m),
v AS (SELECT vec_id, d, list_transform(range(1, 17), lambda k: floor((round_even((0.299::DOUBLE * s[k] + 0.587::DOUBLE * s[16 + k]) + 0.114::DOUBLE * s[32 + k], 0)) / 32)::INTEGER) AS l FROM z),
e AS (SELECT vec_id, unnest(range(16)) AS p, unnest(l) AS v FROM v)
SELECT vec_id, {_ROUND.format("list_sum(l) / 16.0::DOUBLE")} AS own, {_ROUND.format("list_sum(list_transform(range(1, 17), lambda k: (d[48 + k] - d[k]) / (CASE WHEN d[48 + k] + d[k] = 0 THEN 1e-12 ELSE d[48 + k] + d[k] END))) / 16")} AS mean_ndvi,
  {_ROUND.format("(x.c + y.c + z.c) / 3")} AS contrast FROM v JOIN ({_NEAR.format(0, 1)}) x USING (vec_id) JOIN ({_NEAR.format(1, 1)}) y USING (vec_id) JOIN ({_NEAR.format(1, 0)}) z USING (vec_id)""",
)
def image_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = rasters(spark, sf_dir, True).select("vec_id", F.transform("data", lambda v: v + 128).alias("data"))
    got = datasets.image_features(images, "vec_id", "data", 4, 4, 4, {"red": 0, "green": 1, "blue": 2, "nir": 3}, ["contrast", "mean_ndvi", "own"], {"own": I.mean_index})
    return got.select("vec_id", *(r6(c).alias(c) for c in ("own", "mean_ndvi", "contrast")))


@query("st_map_layer", f"{_SPARSE}, n AS (SELECT c, f FROM dense WHERE t = 5) SELECT c::INTEGER AS cell_id, f AS feature, f / (SELECT greatest(1.0, max(f)) FROM n) AS height FROM n")
def st_map_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid.get_grid_cell_polygons(events(spark, sf_dir), "geometry", 8, 8)
    return adapter.st_map_layer(cells, _sparse(spark, sf_dir), 5, "_id_timestep", "cell_id", "aggregated_feature").drop("geojson")


query(
    "weather_field",
    """WITH s AS (SELECT l_shipdate, l_linenumber, l_quantity, max(l_extendedprice)::DOUBLE AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT dense_rank() OVER (ORDER BY l_shipdate) - 1 AS t, dense_rank() OVER (ORDER BY l_linenumber) - 1 AS h, dense_rank() OVER (ORDER BY l_quantity) - 1 AS w, v AS value FROM s""",
)(lambda s, d: weather.field_frames(table(s, d, "lineitem"), "l_extendedprice", "l_shipdate", "l_linenumber", "l_quantity", "l_returnflag", "R"))
query("weather_shape", "SELECT count(DISTINCT l_shipdate) AS timesteps, count(DISTINCT l_linenumber) AS height, count(DISTINCT l_quantity) AS width FROM lineitem")(
    lambda s, d: weather.field_shape(weather.field_frames(table(s, d, "lineitem"), "l_extendedprice", "l_shipdate", "l_linenumber", "l_quantity"))
)


@query(
    "hexagon_layer",
    f"""WITH p AS (SELECT c_acctbal::DOUBLE / 100 AS x, c_nationkey::DOUBLE AS y FROM customer), m AS (SELECT (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM p),
u AS (SELECT mx, my, (x - mx) * (111320.0::DOUBLE * cos(radians(my))) / 200000 AS x, (y - my) * 111320.0::DOUBLE / 200000 AS y FROM p, m),
a AS (SELECT mx, my, sqrt(3.0::DOUBLE) / 3 * x - y / 3 AS q, y * 2 / 3 AS r FROM u), b AS (SELECT *, -q - r AS s, floor(q + 0.5::DOUBLE) AS nq, floor(r + 0.5::DOUBLE) AS nr, floor(-q - r + 0.5::DOUBLE) AS ns FROM a),
c AS (SELECT *, abs(nq - q) AS oq, abs(nr - r) AS o_r, abs(ns - s) AS os FROM b),
h AS (SELECT (CASE WHEN oq > o_r AND oq > os THEN -nr - ns ELSE nq END)::BIGINT AS q, (CASE WHEN NOT (oq > o_r AND oq > os) AND o_r > os THEN -nq - ns ELSE nr END)::BIGINT AS r, mx, my FROM c),
g AS (SELECT q, r, count(*) AS points, any_value(mx) AS mid_longitude, any_value(my) AS mid_latitude FROM h GROUP BY q, r)
SELECT q, r, points, {_ROUND.format("(mid_latitude + r * 1.5::DOUBLE * 200000 / 111320)")} AS latitude, {_ROUND.format("(mid_longitude + sqrt(3.0::DOUBLE) * (q + r / 2.0::DOUBLE) * 200000 / (111320 * cos(radians(mid_latitude))))")} AS longitude, mid_latitude, mid_longitude FROM g""",
)
def hexagon_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select((F.col("c_acctbal").cast("double") / 100).alias("x"), F.col("c_nationkey").alias("y"))
    return adapter.hexagon_layer(rows, "y", "x", 200_000.0).withColumns({c: r6(c) for c in ("latitude", "longitude")})


# the series of a zone with the numbers of WGS 84, to a millimetre
_ZONE_N = 1 / 298.257223563 / (2 - 1 / 298.257223563)
_ZONE_E = 2 * _ZONE_N**0.5 / (1 + _ZONE_N)
_ZONE_SIZE = 0.9996 * 6378137.0 * (1 + _ZONE_N**2 / 4 + _ZONE_N**4 / 64) / (1 + _ZONE_N)
_ZONE_C = [_ZONE_N / 2 - 2 * _ZONE_N**2 / 3 + 5 * _ZONE_N**3 / 16, 13 * _ZONE_N**2 / 48 - 3 * _ZONE_N**3 / 5, 61 * _ZONE_N**3 / 240]
_ZONE_SUM = lambda f, g: " + ".join(f"{c!r}::DOUBLE * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, c in enumerate(_ZONE_C, 1))


@query(
    "crs_zone",
    f"""WITH d AS (SELECT s_suppkey, sin(radians(s_acctbal / 200)) AS s, radians(s_nationkey / 10.0::DOUBLE) AS l FROM supplier),
t AS (SELECT s_suppkey, l, sinh(atanh(s) - {_ZONE_E!r}::DOUBLE * atanh({_ZONE_E!r}::DOUBLE * s)) AS t FROM d), p AS (SELECT s_suppkey, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta FROM t)
SELECT s_suppkey, floor((500000 + {_ZONE_SIZE!r}::DOUBLE * (eta + {_ZONE_SUM("cos", "sinh")})) * 1000 + 0.5) / 1000 AS east, floor({_ZONE_SIZE!r}::DOUBLE * (xi + {_ZONE_SUM("sin", "cosh")}) * 1000 + 0.5) / 1000 AS north FROM p""",
)
def crs_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "supplier").select("s_suppkey", G.point(F.lit(-75.0) + F.col("s_nationkey") / 10, F.col("s_acctbal") / 200).alias("geometry"))
    moved = adapter.transform_crs(points, "geometry", "EPSG:4326", "EPSG:32618")
    mm = lambda c: F.floor(c * 1000 + 0.5) / 1000
    return moved.select("s_suppkey", mm(G.x_of(F.col("geometry"))).alias("east"), mm(G.y_of(F.col("geometry"))).alias("north"))


def _conic_sql(code: str) -> str:
    c = projections.CONICS[code]
    e, n, scale, rho0 = c.shape
    return f"""
SELECT s_suppkey, floor(1000 * ({c.x0} + rho * sin(theta)) + 0.5) / 1000 AS east, floor(1000 * ({rho0!r} - rho * cos(theta) + {c.y0}) + 0.5) / 1000 AS north
FROM (SELECT s_suppkey, {n!r} * radians(lon - {c.lon0}) AS theta,
        {scale!r} * pow(tan(pi() / 4 - radians(lat) / 2) / pow((1 - {e!r} * sin(radians(lat))) / (1 + {e!r} * sin(radians(lat))), {e / 2!r}), {n!r}) AS rho
      FROM (SELECT s_suppkey, s_nationkey::DOUBLE - 5 AS lon, 45 + s_acctbal::DOUBLE / 1000 AS lat FROM supplier))"""


@query("crs_conic", _conic_sql("epsg:3034"))
def crs_conic(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "supplier").select("s_suppkey", G.point(F.col("s_nationkey").cast("double") - 5, F.col("s_acctbal").cast("double") / 1000 + 45).alias("geometry"))
    moved = adapter.transform_crs(points, "geometry", "EPSG:4326", "EPSG:3034")
    mm = lambda c: F.floor(c * 1000 + 0.5) / 1000
    return moved.select("s_suppkey", mm(G.x_of(F.col("geometry"))).alias("east"), mm(G.y_of(F.col("geometry"))).alias("north"))
