"""Spatial joins by tiles, and aggregates over them.

Both sides are dealt to the tiles that their envelopes overlap and joined on
the tile, an equi-join that Spark can shuffle, broadcast or split where it is
skewed; exact predicates refine the pairs.  Tiles come in levels, each twice as
wide as the one below, and a geometry belongs to the level whose tiles are just
as large as it is, so it has four tiles at most whatever the others' sizes; a
pair meets on the level of its larger geometry, to which the smaller one is
dealt too.  A pair that shares several tiles is kept in the one with the lower
left corner of what the envelopes have in common, so nothing needs to be made
distinct.  Tiles of coarse levels, which are few, are cut into parts where many
small geometries meet large ones.

Equal geometries of a side are judged together: a row of the join is a geometry
with the list of the rows that have it, and pairs of rows are made from the lists
of the pairs of geometries that are left.  Where many rows are at one place, they
are in several lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..enums import AggregationType, GeoRelationship
from ..errors import InvalidParameters
from ..functions import geometry as G
from ..functions.relate import distance_between, related
from .grid import aggregates


#: Tiles of the lowest level on a side of the box.
FINEST = 1 << 16
#: Smaller geometries that a tile, or a part of one, should hold at most.
TILE_ROWS = 1 << 17
#: Rows that the list of a geometry should hold at most.
LIST_ROWS = 1 << 12

#: Kinds of geometries: what their envelopes alone, or native expressions, decide.
POINT, BOX, AREA, OTHER = range(4)


def _grouped(df: DataFrame, geometry: str, side: str, grown: Column | None) -> tuple[DataFrame, DataFrame]:
    """The geometries of all rows that have one, as ``_g`` with their margin
    ``_w``; and each different one once for each of its lists ``_m``, which hold
    the other columns of the rows.  The hash of a row says which of a geometry's
    lists it is in (``_c``), so the same rows are in it whenever it is made."""
    g, c, m = f"_g{side}", f"_c{side}", f"_m{side}"
    own = [F.col(f"`{n}`") for n in _others(df, geometry)]
    hashable = [F.col(f"`{n}`") for n, kind in df.dtypes if n in _others(df, geometry) and "map<" not in kind and "variant" not in kind]
    listed = F.struct(*own) if own else F.struct(F.lit(0).alias("_"))
    row = F.xxhash64(*hashable) if hashable else F.lit(0)
    margin = F.lit(0.0) if grown is None else grown
    # a generator, as below
    rows = df.select(listed.alias(m), row.alias("_n"), margin.alias("_w"), F.explode(F.array(F.col(f"`{geometry}`"))).alias(g))
    rows = rows.filter(F.col(g).isNotNull()).withColumn("_h", F.xxhash64(g))
    lists = rows.groupBy("_h").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("_l")).filter("_l > 1")
    dealt = rows.join(F.broadcast(lists), "_h", "left").withColumn(c, F.expr("coalesce(pmod(_n, _l), 0)::int"))
    return rows.select(g, "_w"), dealt.groupBy("_h", g, c, "_w").agg(F.collect_list(m).alias(m)).drop("_h")


def _others(df: DataFrame, geometry: str) -> list[str]:
    """The columns but for the geometry, which may be named in another case."""
    same = str.__eq__ if geometry in df.columns else lambda a, b: a.lower() == b.lower()
    return [n for n in df.columns if not same(n, geometry)]


def _sized(df: DataFrame, geometry: str, grown: Column | None) -> DataFrame:
    """``df`` with ``_s``: the envelope, grown by a margin, the kind, and the
    powers of two that the envelope's sides don't exceed."""
    g, margin = f"`{geometry}`", F.lit(0.0) if grown is None else grown
    kind = f"CASE WHEN {g}.type = 'POINT' THEN {POINT} WHEN _s.q THEN {BOX} WHEN {g}.type IN ('POLYGON', 'MULTIPOLYGON') THEN {AREA} ELSE {OTHER} END"
    power = "coalesce(ceil(log2(nullif(_s.e.{0}max - _s.e.{0}min, 0D))), -1100)::int AS {0}"
    # generators, as filters on what they make are not moved below them, where each would make the geometry anew
    made = F.explode(F.array(F.struct(G.envelope(F.col(geometry)).alias("e"), G.is_rectangle(F.col(geometry)).alias("q"), margin.alias("m"))))
    rows = df.filter(f"{g} IS NOT NULL").select("*", made.alias("_s"))
    rows = rows.withColumn("_s", F.expr(f"struct(struct(_s.e.xmin - _s.m AS xmin, _s.e.ymin - _s.m AS ymin, _s.e.xmax + _s.m AS xmax, _s.e.ymax + _s.m AS ymax) AS e, {kind} AS k)"))
    return rows.withColumn("_s", F.expr(f"struct(_s.e AS e, _s.k AS k, {power.format('x')}, {power.format('y')})"))


def _summary(sized: DataFrame, count: Column) -> DataFrame:
    """The box of all geometries, the powers of two of its finest tiles' sides,
    and the sizes that occur (some hundreds at most) with their counts: one row."""
    corners = ["xmin", "ymin", "xmax", "ymax"]
    of_size = sized.groupBy(F.col("_s.x").alias("x"), F.col("_s.y").alias("y")).agg(*(F.expr(f"{c[1:]}(_s.e.{c}) AS {c}") for c in corners), count.alias("n"))
    box = of_size.agg(*(F.expr(f"{c[1:]}({c}) AS {c}") for c in corners), F.expr("collect_list(struct(x, y, n)) AS sizes"))
    finest = f"coalesce(floor(log2(nullif(({{0}}max - {{0}}min) / {FINEST}, 0D))), 0)::int AS {{0}}"
    return box.select(F.expr(f"struct({', '.join(corners)}, {finest.format('x')}, {finest.format('y')}, sizes)").alias("s"))


def _tiling(summary1: DataFrame, summary2: DataFrame, by_right: bool) -> Column:
    """One value of the plan: the box of one side, the levels of each (``levels1,
    levels2``) and ``salts``, the number of parts into which a tile of a role and
    level is cut, where that is more than one.

    A tile gets as many parts as bring the smaller geometries that meet on its
    level, spread evenly over the box, down to ``TILE_ROWS`` each.  Larger ones
    are repeated for each part, once for ``TILE_ROWS`` of the pairs they are in.

    Tiles have the proportions of the most frequent size, not of the box: in a
    long and narrow box, geometries as high as the box would otherwise have tiles
    as long as it.
    """
    f = "b" if by_right else "a"
    both = summary1.select(F.col("s").alias("a"), summary2.scalar().alias("b"))
    wider = f"s -> struct(s.n AS n, greatest(s.x - {f}.x, 0) - greatest(s.y - {f}.y, 0) AS by)"
    both = both.withColumn("w", F.expr(f"coalesce(array_max(transform(filter(concat(a.sizes, b.sizes), s -> greatest(s.x - {f}.x, s.y - {f}.y) > 0), {wider})).by, 0)"))
    both = both.selectExpr(f"struct({f}.xmin, {f}.ymin, {f}.xmax, {f}.ymax, {f}.x + greatest(w, 0) AS x, {f}.y + greatest(-w, 0) AS y) AS f", "a", "b")
    levels = lambda side: f"transform({side}.sizes, s -> struct(greatest(s.x - f.x, s.y - f.y, 0) AS level, s.n AS n))"
    both = both.selectExpr("f", f"{levels('a')} AS a", f"{levels('b')} AS b")
    both = both.selectExpr("f", "a", "b", "array_distinct(a.level) AS levels1", "array_distinct(b.level) AS levels2")
    across = lambda c: f"greatest(ceil((f.{c}max - f.{c}min) / pow(2D, v + f.{c})), 1)"
    met = lambda side, test: f"aggregate(filter({side}, s -> s.level {test} v), 0L, (t, s) -> t + s.n)"
    parts = lambda role, own, side, test: f"transform({own}, v -> struct(struct({role} AS role, v AS level) AS k, ceil({met(side, test)} / ({across('x')} * {across('y')} * {TILE_ROWS}))::int AS n))"
    salts = f"map_from_entries(filter(concat({parts(0, 'levels1', 'b', '<=')}, {parts(1, 'levels2', 'a', '<')}), e -> e.n > 1))"
    return both.select(F.expr(f"struct(f.xmin, f.ymin, f.xmax, f.ymax, f.x, f.y, levels1, levels2, {salts} AS salts)")).scalar()


def _tile(v: str, axis: str) -> str:
    return f"floor(({v} - _f.{axis}min) / pow(2D, _r.level + _f.{axis}))::bigint"


def _dealt(sized: DataFrame, side: str, tiling: Column, upper: str) -> DataFrame:
    """A row for each tile of each role.  Role 0: the left geometry is as large
    or larger; 1: the right one is.  A geometry stands on its own level, if the
    other side has smaller ones, and on the levels of the other side's larger
    ones (``upper`` compares them with its own).  Where tiles have parts, the
    smaller one is in the part that its row's hash names, the larger one in all."""
    own = [f"`{c}`" for c in sized.columns if c != "_s"]
    lists = [f"_g{side}", f"_c{side}"]  # a list itself is in any order
    hashable = lists if lists[1] in sized.columns else [f"`{c}`" for c, kind in sized.drop("_s").dtypes if "map<" not in kind and "variant" not in kind]
    mine = 0 if side == "1" else 1
    e, others = f"_e{side}", f"_f.levels{2 - mine}"
    rows = sized.select(*own, F.col("_s.e").alias(e), F.col("_s.k").alias(f"_k{side}"), tiling.alias("_f"), "_s")
    rows = rows.filter(f"{e}.xmin <= _f.xmax AND {e}.xmax >= _f.xmin AND {e}.ymin <= _f.ymax AND {e}.ymax >= _f.ymin")
    rows = rows.selectExpr(*own, e, f"_k{side}", "_f", "greatest(_s.x - _f.x, _s.y - _f.y, 0) AS _l")
    alone = f"filter(array(struct({mine} AS role, _l AS level)), r -> exists({others}, v -> NOT v {upper} _l))"
    raised = f"transform(filter({others}, v -> v {upper} _l), v -> struct({1 - mine} AS role, v AS level))"
    rows = rows.selectExpr(*own, e, f"_k{side}", "_f", f"explode(concat({alone}, {raised})) AS _r")
    parts = "_f.salts[_r]"
    part = f"CASE WHEN {parts} IS NULL THEN array(0) WHEN _r.role = {mine} THEN sequence(0, {parts} - 1) ELSE array(pmod(xxhash64({', '.join(hashable)}), {parts})::int) END"
    across = lambda axis: f"explode(sequence({_tile(f'{e}.{axis}min', axis)}, {_tile(f'{e}.{axis}max', axis)})) AS _t{axis}"
    rows = rows.selectExpr("*", f"explode({part}) AS _p").selectExpr("*", across("x")).selectExpr("*", across("y"))
    return rows if mine == 0 else rows.drop("_f")


#: Whether the insides of two envelopes meet; whether one lies in the other.
_STRICTLY = "(_e1.xmin < _e2.xmax AND _e2.xmin < _e1.xmax AND _e1.ymin < _e2.ymax AND _e2.ymin < _e1.ymax)"
_WITHIN = "({0}.xmin >= {1}.xmin AND {0}.xmax <= {1}.xmax AND {0}.ymin >= {1}.ymin AND {0}.ymax <= {1}.ymax)"


def _simple(geometry1: str, geometry2: str, relation: GeoRelationship) -> str:
    """The predicate of a pair whose envelopes meet, if envelopes decide it or a
    point is one of the two; else null."""
    contains, within = relation is GeoRelationship.CONTAINS, relation is GeoRelationship.WITHIN
    in_box = lambda p, q: f"CASE WHEN _k{q} = {POINT} THEN {_STRICTLY} WHEN _k{p} = {POINT} THEN false ELSE {_WITHIN.format(f'_e{q}', f'_e{p}')} END"
    boxes = {GeoRelationship.INTERSECTS: "true", GeoRelationship.TOUCHES: f"NOT {_STRICTLY}", GeoRelationship.CONTAINS: in_box(1, 2), GeoRelationship.WITHIN: in_box(2, 1)}[relation]
    two_points = str(relation is not GeoRelationship.TOUCHES).lower()  # their envelopes meet
    at_point = {GeoRelationship.INTERSECTS: G.COVERS_POINT, GeoRelationship.TOUCHES: G.ON_BOUNDARY}.get(relation, G.CONTAINS_POINT)
    test = lambda area, point: at_point.format(g=f"`{area}`", x=f"`{point}`.rings[0][0].x", y=f"`{point}`.rings[0][0].y")
    return f"""CASE WHEN _k1 = {POINT} AND _k2 = {POINT} THEN {two_points} WHEN _k1 <= {BOX} AND _k2 <= {BOX} THEN {boxes}
      WHEN _k1 = {AREA} AND _k2 = {POINT} THEN {"false" if within else test(geometry1, geometry2)}
      WHEN _k1 = {POINT} AND _k2 = {AREA} THEN {"false" if contains else test(geometry2, geometry1)} END"""


def _met(a: DataFrame, b: DataFrame, tiling: Column) -> DataFrame:
    """The pairs whose envelopes share a point, with the envelopes and kinds; each
    pair once."""
    a, b = _dealt(a, "1", tiling, ">"), _dealt(b, "2", tiling, ">=")
    met = a.join(b, ["_r", "_p", "_tx", "_ty"])
    overlap = "_e1.xmin <= _e2.xmax AND _e2.xmin <= _e1.xmax AND _e1.ymin <= _e2.ymax AND _e2.ymin <= _e1.ymax"
    corner = " AND ".join(f"{_tile(f'greatest(_e1.{c}min, _e2.{c}min)', c)} = _t{c}" for c in "xy")
    return met.filter(f"{overlap} AND {corner}").drop("_r", "_p", "_tx", "_ty", "_f")


_HELPERS = ("_e1", "_e2", "_k1", "_k2")
#: Pairs that noding decides.
_GENERAL = f"NOT (_k1 <= {BOX} AND _k2 <= {BOX} OR greatest(_k1, _k2) = {AREA} AND least(_k1, _k2) = {POINT})"


def _noded(geometry1: str, geometry2: str, relation: GeoRelationship) -> Column:
    only = lambda g: F.expr(f"CASE WHEN {_GENERAL} THEN `{g}` END")
    return related(only(geometry1), only(geometry2), relation.value)


def _listed(
    left: DataFrame, right: DataFrame, geometry1: str, geometry2: str, by_right: bool, first: str, judged: Callable[[DataFrame], DataFrame], grown: Column | None = None
) -> DataFrame:
    """The pairs of rows of the pairs of geometries that pass ``first`` and are
    left by ``judged``, all columns of both and those that it adds.  What is
    dear, and the making of pairs of rows, is done after the pairs of geometries
    were dealt anew, as few of them may make many rows."""
    (every1, a), (every2, b) = _grouped(left, geometry1, "1", grown), _grouped(right, geometry2, "2", None)
    a, b = _sized(a, "_g1", F.col("_w")), _sized(b.drop("_w"), "_g2", None)
    different = lambda g: F.approx_count_distinct(F.xxhash64(g))
    tiling = _tiling(_summary(_sized(every1, "_g1", F.col("_w")), different("_g1")), _summary(_sized(every2, "_g2", None), different("_g2")), by_right)
    met = _met(a, b, tiling).filter(first)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = judged(met.repartition(tasks, "_g1", "_c1", "_g2", "_c2"))
    added = [c for c in found.columns if c not in met.columns]
    rows = found.select("_g1", "_g2", "_m2", *added, F.explode("_m1").alias("_m1")).select("_g1", "_g2", "_m1", *added, F.explode("_m2").alias("_m2"))
    columns = lambda df, geometry, k: [(F.col(f"_m{k}").getField(n) if n in _others(df, geometry) else F.col(f"_g{k}")).alias(n) for n in df.columns if n not in added]
    return rows.select(*columns(left, geometry1, 1), *columns(right, geometry2, 2), *added)


def related_rows(left: DataFrame, right: DataFrame, geometry1: str, geometry2: str, relation: GeoRelationship, **also: Callable[[Column, Column], Column]) -> DataFrame:
    """``spatial_join`` with more columns, functions of the two geometries that
    are computed once for each pair of different ones."""
    relation = GeoRelationship(relation)

    simple = _simple("_g1", "_g2", relation)

    def judged(met: DataFrame) -> DataFrame:
        found = met.withColumn("_x", _noded("_g1", "_g2", relation)).filter(f"CASE WHEN {_GENERAL} THEN _x ELSE {simple} END").drop("_x")
        return found.withColumns({name: f(F.col("_g1"), F.col("_g2")) for name, f in also.items()}) if also else found

    first = f"CASE WHEN _k1 <= {BOX} AND _k2 <= {BOX} THEN {simple} ELSE true END"
    return _listed(left, right, geometry1, geometry2, relation is GeoRelationship.WITHIN, first, judged)


def spatial_join(left: DataFrame, right: DataFrame, geometry1: str, geometry2: str, relation: GeoRelationship) -> DataFrame:
    """The pairs of rows with ``geometry1`` in ``relation`` to ``geometry2``, all
    columns of both; rows without a geometry have none.

    The box of the containing side (of the left one in general) sets the tiles;
    what lies outside it is dropped before anything is shuffled.  Box and levels
    are values of the plan, so nothing runs before the result is asked for.
    Rectangles and points are decided by native expressions, any other pair by
    noding (``functions.relate``).
    """
    return related_rows(left, right, geometry1, geometry2, relation)


def _joined(left: DataFrame, right: DataFrame, geometry1: str, geometry2: str, relation: GeoRelationship) -> DataFrame:
    """The same row by row, for points in cells, where a pair is judged at no
    more cost than a row is put into a list."""
    relation = GeoRelationship(relation)
    a, b = _sized(left, geometry1, None), _sized(right, geometry2, None)
    tiling = _tiling(_summary(a, F.count("*")), _summary(b, F.count("*")), relation is GeoRelationship.WITHIN)
    met = _met(a, b, tiling).withColumn("_x", _noded(geometry1, geometry2, relation))
    return met.filter(f"CASE WHEN {_GENERAL} THEN _x ELSE {_simple(geometry1, geometry2, relation)} END").drop("_x", *_HELPERS)


#: The least and greatest coordinates of a point or rectangle; the gap of two of them.
_LEAST = "least({g}.rings[0][0].{c}, get({g}.rings[0], 2).{c})"
_MOST = _LEAST.replace("least", "greatest")
_GAP = f"greatest({_LEAST.format(g='_g1', c='{c}')} - {_MOST.format(g='_g2', c='{c}')}, {_LEAST.format(g='_g2', c='{c}')} - {_MOST.format(g='_g1', c='{c}')}, 0D)"


def distance_join(left: DataFrame, right: DataFrame, geometry1: str, geometry2: str, radius: float | Column, name: str = "distance") -> DataFrame:
    """The pairs of rows whose geometries are at most ``radius`` apart, with the
    distance.  Envelopes of the left side, grown by the radius, meet the right
    one's on the tiles, so no product is formed.  The radius may be a value of the
    plan, such as a scalar subquery."""
    if not isinstance(radius, Column):
        if not radius >= 0:
            raise InvalidParameters("the radius is a number from 0")
        radius = F.lit(float(radius))
    plain = f"greatest(_k1, _k2) <= {BOX}"
    x, y = F.expr(_GAP.format(c="x")), F.expr(_GAP.format(c="y"))

    def judged(met: DataFrame) -> DataFrame:
        only = lambda g: F.expr(f"CASE WHEN NOT {plain} THEN {g} END")
        far = met.withColumn("_x", distance_between(only("_g1"), only("_g2")))
        return far.withColumn(name, F.when(F.expr(plain), F.sqrt(x * x + y * y)).otherwise(F.col("_x"))).filter(F.col(name) <= F.col("_w")).drop("_x")

    return _listed(left, right, geometry1, geometry2, True, "true", judged, radius)


def aggregate_st_dfs(
    dataset1: DataFrame, dataset2: DataFrame, geometry1: str, geometry2: str, id1: str, id2: str, relation: GeoRelationship,
    columns_to_aggregate: list[str], column_aggregation_types: list[AggregationType], column_alias_list: list[str] | None = None, ordered: bool = True,
) -> DataFrame:
    """Aggregates of the second side's columns by ``(id2, id1)`` over the pairs
    of the join; geometries without a partner are absent."""
    joined = _joined(dataset1.select(id1, geometry1), dataset2.select(*dict.fromkeys([id2, geometry2, *columns_to_aggregate])), geometry1, geometry2, relation)
    out = joined.groupBy(id2, id1).agg(*aggregates(columns_to_aggregate, column_aggregation_types, column_alias_list))
    return out.orderBy(id2, id1) if ordered else out


def aggregate_spatial_dfs(
    dataset1: DataFrame, dataset2: DataFrame, geometry1: str, geometry2: str, id1: str, relation: GeoRelationship,
    columns_to_aggregate: list[str], column_aggregation_types: list[AggregationType], column_alias_list: list[str] | None = None, ordered: bool = True,
) -> DataFrame:
    """The same by ``id1`` alone."""
    joined = _joined(dataset1.select(id1, geometry1), dataset2.select(*dict.fromkeys([geometry2, *columns_to_aggregate])), geometry1, geometry2, relation)
    out = joined.groupBy(id1).agg(*aggregates(columns_to_aggregate, column_aggregation_types, column_alias_list))
    return out.orderBy(id1) if ordered else out


def points_in_grid(points: DataFrame, geometry: str, box: tuple[float, float, float, float] | None, partitions_x: int, partitions_y: int) -> DataFrame:
    """The points that a cell of the grid over ``box`` (xmin, ymin, xmax, ymax;
    without one, the points' own) contains, with their ``cell_id``: what
    ``spatial_join`` with CONTAINS gives for generated cells, without any join.
    Points on an edge are in no cell."""
    x, y = G.x_of(F.col(geometry)), G.y_of(F.col(geometry))
    if box is None:
        b = points.agg(F.struct(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))).scalar()
    else:
        b = F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("xmin", "ymin", "xmax", "ymax"), box, strict=True)))
    rows = points.withColumn("_b", b)

    def place(v: Column, axis: str, n: int) -> Column:
        # the division may be off by one at an edge, so its neighbours are tried
        low, step = F.col(f"_b.{axis}min"), (F.col(f"_b.{axis}max") - F.col(f"_b.{axis}min")) / n
        guess = F.floor((v - low) / step)
        inside = lambda k: (k >= 0) & (k < n) & (v > low + step * k) & (v < low + step * (k + 1))
        return F.coalesce(*(F.when(inside(guess + d), guess + d) for d in (0, -1, 1)))

    rows = rows.withColumns({"_i": place(x, "x", partitions_x), "_j": place(y, "y", partitions_y)}).filter("_i IS NOT NULL AND _j IS NOT NULL")
    return rows.withColumn("cell_id", (F.col("_j") * partitions_x + F.col("_i")).cast("int")).drop("_b", "_i", "_j")
