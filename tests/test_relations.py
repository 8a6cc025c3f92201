"""Relations, common borders, distances and hulls of geometries of any kind."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.enums import GeoRelationship
from gridloom.errors import InvalidParameters
from gridloom.functions import geometry, relate, texture
from gridloom.operators import adjacency, extent, spatial_join

U = "POLYGON ((0 0, 10 0, 10 10, 8 10, 8 2, 2 2, 2 10, 0 10, 0 0))"
HOLED = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
BOX = "POLYGON (({0} {1}, {2} {1}, {2} {3}, {0} {3}, {0} {1}))"


def box(*corners):
    return BOX.format(*corners)


#: First, second, and whether the first contains, is within, touches or intersects it.
CASES = [
    (HOLED, box(2, 2, 8, 8), "i"),
    (HOLED, box(4, 4, 6, 6), "ti"),
    (HOLED, box(0, 0, 4, 4), "ci"),
    (HOLED, box(4.5, 4.5, 5.5, 5.5), ""),
    (U, box(2, 2, 8, 10), "ti"),
    (U, box(2, 5, 8, 7), "ti"),
    (U, box(3, 5, 7, 7), ""),
    (U, box(1, 5, 9, 7), "i"),
    (U, U, "cwi"),
    (U, "POLYGON ((0 10, 2 10, 2 2, 8 2, 8 10, 10 10, 10 0, 0 0, 0 10))", "cwi"),
    (box(0, 0, 1, 1), box(1, 1, 2, 2), "ti"),
    ("POLYGON ((0 0, 0.3 0.1, 0.1 0.3, 0 0))", "POLYGON ((0.3 0.1, 0.6 0.6, 0.1 0.3, 0.3 0.1))", "ti"),
    (U, "LINESTRING (1 9, 9 9)", "i"),
    (U, "LINESTRING (2 5, 8 5)", "ti"),
    (U, "LINESTRING (0 0, 10 0)", "ti"),
    (U, "LINESTRING (1 9, 1 1, 9 1)", "ci"),
    (U, "LINESTRING (3 5, 7 7)", ""),
    ("LINESTRING (0 0, 4 4)", "LINESTRING (0 4, 4 0)", "i"),
    ("LINESTRING (0 0, 4 4)", "LINESTRING (4 4, 8 0)", "ti"),
    ("LINESTRING (0 0, 4 4)", "LINESTRING (2 2, 8 0)", "ti"),
    ("LINESTRING (0 0, 4 4)", "LINESTRING (1 1, 3 3)", "ci"),
    ("LINESTRING (0 0, 4 4)", "LINESTRING (3 3, 6 6)", "i"),
    ("LINESTRING (0 0, 4 0, 4 4, 0 0)", "LINESTRING (0 0, -1 -1)", "ti"),
    ("MULTILINESTRING ((0 0, 1 0), (1 0, 2 0))", "LINESTRING (0 0, 2 0)", "cwi"),
    ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((2 2, 3 2, 3 3, 2 3, 2 2)))", box(0, 0, 1, 1), "ci"),
    ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((2 2, 3 2, 3 3, 2 3, 2 2)))", box(1, 1, 2, 2), "ti"),
    ("MULTIPOINT (1 1, 20 20)", U, "i"),
    ("MULTIPOINT (1 1, 9 9)", U, "wi"),
    ("MULTIPOINT (0 0, 20 20)", U, "ti"),
    ("MULTIPOINT (0 0, 1 1)", "MULTIPOINT (1 1)", "ci"),
    ("LINESTRING (0 0, 4 4)", "MULTIPOINT (0 0, 4 4)", "ti"),
    ("POINT (1 1)", U, "wi"),
    ("POINT (2 5)", U, "ti"),
    ("POINT (2 2)", "LINESTRING (0 0, 4 4)", "wi"),
    ("POINT (3 2)", "LINESTRING (0 0, 4 4)", ""),
    ("POINT (1 1)", "POINT (1 1)", "cwi"),
    ("POINT (1 1)", box(0, 0, 2, 2), "wi"),
    (box(0, 0, 4, 4), box(1, 1, 2, 2), "ci"),
]
NAMES = {"c": GeoRelationship.CONTAINS, "w": GeoRelationship.WITHIN, "t": GeoRelationship.TOUCHES, "i": GeoRelationship.INTERSECTS}


def geometries(spark, texts, id_name="id", name="g"):
    return spark.createDataFrame(list(enumerate(texts)), f"{id_name} int, wkt string").select(id_name, geometry.from_wkt(F.col("wkt")).alias(name))


@pytest.mark.parametrize("letter", NAMES)
def test_relations_of_known_pairs(spark, letter):
    back = {"c": "w", "w": "c", "t": "t", "i": "i"}[letter]
    a, b = geometries(spark, [c[0] for c in CASES]), geometries(spark, [c[1] for c in CASES], "id2", "h")
    got = {r.id for r in spatial_join.spatial_join(a, b, "g", "h", NAMES[letter]).filter("id = id2").collect()}
    turned = {r.id for r in spatial_join.spatial_join(b, a, "h", "g", NAMES[back]).filter("id = id2").collect()}
    expected = {i for i, (*_, holds) in enumerate(CASES) if letter in holds}
    assert got == expected and turned == expected


def test_rows_without_geometry_and_empty_sides_meet_nothing(spark):
    some, none = geometries(spark, [U, "nonsense"]), geometries(spark, [], "id2", "h")
    assert spatial_join.spatial_join(some, none, "g", "h", GeoRelationship.INTERSECTS).count() == 0
    assert spatial_join.spatial_join(none, some, "h", "g", GeoRelationship.INTERSECTS).count() == 0
    assert spatial_join.spatial_join(some, geometries(spark, [U], "id2", "h"), "g", "h", GeoRelationship.INTERSECTS).count() == 1


def cells_of(shape_id, rng):
    """A polygon of whole cells, as (cells, rings by part)."""
    n, x, y = rng.randrange(1, 4), rng.randrange(12), rng.randrange(12)
    parts = [
        ([(0, 0), (1, 0), (2, 0), (0, 1), (2, 1), (0, 2), (2, 2)], [[(0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3), (0, 0)]]),
        ([(i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1)], [[(0, 0), (3, 0), (3, 3), (0, 3), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]]),
        ([(0, 0), (1, 0), (1, 1)], [[(0, 0), (2, 0), (2, 2), (1, 2), (1, 1), (0, 1), (0, 0)]]),
        ([(0, 0)], [[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]]),
    ]
    cells, rings = parts[shape_id % len(parts)]
    own = {(x + i * n + u, y + j * n + v) for i, j in cells for u in range(n) for v in range(n)}
    return own, [np.array([(x + i * n, y + j * n) for i, j in r], float) for r in rings]


@pytest.mark.parametrize("turned", [np.eye(2), np.array([[3.0, 1.0], [-1.0, 3.0]]), np.array([[0.5, -0.25], [0.75, 2.0]])])
def test_relations_and_lengths_equal_those_of_cells(turned):
    """Also slanted by a linear map of which no corner is rounded."""
    rng = random.Random(4)
    made = [cells_of(i, rng) for i in range(160)]
    shapes = [relate.shape("POLYGON", [r @ turned for r in rings]) for _, rings in made]
    pairs = [(i, j) for i in range(160) for j in range(0, 160, 3)]
    got = relate.relate([shapes[i] for i, _ in pairs], [shapes[j] for _, j in pairs])
    corners = [{(x + dx, y + dy) for x, y in cells for dx in (0, 1) for dy in (0, 1)} for cells, _ in made]
    for k, (i, j) in enumerate(pairs):
        a, b = made[i][0], made[j][0]
        expected = (bool(corners[i] & corners[j]), bool(a & b), b <= a, a <= b)
        assert (got.meet[k], got.inner[k], got.covers[k], got.covered[k]) == expected, (made[i], made[j])
        if a == b:
            assert got.length[k] == pytest.approx(sum(np.hypot(*(r @ turned)[1:].T - (r @ turned)[:-1].T).sum() for r in made[i][1]))


def test_sides_are_told_exactly():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = [(rng.choice([0.1, 0.3, 1.7, 1e-9, rng.random()]), rng.random()) for _ in range(2)]
        t = rng.random()
        c = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
        six = [np.array([v]) for v in (*a, *b, *c)]
        ax, ay, bx, by, cx, cy = map(Fraction, (*a, *b, *c))
        exact = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        assert np.sign(relate.turn(*six)[0]) == (exact > 0) - (exact < 0)


def test_common_length_of_overlap_border_and_lines(spark):
    pairs = [(box(0, 0, 10, 10), box(5, 5, 15, 15), 20.0), (box(0, 0, 1, 1), box(1, 0, 2, 1), 1.0), (box(0, 0, 1, 1), box(1, 1, 2, 2), 0.0), (U, box(2, 2, 8, 10), 22.0), (U, "LINESTRING (-5 1, 20 1)", 10.0)]
    a, b = geometries(spark, [p[0] for p in pairs]), geometries(spark, [p[1] for p in pairs], "id", "h")
    got = a.join(b, "id").select("id", relate.common_length(F.col("g"), F.col("h")).alias("n")).orderBy("id").collect()
    assert [r.n for r in got] == [p[2] for p in pairs]
    two = geometries(spark, [box(0, 0, 10, 10), box(5, 5, 15, 15)])
    assert {(r.id, r.nbr_id): r.weight for r in adjacency.border_shares(two, "id", "g").collect()} == {(0, 0): 1.0, (1, 1): 1.0, (0, 1): 0.5, (1, 0): 0.5}


def points(spark, n, seed, spread=100.0):
    rng = random.Random(seed)
    rows = [(i, rng.random() * spread, rng.random() * spread) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, x double, y double").select("id", geometry.point(F.col("x"), F.col("y")).alias("p"))


def test_distance_join_equals_all_pairs(spark):
    rows, df = points(spark, 300, 1)
    other = df.select(F.col("id").alias("id2"), F.col("p").alias("q"))
    got = {(r.id, r.id2): r.distance for r in spatial_join.distance_join(df, other, "p", "q", 7.5).collect()}
    far = {(a[0], b[0]): math.hypot(a[1] - b[1], a[2] - b[2]) for a in rows for b in rows}
    assert got == pytest.approx({k: d for k, d in far.items() if d <= 7.5})
    with pytest.raises(InvalidParameters):
        spatial_join.distance_join(df, other, "p", "q", -1.0)


def test_distances_of_polygons_and_lines(spark):
    a = geometries(spark, [U] * 4)
    b = geometries(spark, [box(4, 5, 6, 7), box(13, 14, 20, 20), "LINESTRING (20 0, 20 9)", "POINT (5 5)"], "id2", "h")
    got = {r.id2: r.distance for r in spatial_join.distance_join(a, b, "g", "h", 30.0).filter("id = 0").collect()}
    assert got == pytest.approx({0: 2.0, 1: 5.0, 2: 10.0, 3: 3.0})


def test_near_weights_are_those_of_all_pairs(spark):
    _, df = points(spark, 200, 2)
    every = {(r.id, r.nbr_id): r.weight for r in adjacency.point_weights(df, "id", "p").collect()}
    near = {(r.id, r.nbr_id): r.weight for r in adjacency.near_weights(df, "id", "p", least=0.98).collect()}
    assert near == pytest.approx({k: w for k, w in every.items() if w >= 0.98}) and len(near) < len(every) / 10


def test_many_points_meet_without_a_product(spark):
    _, df = points(spark, 100_000, 3, 10_000.0)
    other = df.select(F.col("id").alias("id2"), F.col("p").alias("q"))
    near = spatial_join.distance_join(df, other, "p", "q", 5.0)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert 100_000 < near.count() < 300_000


@pytest.mark.parametrize("relation", [GeoRelationship.CONTAINS, GeoRelationship.INTERSECTS, GeoRelationship.WITHIN])
def test_tiles_in_parts_give_each_pair_once(spark, monkeypatch, relation):
    rng = random.Random(4)
    corners = [(rng.uniform(0, 60), rng.uniform(0, 60), size) for size in (40, 40, 30, 11, 3, 3, 0.5)]
    shapes = geometries(spark, [box(x, y, x + s, y + s) for x, y, s in corners])
    # rows that are repeated, and others at one place
    rows, df = points(spark, 400, 8)
    spots = df.select(F.col("id").alias("id2"), F.col("p").alias("h"))
    spots = spots.union(spots.filter("id2 % 3 = 0")).union(spots.select("id2", F.lit(None).cast(spots.schema["h"].dataType)))
    sides = (spots, shapes, "h", "g") if relation is GeoRelationship.WITHIN else (shapes, spots, "g", "h")
    pairs = lambda: sorted((r.id, r.id2) for r in spatial_join.spatial_join(*sides, relation).select("id", "id2").collect())
    inside = [(k, i) for i, px, py in rows for k, (x, y, s) in enumerate(corners) if x < px < x + s and y < py < y + s]
    expected = sorted(inside + [(k, i) for k, i in inside if i % 3 == 0])
    for most in (20, 1):
        monkeypatch.setattr(spatial_join, "TILE_ROWS", most)
        assert pairs() == expected


def test_diameter_equals_all_pairs(spark):
    rng = random.Random(7)
    for n in (1, 2, 3, 10, 200):
        for grid in (False, True):
            pts = [(rng.randrange(5), rng.randrange(5)) if grid else (rng.random(), rng.random()) for _ in range(n)]
            widest = extent.widest(extent.hull(np.array(pts, float)))
            assert widest == pytest.approx(max(math.dist(a, b) for a in pts for b in pts))
    rows, df = points(spark, 500, 8)
    got = extent.greatest_distance(df.repartition(7), F.col("p")["rings"][0][0]).first().d
    assert got == pytest.approx(max(math.dist(a[1:], b[1:]) for a in rows for b in rows))
    assert extent.greatest_distance(df.filter("false"), F.col("p")["rings"][0][0]).collect() == []


def textures_by_force(image):
    h, w = image.shape
    means = []
    for dr, dc in texture.STEPS.values():
        pairs = [(image[r, c], image[r + dr, c + dc]) for r in range(h - dr) for c in range(w - dc)]
        pairs += [(j, i) for i, j in pairs]
        n = len(pairs)
        p = {}
        for ij in pairs:
            p[ij] = p.get(ij, 0) + 1 / n
        mean = sum(i * q for (i, _), q in p.items())
        var = sum(q * (i - mean) ** 2 for (i, _), q in p.items())
        corr = sum(q * (i - mean) * (j - mean) for (i, j), q in p.items()) / var if var > 1e-15 else 1.0
        asm = sum(q * q for q in p.values())
        means.append([sum(q * (i - j) ** 2 for (i, j), q in p.items()), sum(q * abs(i - j) for (i, j), q in p.items()), sum(q / (1 + (i - j) ** 2) for (i, j), q in p.items()), asm, asm**0.5, corr])
    out = np.mean(means, axis=0)
    out[3] = (means[1][3] + means[2][3]) / 2
    return out


def test_textures_of_images_of_real_size(spark):
    rng = np.random.default_rng(0)
    small, large = rng.integers(0, 8, (12, 9)), rng.integers(0, 8, (384, 384))
    for image in (small, np.zeros((5, 5))):
        assert texture.features(image.astype(float)) == pytest.approx(textures_by_force(image))
    df = spark.createDataFrame([(1, large.ravel().tolist()), (2, None), (3, [1, 2])], "id int, levels array<int>")
    got = {r.id: r for r in texture.glcm_features(df, "id", "levels", 384, 384).collect()}
    assert [got[1][f] for f in texture.FEATURES] == pytest.approx(texture.features(large.astype(float)))
    assert got[2].contrast is None and got[3].asm is None
    shares = texture.cooccurrence(df.filter("id = 1"), "id", "levels", 384, 384).groupBy("angle").agg(F.sum("p").alias("p")).collect()
    assert {r.angle: round(r.p, 9) for r in shares} == {"0": 1.0, "45": 1.0, "90": 1.0}
