"""How two geometries of any kind lie to each other, by noding.

Each segment of one geometry is cut where the other's segments meet it, so a
piece between two cuts is inside, outside or along the other's boundary as a
whole, and its middle tells which.  Rings are turned so that a polygon's inside
is to the left; a piece along both boundaries then has the insides on one side
or on both.  Whether interiors meet, whether one covers the other and how long
the common boundary is all follow from the pieces.

On which side of a line a point is, is decided exactly; only the places of
crossings are rounded.  The pairs of an Arrow batch are worked on together, in
blocks of some ``BLOCK`` comparisons of segments.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 1 << 18
#: Pieces of a segment shorter than this share of it come from rounding.
SHORT = 1e-12
OUT, IN, SAME, OPPOSITE = range(4)


def _exact_turn(p: tuple[float, ...]) -> float:
    ax, ay, bx, by, cx, cy = map(Fraction, p)
    return float((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _product(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x * y`` and its rounding error."""
    halves = lambda v: (h := (t := 134217729.0 * v) - (t - v), v - h)
    (xh, xl), (yh, yl) = halves(x), halves(y)
    p = x * y
    return p, xl * yl - (((p - xh * yh) - xl * yh) - xh * yl)


def turn(ax, ay, bx, by, cx, cy) -> np.ndarray:
    """Twice the area of a triangle, above 0 if counterclockwise; the sign is exact."""
    dx, dy, ex, ey = bx - ax, cy - ay, by - ay, cx - ax
    left, right = dx * dy, ex * ey
    det = np.asarray(left - right)
    unsure = np.flatnonzero((np.abs(det) <= 3.4e-16 * (np.abs(left) + np.abs(right))) & ((left != 0) | (right != 0)))
    if len(unsure):
        six = [np.broadcast_to(v, det.shape).reshape(-1)[unsure] for v in (ax, ay, bx, by, cx, cy)]
        parts = [(six[2] - six[0], six[2], six[0]), (six[5] - six[1], six[5], six[1]), (six[3] - six[1], six[3], six[1]), (six[4] - six[0], six[4], six[0])]
        rounded = np.zeros(len(unsure), bool)
        for d, high, low in parts:  # whether a difference was rounded
            back = high - d
            rounded |= ((high - (d + back)) + (back - low)) != 0
        (p, pe), (q, qe) = _product(parts[0][0], parts[1][0]), _product(parts[2][0], parts[3][0])
        value = (p - q) + (pe - qe)
        rounded |= (value != 0) & (np.abs(value) < 1e-10 * (np.abs(pe) + np.abs(qe)))
        for i in np.flatnonzero(rounded).tolist():
            value[i] = _exact_turn(tuple(v[i] for v in six))
        det.reshape(-1)[unsure] = value
    return det


@dataclass
class Shape:
    """A geometry's segments ``a`` to ``b`` with the inside of polygons to the
    left, its points, and where its lines end."""

    dim: int
    points: np.ndarray
    a: np.ndarray
    b: np.ndarray
    ends: set[tuple[float, float]]


def shape(kind: str, rings: list[np.ndarray]) -> Shape:
    dim = 2 if kind.endswith("POLYGON") else 1 if kind.endswith("LINESTRING") else 0
    segments, ends = [], Counter()
    for i, r in enumerate(rings if dim else []):
        if dim == 2 and kind == "POLYGON":  # those of a MULTIPOLYGON are turned already
            x, y = r[:, 0] - r[0, 0], r[:, 1] - r[0, 1]
            if ((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() < 0) == (i == 0):
                r = r[::-1]
        if dim == 1:
            ends.update([tuple(r[0]), tuple(r[-1])])
        keep = (r[1:] != r[:-1]).any(axis=1)
        segments.append((r[:-1][keep], r[1:][keep]))
    none = np.empty((0, 2))
    a, b = (np.concatenate([s[k] for s in segments] or [none]) for k in (0, 1))
    if dim and not len(a):  # a line or ring of a single place
        dim = 0
    points = np.concatenate(rings) if rings and not dim else none
    return Shape(dim, points, a, b, {p for p, n in ends.items() if n % 2})


def _on(a: np.ndarray, b: np.ndarray, p: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether points are on segments, from the exact ``side``."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    return (side == 0) & ((p >= low) & (p <= high)).all(axis=-1)


def located(points: np.ndarray, g: Shape) -> np.ndarray:
    """2 for points in the interior of ``g``, 1 on its boundary, 0 elsewhere."""
    if g.dim == 0:
        own = set(map(tuple, g.points))
        return np.array([2 * (tuple(p) in own) for p in points], np.int8)
    out = np.zeros(len(points), np.int8)
    step = max(1, BLOCK // len(g.a))
    for i in range(0, len(points), step):
        p = points[i : i + step, None, :]
        side = turn(g.a[:, 0], g.a[:, 1], g.b[:, 0], g.b[:, 1], p[..., 0], p[..., 1])
        on = _on(g.a, g.b, p, side).any(axis=1)
        if g.dim == 2:
            crossed = ((g.a[:, 1] > p[..., 1]) != (g.b[:, 1] > p[..., 1])) & ((side > 0) == (g.b[:, 1] > g.a[:, 1]))
            out[i : i + step] = np.where(on, 1, 2 * (crossed.sum(axis=1) % 2))
        else:
            inner = np.array([tuple(q) not in g.ends for q in points[i : i + step]])
            out[i : i + step] = np.where(on, 1 + inner, 0)
    return out


def _along(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How far along their segments points on them are, from 0 to 1."""
    d = b - a
    wide = np.abs(d[:, 0]) >= np.abs(d[:, 1])
    part, whole = np.where(wide, p[:, 0] - a[:, 0], p[:, 1] - a[:, 1]), np.where(wide, d[:, 0], d[:, 1])
    return part / whole


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of ``counts`` things: the group of each thing, and its place there."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


class Side:
    """The segments of one side of many pairs, pair after pair."""

    def __init__(self, shapes: list[Shape]):
        self.count = np.array([len(s.a) for s in shapes], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        none = np.empty((0, 2))
        self.a, self.b = (np.concatenate([getattr(s, c) for s in shapes] or [none]) for c in ("a", "b"))
        self.pair = np.repeat(np.arange(len(shapes)), self.count)
        self.area = np.array([s.dim == 2 for s in shapes], bool)
        self.cuts: list[tuple[np.ndarray, np.ndarray]] = []
        self.shared: list[tuple[np.ndarray, ...]] = []

    def cut(self, which: np.ndarray, t: np.ndarray) -> None:
        self.cuts.append((which, t))

    def share(self, which: np.ndarray, at: np.ndarray, to: np.ndarray) -> None:
        """Segments that run along another one, from ``at`` to ``to``."""
        self.shared.append((which, np.minimum(at, to), np.maximum(at, to), np.where(to > at, SAME, OPPOSITE)))

    def pieces(self, other: Side) -> tuple[np.ndarray, np.ndarray]:
        """For each pair, how many pieces of each kind there are, and how long
        they are together."""
        n = len(self.a)
        edge, t = (np.concatenate(c) for c in zip((np.arange(n), np.zeros(n)), (np.arange(n), np.ones(n)), *self.cuts, strict=True))
        order = np.lexsort((t, edge))
        edge, t = edge[order], t[order]
        whole = (edge[1:] == edge[:-1]) & (t[1:] - t[:-1] > SHORT)
        edge, t0, t1 = edge[:-1][whole], t[:-1][whole], t[1:][whole]
        middle, delta = (t0 + t1) / 2, self.b[edge] - self.a[edge]
        kind = np.full(len(edge), OUT)
        tested = np.flatnonzero(other.area[self.pair[edge]])
        at = self.a[edge] + middle[:, None] * delta
        for some in _blocks(other.count[self.pair[edge[tested]]]):
            piece = tested[some]
            pair = self.pair[edge[piece]]
            own, j = _spread(other.count[pair])
            j += other.first[pair][own]
            (x, y), (ax, ay), (bx, by) = at[piece][own].T, other.a[j].T, other.b[j].T
            rise = np.where(ay == by, 1.0, by - ay)
            crossed = ((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / rise)
            kind[piece] = np.where(np.bincount(own, crossed, len(piece)) % 2 == 1, IN, OUT)
        if self.shared:
            which, low, high, way = (np.concatenate(c) for c in zip(*self.shared, strict=True))
            begin, end = np.searchsorted(edge, which), np.searchsorted(edge, which, "right")
            run, at_piece = _spread(end - begin)
            piece = begin[run] + at_piece
            held = (middle[piece] >= low[run]) & (middle[piece] <= high[run])
            for w in (OPPOSITE, SAME):  # of several segments along it, one with the inside on the same side is enough
                kind[piece[held & (way[run] == w)]] = w
        cell = self.pair[edge] * 4 + kind
        length = (t1 - t0) * np.hypot(delta[:, 0], delta[:, 1])
        size = 4 * len(self.count)
        return np.bincount(cell, minlength=size).reshape(-1, 4), np.bincount(cell, length, size).reshape(-1, 4)


def _blocks(counts: np.ndarray) -> Iterator[slice]:
    """Slices of the groups with some ``BLOCK`` things, one group at least."""
    total, low = np.concatenate([[0], np.cumsum(counts)]), 0
    while low < len(counts):
        high = max(low + 1, int(np.searchsorted(total, total[low] + BLOCK, "right")) - 1)
        yield slice(low, high)
        low = high


def _compared(g: Side, h: Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every segment of ``g`` with every one of ``h`` in its pair, in blocks."""
    for some in _blocks(h.count[g.pair]):
        own, j = _spread(h.count[g.pair[some]])
        i = own + some.start
        yield i, j + h.first[g.pair[i]]


@dataclass
class Relations:
    """Of pairs of geometries, one value for each."""

    meet: np.ndarray  #: they share a point
    inner: np.ndarray  #: their interiors do
    covers: np.ndarray  #: no point of the second is outside the first
    covered: np.ndarray
    points: np.ndarray  #: both are points
    length: np.ndarray  #: of what they share: a line's own, a polygon's boundary


def relate(first: list[Shape], second: list[Shape]) -> Relations:
    n = len(first)
    meet, inner, covers, covered, points = (np.zeros(n, bool) for _ in range(5))
    length = np.zeros(n)
    flat = [k for k in range(n) if first[k].dim and second[k].dim]
    for k in set(range(n)) - set(flat):  # points
        g, h, turned = first[k], second[k], first[k].dim > 0
        if turned:
            g, h = h, g
        where = located(g.points, h)
        back = h.dim == 0 and bool((located(h.points, g) > 0).all())
        meet[k], inner[k], points[k] = (where > 0).any(), (where == 2).any(), h.dim == 0
        covers[k], covered[k] = ((where > 0).all(), back) if turned else (back, (where > 0).all())
    if not flat:
        return Relations(meet, inner, covers, covered, points, length)
    g, h = Side([first[k] for k in flat]), Side([second[k] for k in flat])
    met, crossed, free = (np.zeros(len(flat), bool) for _ in range(3))
    lines = ~g.area & ~h.area
    for i, j in _compared(g, h):
        a, b, c, d = g.a[i], g.b[i], h.a[j], h.b[j]
        s1, s2 = (turn(*a.T, *b.T, *v.T) for v in (c, d))
        s3, s4 = (turn(*c.T, *d.T, *v.T) for v in (a, b))
        x = np.flatnonzero((np.sign(s1) * np.sign(s2) < 0) & (np.sign(s3) * np.sign(s4) < 0))
        g.cut(i[x], s3[x] / (s3[x] - s4[x]))
        h.cut(j[x], s1[x] / (s1[x] - s2[x]))
        met[g.pair[i[x]]] = crossed[g.pair[i[x]]] = True
        for side, which, p, q, v, s in ((g, i, a, b, c, s1), (g, i, a, b, d, s2), (h, j, c, d, a, s3), (h, j, c, d, b, s4)):
            x = np.flatnonzero(_on(p, q, v, s))  # vertices of the other side
            side.cut(which[x], _along(p[x], q[x], v[x]))
            pair = g.pair[i[x]]
            met[pair] = True
            for k, place in zip(pair[lines[pair]].tolist(), map(tuple, v[x][lines[pair]].tolist()), strict=True):
                free[k] |= place not in first[flat[k]].ends and place not in second[flat[k]].ends
        x = np.flatnonzero((s1 == 0) & (s2 == 0))
        g.share(i[x], _along(a[x], b[x], c[x]), _along(a[x], b[x], d[x]))
        h.share(j[x], _along(c[x], d[x], a[x]), _along(c[x], d[x], b[x]))
    (p, p_length), (q, q_length) = g.pieces(h), h.pieces(g)
    p, q = p > 0, q > 0
    both, one, other = g.area & h.area, ~g.area & h.area, g.area & ~h.area
    along = p[:, SAME] | p[:, OPPOSITE]
    meet[flat] = met | p[:, IN] | q[:, IN]
    inner[flat] = p[:, IN] | q[:, IN] | np.where(both, p[:, SAME], lines & (along | crossed | free))
    covers[flat] = ~q[:, OUT] & ~one & ~(both & (q[:, OPPOSITE] | p[:, IN]))
    covered[flat] = ~p[:, OUT] & ~other & ~(both & (p[:, OPPOSITE] | q[:, IN]))
    shared = p_length[:, SAME] + p_length[:, OPPOSITE]
    length[flat] = shared + p_length[:, IN] + q_length[:, IN]
    return Relations(meet, inner, covers, covered, points, length)


def _to_segments(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d, e = b - a, v - a
    square = (d * d).sum(axis=1)
    t = np.clip((e * d).sum(axis=1) / np.where(square == 0, 1.0, square), 0, 1)
    return np.hypot(*(e - t[:, None] * d).T)


def distances(first: list[Shape], second: list[Shape]) -> np.ndarray:
    """The least distance of each pair, 0 if they share a point."""
    as_segments = lambda s: s if s.dim else Shape(0, s.points, s.points, s.points, set())
    g, h = Side(list(map(as_segments, first))), Side(list(map(as_segments, second)))
    out = np.full(len(first), math.inf)
    for i, j in _compared(g, h):
        a, b, c, d = g.a[i], g.b[i], h.a[j], h.b[j]
        least = np.minimum.reduce([_to_segments(a, c, d), _to_segments(b, c, d), _to_segments(c, a, b), _to_segments(d, a, b)])
        np.minimum.at(out, g.pair[i], least)
    out[relate(first, second).meet] = 0.0
    return out


# ------------------------------------------------------------------ as columns


def _shapes(column: pa.StructArray) -> list[Shape | None]:
    """Of an Arrow column of geometries; equal ones are made once a batch."""
    kinds, rings = column.field("type").to_pylist(), column.field("rings")
    of_shape, vertices = rings.offsets.to_numpy(), rings.values
    of_ring, xy = vertices.offsets.to_numpy(), vertices.values
    places = np.stack([xy.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1)
    valid, made, out = column.is_valid().to_pylist(), {}, []
    for i, kind in enumerate(kinds):
        bounds = of_ring[of_shape[i] : of_shape[i + 1] + 1]
        if not valid[i] or kind is None or len(bounds) < 2 or bounds[0] == bounds[-1]:
            out.append(None)
            continue
        key = (kind, (bounds - bounds[0]).tobytes(), places[bounds[0] : bounds[-1]].tobytes())
        if key not in made:
            made[key] = shape(kind, [places[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True) if e > s])
        out.append(made[key])
    return out


def _pairwise(value: Callable[[list[Shape], list[Shape]], np.ndarray], kind: pa.DataType, name: str):
    """A column function of two geometries; null where one is null or empty.  It
    counts as not deterministic, as Spark would move a filter on it, and with it
    the work, to before a shuffle that deals the pairs to more tasks."""

    @F.arrow_udf(name)
    def of(g: pa.Array, h: pa.Array) -> pa.Array:
        first, second = _shapes(g), _shapes(h)
        known = [k for k, (a, b) in enumerate(zip(first, second, strict=True)) if a is not None and b is not None]
        out: list[object] = [None] * len(first)
        if known:
            for k, v in zip(known, value([first[k] for k in known], [second[k] for k in known]).tolist(), strict=True):
                out[k] = v
        return pa.array(out, kind)

    return of.asNondeterministic()


#: Relation -> its test.
TESTS: dict[str, Callable[[Relations], np.ndarray]] = {
    "contains": lambda r: r.covers & r.inner,
    "within": lambda r: r.covered & r.inner,
    "intersects": lambda r: r.meet,
    "touches": lambda r: r.meet & ~r.inner & ~r.points,
}


def related(g: Column, h: Column, relation: str) -> Column:
    """Whether ``g`` contains, intersects, touches or is within ``h``."""
    return _pairwise(lambda a, b: TESTS[relation](relate(a, b)), pa.bool_(), "boolean")(g, h)


def common_length(g: Column, h: Column) -> Column:
    """The length of what two geometries share: of a common area its boundary,
    and of borders and lines along each other themselves."""
    return _pairwise(lambda a, b: relate(a, b).length, pa.float64(), "double")(g, h)


def distance_between(g: Column, h: Column) -> Column:
    return _pairwise(distances, pa.float64(), "double")(g, h)
