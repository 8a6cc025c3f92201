"""The greatest distance of two points of a table, from convex hulls."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, counterclockwise."""
    rows = np.unique(points, axis=0)
    if len(rows) < 3:
        return rows

    def chain(ordered: list[list[float]]) -> list[list[float]]:
        out: list[list[float]] = []
        for x, y in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append([x, y])
        return out[:-1]

    ordered = rows.tolist()
    return np.array(chain(ordered) + chain(ordered[::-1]))


def widest(corners: np.ndarray) -> float:
    """The greatest distance of two corners of a convex polygon: those that
    parallel lines can touch at once are met by turning the lines around it."""
    p, n = corners.tolist(), len(corners)
    if n < 3:
        return math.dist(p[0], p[-1]) if n else 0.0
    far = lambda i, j: (p[(i + 1) % n][0] - p[i][0]) * (p[j][1] - p[i][1]) - (p[(i + 1) % n][1] - p[i][1]) * (p[j][0] - p[i][0])
    best, j = 0.0, 1
    for i in range(n):
        while True:
            best = max(best, math.dist(p[i], p[j]), math.dist(p[(i + 1) % n], p[j]))
            if far(i, (j + 1) % n) < far(i, j):
                break
            j = (j + 1) % n
            if j == i:
                break
        # edges that are parallel to it are passed corner by corner above
    return best


def _hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    corners = np.empty((0, 2))
    for batch in batches:
        corners = hull(np.concatenate([corners, batch[["x", "y"]].to_numpy()]))
    yield pd.DataFrame(corners, columns=["x", "y"])


def _widest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found = pd.concat([pd.DataFrame({"x": [], "y": []}), *_hulls(batches)])
    if len(found):
        yield pd.DataFrame({"d": [widest(found.to_numpy())]})


def greatest_distance(df: DataFrame, place: Column, name: str = "d") -> DataFrame:
    """One row: the greatest distance of two vertices ``place``; none without any.
    Each task keeps the corners of its own rows' hull, and the corners alone go
    to the task that merges them."""
    xy = df.select(place["x"].alias("x"), place["y"].alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    return xy.mapInPandas(_hulls, "x double, y double").repartition(1).mapInPandas(_widest, f"{name} double")


def diameter(df: DataFrame, place: Column) -> Column:
    """The same as one value of a plan; null without any."""
    return greatest_distance(df, place).scalar()
