"""Gray-level co-occurrence features of images.

Pixel pairs at distance 1 along an angle are counted both ways and divided by
their total.  An image is a row with an array of levels; its pairs are counted
in that row, in one pass of numpy over Arrow batches, so nothing is shuffled and
the plan doesn't grow with the image.  An image that is null, holds a null or
has another number of pixels has no features.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Angle -> step in rows and columns.
STEPS = {"0": (0, 1), "45": (1, 1), "90": (1, 0)}
FEATURES = ["contrast", "dissimilarity", "homogeneity", "asm", "energy", "correlation"]


def matrix(levels: np.ndarray, angle: str) -> tuple[np.ndarray, np.ndarray]:
    """The levels that occur in a two-dimensional image, and the share of each
    pair of them along an angle."""
    dr, dc = STEPS[angle]
    height, width = levels.shape
    values, place = np.unique(levels, return_inverse=True)
    place = place.reshape(levels.shape)
    at, to = place[: height - dr, : width - dc], place[dr:, dc:]
    n = len(values)
    counts = np.bincount((at * n + to).ravel(), minlength=n * n).reshape(n, n)
    return values, (counts + counts.T) / max(2 * at.size, 1)


def features(levels: np.ndarray) -> list[float]:
    """``FEATURES`` of one image: means over the angles 0, 45 and 90 degrees (for
    ``asm``: 45 and 90).  Correlation is 1 for an image of one level."""
    per = []
    for angle in STEPS:
        v, p = matrix(levels, angle)
        i, j = v[:, None], v[None, :]
        d, mean = i - j, float((p * i).sum())  # symmetric, so both margins are alike
        variance = float((p * i * i).sum()) - mean * mean
        asm = float((p * p).sum())
        correlation = 1.0 if variance < 1e-15 else (float((p * i * j).sum()) - mean * mean) / variance
        per.append([float((p * d * d).sum()), float((p * abs(d)).sum()), float((p / (1 + d * d)).sum()), asm, asm**0.5, correlation])
    means = np.mean(per, axis=0).tolist()
    means[FEATURES.index("asm")] = (per[1][3] + per[2][3]) / 2
    return means


def _per_image(of: Callable[[np.ndarray], object], height: int, width: int, made: pa.DataType, name: str):
    @F.arrow_udf(name)
    def each(images: pa.Array) -> pa.Array:
        flat = images.values.to_numpy(zero_copy_only=False).astype(float)
        ends, valid = images.offsets.to_numpy(), images.is_valid().to_pylist()
        out = []
        for ok, low, high in zip(valid, ends[:-1], ends[1:], strict=True):
            image = flat[low:high]
            whole = ok and len(image) == height * width and not np.isnan(image).any()
            out.append(of(image.reshape(height, width)) if whole else None)
        return pa.array(out, made)

    return each


def cooccurrence(df: DataFrame, id_col: str, levels: str, height: int, width: int, angles: tuple[str, ...] = ("0", "45", "90")) -> DataFrame:
    """``(id, angle, i, j, p)``: the share of each pair of levels."""

    def shares(image: np.ndarray) -> list[dict[str, object]]:
        out = []
        for angle in angles:
            v, p = matrix(image, angle)
            out += [{"angle": angle, "i": v[r], "j": v[c], "p": p[r, c]} for r, c in zip(*np.nonzero(p), strict=True)]
        return out

    made = pa.list_(pa.struct([("angle", pa.string()), ("i", pa.float64()), ("j", pa.float64()), ("p", pa.float64())]))
    each = _per_image(shares, height, width, made, "array<struct<angle:string,i:double,j:double,p:double>>")
    return df.select(id_col, F.explode(each(F.col(levels))).alias("x")).select(id_col, "x.*")


def image_textures(levels: Column, height: int, width: int) -> Column:
    """``FEATURES`` of a column of images, as a struct."""
    made = pa.struct([(f, pa.float64()) for f in FEATURES])
    each = _per_image(lambda image: dict(zip(FEATURES, features(image), strict=True)), height, width, made, ", ".join(f"{f} double" for f in FEATURES))
    return each(levels)


def glcm_features(df: DataFrame, id_col: str, levels: str, height: int, width: int) -> DataFrame:
    """``(id, feature...)`` of each image."""
    return df.select(id_col, image_textures(F.col(levels), height, width).alias("x")).select(id_col, "x.*")
