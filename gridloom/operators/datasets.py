"""Labels, masks, splits and metrics of training tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameters
from ..functions import indices, texture
from ..functions.bands import band
from .adapter import numbered


def class_labels(df: DataFrame, col_label: str) -> DataFrame:
    """``label, label_id``: the distinct labels in ascending order, from 0; null
    is no label."""
    distinct = df.select(F.col(col_label).alias("label")).filter("label IS NOT NULL").distinct()
    return numbered(distinct, "label", "label_id").withColumn("label_id", F.col("label_id").cast("int"))


def classification_frame(df: DataFrame, col_data: str, col_label: str, features: str | None = None) -> DataFrame:
    """``image_data, label`` (the label's id; null for none) and the features."""
    keep = [F.col(col_data).alias("image_data"), F.col("label_id").alias("label"), *([F.col(features)] if features else [])]
    return df.join(class_labels(df, col_label), F.col(col_label) == F.col("label"), "left").select(*keep)


def segmentation_frame(df: DataFrame, col_data: str, col_label: str, is_label_masked: bool = True, masking_threshold: float = 255) -> DataFrame:
    """``image_data, label``: the mask as 0 and 1."""
    mask = F.col(col_label) if is_label_masked else F.transform(col_label, lambda v: F.when(v >= masking_threshold, 1).otherwise(0))
    return df.select(F.col(col_data).alias("image_data"), mask.cast("array<int>").alias("label"))


def image_tensor(data: Column, n_bands: int, height: int, width: int) -> Column:
    """``array<array<array<float>>>``: bands of rows of pixels."""
    row = lambda b, r: F.slice(data, F.lit(1) + b * (height * width) + r * width, F.lit(width)).cast("array<float>")
    return F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda b: F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: row(b, r)))


#: Rounds of the permutation, and steps that leave its margin (see ``shuffled_place``).
ROUNDS, STEPS_BACK = 4, 64


def shuffled_place(index: Column, n: Column, seed: int) -> Column:
    """The place of ``index`` in a shuffle of 0 to ``n`` - 1 that ``seed`` names:
    a bijection that needs no sort, so any row's place is known by itself.

    The index is a pair (l, r) of about the root of ``n`` each; in turn each of
    them is moved by a digest of the other, which can be undone.  Of the few
    pairs beyond ``n`` the permutation is gone on with until it is back; their
    number bounds the steps, and beyond ``STEPS_BACK`` of them it takes fewer
    with all but certainty.
    """
    high = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    low = F.ceil(n / high).cast("long")

    def moved(value: Column, by: Column, turn: int, size: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit(turn), by))
        return (value + F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")) % size

    def round_of(turn: int):
        if turn % 2 == 0:
            return lambda p: F.struct(moved(p["l"], p["r"], turn, high).alias("l"), p["r"].alias("r"))
        return lambda p: F.struct(p["l"].alias("l"), moved(p["r"], p["l"], turn, low).alias("r"))

    def permuted(x: Column) -> Column:
        pair = F.struct(F.floor(x / low).cast("long").alias("l"), (x % low).alias("r"))
        for turn in range(ROUNDS):  # in an array of one, so that each round is written once
            pair = F.transform(F.array(pair), round_of(turn))[0]
        return F.transform(F.array(pair), lambda p: p["l"] * low + p["r"])[0]

    back = F.sequence(F.lit(1), F.least(high * low - n + 1, F.lit(STEPS_BACK)))
    return F.aggregate(back, permuted(index), lambda x, _: F.when(x < n, x).otherwise(permuted(x)))


def split_train_validation_test(df: DataFrame, index_col: str, validation_ratio: float, test_ratio: float, shuffle_seed: int | None = None) -> DataFrame:
    """``df`` with ``split``: contiguous ranges of an index from 0 without gaps
    (see ``add_row_id``); with a seed, of its places in a shuffle.  The parts'
    sizes are the same either way."""
    rows = df.withColumn("_n", df.agg(F.count("*")).scalar())
    n, index = F.col("_n"), F.col(index_col).cast("long")
    at = index if shuffle_seed is None else shuffled_place(index, n, shuffle_seed)
    first = F.floor((1 - validation_ratio - test_ratio) * n)
    second = F.floor((1 - test_ratio) * n)
    rows = rows.withColumn("_at", at)
    return rows.withColumn("split", F.when(F.col("_at") < first, "train").when(F.col("_at") < second, "validation").otherwise("test")).drop("_n", "_at")


def forecast_errors(df: DataFrame, prediction: str, actual: str) -> DataFrame:
    """One row: ``mse, mae, rmse``."""
    d = F.col(prediction) - F.col(actual)
    got = df.agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"))
    return got.withColumn("rmse", F.sqrt("mse"))


def arg_max(scores: Column) -> Column:
    """Where the greatest score is, from 0."""
    return F.array_position(scores, F.array_max(scores)) - 1


def accuracy(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """One row: the share of right predictions in per cent."""
    return df.agg(F.avg(F.when(F.col(prediction) == F.col(label), 100.0).otherwise(0.0)).alias("accuracy"))


def channel_stats(df: DataFrame, data: str, n_bands: int) -> DataFrame:
    """``band, mean, std`` over all pixels of all images."""
    pixels = df.select(F.size(data).alias("n"), F.posexplode(data).alias("p", "v"))
    got = pixels.withColumn("band", F.floor(F.col("p") / (F.col("n") / n_bands)).cast("int")).groupBy("band")
    return got.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def one_hot_label(columns: list[str]) -> Column:
    """The place of the greatest of one-hot columns."""
    return arg_max(F.array(*columns))


def channels_first(data: Column, height: int, width: int, n_bands: int) -> Column:
    """Pixels of interleaved bands, band after band."""
    size = height * width
    return F.transform(F.sequence(F.lit(0), F.lit(size * n_bands - 1)), lambda i: data[(i % size) * n_bands + F.floor(i / size).cast("int")])


#: Feature -> the spectral index whose mean it is.
MEAN_FEATURES = {**{f"mean_{name}": name for name in indices.INDEX_BANDS}, "mean_builtup_index": "ndbi"}


def image_levels(data: Column, n_bands: int, red: int, green: int, blue: int) -> Column:
    """The eight gray levels of an image, its visible bands scaled to 0 to 255
    by their greatest value."""
    visible = [band(data, n_bands, b) for b in (red, green, blue)]
    unit = F.array_max(F.concat(*visible)) / 255.0
    scaled = [F.transform(v, lambda p: F.floor(F.try_divide(p, unit)).cast("double")) for v in visible]
    return indices.digitized(indices.gray(*scaled))


def image_features(
    df: DataFrame, id_col: str, data: str, n_bands: int, height: int, width: int, bands: dict[str, int], features: list[str], callbacks: dict[str, Callable[[Column], Column]] | None = None
) -> DataFrame:
    """``df`` with a column for each feature: a texture of the gray levels, the
    mean of a spectral index (``mean_ndvi`` ...), or what a callback makes of the
    column of gray levels; callbacks come first.  ``bands`` says where each named
    band is.  Nothing is shuffled; ``id_col`` is kept for callers that pass it."""
    callbacks = callbacks or {}
    own = {f.lower(): f for f in features if f not in callbacks}
    unknown = [f for f in own if f not in MEAN_FEATURES and f not in texture.FEATURES]
    if unknown:
        raise InvalidParameters(f"no callback for {', '.join(unknown)}")
    levels = image_levels(F.col(data), n_bands, *(bands[b] for b in ("red", "green", "blue")))
    rows = df.withColumn("_levels", levels)
    means = {f: indices.mean_index(indices.spectral_index(MEAN_FEATURES[k], F.col(data), n_bands, bands)) for k, f in own.items() if k in MEAN_FEATURES}
    rows = rows.withColumns({**means, **{f: callbacks[f](F.col("_levels")) for f in features if f in callbacks}})
    textures = {f: F.col("_textures")[k] for k, f in own.items() if k in texture.FEATURES}
    if textures:
        rows = rows.withColumn("_textures", texture.image_textures(F.col("_levels"), height, width)).withColumns(textures)
    return rows.drop("_levels", "_textures")
