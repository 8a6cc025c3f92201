"""Dense tables over time steps and cells, and training samples made of them.

A sparse table of features by step and cell is completed by a left join with all
(step, cell) pairs, or kept in long form.  Samples are made by equi-joins on the
step, so steps are spread over the cluster; arrays come at the very end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameters


def _completed(df: DataFrame, keys: dict[str, int], columns: list[str], missing: float | None) -> DataFrame:
    """All combinations of ``keys`` (name -> count), with the features; of
    several rows for one combination each feature's greatest value counts."""
    total = int(np.prod(list(keys.values())))
    parts, below = {}, total
    for k, n in keys.items():
        below //= n
        parts[k] = (F.floor(F.col("id") / below) % n).cast("long")
    scaffold = df.sparkSession.range(total).select(*(v.alias(k) for k, v in parts.items()))
    own = df.select(*(F.col(k).cast("long").alias(k) for k in keys), *(F.col(c).cast("double").alias(c) for c in columns))
    own = own.groupBy(*keys).agg(*(F.max(c).alias(c) for c in columns))
    fill = F.lit(float("nan") if missing is None else float(missing))
    return scaffold.join(own, list(keys), "left").select(*keys, *(F.coalesce(c, fill).alias(c) for c in columns))


def get_st_array(df: DataFrame, temporal_id: str, spatial_id: str, columns: list[str], temporal_size: int, spatial_size: int, missing: float | None = None) -> DataFrame:
    """``temporal_id, spatial_id`` and the features of every step and place."""
    return _completed(df, {temporal_id: temporal_size, spatial_id: spatial_size}, columns, missing)


def get_spatial_array(df: DataFrame, spatial_id: str, columns: list[str], spatial_size: int, missing: float | None = None) -> DataFrame:
    return _completed(df, {spatial_id: spatial_size}, columns, missing)


def _with_position(df: DataFrame, spatial_id: str, width: int) -> DataFrame:
    return df.withColumns({"h": F.floor(F.col(spatial_id) / width).cast("long"), "w": F.col(spatial_id) % width})


def get_st_grid_array(df: DataFrame, temporal_id: str, spatial_id: str, columns: list[str], temporal_size: int, height: int, width: int, missing: float | None = None) -> DataFrame:
    """With the row ``h`` and the column ``w`` of each cell."""
    return _with_position(get_st_array(df, temporal_id, spatial_id, columns, temporal_size, height * width, missing), spatial_id, width)


def get_spatial_grid_array(df: DataFrame, spatial_id: str, columns: list[str], height: int, width: int, missing: float | None = None) -> DataFrame:
    return _with_position(get_spatial_array(df, spatial_id, columns, height * width, missing), spatial_id, width)


def to_numpy(dense: DataFrame, keys: list[str], columns: list[str], shape: tuple[int, ...]) -> np.ndarray:
    """A dense table as an array of ``shape`` and a last axis of features: the
    end of the way, through the driver, for what fits it."""
    rows = dense.orderBy(*keys).select(*columns).toPandas()
    return rows.to_numpy().reshape(*shape, len(columns))


def min_max(dense: DataFrame, columns: list[str]) -> DataFrame:
    """One row: ``max_minus_min, max_plus_min`` over all features."""
    low, high = (F.least, F.greatest) if len(columns) > 1 else (lambda c: c, lambda c: c)
    both = dense.agg(low(*(F.min(c) for c in columns)).alias("low"), high(*(F.max(c) for c in columns)).alias("high"))
    return both.select((F.col("high") - F.col("low")).alias("max_minus_min"), (F.col("high") + F.col("low")).alias("max_plus_min"))


def normalized(dense: DataFrame, columns: list[str]) -> DataFrame:
    """Features in [-1, 1] by the least and greatest of all of them; null if they
    are all the same."""
    m = min_max(dense, columns).select(F.struct("max_minus_min", "max_plus_min")).scalar()
    rows = dense.withColumn("_m", m)
    return rows.withColumns({c: F.try_divide(2 * F.col(c) - F.col("_m.max_plus_min"), F.col("_m.max_minus_min")) for c in columns}).drop("_m")


def frames(dense: DataFrame, temporal_id: str, spatial_id: str, columns: list[str]) -> DataFrame:
    """``t, frame``: the features of a step as one array, feature after feature,
    each by cell."""
    by_cell = F.array_sort(F.collect_list(F.struct(F.col(spatial_id).alias("s"), *columns)))
    got = dense.groupBy(F.col(temporal_id).cast("long").alias("t")).agg(by_cell.alias("cells"))
    feature = lambda c: F.transform("cells", lambda x: x[c])
    return got.select("t", F.concat(*map(feature, columns)).alias("frame"))


def lead_time_pairs(steps: DataFrame, lead_time: int) -> DataFrame:
    """``t, x_data, y_data``: each frame with the one ``lead_time`` steps on."""
    later = steps.select((F.col("t") - lead_time).alias("t"), F.col("frame").alias("y_data"))
    return steps.select("t", F.col("frame").alias("x_data")).join(later, "t")


#: Steps that one task makes samples for.
BLOCK_STEPS = 256


def _gathered(steps: DataFrame, asked: Column, offsets: dict[str, list[int]], block: int = BLOCK_STEPS) -> DataFrame:
    """For each ``t`` that ``asked`` holds for, arrays of the frames at ``t +
    offset``; what is missing is left out, and so is a ``t`` that has none.

    Steps are dealt to blocks of ``block``; a frame goes to its own block and to
    those whose samples reach it, so it is sent about once if blocks are longer
    than samples, and samples are cut inside the row of a block.
    """
    every = [o for os in offsets.values() for o in os]
    if not every:
        return steps.filter(asked).select("t")
    low, high = min([0, *every]), max([0, *every])
    span = F.sequence(F.floor((F.col("t") - high) / block), F.floor((F.col("t") - low) / block))
    sent = steps.select("t", "frame", asked.alias("asked"), F.explode(span).alias("block"))
    own = F.col("asked") & (F.floor(F.col("t") / block) == F.col("block"))
    held = sent.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("t", "frame"))).alias("m"), F.collect_list(F.when(own, F.col("t"))).alias("ts"))

    def window(t: Column, os: list[int]) -> Column:
        got = F.transform(F.array(*map(F.lit, os)).cast("array<bigint>"), lambda o: F.try_element_at("m", t + o))
        return F.filter(got, lambda f: f.isNotNull())

    samples = F.transform("ts", lambda t: F.struct(t.alias("t"), *(window(t, os).alias(name) for name, os in offsets.items())))
    out = held.select(F.explode(samples).alias("s")).select("s.*")
    return out.filter(sum((F.size(name) for name in offsets), F.lit(0)) > 0)


def sequential_windows(steps: DataFrame, history_length: int, predict_length: int, temporal_size: int) -> DataFrame:
    """``t, x_data, y_data``: ``history_length`` frames from ``t`` on and the
    ``predict_length`` after them, for the first ``temporal_size - history_length
    - predict_length`` steps."""
    asked = F.col("t") < temporal_size - history_length - predict_length
    return _gathered(steps, asked, {"x_data": list(range(history_length)), "y_data": list(range(history_length, history_length + predict_length))})


def periodical_features(
    steps: DataFrame, len_closeness: int = 3, len_period: int = 4, len_trend: int = 4, t_closeness: int = 1, t_period: int = 24, t_trend: int = 168
) -> DataFrame:
    """``t, x_closeness, x_period, x_trend, t_data, y_data``: for every step that
    has them, the frames at multiples of each interval before it (the nearest
    first), the hour and the day one-hot, and its own frame."""
    skip = next((x for x in (t_trend * len_trend, t_period * len_period, t_closeness * len_closeness) if x > 0), None)
    if skip is None:
        raise InvalidParameters("one of the lengths must be above 0")
    back = {name: [-step * i for i in range(1, n + 1)] for name, n, step in (("x_closeness", len_closeness, t_closeness), ("x_period", len_period, t_period), ("x_trend", len_trend, t_trend))}
    got = _gathered(steps, F.col("t") >= skip, back | {"_own": [0]})
    return got.filter(sum((F.size(name) for name in back), F.lit(0)) > 0).select("t", *back, time_one_hot(F.col("t"), t_period).alias("t_data"), F.col("_own")[0].alias("y_data"))


def time_one_hot(t, t_period: int = 24):
    """24 places for ``t % t_period`` and 7 for the day."""
    hour, day = t % t_period, F.floor(t / t_period) % 7
    place = lambda n, v: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == v, 1.0).otherwise(0.0))
    return F.concat(place(24, hour), place(7, day))


def neighbourhoods(dense: DataFrame, temporal_id: str, columns: list[str], height: int, width: int, reach: int) -> DataFrame:
    """``t, h, w`` and for each feature the array of the ``(2 reach + 1)^2``
    cells around the cell, row by row, 0 outside the grid.

    Each cell is sent to the cells that have it in reach; what is outside the
    grid is filled in the array, so no row is made for it.
    """
    side = range(-reach, reach + 1)
    around = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in side for dc in side))
    sent = dense.select(F.col(temporal_id).alias("t"), "h", "w", *columns, F.explode(around).alias("o"))
    sent = sent.select("t", (F.col("h") - F.col("o.dr")).alias("h"), (F.col("w") - F.col("o.dc")).alias("w"), ((F.col("o.dr") + reach) * (2 * reach + 1) + F.col("o.dc") + reach).alias("k"), *columns)
    sent = sent.filter(F.col("h").between(0, height - 1) & F.col("w").between(0, width - 1))
    maps = [F.map_from_entries(F.collect_list(F.struct("k", c))).alias(c) for c in columns]
    got = sent.groupBy("t", "h", "w").agg(*maps)
    full = lambda c: F.transform(F.sequence(F.lit(0), F.lit((2 * reach + 1) ** 2 - 1)), lambda k: F.coalesce(F.try_element_at(F.col(c), k), F.lit(0.0)))
    return got.select("t", "h", "w", *(full(c).alias(c) for c in columns))
