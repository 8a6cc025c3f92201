"""Samples of traffic models: flows between cells, histories of cells, planes
of what lies in a cell.

Flows and volumes stay in long form and are joined on (step, row, column), so
work is spread over steps and cells; arrays are made per cell and step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import band
from . import tensor

CELL = ["t", "h", "w"]


def scaled_planes(data: Column, n_planes: int) -> Column:
    """Planes of one array, each divided by its greatest value (null if that is 0)."""

    def scaled(plane: Column) -> Column:
        return F.transform(plane, lambda v: F.try_divide(v, F.array_max(plane)))

    return F.concat(*(scaled(band(data, n_planes, i)) for i in range(n_planes)))


def with_planes(samples: DataFrame, planes: DataFrame, data: str, n_planes: int) -> DataFrame:
    """``samples`` with ``p_data``: the scaled planes of the one row of ``planes``,
    the same for every sample."""
    return samples.withColumn("p_data", planes.select(scaled_planes(F.col(data), n_planes)).scalar())


def flow_channels(flows: DataFrame, reach: int) -> DataFrame:
    """``t, h, w, pos, channel, n``: flows of a cell to and from the cells within
    ``reach``, at place ``pos`` of the square around it, where there are any.

    ``flows`` has ``k, t, h, w, to_h, to_w, n``: trips from a cell to another
    that began at ``t``, ended in the same step (k = 0) or in the next (k = 1).
    Channels: 0 out and 1 in of the step itself, 2 out and 3 in of trips that
    began a step before.  Every flow goes to its two ends; nothing is joined.
    """
    side = 2 * reach + 1
    dh, dw = F.col("to_h") - F.col("h"), F.col("to_w") - F.col("w")
    end = lambda h, w, sign, c: F.struct(h.alias("h"), w.alias("w"), ((dh * sign + reach) * side + dw * sign + reach).cast("int").alias("pos"), (F.col("k") * 2 + c).cast("int").alias("channel"))
    ends = F.array(end(F.col("h"), F.col("w"), 1, 0), end(F.col("to_h"), F.col("to_w"), -1, 1))
    near = flows.filter((F.abs(dh) <= reach) & (F.abs(dw) <= reach))
    each = near.select((F.col("t") + F.col("k")).alias("t"), "n", F.explode(ends).alias("e")).select("t", "e.*", "n")
    return each.groupBy(*CELL, "pos", "channel").agg(F.sum("n").cast("double").alias("n"))


def local_flows(flows: DataFrame, reach: int) -> DataFrame:
    """``t, h, w, flow``: the four channels of every place around a cell as one
    array, place by place; cells without flows have no row."""
    size = (2 * reach + 1) ** 2 * 4
    got = flow_channels(flows, reach).groupBy(*CELL).agg(F.map_from_entries(F.collect_list(F.struct(F.col("pos") * 4 + F.col("channel"), "n"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return got.select(*CELL, full.alias("flow"))


def cell_history(dense: DataFrame, temporal_id: str, columns: list[str], day: int, days: int, last: int) -> DataFrame:
    """``t, h, w, history``: the features of a cell at the same step of the
    ``days`` days before, then of the ``last`` steps before, the oldest first;
    for every step that has them all, with the one after the table's end."""
    back = [day * i for i in range(days, 0, -1)] + list(range(last, 0, -1))
    asked = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(b).alias("back")) for i, b in enumerate(back)))
    sent = dense.select(F.col(temporal_id).alias("t0"), "h", "w", F.array(*columns).alias("v"), F.explode(asked).alias("a"))
    sent = sent.select((F.col("t0") + F.col("a.back")).alias("t"), "h", "w", F.struct(F.col("a.i").alias("i"), "v").alias("s"))
    got = sent.groupBy(*CELL).agg(F.array_sort(F.collect_list("s")).alias("s")).filter(F.size("s") == len(back))
    return got.select(*CELL, F.flatten(F.transform("s", lambda s: s["v"])).alias("history"))


def _patch(dense: DataFrame, temporal_id: str, columns: list[str], height: int, width: int, reach: int, name: str) -> DataFrame:
    """The square around each cell as one array, place by place."""
    got = tensor.neighbourhoods(dense, temporal_id, columns, height, width, reach)
    return got.select(*CELL, F.flatten(F.transform(F.arrays_zip(*columns), lambda z: F.array(*(z[c] for c in columns)))).alias(name))


def forecast_samples(
    dense: DataFrame, flows: DataFrame, temporal_id: str, columns: list[str], temporal_size: int, height: int, width: int,
    day: int = 48, short: int = 7, long_days: int = 3, long_length: int = 3, days: int = 7, last: int = 7, reach: int = 3, image_reach: int = 3,
) -> DataFrame:
    """``t, h, w, short, long, label``: what a model of the next step of a cell
    is given, for every cell and every step with all the history.

    ``short`` is of the ``short`` steps before; ``long`` of ``long_length`` steps
    about the same time of each of the ``long_days`` days before.  Each is an
    array of ``a`` (day), ``i`` (step), ``x`` (history and the square of
    ``reach``), ``image`` (the square of ``image_reach``) and ``flow``.
    """
    features = cell_history(dense, temporal_id, columns, day, days, last).join(_patch(dense, temporal_id, columns, height, width, image_reach, "image"), CELL)
    if reach == image_reach:
        features = features.withColumn("near", F.col("image"))
    else:
        features = features.join(_patch(dense, temporal_id, columns, height, width, reach, "near"), CELL)
    features = features.join(local_flows(flows, image_reach), CELL, "left")
    none = F.array_repeat(F.lit(0.0), (2 * image_reach + 1) ** 2 * 4)
    features = features.select(F.col("t").alias("at"), "h", "w", F.concat("history", "near").alias("x"), "image", F.coalesce("flow", none).alias("flow"))

    wanted = [("short", 0, i, i - short) for i in range(short)]
    middle = (long_length - 1) // 2 + 1
    wanted += [("long", a, i, (a - long_days) * day + middle - long_length + i) for a in range(long_days) for i in range(long_length)]
    asked = F.array(*(F.struct(F.lit(p).alias("part"), F.lit(a).alias("a"), F.lit(i).alias("i"), F.lit(o).alias("o")) for p, a, i, o in wanted))
    first = (days + long_days) * day + long_length
    starts = dense.select(F.col(temporal_id).alias("t"), "h", "w", F.array(*columns).alias("label")).filter(F.col("t").between(first, temporal_size - 1))
    met = starts.select(*CELL, F.explode(asked).alias("q")).select(*CELL, "q.part", "q.a", "q.i", (F.col("t") + F.col("q.o")).alias("at")).join(features, ["at", "h", "w"])
    parts = [F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("a", "i", "x", "image", "flow")))).alias(p) for p in ("short", "long")]
    return met.groupBy(*CELL).agg(*parts).join(starts, CELL)
