"""Raster band algebra on array columns, all in native higher-order functions.

A raster is one array of doubles, band after band, with its count of bands.
Bands are counted from 0.  Division by zero gives null, and rounding to two
places is ``floor(100 x + 0.5) / 100``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameters


def _int(x) -> Column:
    return x.cast("int") if isinstance(x, Column) else F.lit(int(x))


def band(data: Column, n_bands: Column | int, index: int) -> Column:
    """The values of one band."""
    if index < 0:
        raise InvalidParameters("bands are counted from 0")
    size = F.floor(F.size(data) / _int(n_bands)).cast("int")
    return F.slice(data, size * F.lit(index) + F.lit(1), size)


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` computed once: inside a lambda function it would be
    computed again for every element."""
    return F.transform(F.array(x), use)[0]


def floored(x: Column) -> Column:
    """The floor of a double as a double: Spark's own is a long, which ends at 9.2e18."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def round2(x: Column) -> Column:
    return floored(x * 100 + 0.5) / 100


def _mean(b: Column) -> Column:
    return F.try_divide(F.aggregate(b, F.lit(0.0), lambda s, v: s + v), F.size(b))


def normalized(b: Column) -> Column:
    """Scaled to 0 to 255: ``floor(v / (max / 255))``."""
    return bound(F.array_max(b) / 255, lambda unit: F.transform(b, lambda v: floored(F.try_divide(v, unit))))


def normalized_difference(a: Column, b: Column) -> Column:
    """``(b - a) / (b + a)`` to two places."""
    return F.zip_with(a, b, lambda x, y: round2(F.try_divide(y - x, y + x)))


def mode(b: Column) -> Column:
    """All most frequent values, in ascending order."""
    count = lambda v: F.struct(F.size(F.filter(b, lambda w: w == v)).alias("n"), v.alias("v"))
    most = lambda c: F.array_max(F.transform(c, lambda x: x["n"]))
    best = lambda c: bound(most(c), lambda n: F.transform(F.filter(c, lambda x: x["n"] == n), lambda x: x["v"]))
    return bound(F.transform(F.array_sort(F.array_distinct(b)), count), best)


def masked(b: Column, test: Callable[[Column], Column]) -> Column:
    return F.transform(b, lambda v: F.when(test(v), 1.0).otherwise(0.0))


def standardized(data: Column, n_bands: Column | int) -> Column:
    """Each band by its own mean and standard deviation (of the population)."""
    n = _int(n_bands)
    size = F.floor(F.size(data) / n).cast("int")

    def scaled(b: Column, mean: Column) -> Column:
        squares = F.aggregate(b, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
        return bound(F.sqrt(F.try_divide(squares, F.size(b))), lambda std: F.transform(b, lambda v: F.try_divide(v - mean, std)))

    one = lambda i: bound(F.slice(data, i * size + 1, size), lambda b: bound(_mean(b), lambda mean: scaled(b, mean)))
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), one))


# ------------------------------------------------------- DataFrame operations


def _result(df: DataFrame, value: Column, name: str, full: bool) -> DataFrame:
    return df.withColumn(name, value) if full else df.select(value.alias(name))


def _one(default: Callable[..., str], value: Callable[..., Column]):
    """An operation on one band and further arguments."""

    def operation(df: DataFrame, band_index: int, *args, data: str = "data", n_bands: str = "nBands", name: str | None = None, full: bool = True) -> DataFrame:
        b = band(F.col(data), F.col(n_bands), band_index)
        return _result(df, value(b, *args), name or default(band_index, *args), full)

    return operation


def _two(default: Callable[[int, int], str], value: Callable[[Column, Column], Column]):
    """An operation on two bands."""

    def operation(df: DataFrame, band1: int, band2: int, data: str = "data", n_bands: str = "nBands", name: str | None = None, full: bool = True) -> DataFrame:
        a, b = (band(F.col(data), F.col(n_bands), i) for i in (band1, band2))
        return _result(df, value(a, b), name or default(band1, band2), full)

    return operation


def _named(text: str) -> Callable[..., str]:
    return lambda *args: text.format(*args)


def _cells(value: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.zip_with(a, b, value)


get_band_from_array_data = _one(_named("band_value{0}"), lambda b: b)
get_normalized_band = _one(_named("normalized_band{0}"), normalized)
get_band_mean = _one(_named("mean_band{0}"), lambda b: round2(_mean(b)))
get_band_mode = _one(_named("mode_band{0}"), mode)
mask_band_on_greater_than = _one(_named("masked_band{0}"), lambda b, t: masked(b, lambda v: v > t))
mask_band_on_greater_than_equal = _one(_named("masked_band{0}"), lambda b, t: masked(b, lambda v: v >= t))
mask_band_on_less_than = _one(_named("masked_band{0}"), lambda b, t: masked(b, lambda v: v < t))
mask_band_on_less_than_equal = _one(_named("masked_band{0}"), lambda b, t: masked(b, lambda v: v <= t))
multiply_band_by_factor = _one(_named("multiplied_band{0}"), lambda b, f: F.transform(b, lambda v: v * f))
get_occurrence_count = _one(lambda i, t: f"count_{t:g}_in_band{i}".replace(".", "_"), lambda b, t: F.size(F.filter(b, lambda v: v == t)))
get_modulas = _one(_named("band{0}_modulo_{1}"), lambda b, d: F.transform(b, lambda v: F.try_mod(v, F.lit(float(d)))))
get_square_root = _one(_named("square_root_band{0}"), lambda b: F.transform(b, lambda v: round2(F.sqrt(v))))

get_normalized_difference_index = _two(_named("normalized_difference"), normalized_difference)
add_bands = _two(_named("added_bands_{0}_{1}"), _cells(lambda x, y: x + y))
subtract_bands = _two(_named("subtracted_bands_{0}_{1}"), _cells(lambda x, y: x - y))
multiply_bands = _two(_named("multiplied_bands_{0}_{1}"), _cells(lambda x, y: x * y))
divide_bands = _two(_named("divided_bands_{0}_{1}"), _cells(lambda x, y: round2(F.try_divide(x, y))))
bitwise_and_of_bands = _two(_named("bitwise_and_bands_{0}_{1}"), _cells(lambda x, y: x.cast("int").bitwiseAND(y.cast("int")).cast("double")))
bitwise_or_of_bands = _two(_named("bitwise_or_bands_{0}_{1}"), _cells(lambda x, y: x.cast("int").bitwiseOR(y.cast("int")).cast("double")))
logical_difference_of_bands = _two(_named("logical_diff_bands_{0}_{1}"), _cells(lambda x, y: F.when(x != y, x).otherwise(0.0)))
logical_over_of_bands = _two(_named("logical_over_bands_{0}_{1}"), _cells(lambda x, y: F.when(x != 0, x).otherwise(y)))


def append_normalized_difference_index(df: DataFrame, band1: int, band2: int, data: str = "data", n_bands: str = "nBands") -> DataFrame:
    """The rasters with the index as one more band."""
    a, b = (band(F.col(data), F.col(n_bands), i) for i in (band1, band2))
    return df.withColumns({data: F.concat(F.col(data), normalized_difference(a, b)), n_bands: F.col(n_bands) + 1})


def get_normalized_array_data(df: DataFrame, data: str = "data", n_bands: str = "nBands", name: str = "normalized_array_data", full: bool = True) -> DataFrame:
    """Each band standardised by its mean and deviation."""
    return _result(df, standardized(F.col(data), F.col(n_bands)), name, full)
