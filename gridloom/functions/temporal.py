"""Date functions, trims and time steps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidParameters

DEFAULT_FORMAT = "yyyy-MM-dd HH:mm:ss"


def unix_seconds(df: DataFrame, column: str, date_format: str = DEFAULT_FORMAT) -> Column:
    """Whole seconds since 1970 of a text, date or timestamp column; null for a
    text that doesn't parse."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.StringType):
        return F.unix_timestamp(F.try_to_timestamp(c, F.lit(date_format)))
    return F.unix_timestamp(c.cast("timestamp"))


def convert_date_format(df: DataFrame, date_column: str, new_format: str, alias: str | None = None) -> DataFrame:
    return df.withColumn(alias or f"reformatted_{date_column}", F.date_format(date_column, new_format))


def get_unix_timestamp(df: DataFrame, date_column: str, date_format: str = DEFAULT_FORMAT, alias: str | None = None) -> DataFrame:
    return df.withColumn(alias or f"unix_{date_column}", unix_seconds(df, date_column, date_format))


def _between(c: Column, lower, upper) -> Column:
    if lower is None and upper is None:
        raise InvalidParameters("give a lower or an upper bound")
    tests = ([c >= lower] if lower is not None else []) + ([c <= upper] if upper is not None else [])
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]


def trim_on_timestamp(df: DataFrame, time_column: str, upper: float | None = None, lower: float | None = None) -> DataFrame:
    """Rows within the bounds, both included; null times go.  The bare column is
    compared, so the filter reaches the scan."""
    return df.filter(_between(F.col(time_column), lower, upper))


def trim_on_datetime(df: DataFrame, date_column: str, upper: str | datetime | None = None, lower: str | datetime | None = None, date_format: str = DEFAULT_FORMAT) -> DataFrame:
    """Rows within the bounds to the second, both included.

    Of a date or timestamp column the bare column is compared with bounds of
    its type, so the filter reaches the scan; a text column is parsed with
    ``date_format``.  Bounds given as text are written as in DEFAULT_FORMAT.
    """
    kind = df.schema[date_column].dataType
    if isinstance(kind, T.StringType):
        literal = lambda b: None if b is None else F.unix_timestamp(F.lit(b).cast("timestamp"))
        return df.filter(_between(unix_seconds(df, date_column, date_format), literal(lower), literal(upper)))
    sql_type = kind.simpleString()
    low = None if lower is None else F.lit(lower).cast(sql_type)
    # whole seconds are compared, so what is within the last second stays
    below = None if upper is None else (F.lit(upper).cast("timestamp") + F.expr("INTERVAL 1 SECOND")).cast(sql_type)
    if isinstance(kind, T.DateType):
        return df.filter(_between(F.col(date_column), low, None if upper is None else F.lit(upper).cast("date")))
    tests = ([] if low is None else [F.col(date_column) >= low]) + ([] if below is None else [F.col(date_column) < below])
    if not tests:
        raise InvalidParameters("give a lower or an upper bound")
    return df.filter(tests[0] if len(tests) == 1 else tests[0] & tests[1])


def add_temporal_steps(df: DataFrame, timestamp_column: str, step_duration: int, alias: str | None = None, origin: int | None = None) -> DataFrame:
    """The step of each row, from the least time (or ``origin``); null times have
    none.  The least time is a scalar subquery: one pass, nothing collected."""
    start = F.lit(origin) if origin is not None else df.agg(F.min(timestamp_column)).scalar()
    step = F.floor((F.col(timestamp_column) - start) / F.lit(step_duration)).cast("long")
    return df.withColumn(alias or "temporal_steps", step)


def get_temporal_steps_count(df: DataFrame, steps_column: str) -> int:
    """The last step and one; 0 without rows."""
    last = df.agg(F.max(steps_column)).first()[0]
    return 0 if last is None else last + 1
