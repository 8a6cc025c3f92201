"""The grid aggregate over a stream.

The least time of a stream isn't known, so steps are counted from an origin;
the grid's box is given too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_grid_counts(events: DataFrame, x: str, y: str, time: str, box: tuple[float, float, float, float], partitions_x: int, partitions_y: int, step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by ``cell_id`` and ``step`` of events in the box; events later than
    ``late`` after the newest are dropped, so that old windows can be closed."""
    xmin, ymin, xmax, ymax = map(float, box)
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).filter(F.col(x).between(xmin, xmax) & F.col(y).between(ymin, ymax))
    # the upper edges belong to the last cells
    col = F.least(F.floor((F.col(x) - xmin) / ((xmax - xmin) / partitions_x)), F.lit(partitions_x - 1))
    row = F.least(F.floor((F.col(y) - ymin) / ((ymax - ymin) / partitions_y)), F.lit(partitions_y - 1))
    cell = (row * partitions_x + col).cast("int").alias("cell_id")
    return rows.groupBy(F.window(time, step).alias("w"), cell).agg(F.count("*").alias("aggregated_feature")).select(F.col("w.start").alias("step"), "cell_id", "aggregated_feature")
