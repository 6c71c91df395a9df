"""Time-tolerant matching inside a key, without listing pairs.

Times are cut into cells as wide as the tolerance, so everything within the tolerance lies in
the same or a neighbouring cell. Windows run per (key, cell) over distinct times, which bounds
them by the time resolution and not by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell_of(time: Column, tol: float) -> Column:
    """Number of the cell holding ``time``; without tolerance every time is its own cell."""
    return F.floor(time / F.lit(float(tol))) if tol > 0 else time


def reach(cell: Column, tol: float) -> Column:
    """Cells that can see a row of ``cell``."""
    return F.array(cell - 1, cell, cell + 1) if tol > 0 else F.array(cell)


def nearest_within(
    left: DataFrame, right: DataFrame, keys: list[str], time: str, tol: float
) -> DataFrame:
    """Left rows having a right row of the same key within ``tol``, with its ``prior_time``.

    Of two equally near times the earlier is taken. The left side, as a rule the smaller one,
    is copied to the neighbouring cells; the right side is not.
    """
    asked = left.select(*keys, time).distinct()
    asked = asked.withColumn("_cell", F.explode(reach(cell_of(F.col(time), tol), tol)))
    known = right.select(*keys, time).distinct()
    known = known.withColumns({"_cell": cell_of(F.col(time), tol), "_known": F.lit(True)})
    both = asked.withColumn("_known", F.lit(False)).unionByName(known)

    line = Window.partitionBy(*keys, "_cell").orderBy(time, F.desc("_known"))
    seen = F.when(F.col("_known"), F.col(time))
    found = both.withColumns(
        {
            "_before": F.last(seen, True).over(line.rowsBetween(Window.unboundedPreceding, 0)),
            "_after": F.first(seen, True).over(line.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).filter(~F.col("_known"))
    back, ahead = F.col(time) - F.col("_before"), F.col("_after") - F.col(time)
    use_before = F.col("_before").isNotNull() & (F.col("_after").isNull() | (back <= ahead))
    found = (
        found.withColumn("prior_time", F.when(use_before, F.col("_before")).otherwise(F.col("_after")))
        .withColumn("time_diff", F.abs(F.col(time) - F.col("prior_time")))
        .filter(F.col("time_diff") <= tol)
        .groupBy(*keys, time)
        .agg(F.min(F.struct("time_diff", "prior_time")).alias("_best"))
        .select(*keys, time, "_best.prior_time", "_best.time_diff")
    )
    return left.join(found, [*keys, time])


def near_neighbours(df: DataFrame, keys: list[str], time: str, tol: float) -> DataFrame:
    """Rows that have another row of the same key within ``tol``, with the smallest ``gap``."""
    times = df.groupBy(*keys, time).agg(F.count("*").alias("_rows"))
    home = cell_of(F.col(time), tol)
    cells = times.withColumn("_home", home).withColumn("_cell", F.explode(reach(home, tol)))
    line = Window.partitionBy(*keys, "_cell").orderBy(time)
    back = F.col(time) - F.lag(time).over(line)
    ahead = F.lead(time).over(line) - F.col(time)
    gap = F.when(F.col("_rows") > 1, F.lit(0.0)).otherwise(F.least(back, ahead))
    gaps = (
        cells.withColumn("gap", gap)
        .filter((F.col("_cell") == F.col("_home")) & (F.col("gap") <= tol))
        .select(*keys, time, "gap")
    )
    return df.join(gaps, [*keys, time])
