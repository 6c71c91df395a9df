"""Running numbers without a single-task window.

Rows are range-partitioned and sorted, numbered inside each partition, and shifted by the
number of rows in the partitions before. Range bounds come from sampling, so the sorted rows
are settled before they are counted. Ranges cut through a hot group, which therefore is
numbered by many tasks.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailgraph.operators.joins import null_safe_join
from mailgraph.session import settle

# monotonically_increasing_id holds the partition above bit 33 and the row below it.
_ROW_BITS = 33


def _placed(df: DataFrame, order: list) -> DataFrame:
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(ranged.withColumn("_at", F.monotonically_increasing_id()))


def partition_of(number: str) -> Column:
    """The partition in which ``monotonically_increasing_id`` gave this number."""
    return F.shiftright(number, _ROW_BITS)


def row_in_partition(number: str) -> Column:
    return F.col(number).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))


def dense_ids(df: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """Add consecutive numbers from ``start`` in the order of the ``order`` columns."""
    placed = _placed(df, order)
    counts = placed.groupBy(partition_of("_at").alias("_part")).count().orderBy("_part").collect()
    # One row per partition, whatever the number of rows.
    before = accumulate((row["count"] for row in counts), initial=start)
    shifts = df.sparkSession.createDataFrame(
        [(row["_part"], shift) for row, shift in zip(counts, before)],
        "_part bigint, _shift bigint",
    )
    row = F.col("_at") - F.shiftleft("_part", _ROW_BITS)
    return (
        placed.withColumn("_part", partition_of("_at"))
        .join(F.broadcast(shifts), "_part")
        .withColumn(name, row + F.col("_shift"))
        .drop("_at", "_part", "_shift")
    )


def position_in_group(
    df: DataFrame, group: list[str], order: list, name: str, total: str | None = None
) -> DataFrame:
    """Add each row's position (from 1) in its group, and the group's size as ``total``.

    A group that spans several partitions gets, per partition, the number of its rows in the
    partitions before; the join key (group, partition) never holds more than one partition.
    """
    placed = _placed(df, [*group, *order]).withColumn("_part", partition_of("_at"))
    spans = placed.groupBy(*group, "_part").agg(
        F.min("_at").alias("_first"), F.count("*").alias("_rows")
    )
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    if total:
        spans = spans.withColumn(total, F.sum("_rows").over(whole))
    # Null is a group of its own.
    return (
        null_safe_join(placed, spans, [*group, "_part"])
        .withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1)
        .drop("_at", "_part", "_first", "_rows", "_before")
    )
