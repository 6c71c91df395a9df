"""Runs of rows that follow each other within a tolerance, numbered without a window per key.

Rows are range-partitioned by key and time, so a hot key lies in many partitions. Each task
numbers the runs inside its own rows and carries the row before along; what a run is at a border
follows from the first and the last row of every partition, one small row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgraph.operators.numbering import partition_of, row_in_partition
from mailgraph.session import settle


def gap_runs(
    df: DataFrame, keys: list[str], time: str, tol: float, tie: str, name: str = "run"
) -> DataFrame:
    """Add the number of each row's run, from 1, and ``prior``, the ``tie`` value of the row before.

    A run ends where the next row of the same key, in the order of ``time`` and ``tie``, comes
    more than ``tol`` later; ``prior`` is null for its first row. Rows without a time are in no
    run and left out. Null keys are a key of their own. ``tie`` is a whole number.
    """
    order = [*keys, time, tie]
    rows = df.filter(F.col(time).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, runs = None, 0
        for batch in batches:
            if not len(batch):
                continue
            whole = batch if before is None else pd.concat([before, batch], ignore_index=True)
            last = whole.shift()
            starts = (whole[time] - last[time] > tol).to_numpy()
            for key in keys:
                starts |= ~((whole[key] == last[key]) | (whole[key].isna() & last[key].isna())).to_numpy()
            # The partition's first row belongs to its run 0, whether or not that began before.
            starts[0] = False
            local = runs + np.cumsum(starts)
            prior = last[tie].astype("Int64").mask(starts)
            skip = len(whole) - len(batch)
            yield batch.assign(_local=local[skip:], prior=prior.to_numpy(dtype=object, na_value=None)[skip:])
            before, runs = batch.tail(1).reset_index(drop=True), int(local[-1])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    numbered = rows.mapInPandas(number, ", ".join([*fields, "_local bigint", "prior bigint"]))
    placed = settle(numbered.withColumn("_at", F.monotonically_increasing_id()))
    edge = F.struct(*order)
    ends = placed.groupBy(partition_of("_at").alias("_part")).agg(
        F.min_by(edge, "_at").alias("first"), F.max_by(edge, "_at").alias("last"), F.max("_local").alias("runs")
    )
    shifts, done, before = [], 0, None
    # One row for each partition, whatever the number of rows.
    for row in ends.orderBy("_part").collect():
        first = row["first"]
        goes_on = (
            before is not None
            and all(first[k] == before[k] for k in keys)
            and first[time] - before[time] <= tol
        )
        base = done if goes_on else done + 1
        shifts.append((row["_part"], base, before[tie] if goes_on else None))
        done, before = base + row["runs"], row["last"]
    shift = df.sparkSession.createDataFrame(shifts, "_part bigint, _base bigint, _prior bigint")
    at_border = row_in_partition("_at") == 0
    return (
        placed.withColumn("_part", partition_of("_at"))
        .join(F.broadcast(shift), "_part")
        .withColumn(name, F.col("_base") + F.col("_local"))
        .withColumn("prior", F.when(at_border, F.col("_prior")).otherwise(F.col("prior")))
        .drop("_at", "_part", "_local", "_base", "_prior")
    )


def near_duplicate_runs(df: DataFrame, key: str, time: str, tol: float, tie: str) -> DataFrame:
    """(key, run, first, last, mails) of all runs of two rows or more."""
    return (
        gap_runs(df.select(key, time, tie), [key], time, tol, tie)
        .groupBy("run")
        .agg(
            F.first(key).alias(key),
            F.min(time).alias("first"),
            F.max(time).alias("last"),
            F.count("*").alias("mails"),
        )
        .filter("mails > 1")
        .select(key, "run", "first", "last", "mails")
    )
