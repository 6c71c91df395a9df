"""Tables: reading, appending, insert-if-absent and status updates."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgraph.operators.joins import null_safe_join
from mailgraph.session import settle


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int,
              properties: dict[str, str] | None = None) -> DataFrame:
    """Table of an external database, read by ``parts`` tasks over ranges of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high,
                           numPartitions=parts, properties=properties or {})


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def not_in(df: DataFrame, existing: DataFrame, keys: list[str], unique: bool = False) -> DataFrame:
    """Rows of ``df`` whose key is not yet in ``existing``.

    ``unique`` says that ``existing`` is a stored table with one row per key.
    """
    found = existing.select(*keys)
    return df.join(found if unique else settle(found.distinct()), keys, "left_anti")


def absent_rows(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to insert so that no key is there twice: new keys only, one row for each."""
    return not_in(df.dropDuplicates(keys), existing, keys)


def mark_status(df: DataFrame, done: DataFrame, key: str, status: str = "OK") -> DataFrame:
    """New version of ``df`` with ``status`` set on every row whose key is in ``done``."""
    flags = settle(done.select(key).distinct()).withColumn("_done", F.lit(True))
    new_status = F.when(F.col("_done"), F.lit(status)).otherwise(F.col("status"))
    return df.join(flags, key, "left").withColumn("status", new_status).drop("_done")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None if nothing has been written there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_exports(records: DataFrame, path: str, folders: int = 64) -> None:
    """Append sender records as JSON lines below ``records``, and their users to ``users``.

    Users are spread over a fixed number of folders by a hash, so millions of them do not make
    millions of folders. The users come last: an export that failed midway is not taken for done.
    """
    records = settle(records)
    folder = F.pmod(F.xxhash64("user_folder"), F.lit(folders)).alias("folder")
    records.select("*", folder).write.mode("append").partitionBy("folder").json(f"{path}/records")
    append_table(records.select("user_folder").distinct(), f"{path}/users")


def unexported(records: DataFrame, path: str) -> DataFrame:
    """Records of users that have no export below ``path`` yet; only the list of users is read.

    Records without a user folder are those of one user."""
    done = stored(records.sparkSession, f"{path}/users")
    if done is None:
        return records
    return null_safe_join(records, settle(done.select("user_folder").distinct()), ["user_folder"], "left_anti")


def write_snapshots(edges: DataFrame, path: str) -> None:
    """Snapshot edges as Parquet, one folder per snapshot, so that a reader prunes by month.

    Rows are ranged by snapshot and sender first: a task writes to few folders.
    """
    ranged = edges.repartitionByRange("snapshot", edges.columns[1])
    ranged.write.mode("overwrite").partitionBy("snapshot").parquet(path)
