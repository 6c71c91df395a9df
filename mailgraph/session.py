"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Mail times carry no zone, so every epoch conversion is done in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot sender, mail or word may hold a third of all rows: let joins split it,
    # also where the split costs one more shuffle further up.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shuffle files go when their query ends, not when the driver next collects its garbage: a
    # model's passes need the disk of one pass.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job in this package relies on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "mailgraph") -> SparkSession:
    return prepare(SparkSession.builder.appName(app_name).getOrCreate())


def scratch_folder(spark: SparkSession) -> str:
    """The reliable folder for intermediate tables, shared by all executors.

    This is the cluster's ``spark.checkpoint.dir``. Only a local session without that setting
    gets a temporary folder; on a cluster a missing setting is an error, because a
    machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="mailgraph-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def bounded_tasks(spark: SparkSession, rows: int, task_rows: int) -> int:
    """Number of tasks that gives each some ``task_rows`` rows, but work to every core.

    A number that is given is kept: adaptive execution makes of a default one few tasks, which
    then hold more the more rows there are.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // task_rows))


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, keep it as a table in the scratch folder and cut its lineage.

    A Parquet table is smaller than an RDD checkpoint and is read column by column. It stays
    in the folder, like a checkpoint, until the cluster's retention rule removes it.

    Lookup tables are settled before they are joined to rows with hot keys: adaptive execution
    splits a hot key only where both join sides come straight from a shuffle, which the result
    of an aggregation by that key does not.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/mailgraph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
