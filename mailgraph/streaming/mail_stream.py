"""Continuous loading of a mail archive: each new file is parsed and catalogued once.

The stream's checkpoint remembers which files were read. De-duplication against stored
edges carries the arrival rule across batches; a batch repeated after a failure is recognised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailgraph.plans.mail_etl import load_batch
from mailgraph.sources.mail_files import FILE_SCHEMA, as_text


def mail_file_stream(spark: SparkSession, root: str, files_per_batch: int | None = None) -> DataFrame:
    reader = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", True)
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(root).select("path", as_text(F.col("content")).alias("text"))


def start_loading(mails: DataFrame, folder: str, checkpoint: str, **options) -> StreamingQuery:
    """Load a stream of (path, text) into the tables below ``folder`` until it is used up."""

    def load(batch: DataFrame, batch_id: int) -> None:
        load_batch(batch, folder, token=f"{checkpoint}#{batch_id}", **options)

    return (
        mails.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
