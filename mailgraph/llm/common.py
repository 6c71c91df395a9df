"""What several operators of this folder share: table reading, words, and batch functions."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailgraph.session import prepare

# Rows of one Arrow batch: with texts of some kilobytes a batch stays in tens of megabytes.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: bytes) -> list[bytes]:
    """Maximal runs of bytes other than blank, tab, \\n, \\v, \\f, \\r: the words of UTF-8 text."""
    return text.split()


def texts_of(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def kept_in_worker(key: str, make: Callable):
    """A table that is built once per Python worker.

    Functions travel to the tasks by value, so a module's globals are new in every task; the
    worker process outlives it. Keep only what has a fixed bound here.
    """
    store = sys.modules.setdefault("mailgraph_worker", types.ModuleType("mailgraph_worker"))
    if key not in store.__dict__:
        store.__dict__[key] = make()
    return store.__dict__[key]


def append_columns(
    df: DataFrame, inputs: list[str], outputs: str, function: Callable[..., Iterator]
) -> DataFrame:
    """Append columns made batch by batch.

    ``function(*arrays)`` takes the input columns of one batch and returns the new columns as
    lists or arrays. A column of ``df`` that has the name of a new one is replaced.
    """
    new = T._parse_datatype_string(outputs)
    kept = [c for c in df.columns if c not in new.names or c in inputs]
    out_names = [c for c in kept if c not in new.names]
    schema = T.StructType([df.schema[c] for c in out_names] + new.fields)
    arrow_types = _arrow_types(new)

    def run(batches):
        for batch in batches:
            results = function(*[batch.column(c) for c in inputs])
            arrays = [batch.column(c) for c in out_names]
            arrays += [
                r if isinstance(r, (pa.Array, pa.ChunkedArray)) else pa.array(r, kind)
                for r, kind in zip(results, arrow_types)
            ]
            yield pa.RecordBatch.from_arrays(arrays, out_names + new.names)

    return df.select(*kept).mapInArrow(run, schema)


def _arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(field.dataType) for field in schema]
