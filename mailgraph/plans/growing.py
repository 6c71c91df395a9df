"""Tables that grow with every load: document frequencies, lasting ids, monthly pairs.

A load writes what its own rows add, below ``batch=n`` of each table, and then one row with running
totals to ``loads``. A load that failed midway has no such row: its folders are ignored and written
over by the next try. What earlier loads have written is never written again: counts are added up
when they are read, and ids once given stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgraph.functions.numeric import smooth_idf
from mailgraph.operators import graph as G
from mailgraph.operators.numbering import dense_ids
from mailgraph.session import settle
from mailgraph.sources.tables import append_table, not_in, stored

TERM_LOADS = "batch int, documents bigint"
GRAPH_LOADS = "batch int, nodes bigint, connections bigint, first bigint, last bigint"


def last_load(spark: SparkSession, folder: str):
    """The row of the latest load, None before the first: totals run on from load to load."""
    loads = stored(spark, f"{folder}/loads")
    return None if loads is None else loads.orderBy(F.desc("batch")).first()


def _rows(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """Rows of all finished loads of a table."""
    last, table = last_load(spark, folder), stored(spark, f"{folder}/{name}")
    if last is None or table is None:
        return None
    return table.filter(F.col("batch") <= last["batch"]).drop("batch")


def _write(df: DataFrame, folder: str, name: str, batch: int) -> DataFrame:
    path = f"{folder}/{name}/batch={batch}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _commit(spark: SparkSession, folder: str, row: tuple, schema: str) -> None:
    append_table(spark.createDataFrame([row], schema).coalesce(1), f"{folder}/loads")


def add_terms(tf: DataFrame, folder: str) -> None:
    """Add the rows (file_id, word, …) of new documents, one for each word of a document.

    Of earlier loads only the words are read, to tell which are new.
    """
    spark = tf.sparkSession
    last = last_load(spark, folder)
    batch, documents = (last["batch"] + 1, last["documents"]) if last else (1, 0)
    tf = settle(tf.select("file_id", "word"))
    documents += tf.select("file_id").distinct().count()
    counts = _write(tf.groupBy("word").agg(F.count("*").alias("df")), folder, "frequencies", batch)
    known = _rows(spark, folder, "frozen")
    fresh = counts if known is None else not_in(counts, known, ["word"], unique=True)
    frozen = fresh.select("word", smooth_idf(F.lit(documents), F.col("df")).alias("idf"), "df")
    _write(frozen, folder, "frozen", batch)
    _commit(spark, folder, (batch, documents), TERM_LOADS)


def idf_after_loads(spark: SparkSession, folder: str, frozen: bool = False) -> DataFrame:
    """word, idf, df over all loads; with ``frozen`` as they were when the word first came."""
    if frozen:
        return _rows(spark, folder, "frozen").select("word", "idf", "df")
    documents = last_load(spark, folder)["documents"]
    sums = _rows(spark, folder, "frequencies").groupBy("word").agg(F.sum("df").alias("df"))
    return sums.select("word", smooth_idf(F.lit(documents), F.col("df")).alias("idf"), "df")


def _numbered(new: DataFrame, known: DataFrame | None, keys: list[str], name: str, start: int) -> DataFrame:
    """Keys that no earlier load has, numbered on from ``start`` in key order."""
    unseen = new if known is None else not_in(new, known, keys, unique=True)
    return dense_ids(unseen, keys, name, start).select(name, *keys)


def add_edges(edges: DataFrame, folder: str) -> None:
    """Add new edges (sender, recipient, msg_time, …) to accounts, connections and months.

    Mails of a month matter by month only, but for those of its last day, on which one window
    ends and the next begins: their times are kept, all others stand for the month's first second.
    """
    spark = edges.sparkSession
    last = last_load(spark, folder)
    batch, nodes, pairs = (last["batch"] + 1, last["nodes"], last["connections"]) if last else (1, 0, 0)
    edges = settle(edges.select("sender", "recipient", "msg_time"))
    accounts = _numbered(G.account_names(edges), _rows(spark, folder, "accounts"), ["account"], "node_id", nodes)
    nodes += _write(accounts, folder, "accounts", batch).count()
    counts = _write(G.pair_frequency(edges), folder, "pair_counts", batch)
    ends = ["sender", "recipient"]
    found = _numbered(counts.select(*ends), _rows(spark, folder, "connections"), ends, "connection_id", pairs + 1)
    pairs += _write(found, folder, "connections", batch).count()
    chosen = G.filtered_edges(edges)
    day = F.timestamp_seconds(F.floor("msg_time")).cast("date")
    month = F.unix_timestamp(F.trunc(day, "month").cast("timestamp")).cast("double")
    time = F.when(day == F.last_day(day), F.col("msg_time")).otherwise(month)
    months = chosen.withColumn("msg_time", time).groupBy(*ends, "msg_time").agg(F.count("*").alias("mails"))
    _write(months, folder, "months", batch)
    spans = [span for span in (G.time_span(chosen), last and (last["first"], last["last"])) if span and span[0] is not None]
    first, end = (min(s[0] for s in spans), max(s[1] for s in spans)) if spans else (None, None)
    _commit(spark, folder, (batch, nodes, pairs, first, end), GRAPH_LOADS)


def accounts_after_loads(spark: SparkSession, folder: str) -> DataFrame:
    """node_id, account: those of the first load in name order from 0, later ones numbered on."""
    return _rows(spark, folder, "accounts").select("node_id", "account")


def connections_after_loads(spark: SparkSession, folder: str) -> DataFrame:
    """connection_id, sender, recipient, frequency over all loads."""
    ends = ["sender", "recipient"]
    sums = _rows(spark, folder, "pair_counts").groupBy(*ends).agg(F.sum("frequency").alias("frequency"))
    return _rows(spark, folder, "connections").join(sums, ends).select("connection_id", *ends, "frequency")


def monthly_edges_after_loads(spark: SparkSession, folder: str) -> DataFrame:
    """As ``graph.monthly_edges`` of all edges, from the monthly counts of the loads."""
    last = last_load(spark, folder)
    span = None if last["first"] is None else (last["first"], last["last"])
    windowed = G.in_month_windows(_rows(spark, folder, "months"), span)
    keys = ["window_start", "window_end", "sender", "recipient"]
    pairs = windowed.groupBy(*keys).agg(F.sum("mails").alias("mails"))
    return G.number_snapshots(pairs).select("snapshot", *keys, "mails")
