"""Raw mail files to relational tables, first load and increments alike."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgraph.functions import headers as H
from mailgraph.functions.tokens import without_stop_words
from mailgraph.operators import messages as M
from mailgraph.operators import terms as T
from mailgraph.operators.dedupe import dedupe_messages
from mailgraph.operators.numbering import dense_ids
from mailgraph.plans import growing
from mailgraph.session import settle
from mailgraph.sources import mail_files as S
from mailgraph.sources.tables import append_table, not_in, stored


@dataclass
class MailTables:
    mail_list: DataFrame
    emails: DataFrame
    recipients: DataFrame
    edges: DataFrame
    duplicate_log: DataFrame
    unprocessed_log: DataFrame
    reject_log: DataFrame
    body_tf: DataFrame
    subject_tf: DataFrame


TABLES = [f.name for f in fields(MailTables)]
# Buckets of the table of known links.
LINK_BUCKETS = 32


def new_files(files: DataFrame, *known: DataFrame | None) -> DataFrame:
    """Files whose link is in none of the tables given, each with one row for a link."""
    links = files.withColumn("file_link", H.escape_path(F.col("path")))
    for table in known:
        if table is not None:
            links = not_in(links, table, ["file_link"], unique=True)
    return links.drop("file_link")


def link_table(spark: SparkSession, folder: str, buckets: int = LINK_BUCKETS) -> str:
    """Name of the table of all links that loads have catalogued or logged, bucketed by link.

    Its files lie below ``folder``; the name is only this session's. An increment is dealt into the
    buckets, the table itself is not shuffled. ``buckets`` must stay as it was first given, and be
    at least the number of shuffle partitions: below that the engine deals out both sides.
    """
    path = f"{folder}/links"
    name = f"mailgraph_links_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (file_link STRING, attempt STRING) USING parquet"
        f" CLUSTERED BY (file_link) SORTED BY (file_link) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    spark.catalog.refreshTable(name)
    return name


def known_links(spark: SparkSession, folder: str, buckets: int = LINK_BUCKETS) -> DataFrame | None:
    """Links of all files that finished loads have catalogued or logged; None before the first.

    Rows of a load that failed midway carry an attempt that ``loads`` does not name.
    """
    loads = stored(spark, f"{folder}/loads")
    if loads is None:
        return None
    attempts = [row["attempt"] for row in loads.select("attempt").distinct().collect()]
    table = spark.table(link_table(spark, folder, buckets))
    return table.filter(F.col("attempt").isin(attempts)).select("file_link")


def _add_links(spark: SparkSession, folder: str, batch: int, attempt: str, buckets: int) -> None:
    """The links that a batch has just written to its catalogue and logs."""
    written = [spark.read.parquet(f"{folder}/{name}/batch={batch}") for name in ("mail_list", "unprocessed_log")]
    rejected = spark.read.parquet(f"{folder}/reject_log/batch={batch}")
    links = rejected.select(H.escape_path(F.col("path")).alias("file_link"))
    for table in written:
        links = links.unionByName(table.select("file_link"))
    links = links.repartition(buckets, "file_link").withColumn("attempt", F.lit(attempt))
    links.write.insertInto(link_table(spark, folder, buckets))


def file_numbers(files: DataFrame, start: int = 1) -> DataFrame:
    """path, file_id: arrival numbers in path order. Only paths are read and sorted."""
    return dense_ids(files.select("path"), ["path"], "file_id", start)


def parse_files(
    files: DataFrame, stop_words: list[str] | None = None, fix_fwd: bool = False
) -> DataFrame:
    """Messages with tokens and status from raw files (path, text), without body texts.

    This needs no shuffle; what leaves the task is smaller than the file.
    """
    parsed = M.to_messages(S.split_mail(files), fix_fwd)
    return M.with_status(M.with_tokens(parsed, stop_words)).drop("body")


def read_messages(
    files: DataFrame,
    numbers: DataFrame,
    stop_words: list[str] | None = None,
    lemmas: DataFrame | None = None,
    fix_fwd: bool = False,
) -> DataFrame:
    """Parsed and numbered messages, stored once for all tables built from them.

    Raw files are dealt out by their path before they are parsed, however few row groups hold them.
    """
    early_stops = stop_words if lemmas is None else None
    numbered = files.join(numbers, "path").repartition("path")
    messages = settle(parse_files(numbered, early_stops, fix_fwd))
    if lemmas is None:
        return messages
    # Lemmas come before stop words.
    columns = ("body_tokens", "subject_tokens")
    for column in columns:
        messages = M.lemmatise(messages, lemmas, column)
    kept = {c: without_stop_words(F.col(c), stop_words or []) for c in columns}
    return settle(M.with_status(messages.withColumns(kept)))


def build_tables(
    messages: DataFrame, existing_edges: DataFrame | None = None, tol: float = 2.0
) -> MailTables:
    """All tables of one batch of messages from ``read_messages``."""
    valid = messages.filter("status = 'valid'")
    kept, log = dedupe_messages(valid, existing_edges, tol)
    log = settle(log)
    kept = not_in(valid, log, ["file_id"], unique=True)
    return MailTables(
        mail_list=M.mail_list_table(valid),
        emails=M.emails_table(kept),
        recipients=M.recipients_table(kept),
        edges=M.edges_table(kept),
        duplicate_log=log,
        unprocessed_log=M.unprocessed_log(messages),
        reject_log=messages.filter("reject_reason is not null").select(
            "file_id", "path", "reject_reason"
        ),
        body_tf=T.term_frequency(kept, "body_tokens"),
        subject_tf=T.term_frequency(kept, "subject_tokens"),
    )


def stored_table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """Rows of all finished batches of a table below ``folder``; None before the first."""
    loads, table = stored(spark, f"{folder}/loads"), stored(spark, f"{folder}/{name}")
    if loads is None or table is None:
        return None
    return table.filter(F.col("batch") <= loads.agg(F.max("batch")).first()[0]).drop("batch")


def load_batch(
    files: DataFrame,
    folder: str,
    token: str | None = None,
    stop_words: list[str] | None = None,
    lemmas: DataFrame | None = None,
    tol: float = 2.0,
    fix_fwd: bool = False,
    link_buckets: int = LINK_BUCKETS,
) -> None:
    """Add files (path, text) that are not catalogued yet to the tables below ``folder``.

    Every batch writes its own ``batch=n`` folders and then one row to ``loads``. A batch that
    failed midway has no such row: its folders are ignored and written over by the next try.
    A batch whose ``token`` is already there is not loaded again.
    """
    spark = files.sparkSession
    batch, last_id = 1, 0
    loads = stored(spark, f"{folder}/loads")
    if loads is not None:
        if token is not None and not loads.filter(F.col("token") == token).isEmpty():
            return
        done = loads.agg(F.max("batch"), F.max("last_file_id")).first()
        batch, last_id = done[0] + 1, done[1]
    files = new_files(files, known_links(spark, folder, link_buckets))
    numbers = settle(file_numbers(files, last_id + 1))
    messages = read_messages(files, numbers, stop_words, lemmas, fix_fwd)
    tables = build_tables(messages, stored_table(spark, folder, "edges"), tol)
    for name in TABLES:
        getattr(tables, name).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
    attempt = uuid.uuid4().hex
    _add_links(spark, folder, batch, attempt, link_buckets)
    last_id = numbers.agg(F.max("file_id")).first()[0] or last_id
    load = spark.createDataFrame(
        [(batch, last_id, token, attempt)], "batch int, last_file_id bigint, token string, attempt string"
    )
    append_table(load.coalesce(1), f"{folder}/loads")


def load_archive(
    spark: SparkSession, root: str, folder: str, stop_word_file: str | None = None, **options
) -> None:
    """Load the files below ``root``; stop words come as a list or from a file of one per line."""
    if stop_word_file is not None:
        options["stop_words"] = S.stop_word_list(spark, stop_word_file)
    load_batch(S.scan_mail_files(spark, root), folder, **options)


def grow(spark: SparkSession, folder: str) -> None:
    """Bring the growing tables below ``folder`` up to the loads: term counts, ids, months.

    Only batches that they do not hold yet are read; see ``growing``.
    """
    jobs = (
        ("body_tf", "body_growth", growing.add_terms),
        ("subject_tf", "subject_growth", growing.add_terms),
        ("edges", "graph_growth", growing.add_edges),
    )
    for name, target, add in jobs:
        last = growing.last_load(spark, f"{folder}/{target}")
        done = stored(spark, f"{folder}/loads").agg(F.max("batch")).first()[0]
        for batch in range(last["batch"] + 1 if last else 1, done + 1):
            add(spark.read.parquet(f"{folder}/{name}/batch={batch}"), f"{folder}/{target}")


def build_term_tables(tf: DataFrame, folder: str, name: str) -> None:
    """IDF and TF-IDF tables of a stored term-frequency table (``name`` is body or subject)."""
    T.idf(tf).write.mode("overwrite").parquet(f"{folder}/{name}_idf")
    T.word_tfidf(tf).write.mode("overwrite").parquet(f"{folder}/{name}_tfidf")
