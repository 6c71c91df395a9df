"""Accounts, connections, calendar-month snapshots and graph statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailgraph.operators.numbering import dense_ids
from mailgraph.session import settle

DAY = 86400
# Mails of a connection whose words are counted by one task; words that travel at a time.
OWN_TASK_MAILS, ROUND_WORDS = 4096, 2**28


def filtered_edges(edges: DataFrame, domain: str | None = None) -> DataFrame:
    """Edges with both ends filled and, on request, both inside a domain."""
    kept = edges.filter("sender <> '' and recipient <> ''")
    if domain:
        kept = kept.filter(F.col("sender").contains(domain) & F.col("recipient").contains(domain))
    return kept


def account_names(edges: DataFrame) -> DataFrame:
    """Every sender or recipient once."""
    ends = F.explode(F.array("sender", "recipient")).alias("account")
    return edges.select("sender", "recipient").distinct().select(ends).distinct()


def accounts(edges: DataFrame) -> DataFrame:
    """node_id (from 0, in name order), account."""
    return dense_ids(account_names(edges), ["account"], "node_id").select("node_id", "account")


def pair_frequency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("sender", "recipient").agg(F.count("*").alias("frequency"))


def pair_receipt_counts(edges: DataFrame) -> DataFrame:
    counts = [
        F.count_if(F.col("rec_cat") == cat).alias(f"{cat.lower()}_count") for cat in ("TO", "CC", "BCC")
    ]
    return edges.groupBy("sender", "recipient").agg(F.count("*").alias("mails"), *counts)


def connections(edges: DataFrame) -> DataFrame:
    """connection_id (from 1, in sender and recipient order), sender, recipient, frequency."""
    return dense_ids(pair_frequency(edges), ["sender", "recipient"], "connection_id", start=1).select(
        "connection_id", "sender", "recipient", "frequency"
    )


def communication_words(connection_table: DataFrame, edges: DataFrame, body_tf: DataFrame) -> DataFrame:
    """connection_id, file_id, word: the words of every mail on a connection."""
    mails = edges.select("sender", "recipient", "file_id").distinct()
    linked = mails.join(connection_table, ["sender", "recipient"]).select("connection_id", "file_id")
    return linked.join(body_tf.select("file_id", "word"), "file_id")


def communication_bags(connection_table: DataFrame, edges: DataFrame, body_tf: DataFrame) -> DataFrame:
    """connection_id, word, value: the mails of a connection that hold the word.

    A connection of one mail has the words of that mail, which stay where they are. The words of
    other mails travel as one array to the task that counts their connection, in rounds, so that
    what travels at a time does not grow with the mails. Connections of very many mails are counted
    by many tasks before their counts meet.
    """
    times = body_tf.filter("word is not null").groupBy("file_id", "word").agg(F.count("*").alias("value"))
    texts = settle(times.groupBy("file_id").agg(F.collect_list(F.struct("word", "value")).alias("words")))
    mails = edges.select("sender", "recipient", "file_id").distinct()
    linked = mails.join(connection_table, ["sender", "recipient"]).select("connection_id", "file_id")
    linked = settle(linked.withColumn("mails", F.count("*").over(Window.partitionBy("connection_id"))))
    alone, few = F.col("mails") == 1, F.col("mails") <= OWN_TASK_MAILS
    words = F.inline("words")
    several = linked.filter(~alone)
    moved = several.join(texts.select("file_id", F.size("words").alias("n")), "file_id").agg(F.sum("n")).first()[0]
    rounds = -(-(moved or 0) // ROUND_WORDS)

    def counted(rows: DataFrame) -> DataFrame:
        return rows.select("connection_id", words).groupBy("connection_id", "word").agg(F.sum("value").alias("value"))

    def one_round(number: int) -> DataFrame:
        chosen = several.filter(F.pmod(F.xxhash64("connection_id", F.lit(3)), F.lit(rounds)) == number)
        own = chosen.filter(few).join(texts, "file_id").select("connection_id", "words").repartition("connection_id")
        counts = counted(own).unionByName(counted(chosen.filter(~few).join(texts, "file_id")))
        return settle(counts) if rounds > 1 else counts

    bags = linked.filter(alone).join(texts, "file_id").select("connection_id", words)
    for number in range(rounds):
        bags = bags.unionByName(one_round(number))
    return bags


def with_node_ids(edges: DataFrame, account_table: DataFrame) -> DataFrame:
    """Add sender_id and recipient_id; NULL where an account has no id.

    Accounts grow with the data, so no broadcast is forced.
    """
    for end in ("sender", "recipient"):
        ids = account_table.select(F.col("node_id").alias(f"{end}_id"), F.col("account").alias(end))
        edges = edges.join(ids, end, "left")
    return edges


def with_accounts(edges: DataFrame, account_table: DataFrame) -> DataFrame:
    """Add sender and recipient by node id; edges with an unknown id are left out."""
    for end in ("sender", "recipient"):
        names = account_table.select(F.col("node_id").alias(f"{end}_id"), F.col("account").alias(end))
        edges = edges.join(names, f"{end}_id")
    return edges


def time_span(edges: DataFrame) -> tuple[int, int] | None:
    """First and last whole second of the table: one row to the driver."""
    low, high = edges.agg(
        F.min("msg_time").cast("bigint"), F.max("msg_time").cast("bigint")
    ).first()
    return None if low is None else (low, high)


def _month_end(day: Column, time_of_day: int) -> Column:
    """Last day of the month of ``day`` at the given second, as epoch seconds."""
    return F.unix_timestamp(F.last_day(day).cast("timestamp")) + time_of_day


def month_calendar(edges: DataFrame) -> DataFrame:
    """window_start, window_end of consecutive month ends inside the table's time span.

    Month ends carry the time of day of the first mail. Some rows per year, from one row.
    """
    first, last = time_span(edges) or (0, 0)
    starts = F.sequence(
        F.trunc(F.timestamp_seconds(F.lit(first)).cast("date"), "month"),
        F.timestamp_seconds(F.lit(last)).cast("date"),
        F.expr("interval 1 month"),
    )
    months = edges.sparkSession.range(1).select(F.explode(starts).alias("month"))
    windows = months.select(
        _month_end(F.col("month"), first % DAY).alias("window_start"),
        _month_end(F.add_months("month", 1), first % DAY).alias("window_end"),
    )
    return windows.filter(F.col("window_end") <= last)


def in_month_windows(edges: DataFrame, span: tuple[int, int] | None) -> DataFrame:
    """One row per edge and window holding it, both window ends inclusive.

    ``span`` is the ``time_span`` of all edges; ``edges`` should be a stored table.

    The window follows from the mail's own month, so nothing is joined: a mail before its
    month's end instant is in the window closing then, one after it in the next, one exactly
    on it in both. Mails before the first or after the last month end are in none.
    """
    first, last = span or (0, 0)
    tod = first % DAY
    day = F.timestamp_seconds(F.floor("msg_time")).cast("date")
    month = F.trunc(day, "month")
    here = _month_end(day, tod)
    before = F.struct(
        _month_end(F.add_months(month, -1), tod).alias("window_start"), here.alias("window_end")
    )
    after = F.struct(
        here.alias("window_start"), _month_end(F.add_months(month, 1), tod).alias("window_end")
    )
    time = F.col("msg_time")
    windows = F.array_compact(F.array(F.when(time <= here, before), F.when(time >= here, after)))
    first_end = _month_end(F.timestamp_seconds(F.lit(first)).cast("date"), tod)
    return (
        edges.withColumn("_window", F.explode_outer(windows))
        .select(*edges.columns, "_window.*")
        .filter((F.col("window_start") >= first_end) & (F.col("window_end") <= last))
    )


def number_snapshots(windowed: DataFrame) -> DataFrame:
    """Add ``snapshot``: non-empty windows counted from 0. The window list is one row a month."""
    windowed = settle(windowed)
    windows = dense_ids(windowed.select("window_start").distinct(), ["window_start"], "snapshot")
    return windowed.join(F.broadcast(windows), "window_start")


def monthly_edges(edges: DataFrame) -> DataFrame:
    """Distinct pairs per non-empty month with their mail count."""
    chosen = settle(filtered_edges(edges).select("sender", "recipient", "msg_time"))
    pairs = (
        in_month_windows(chosen, time_span(chosen))
        .groupBy("window_start", "window_end", "sender", "recipient")
        .agg(F.count("*").alias("mails"))
    )
    return number_snapshots(pairs).select(
        "snapshot", "window_start", "window_end", "sender", "recipient", "mails"
    )


def snapshot_counts(snapshot_edges: DataFrame) -> DataFrame:
    return snapshot_edges.groupBy("snapshot").agg(F.count("*").alias("edges"))


def snapshot_total(snapshot_edges: DataFrame) -> DataFrame:
    return snapshot_edges.agg(F.count_distinct("snapshot").alias("snapshots"))


def adjacency(snapshot_edges: DataFrame, account_table: DataFrame, values: list[str]) -> DataFrame:
    """Coordinate form per snapshot: snapshot, i, j and the value columns."""
    return with_node_ids(snapshot_edges, account_table).select(
        "snapshot", F.col("sender_id").alias("i"), F.col("recipient_id").alias("j"), *values
    )


def undirected(edges: DataFrame) -> DataFrame:
    """Every unordered pair of accounts once; a self-loop has equal ends."""
    return edges.select(
        F.least("sender", "recipient").alias("a"), F.greatest("sender", "recipient").alias("b")
    ).distinct()


def self_loops(edges: DataFrame) -> DataFrame:
    return undirected(edges).filter("a = b").select(F.col("a").alias("account"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Long form: one row per account and account reachable in one step."""
    both = F.array(
        F.struct(F.col("a").alias("account"), F.col("b").alias("neighbour")),
        F.struct(F.col("b").alias("account"), F.col("a").alias("neighbour")),
    )
    ways = F.when(F.col("a") == F.col("b"), F.slice(both, 1, 1)).otherwise(both)
    return undirected(edges).select(F.inline(ways))


def degrees(edges: DataFrame) -> DataFrame:
    """Degree in the undirected simple graph; a self-loop counts twice."""
    ends = F.explode(F.array("a", "b")).alias("account")
    return undirected(edges).select(ends).groupBy("account").agg(F.count("*").alias("degree"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, self_loops, density."""
    pairs = undirected(edges)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("account")).agg(
        F.count_distinct("account").alias("n")
    )
    stats = pairs.agg(F.count("*").alias("edges"), F.count_if(F.col("a") == F.col("b")).alias("self_loops"))
    with_nodes = stats.select(nodes.scalar().alias("nodes"), "edges", "self_loops")
    possible = F.col("nodes") * (F.col("nodes") - 1)
    return with_nodes.withColumn(
        "density", F.when(possible > 0, F.col("edges") * 2 / possible).otherwise(F.lit(0.0))
    )
