"""The driver tables seen as mails, edges, folders and topic vectors, in Spark and in SQL.

One order is one mail and its line items are the recipients; documents are mail bodies;
conversations are user folders; embeddings are topic vectors. Every view covers whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgraph.session import prepare

TOPICS = 10
MAIL_START = 978307200  # 2001-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Deal texts out to the number of tasks that the session sets, if it sets any.

    Without the setting texts are dealt out by ``key``, so that few row groups do not make few
    tasks; without a key the table is read as it is.
    """
    tasks = df.sparkSession.conf.get("spark.mailgraph.textTasks", None)
    if tasks is not None:
        return df.repartition(int(tasks))
    return df if key is None else df.repartition(key)


def edges(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """``tasks`` fixes the number of tasks that both tables are dealt out to, by mail."""
    orders = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem")
    if tasks is not None:
        orders, items = orders.repartition(tasks, "o_orderkey"), items.repartition(tasks, "l_orderkey")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey)
    return joined.selectExpr(
        "l_orderkey AS file_id",
        "concat('u', o_custkey, '@example.org') AS sender",
        "concat('u', l_suppkey, '@example.org') AS recipient",
        "cast(unix_timestamp(cast(o_orderdate AS timestamp)) AS double) AS msg_time",
        "CASE o_orderstatus WHEN 'F' THEN 'RE' WHEN 'O' THEN 'INIT' ELSE 'FWD' END AS mail_cat",
        "CASE l_returnflag WHEN 'A' THEN 'TO' WHEN 'N' THEN 'CC' ELSE 'BCC' END AS rec_cat",
    )


EDGES = """edges AS (
  SELECT l_orderkey AS file_id, concat('u', o_custkey, '@example.org') AS sender,
         concat('u', l_suppkey, '@example.org') AS recipient,
         CAST(floor(epoch(o_orderdate)) AS DOUBLE) AS msg_time,
         CASE o_orderstatus WHEN 'F' THEN 'RE' WHEN 'O' THEN 'INIT' ELSE 'FWD' END AS mail_cat,
         CASE l_returnflag WHEN 'A' THEN 'TO' WHEN 'N' THEN 'CC' ELSE 'BCC' END AS rec_cat
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header columns around each document; the subject is the document's first line."""
    return spread(table(spark, sf_dir, "documents"), "doc_id").selectExpr(
        "doc_id AS file_id",
        "concat('user', doc_id % 50, '@example.org') AS from_mail",
        "concat('user', (doc_id * 7) % 50, '@example.org, <user', (doc_id * 11) % 50, '@example.org>') AS to_hdr",
        "CASE WHEN doc_id % 3 = 0 THEN concat('user', (doc_id * 13) % 50, '@example.org') END AS cc_hdr",
        """concat(CASE doc_id % 5 WHEN 0 THEN 'RE: ' WHEN 1 THEN 'Fw: ' WHEN 2 THEN 'Fwd: '
                  WHEN 3 THEN 're: ' ELSE '' END, split_part(text, '\\n', 1)) AS subject""",
        f"cast({MAIL_START} + (doc_id div 150) * 2 AS bigint) AS sent",
        "concat('User ', doc_id % 50, ' O\"Neil <user', doc_id % 50, '@example.org>') AS x_from",
        "concat('(Person) \\'', lang, ' ', source, ' <p', doc_id, '@example.org>') AS x_to",
        "text AS body",
    )


MAILS = f"""mails AS (
  SELECT doc_id AS file_id, concat('user', doc_id % 50, '@example.org') AS from_mail,
         concat('user', (doc_id * 7) % 50, '@example.org, <user', (doc_id * 11) % 50, '@example.org>') AS to_hdr,
         CASE WHEN doc_id % 3 = 0 THEN concat('user', (doc_id * 13) % 50, '@example.org') END AS cc_hdr,
         concat(CASE doc_id % 5 WHEN 0 THEN 'RE: ' WHEN 1 THEN 'Fw: ' WHEN 2 THEN 'Fwd: '
                WHEN 3 THEN 're: ' ELSE '' END, split_part(text, chr(10), 1)) AS subject,
         CAST({MAIL_START} + (doc_id // 150) * 2 AS BIGINT) AS sent,
         concat('User ', doc_id % 50, ' O"Neil <user', doc_id % 50, '@example.org>') AS x_from,
         concat('(Person) ''', lang, ' ', source, ' <p', doc_id, '@example.org>') AS x_to,
         text AS body
  FROM documents)"""


def raw_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mails rendered as message files: path, text. The To header is folded."""
    rows = mails(spark, sf_dir)
    date = F.date_format(F.timestamp_seconds("sent"), "EEE, d MMM yyyy HH:mm:ss")
    cc = F.when(F.col("cc_hdr").isNotNull(), F.concat(F.lit("Cc: "), "cc_hdr", F.lit("\n")))
    text = F.concat(
        F.lit("Message-ID: <"), "file_id", F.lit("@example.org>\nDate: "), date,
        F.lit(" -0800 (PST)\nFrom: "), "from_mail", F.lit("\nTo: "),
        F.replace("to_hdr", F.lit(", "), F.lit(", \n\t")), F.lit("\n"), F.coalesce(cc, F.lit("")),
        F.lit("Subject: "), "subject", F.lit("\nX-From: "), "x_from", F.lit("\nX-To: "), "x_to",
        F.lit("\nX-cc: \n\n"), "body",
    )
    name = F.lpad(F.col("file_id").cast("string"), 12, "0")
    path = F.concat(F.lit("archive/"), F.substring_index("from_mail", "@", 1), F.lit("/sent/"), name)
    return rows.select("file_id", path.alias("path"), text.alias("text"))


def odd_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and web pages as message files of which many lack a header or usable text."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id * 2 AS file_id", "text AS body")
    pages = table(spark, sf_dir, "pages").selectExpr("page_id * 2 + 1 AS file_id", "html AS body")
    return docs.unionByName(pages).selectExpr(
        "file_id",
        "concat('odd/', file_id) AS path",
        """concat('Date: ', CASE WHEN file_id % 11 = 0 THEN 'soon' ELSE 'Mon, 1 Jan 2001 00:00:00 -0800' END,
                  CASE WHEN file_id % 11 = 1 THEN '' ELSE '\nFrom: a@x' END,
                  CASE WHEN file_id % 11 = 2 THEN '' ELSE '\nTo: b@x' END,
                  CASE WHEN file_id % 11 = 3 THEN '' ELSE '\nSubject: s' END,
                  CASE WHEN file_id % 11 = 4 THEN '' ELSE '\nX-From: A' END,
                  CASE WHEN file_id % 11 = 5 THEN '' WHEN file_id % 11 < 8 THEN '\nX-To: <b@x>' ELSE '\nX-To: B' END,
                  CASE WHEN file_id % 11 = 6 THEN '' ELSE '\nX-cc: C' END,
                  CASE WHEN file_id % 11 = 8 THEN '\nContent-Type: multipart/mixed' ELSE '' END,
                  '\n\n', body) AS text""",
    )


ODD_MAILS = """odd AS (SELECT doc_id * 2 AS file_id, text FROM documents
  UNION ALL SELECT page_id * 2 + 1, html FROM pages)"""
ODD_REASON = """CASE file_id % 11 WHEN 3 THEN 'no subject' WHEN 5 THEN 'no x-to' WHEN 6 THEN 'no recipient name'
  WHEN 4 THEN 'no x-from' WHEN 0 THEN 'bad date' WHEN 8 THEN 'multipart'
  ELSE CASE WHEN text = '' THEN 'empty body' END END"""


# The user whose files lie directly below the root, so that they have no user folder.
NO_FOLDER = "user5"


def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as two sent folders per user: user turns in `sent`, others in `sent_items`."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "concat('user', conv_id) AS user_folder",
        "CASE WHEN role = 'user' THEN 'sent' ELSE 'sent_items' END AS folder",
        "cast(turn AS string) AS file_name",
        "text",
    )


def export_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as parsed mails of one export folder per conversation; one has no folder."""
    return table(spark, sf_dir, "conversations").selectExpr(
        f"nullif(concat('user', conv_id), '{NO_FOLDER}') AS user_folder",
        "cast(turn AS string) AS file_name",
        "concat('conv', conv_id, '@example.org') AS from_header",
        "concat('Conv Nr', conv_id, ' <conv', conv_id, '@example.org>') AS x_from",
        "CASE WHEN turn % 4 = 3 THEN '' ELSE concat(role, '@example.org, all@example.org') END AS to_header",
        "concat(role, '@example.net') AS cc_header",
        "CASE WHEN turn % 4 = 3 THEN '' ELSE concat(role, ' -Person, Nr', turn, ' <', role, '@example.org>') END AS x_to",
        "concat('Copy ', role) AS x_cc",
        "text AS subject_header",
        "concat('Mon, 1 Jan 2001 00:00:', lpad(cast(turn AS string), 2, '0'), ' -0800 (PST)') AS date_header",
        "text AS raw_body",
    )


EXPORT = r"""src AS (
  SELECT nullif(concat('user', conv_id), 'user5') AS user_folder, turn, CAST(turn AS VARCHAR) AS file_name,
         concat('conv', conv_id, '@example.org') AS from_email,
         concat('Conv Nr', conv_id, ' ') AS from_name,
         CASE WHEN turn % 4 = 3 THEN concat(role, '@example.net')
              ELSE concat(role, '@example.org all@example.org') END AS to_key,
         CASE WHEN turn % 4 = 3 THEN concat(role, '@example.net')
              ELSE concat(role, '@example.org, all@example.org') END AS to_email,
         CASE WHEN turn % 4 = 3 THEN concat('Copy ', role)
              ELSE concat(role, ' -Person Nr', turn, ' ') END AS to_name,
         replace(replace(replace(replace(translate(text, concat(chr(10), chr(9), '"\,'), ''),
                 ' (PST)', ''), ' (PDT)', ''), ' -0800', ''), ' -0700', '') AS subject,
         concat('Mon 1 Jan 2001 00:00:', lpad(CAST(turn AS VARCHAR), 2, '0')) AS date,
         text AS body
  FROM conversations),
elements AS (
  SELECT *, row_number() OVER (PARTITION BY user_folder, to_key ORDER BY turn) AS position,
         row_number() OVER (PARTITION BY user_folder, to_key ORDER BY turn DESC) AS from_last,
         array_to_string(list_transform(string_split(to_name, ' '), lambda w:
           CASE WHEN substr(w, 1, 1) IN ('''', '-', '_', '\', '/', '<', '>', '@')
                THEN substr(w, 2, 1) ELSE substr(w, 1, 1) END), '') AS to_label,
         array_to_string(list_transform(string_split(from_name, ' '), lambda w: substr(w, 1, 1)), '') AS from_label
  FROM src)"""


def pair_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as mails: the user is the sender, the event type the recipient."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS file_id",
        "concat('u', user_id) AS from_mail",
        "array(event_type) AS recipients",
        "cast(unix_timestamp(cast(ts AS timestamp)) AS double) AS msg_time",
    )


EVENTS = """ev AS (
  SELECT event_id AS file_id, concat('u', user_id) AS sender, event_type AS recipient,
         CAST(floor(epoch(ts)) AS DOUBLE) AS msg_time
  FROM events)"""


def vectors(spark: SparkSession, sf_dir: str, key: str = "vec_id") -> DataFrame:
    """Topic probabilities (4 places) from all values of each embedding: value i is part of
    topic i modulo TOPICS."""
    values = table(spark, sf_dir, "embeddings").selectExpr(
        f"vec_id AS {key}",
        "posexplode(transform(embedding,"
        " v -> cast(floor(abs(cast(v AS double)) * 10000) AS bigint))) AS (place, a)",
    )
    topic = (F.col("place") % TOPICS).alias("topic")
    cells = values.groupBy(key, topic).agg(F.sum("a").alias("a"))
    total = cells.groupBy(key).agg(F.sum("a").alias("total"))
    share = F.expr("((20000 * a + total) div (2 * total)) / 10000.0D")
    return cells.join(total, key).select(key, "topic", share.alias("prob"))


VECTORS = """cells AS (
  SELECT vec_id, place % 10 AS topic, CAST(sum(a) AS BIGINT) AS a FROM (
    SELECT vec_id, unnest(range(0, len(embedding))) AS place,
           unnest(list_transform(embedding,
             lambda v: CAST(floor(abs(CAST(v AS DOUBLE)) * 10000) AS BIGINT))) AS a
    FROM embeddings)
  GROUP BY vec_id, place % 10),
vectors AS (
  SELECT vec_id, CAST(topic AS INTEGER) AS topic, CAST(
         ((20000 * a + sum(a) OVER (PARTITION BY vec_id)) // (2 * sum(a) OVER (PARTITION BY vec_id))) AS DOUBLE)
         / 10000.0 AS prob
  FROM cells)"""


def file_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic columns for every mail of the edges view: mails share the vectors round robin."""
    from mailgraph.operators.edge_attrs import dense_topics

    dense = dense_topics(vectors(spark, sf_dir), "vec_id", TOPICS)
    n = table(spark, sf_dir, "embeddings").count()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"))
    return orders.withColumn("vec_id", F.col("file_id") % n).join(dense, "vec_id").drop("vec_id")


FILE_VECTORS = """dense AS (
  SELECT o_orderkey AS file_id, topic, prob
  FROM orders JOIN vectors ON vec_id = o_orderkey % (SELECT count(*) FROM embeddings))"""
