"""Tables that grow with every load, each the same as a count over all loads at once."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mailgraph.catalog import graph_queries as Q
from mailgraph.catalog import term_queries as R
from mailgraph.catalog import views as V
from mailgraph.plans import growing
from mailgraph.session import scratch_folder, settle

LOADS = 2


def _folder(spark):
    return f"{scratch_folder(spark)}/growing-{uuid.uuid4().hex}"


def _loaded_terms(spark, sf_dir):
    """Body words in two loads, dealt out by the mail's number."""
    folder = _folder(spark)
    tf = settle(R.body_table(spark, sf_dir).select("file_id", "word"))
    for load in range(LOADS):
        growing.add_terms(tf.filter(F.col("file_id") % LOADS == load), folder)
    return folder


def _loaded_edges(spark, sf_dir):
    folder = _folder(spark)
    edges = settle(V.edges(spark, sf_dir).select("file_id", "sender", "recipient", "msg_time"))
    for load in range(LOADS):
        growing.add_edges(edges.filter(F.col("file_id") % LOADS == load), folder)
    return folder


def idf_after_loads(spark, sf_dir):
    """Values over all loads, and those that each word has kept since it first came."""
    folder = _loaded_terms(spark, sf_dir)
    frozen = growing.idf_after_loads(spark, folder, frozen=True)
    frozen = frozen.select("word", F.col("idf").alias("frozen_idf"), F.col("df").alias("frozen_df"))
    return growing.idf_after_loads(spark, folder).join(frozen, "word")


def accounts_after_loads(spark, sf_dir):
    return growing.accounts_after_loads(spark, _loaded_edges(spark, sf_dir))


def connections_after_loads(spark, sf_dir):
    return growing.connections_after_loads(spark, _loaded_edges(spark, sf_dir))


def monthly_edges_after_loads(spark, sf_dir):
    return growing.monthly_edges_after_loads(spark, _loaded_edges(spark, sf_dir))


QUERIES = {
    "idf_after_loads": (
        idf_after_loads,
        f"""WITH {R.BODY_TF}, {R.IDF},
early AS (SELECT * FROM tf WHERE file_id % 2 = 0),
frozen AS (
  SELECT word, round(ln((1 + (SELECT count(DISTINCT file_id) FROM early)) / (1 + count(*))), 4) AS frozen_idf,
    count(*) AS frozen_df FROM early GROUP BY word
  UNION ALL SELECT word, idf, df FROM idf WHERE word NOT IN (SELECT word FROM early))
SELECT word, idf, df, frozen_idf, frozen_df FROM idf JOIN frozen USING (word)""",
    ),
    "accounts_after_loads": (
        accounts_after_loads,
        f"""WITH {V.EDGES},
ends AS (SELECT sender AS account, file_id % 2 AS load FROM edges UNION ALL SELECT recipient, file_id % 2 FROM edges),
first AS (SELECT account, min(load) AS load FROM ends GROUP BY account)
SELECT row_number() OVER (ORDER BY load, account) - 1 AS node_id, account FROM first""",
    ),
    "connections_after_loads": (
        connections_after_loads,
        f"""WITH {V.EDGES},
pairs AS (SELECT sender, recipient, min(file_id % 2) AS load, count(*) AS frequency FROM edges GROUP BY sender, recipient)
SELECT row_number() OVER (ORDER BY load, sender, recipient) AS connection_id, sender, recipient, frequency FROM pairs""",
    ),
    "monthly_edges_after_loads": (
        monthly_edges_after_loads, f"WITH {Q.MONTHLY} SELECT * FROM monthly"
    ),
}
