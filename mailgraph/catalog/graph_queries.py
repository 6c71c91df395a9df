"""Accounts, connections, snapshots, edge vectors, samples and graph statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailgraph.catalog import text_queries as X
from mailgraph.catalog import views as V
from mailgraph.operators import edge_attrs as E
from mailgraph.operators import graph as G
from mailgraph.operators import terms
from mailgraph.session import bounded_tasks, settle

ACCOUNTS = """accounts AS (
  SELECT row_number() OVER (ORDER BY account) - 1 AS node_id, account
  FROM (SELECT sender AS account FROM edges UNION SELECT recipient FROM edges))"""
CONNECTIONS = """connections AS (
  SELECT row_number() OVER (ORDER BY sender, recipient) AS connection_id, sender, recipient, count(*) AS frequency
  FROM edges GROUP BY sender, recipient)"""
CALENDAR = """span AS (
  SELECT CAST(floor(min(msg_time)) AS BIGINT) AS t0, CAST(floor(max(msg_time)) AS BIGINT) AS t1 FROM edges),
ends AS (
  SELECT CAST(epoch(last_day(m)) AS BIGINT) + t0 % 86400 AS month_end, t1
  FROM (SELECT unnest(generate_series(date_trunc('month', make_timestamp(t0 * 1000000)),
                                      make_timestamp(t1 * 1000000), INTERVAL 1 MONTH)) AS m, t0, t1 FROM span)),
calendar AS (
  SELECT * FROM (SELECT month_end AS window_start, lead(month_end) OVER (ORDER BY month_end) AS window_end, t1 FROM ends)
  WHERE window_end <= t1)"""
MONTHLY = f"""{V.EDGES}, {CALENDAR},
windowed AS (
  SELECT e.*, window_start, window_end,
         dense_rank() OVER (ORDER BY window_start) - 1 AS snapshot
  FROM edges e JOIN calendar ON msg_time BETWEEN window_start AND window_end
  WHERE sender <> '' AND recipient <> ''),
monthly AS (
  SELECT snapshot, window_start, window_end, sender, recipient, count(*) AS mails
  FROM windowed GROUP BY ALL)"""
DIGEST = "md5(concat('42|', {keys}))"
SAMPLED_PAIRS = f"""{MONTHLY},
sampled_pairs AS (
  SELECT snapshot, sender, recipient, n AS group_size FROM (
    SELECT *, count(*) OVER (PARTITION BY snapshot) AS n,
      row_number() OVER (PARTITION BY snapshot
        ORDER BY md5(concat('42|', snapshot, '|', sender, '|', recipient)), sender, recipient) AS pos
    FROM monthly WHERE snapshot BETWEEN 7 AND 33)
  WHERE pos <= (n * 80) // 100)"""


def _attrs_sql(keys: str, source: str, total: str) -> str:
    """Mean of ten topic weights in whole ten-thousandths, then the four counts."""
    means = ", ".join(
        f"CAST((2 * sum(a{j}) + count(*)) // (2 * count(*)) AS DOUBLE) / 10000.0" for j in range(10)
    )
    return f"""SELECT {keys}, [{means}, CAST({total} AS DOUBLE),
  CAST(count(*) FILTER (rec_cat = 'TO') AS DOUBLE), CAST(count(*) FILTER (rec_cat = 'CC') AS DOUBLE),
  CAST(count(*) FILTER (rec_cat = 'BCC') AS DOUBLE)] AS attrs
FROM {source} JOIN wide USING (file_id) GROUP BY {keys}"""


WIDE = (
    f"{V.VECTORS},\n{V.FILE_VECTORS},\nwide AS (SELECT file_id, "
    + ", ".join(f"CAST(round(max(prob) FILTER (topic = {j}) * 10000) AS BIGINT) AS a{j}" for j in range(10))
    + " FROM dense GROUP BY file_id)"
)


def pair_frequency(spark, sf_dir):
    return G.pair_frequency(V.edges(spark, sf_dir))


def pair_receipt_counts(spark, sf_dir):
    return G.pair_receipt_counts(V.edges(spark, sf_dir))


def accounts(spark, sf_dir):
    return G.accounts(V.edges(spark, sf_dir))


def connections(spark, sf_dir):
    return G.connections(V.edges(spark, sf_dir))


def edge_node_ids(spark, sf_dir):
    edges = settle(G.filtered_edges(V.edges(spark, sf_dir), "@example.org"))
    return G.with_node_ids(edges, settle(G.accounts(edges))).select(
        "file_id", "sender_id", "recipient_id", "msg_time"
    )


def node_accounts(spark, sf_dir):
    """Ids back to accounts for every connection."""
    edges = settle(V.edges(spark, sf_dir).select("sender", "recipient"))
    nodes = settle(G.accounts(edges))
    ids = G.with_node_ids(G.pair_frequency(edges), nodes).drop("sender", "recipient")
    return G.with_accounts(ids, nodes)


def month_calendar(spark, sf_dir):
    return G.month_calendar(V.edges(spark, sf_dir))


def monthly_edges(spark, sf_dir):
    return G.monthly_edges(V.edges(spark, sf_dir))


def snapshot_counts(spark, sf_dir):
    return G.snapshot_counts(G.monthly_edges(V.edges(spark, sf_dir)))


def snapshot_total(spark, sf_dir):
    return G.snapshot_total(G.monthly_edges(V.edges(spark, sf_dir)))


def adjacency_coo(spark, sf_dir):
    edges = settle(V.edges(spark, sf_dir).select("sender", "recipient", "msg_time"))
    return G.adjacency(G.monthly_edges(edges), G.accounts(edges), ["mails"])


def snapshot_attrs(spark, sf_dir):
    return E.snapshot_attributes(V.edges(spark, sf_dir), V.file_vectors(spark, sf_dir), V.TOPICS)


def snapshot_attrs_last(spark, sf_dir):
    """Edge vectors from the last mail of each pair and month."""
    return E.snapshot_attributes(
        V.edges(spark, sf_dir), V.file_vectors(spark, sf_dir), V.TOPICS, reduce="last"
    )


def connection_vectors(spark, sf_dir):
    """Topic probabilities per connection: connections share the vectors round robin."""
    n = V.table(spark, sf_dir, "embeddings").count()
    found = settle(G.connections(V.edges(spark, sf_dir)))
    keyed = found.select("connection_id", (F.col("connection_id") % n).alias("vec_id"))
    return found, keyed.join(V.vectors(spark, sf_dir), "vec_id").drop("vec_id")


def weighted_graph(spark, sf_dir):
    found, prob = connection_vectors(spark, sf_dir)
    return E.weighted_graph(found, prob, V.TOPICS)


def sample_pairs(spark, sf_dir):
    return E.sample_pairs(G.monthly_edges(V.edges(spark, sf_dir)))


# Edges that one task joins and tells apart in memory.
TASK_EDGES = 500_000


def _unique_edges(spark, sf_dir):
    """One row per mail, recipient and category; the number of tasks grows with the edges."""
    items = V.table(spark, sf_dir, "lineitem").count()
    return V.edges(spark, sf_dir, bounded_tasks(spark, items, TASK_EDGES)).distinct()


def sample_mails(spark, sf_dir):
    return E.sample_mails(_unique_edges(spark, sf_dir)).select(
        "sender", "recipient", "file_id", "rec_cat", "group_size"
    )


def sampled_attrs(spark, sf_dir):
    edges = settle(_unique_edges(spark, sf_dir))
    pairs = E.sample_pairs(G.monthly_edges(edges))
    return E.sampled_attributes(pairs, edges, V.file_vectors(spark, sf_dir), V.TOPICS)


def graph_stats(spark, sf_dir):
    return G.graph_stats(V.edges(spark, sf_dir)).withColumn("density", F.round("density", 6))


def degree(spark, sf_dir):
    return G.degrees(V.edges(spark, sf_dir))


def self_loops(spark, sf_dir):
    return G.self_loops(V.edges(spark, sf_dir))


def neighbours(spark, sf_dir):
    return G.neighbours(V.edges(spark, sf_dir))


def comm_bow(spark, sf_dir):
    """Word counts per connection; mail n of the edges has the body of document n mod N."""
    docs = X.document_tokens(spark, sf_dir)
    n = docs.count()
    body_tf = terms.term_frequency(docs)
    edges = V.edges(spark, sf_dir).withColumn("file_id", F.col("file_id") % n)
    counts = G.communication_bags(G.connections(edges), edges, body_tf)
    return counts.groupBy("connection_id").agg(
        F.count("*").alias("words"), F.sum("value").alias("total"), F.max("value").alias("most")
    )


_UNDIRECTED = f"{V.EDGES}, pairs AS (SELECT DISTINCT least(sender, recipient) AS a, greatest(sender, recipient) AS b FROM edges)"
_UNIQUE = f"{V.EDGES.replace('edges AS', 'all_edges AS', 1)}, edges AS (SELECT DISTINCT * FROM all_edges)"

QUERIES = {
    "pair_frequency": (
        pair_frequency,
        f"WITH {V.EDGES} SELECT sender, recipient, count(*) AS frequency FROM edges GROUP BY sender, recipient",
    ),
    "pair_receipt_counts": (
        pair_receipt_counts,
        f"""WITH {V.EDGES} SELECT sender, recipient, count(*) AS mails,
  count(*) FILTER (rec_cat = 'TO') AS to_count, count(*) FILTER (rec_cat = 'CC') AS cc_count,
  count(*) FILTER (rec_cat = 'BCC') AS bcc_count
FROM edges GROUP BY sender, recipient""",
    ),
    "accounts": (accounts, f"WITH {V.EDGES}, {ACCOUNTS} SELECT * FROM accounts"),
    "connections": (connections, f"WITH {V.EDGES}, {CONNECTIONS} SELECT * FROM connections"),
    "edge_node_ids": (
        edge_node_ids,
        f"""WITH {V.EDGES}, {ACCOUNTS}
SELECT file_id, s.node_id AS sender_id, r.node_id AS recipient_id, msg_time
FROM edges JOIN accounts s ON s.account = sender JOIN accounts r ON r.account = recipient""",
    ),
    "node_accounts": (
        node_accounts,
        f"""WITH {V.EDGES}, {ACCOUNTS}
SELECT sender, recipient, frequency, s.node_id AS sender_id, r.node_id AS recipient_id
FROM (SELECT sender, recipient, count(*) AS frequency FROM edges GROUP BY ALL)
JOIN accounts s ON s.account = sender JOIN accounts r ON r.account = recipient""",
    ),
    "month_calendar": (
        month_calendar, f"WITH {V.EDGES}, {CALENDAR} SELECT window_start, window_end FROM calendar"
    ),
    "monthly_edges": (monthly_edges, f"WITH {MONTHLY} SELECT * FROM monthly"),
    "snapshot_counts": (
        snapshot_counts, f"WITH {MONTHLY} SELECT snapshot, count(*) AS edges FROM monthly GROUP BY snapshot"
    ),
    "snapshot_total": (
        snapshot_total, f"WITH {MONTHLY} SELECT count(DISTINCT snapshot) AS snapshots FROM monthly"
    ),
    "adjacency_coo": (
        adjacency_coo,
        f"""WITH {MONTHLY}, {ACCOUNTS}
SELECT snapshot, s.node_id AS i, r.node_id AS j, mails
FROM monthly JOIN accounts s ON s.account = sender JOIN accounts r ON r.account = recipient""",
    ),
    "snapshot_attrs": (
        snapshot_attrs,
        f"""WITH {MONTHLY}, {WIDE}
{_attrs_sql('snapshot, window_start, window_end, sender, recipient', 'windowed', 'count(*)')}""",
    ),
    "snapshot_attrs_last": (
        snapshot_attrs_last,
        f"""WITH {MONTHLY}, {WIDE},
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY snapshot, sender, recipient) AS n,
    row_number() OVER (PARTITION BY snapshot, sender, recipient ORDER BY msg_time DESC, file_id DESC, rec_cat DESC) AS pos
  FROM windowed JOIN wide USING (file_id))
SELECT snapshot, window_start, window_end, sender, recipient,
  [{', '.join(f'a{j} / 10000.0' for j in range(10))}, CAST(n AS DOUBLE), CAST(rec_cat = 'TO' AS DOUBLE),
   CAST(rec_cat = 'CC' AS DOUBLE), CAST(rec_cat = 'BCC' AS DOUBLE)] AS attrs
FROM ranked WHERE pos = 1""",
    ),
    "weighted_graph": (
        weighted_graph,
        f"""WITH {V.EDGES}, {CONNECTIONS}, {V.VECTORS}
SELECT sender, recipient, frequency AS weight,
  list_append(list(prob ORDER BY topic), round(1 / (1 + exp(-frequency)), 4)) AS attrs
FROM connections JOIN vectors ON vec_id = connection_id % (SELECT count(*) FROM embeddings)
GROUP BY sender, recipient, frequency""",
    ),
    "sample_pairs": (sample_pairs, f"WITH {SAMPLED_PAIRS} SELECT * FROM sampled_pairs"),
    "sample_mails": (
        sample_mails,
        f"""WITH {_UNIQUE}
SELECT sender, recipient, file_id, rec_cat, n AS group_size FROM (
  SELECT *, count(*) OVER (PARTITION BY sender, recipient) AS n,
    row_number() OVER (PARTITION BY sender, recipient
      ORDER BY md5(concat('42|', sender, '|', recipient, '|', file_id, '|', rec_cat)), file_id, rec_cat) AS pos
  FROM edges) WHERE pos <= (n * 75) // 100""",
    ),
    "sampled_attrs": (
        sampled_attrs,
        f"""WITH {SAMPLED_PAIRS.replace(V.EDGES, _UNIQUE, 1)}, {WIDE},
sampled AS (
  SELECT * FROM (
    SELECT *, count(*) OVER (PARTITION BY sender, recipient) AS n,
      row_number() OVER (PARTITION BY sender, recipient
        ORDER BY md5(concat('42|', sender, '|', recipient, '|', file_id, '|', rec_cat)), file_id, rec_cat) AS pos
    FROM edges) WHERE pos <= (n * 75) // 100),
vectors_by_pair AS ({_attrs_sql('sender, recipient', 'sampled', 'max(n)')})
SELECT snapshot, sender, recipient, attrs FROM sampled_pairs JOIN vectors_by_pair USING (sender, recipient)""",
    ),
    "graph_stats": (
        graph_stats,
        f"""WITH {_UNDIRECTED}, n AS (SELECT count(*) AS nodes FROM (SELECT a FROM pairs UNION SELECT b FROM pairs))
SELECT max(nodes) AS nodes, count(*) AS edges, count(*) FILTER (a = b) AS self_loops,
  round(CAST(2 * count(*) AS DOUBLE) / (max(nodes) * (max(nodes) - 1)), 6) AS density
FROM pairs, n""",
    ),
    "degree": (
        degree,
        f"""WITH {_UNDIRECTED} SELECT account, count(*) AS degree
FROM (SELECT a AS account FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY account""",
    ),
    "self_loops": (self_loops, f"WITH {_UNDIRECTED} SELECT a AS account FROM pairs WHERE a = b"),
    "neighbours": (
        neighbours,
        f"""WITH {_UNDIRECTED} SELECT a AS account, b AS neighbour FROM pairs
UNION SELECT b, a FROM pairs""",
    ),
    "comm_bow": (
        comm_bow,
        f"""WITH {V.EDGES}, {CONNECTIONS}, {X.DOC_TOKENS},
mail AS (SELECT DISTINCT sender, recipient, file_id % (SELECT count(*) FROM documents) AS file_id FROM edges),
word AS (SELECT DISTINCT file_id, unnest(words) AS word FROM tok),
bow AS (SELECT connection_id, word, count(*) AS value
  FROM mail JOIN connections USING (sender, recipient) JOIN word USING (file_id) GROUP BY connection_id, word)
SELECT connection_id, count(*) AS words, CAST(sum(value) AS BIGINT) AS total, max(value) AS most
FROM bow GROUP BY connection_id""",
    ),
}
