"""Plans hold no cross product, no single-task window and no Python where none is needed."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from mailgraph.operators import dedupe, graph
from mailgraph.sources.tables import not_in

SF_DIR = "/root/testdata/sf0.001"
NATIVE = [
    "body_tf", "body_idf", "word_tfidf", "doc_tfidf", "top_terms", "monthly_edges", "snapshot_attrs",
    "weighted_graph", "sampled_attrs", "edge_node_ids", "near_duplicate_pairs", "nearest_match",
    "header_extract", "merge_folders", "sender_export_subjects", "sender_export_latest_full", "graph_stats",
    "window_counts",
]


@pytest.mark.parametrize("name", NATIVE)
def test_plan(spark, name, capsys):
    spark_entry.queries()[name](spark, SF_DIR).explain("formatted")
    plan = capsys.readouterr().out
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert bad not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line or "Arguments: SinglePartition" in line:
            assert not any("Window" in other for other in lines[max(0, i - 6) : i])


def test_scan_reads_only_what_is_used(spark, capsys):
    spark_entry.queries()["pair_frequency"](spark, SF_DIR).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


SPLIT_EARLY = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.shuffle.partitions": "32",
}


@pytest.fixture
def small_splits(spark):
    before = {key: spark.conf.get(key, None) for key in SPLIT_EARLY}
    for key, value in SPLIT_EARLY.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def hot_or_own(prefix):
    return F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit(prefix), F.col("id")))


def test_hot_sender_is_split(spark, small_splits):
    edges = spark.range(0, 60_000, 1, 8).select(
        hot_or_own("u").alias("sender"), F.concat(F.lit("v"), F.col("id")).alias("recipient")
    )
    found = graph.with_node_ids(edges, graph.accounts(edges))
    rows, plan = final_plan(found.groupBy("recipient").agg(F.max("sender_id"), F.max("recipient_id")))
    assert len(rows) == 60_000 and "skew=true" in plan


def test_hot_word_is_split(spark, small_splits):
    rows = spark.range(0, 60_000, 1, 8).select(hot_or_own("w").alias("word"), "id")
    kept, plan = final_plan(not_in(rows, rows.filter("id < 3000").select("word"), ["word"]))
    assert len(kept) == 38_000 and "skew=true" in plan


def test_hot_pair_is_split_in_dedupe(spark, small_splits):
    edges = spark.range(0, 60_000, 1, 8).select(
        F.col("id").alias("file_id"),
        hot_or_own("u").alias("sender"),
        F.lit("r").alias("recipient"),
        F.lit(5.0).alias("msg_time"),
    )
    found, plan = final_plan(dedupe._contested(edges, 2.0))
    assert len(found) == 20_000 and "skew=true" in plan


def test_words_of_a_connection_travel_by_mail(spark, monkeypatch):
    """Every word of every mail of a connection was a row of its own in the shuffle."""
    from mailgraph.operators import graph as G

    rows = [("a", "b", i) for i in range(5)] + [("a", "b", 0), ("a", "c", 1), ("a", None, 1), ("d", "e", 99)]
    edges = spark.createDataFrame(rows, "sender string, recipient string, file_id bigint")
    tf = spark.createDataFrame([(i, w) for i in range(5) for w in ("x", f"y{i % 2}")], "file_id bigint, word string")
    found = G.connections(edges)
    expected = G.communication_words(found, edges, tf).groupBy("connection_id", "word").count()
    expected = sorted(map(tuple, expected.collect()))
    assert len(expected) == 5
    for mails in (4096, 3):
        monkeypatch.setattr(G, "OWN_TASK_MAILS", mails)
        bags = G.communication_bags(found, edges, tf)
        assert sorted(map(tuple, bags.collect())) == expected
    monkeypatch.setattr(G, "OWN_TASK_MAILS", 4096)
    plan = G.communication_bags(found, edges, tf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(connection_id" in plan.split("Union")[1] and "words" in plan
