"""Work is dealt out to tasks by rows, however few row groups hold the input."""

import datetime

import pytest
from pyspark.sql import functions as F

from mailgraph.catalog import graph_queries, text_queries, views
from mailgraph.plans import mail_etl
from mailgraph.session import bounded_tasks


@pytest.fixture
def small_tasks(spark):
    name = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(name, "1b")
    yield
    spark.conf.unset(name)


def stored(df, folder, name):
    df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def documents(spark, folder):
    rows = [(None if i == 7 else i % 60, f"Word{i} and word") for i in range(64)] + [(3, None)]
    rows = [(*row, "en", "web", 5) for row in rows]
    stored(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
           folder, "documents")


def tasks_of(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.mark.parametrize("read", [text_queries.documents, views.mails])
def test_texts_of_one_row_group_are_dealt_out(spark, tmp_path, small_tasks, read):
    documents(spark, tmp_path)
    found = read(spark, str(tmp_path))
    assert tasks_of(found) > 1 and found.count() == 65


def test_mails_of_one_row_group_are_parsed_by_many_tasks(spark, tmp_path, small_tasks, monkeypatch):
    text = "Date: Mon, 1 Jan 2001 00:00:00 -0800\nFrom: a@x\nTo: b@x\nSubject: s\nX-From: A\nX-To: B\nX-cc: C\n\nWord"
    stored(spark.range(64).select(F.concat(F.lit("p/"), "id").alias("path"), F.lit(text).alias("text")), tmp_path, "files")
    files = spark.read.parquet(f"{tmp_path}/files.parquet")
    parse, tasks = mail_etl.parse_files, []

    def watched(files, *options):
        tasks.append(tasks_of(files))
        return parse(files, *options)

    monkeypatch.setattr(mail_etl, "parse_files", watched)
    messages = mail_etl.read_messages(files, mail_etl.file_numbers(files))
    assert tasks[0] > 1
    assert messages.filter("status = 'valid' AND body_tokens[0] = 'word'").count() == 64


def test_tasks_of_edges_grow_with_the_edges(spark, tmp_path, monkeypatch):
    day = datetime.date(2001, 1, 1)
    stored(spark.createDataFrame([(i, i % 5, day, "F") for i in range(50)],
           "o_orderkey bigint, o_custkey bigint, o_orderdate date, o_orderstatus string"), tmp_path, "orders")
    items = [(i % 50, i % 3, "A") for i in range(200)] + [(None, 1, "A"), (1, None, "N"), (1, None, "N")]
    stored(spark.createDataFrame(items, "l_orderkey bigint, l_suppkey bigint, l_returnflag string"), tmp_path, "lineitem")
    monkeypatch.setattr(graph_queries, "TASK_EDGES", 10)
    edges = graph_queries._unique_edges(spark, str(tmp_path))
    assert edges.rdd.getNumPartitions() == 21
    assert edges.count() == len({i for i in items if i[0] is not None})


def test_bounded_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    assert bounded_tasks(spark, 0, 10) == cores
    assert bounded_tasks(spark, 1001, 10) == 101
