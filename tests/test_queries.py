"""Every registered query with SQL gives the same rows and types as that SQL."""

import pytest
from compare import SAME_TYPE, spark_rows, sql_rows, sql_types

import __spark_entry__ as spark_entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = spark_entry.queries(), spark_entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    types = sql_types(SQL[name], SF_DIR)
    for field in df.schema:
        assert SAME_TYPE[field.dataType.simpleString()] == types[field.name], field
    assert spark_rows(df) == sql_rows(SQL[name], SF_DIR)


def test_topic_shares_sum_to_one(spark):
    shares = QUERIES["lda_topic_prob"](spark, SF_DIR).groupBy("file_id").sum("prob").collect()
    assert shares and all(abs(row[1] - 1) < 0.01 for row in shares)


def test_nmf_topics(spark):
    terms = QUERIES["nmf_topics"](spark, SF_DIR).collect()
    assert {row["topic"] for row in terms} == set(range(10))
    shares = QUERIES["nmf_score"](spark, SF_DIR)
    assert shares.filter("prob < 0.01").isEmpty()
    assert all(row[1] < 1.001 for row in shares.groupBy("file_id").sum("prob").collect())


def test_perplexity_is_finite(spark):
    assert 0 < QUERIES["lda_perplexity"](spark, SF_DIR).first()["perplexity"] < 100


def test_best_model_has_one_topic_per_document(spark):
    rows = QUERIES["best_model"](spark, SF_DIR).collect()
    assert len({row["file_id"] for row in rows}) == len(rows) > 0


def test_entry(spark):
    assert spark_entry.entry(spark).columns == ["word", "file_id", "tf_idf", "rank"]


def test_every_query_is_registered_once():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) == len(spark_entry.CATALOG)
