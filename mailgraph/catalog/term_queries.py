"""Term frequency, IDF, TF-IDF, keywords, and updates of term tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailgraph.catalog import text_queries as X
from mailgraph.catalog import views as V
from mailgraph.functions import body as B
from mailgraph.functions import headers as H
from mailgraph.functions import tokens as T
from mailgraph.operators import terms
from mailgraph.operators import topics
from mailgraph.session import settle
from mailgraph.sources.tables import absent_rows, mark_status

TF = """tf AS (
  SELECT file_id, word, count(*) AS abs_tf, CAST((20000 * count(*) + n) // (2 * n) AS DOUBLE) / 10000.0 AS rel_tf
  FROM (SELECT file_id, len(words) AS n, unnest(words) AS word FROM {tok})
  GROUP BY file_id, word, n)"""
BODY_TF = f"{X.DOC_TOKENS},\n{TF.format(tok='tok')}"
SUBJECT_TF = f"{X.SUBJECT_TOKENS},\n{TF.format(tok='stok')}"
IDF = """idf AS (
  SELECT word, round(ln((1 + (SELECT count(DISTINCT file_id) FROM tf)) / (1 + count(*))), 4) AS idf, count(*) AS df
  FROM tf GROUP BY word)"""
WORD_TFIDF = """word_tfidf AS (
  SELECT word, CAST(round(CAST(rel_tf AS DECIMAL(12, 4)) * CAST(idf AS DECIMAL(12, 4)), 4) AS DOUBLE) AS tf_idf
  FROM (SELECT word, arg_min(rel_tf, file_id) AS rel_tf FROM tf GROUP BY word) JOIN idf USING (word))"""


def body_table(spark, sf_dir):
    return terms.term_frequency(X.document_tokens(spark, sf_dir))


def subject_table(spark, sf_dir):
    subject = F.regexp_replace("subject", "^[ \t]+", "")
    cleaned = F.when(subject == "", "").otherwise(H.clean_header(subject))
    words = T.tokens(B.clean_body(cleaned)).alias("tokens")
    return terms.term_frequency(V.mails(spark, sf_dir).select("file_id", words))


def body_tf(spark, sf_dir):
    return body_table(spark, sf_dir).drop("status")


def subject_tf(spark, sf_dir):
    return subject_table(spark, sf_dir).drop("status")


def body_idf(spark, sf_dir):
    return terms.idf(settle(body_table(spark, sf_dir).select("file_id", "word")))


def subject_idf(spark, sf_dir):
    return terms.idf(settle(subject_table(spark, sf_dir).select("file_id", "word")))


def word_tfidf(spark, sf_dir):
    return terms.word_tfidf(settle(body_table(spark, sf_dir).drop("status")))


def subject_word_tfidf(spark, sf_dir):
    return terms.word_tfidf(settle(subject_table(spark, sf_dir).drop("status")))


def doc_tfidf(spark, sf_dir):
    tf = settle(body_table(spark, sf_dir).select("file_id", "word", "rel_tf"))
    return terms.doc_tfidf(tf, settle(terms.idf(tf)))


def top_terms(spark, sf_dir):
    tf = settle(body_table(spark, sf_dir).select("file_id", "word", "rel_tf"))
    return terms.top_terms(tf, settle(terms.word_tfidf(tf)))


def frozen_idf(spark, sf_dir):
    """IDF of body words; words that subjects already have keep the subject's values."""
    body = settle(body_table(spark, sf_dir).select("file_id", "word"))
    subject = settle(subject_table(spark, sf_dir).select("file_id", "word"))
    return terms.idf(body, frozen=terms.idf(subject))


def insert_if_absent(spark, sf_dir):
    """Body words to add to the subject words, each once."""
    body = body_table(spark, sf_dir).select("word")
    subject = subject_table(spark, sf_dir).select("word")
    return absent_rows(body, subject, ["word"])


def status_update(spark, sf_dir):
    """Subject terms, marked OK where the word also has a body IDF."""
    body = body_table(spark, sf_dir).select("word")
    return mark_status(subject_table(spark, sf_dir), body, "word").select("file_id", "word", "abs_tf", "status")


def stop_word_rows(spark, sf_dir):
    """Document words less a stop-word table: every word of the subjects."""
    words = terms.long_words(X.document_tokens(spark, sf_dir))
    stops = subject_table(spark, sf_dir).select("word")
    return terms.without_words(words, stops).groupBy("word").agg(F.count("*").alias("n"))


def vocabulary(spark, sf_dir):
    bow = topics.bag_of_words(body_table(spark, sf_dir).select("file_id", "word"))
    return topics.vocabulary(bow)


QUERIES = {
    "body_tf": (body_tf, f"WITH {BODY_TF} SELECT * FROM tf"),
    "subject_tf": (subject_tf, f"WITH {SUBJECT_TF} SELECT * FROM tf"),
    "body_idf": (body_idf, f"WITH {BODY_TF}, {IDF} SELECT * FROM idf"),
    "subject_idf": (subject_idf, f"WITH {SUBJECT_TF}, {IDF} SELECT * FROM idf"),
    "word_tfidf": (word_tfidf, f"WITH {BODY_TF}, {IDF}, {WORD_TFIDF} SELECT * FROM word_tfidf"),
    "subject_word_tfidf": (
        subject_word_tfidf, f"WITH {SUBJECT_TF}, {IDF}, {WORD_TFIDF} SELECT * FROM word_tfidf"
    ),
    "doc_tfidf": (
        doc_tfidf,
        f"""WITH {BODY_TF}, {IDF} SELECT file_id, word,
  CAST(round(CAST(rel_tf AS DECIMAL(12, 4)) * CAST(idf AS DECIMAL(12, 4)), 4) AS DOUBLE) AS tf_idf
FROM tf JOIN idf USING (word)""",
    ),
    "top_terms": (
        top_terms,
        f"""WITH {BODY_TF}, {IDF}, {WORD_TFIDF}
SELECT file_id, word, tf_idf, CAST(rank AS INTEGER) AS rank FROM (
  SELECT file_id, word, tf_idf, row_number() OVER (PARTITION BY file_id ORDER BY tf_idf DESC, word) AS rank
  FROM tf JOIN word_tfidf USING (word)) WHERE rank <= 15""",
    ),
    "frozen_idf": (
        frozen_idf,
        f"""WITH {X.DOC_TOKENS},\n{X.SUBJECT_TOKENS},\n{TF.format(tok='tok')}, {IDF},
{TF.format(tok='stok').replace('tf AS', 'stf AS', 1)},
{IDF.replace('idf AS', 'sidf AS', 1).replace('FROM tf', 'FROM stf')}
SELECT * FROM sidf UNION ALL SELECT * FROM idf WHERE word NOT IN (SELECT word FROM sidf)""",
    ),
    "insert_if_absent": (
        insert_if_absent,
        f"""WITH {X.DOC_TOKENS},\n{X.SUBJECT_TOKENS}
SELECT DISTINCT unnest(words) AS word FROM tok EXCEPT SELECT unnest(words) FROM stok""",
    ),
    "status_update": (
        status_update,
        f"""WITH {X.DOC_TOKENS},\n{SUBJECT_TF}
SELECT file_id, word, abs_tf, CASE WHEN word IN (SELECT unnest(words) FROM tok) THEN 'OK' END AS status FROM tf""",
    ),
    "stop_word_rows": (
        stop_word_rows,
        f"""WITH {X.DOC_TOKENS},\n{X.SUBJECT_TOKENS}
SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM tok)
WHERE word NOT IN (SELECT unnest(words) FROM stok) GROUP BY word""",
    ),
    "vocabulary": (
        vocabulary,
        f"""WITH {BODY_TF}
SELECT word, count(*) AS df, row_number() OVER (ORDER BY word) - 1 AS term_id FROM tf GROUP BY word""",
    ),
}
