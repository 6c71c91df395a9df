"""Topic models: bags of words, LDA, NMF, coherence, model choice and topic tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from mailgraph.catalog import graph_queries as Q
from mailgraph.catalog import term_queries as R
from mailgraph.catalog import text_queries as X
from mailgraph.catalog import views as V
from mailgraph.operators import coherence as C
from mailgraph.operators import edge_attrs as E
from mailgraph.operators import graph as G
from mailgraph.operators import lda as L
from mailgraph.operators import nmf as N
from mailgraph.operators import perplexity as P
from mailgraph.operators import topics as T
from mailgraph.plans import dynamic_graph, topic_model
from mailgraph.session import scratch_folder, settle

K = 10
LDA_PASSES, SWEEP_PASSES = 8, 3
PERPLEXITY_COUNTS = [2, 8]
# Three made topics of five words each: the fifteen words in most documents, in this order.
TOPIC_WORDS = 15
WORDS_PER_TOPIC = 5


def body_words(spark, sf_dir):
    return settle(R.body_table(spark, sf_dir).select("file_id", "word"))


def body_bag(spark, sf_dir):
    # The term table lies by document already, so its words are not shuffled again.
    return settle(T.bag_of_words(R.body_table(spark, sf_dir).select("file_id", "word")))


def bag_of_words(spark, sf_dir):
    """Binary bags, from the term table, next to the counted ones, from all tokens."""
    # Dealt out by document, its words need no shuffle of their own.
    docs = X.document_tokens(spark, sf_dir).repartition("file_id")
    counted = T.bag_of_words(R.terms.long_words(docs))
    return counted.groupBy("file_id").agg(F.count("*").alias("words"), F.sum("value").alias("tokens"))


def _lda(spark, sf_dir):
    bow = body_bag(spark, sf_dir)
    return L.fit_lda(bow, K, passes=LDA_PASSES)


def lda_topics(spark, sf_dir):
    model = _lda(spark, sf_dir)
    return T.leading_topic_terms(settle(model.topic_prob()), model.topic_terms())


def lda_topic_prob(spark, sf_dir):
    return _lda(spark, sf_dir).topic_prob()


def _halves(spark, sf_dir):
    parts = P.split(body_bag(spark, sf_dir))
    return settle(parts.fitted), settle(parts.given), settle(parts.scored)


def lda_perplexity(spark, sf_dir):
    """Of the words of documents the model was not fitted on."""
    fitted, given, scored = _halves(spark, sf_dir)
    value, _ = P.held_out_perplexity(L.fit_lda(fitted, K, passes=LDA_PASSES), given, scored)
    return spark.createDataFrame([(K, value)], "k int, perplexity double").select("k", F.round("perplexity", 6).alias("perplexity"))


def perplexity_by_k(spark, sf_dir):
    """Both kinds of models for several topic counts, on the same held-out words."""
    fitted, given, scored = _halves(spark, sf_dir)
    found = []
    ldas = L.fit_sweep(fitted, PERPLEXITY_COUNTS, passes=LDA_PASSES)
    for k, lda, nmf in zip(PERPLEXITY_COUNTS, ldas, N.fit_sweep(fitted, PERPLEXITY_COUNTS)):
        found.append(("lda", k, *P.held_out_perplexity(lda, given, scored)))
        found.append(("nmf", k, *P.held_out_perplexity(nmf, given, scored)))
    rows = spark.createDataFrame(found, "model string, k int, perplexity double, words double")
    return rows.withColumn("perplexity", F.round("perplexity", 6))


def nmf_topics(spark, sf_dir):
    return N.fit_nmf(body_bag(spark, sf_dir), K).topic_terms()


def nmf_topic_prob(spark, sf_dir):
    bow = body_bag(spark, sf_dir)
    return N.fit_nmf(bow, K).topic_prob(bow)


def nmf_score(spark, sf_dir):
    """A model of the bodies, stored, loaded and applied to the subjects."""
    path = f"{scratch_folder(spark)}/nmf-{uuid.uuid4().hex}"
    N.fit_nmf(body_bag(spark, sf_dir), K).save(path)
    subjects = R.subject_table(spark, sf_dir).select("file_id", "word")
    return N.load_nmf(spark, path).topic_prob(settle(T.bag_of_words(subjects)))


def dominant_topic(spark, sf_dir):
    return T.dominant_topics(V.vectors(spark, sf_dir), "vec_id")


def topic_terms(spark, sf_dir):
    """Terms of topics leading in some vector; a topic's terms are the labels, by weight."""
    prob = settle(V.vectors(spark, sf_dir))
    labels = V.table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("w"), "label").alias("word"))
    weights = prob.join(labels, "vec_id").groupBy("topic", "word").agg(F.max("prob").alias("prob"))
    return T.leading_topic_terms(prob, T.best_terms(weights, 3), "vec_id")


def best_k(spark, sf_dir):
    """The choice rule on made scores: one per label, its highest topic weight."""
    labels = V.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("k"))
    scores = V.vectors(spark, sf_dir).join(labels, "vec_id")
    return T.best_k(scores.groupBy("k").agg(F.max("prob").alias("coherence")))


def frequent_words(docs):
    """The words in most documents, numbered in that order: one short list."""
    counts = docs.select("file_id", F.explode(F.array_distinct("tokens")).alias("word")).groupBy("word").count()
    rows = counts.orderBy(F.desc("count"), "word").limit(TOPIC_WORDS).collect()
    return {row["word"]: i for i, row in enumerate(rows)}


def window_counts(spark, sf_dir):
    docs = settle(X.document_tokens(spark, sf_dir))
    return C.joint_window_counts(docs, frequent_words(docs))


def coherence_cv(spark, sf_dir):
    docs = settle(X.document_tokens(spark, sf_dir))
    words = frequent_words(docs)
    rows = [(i // WORDS_PER_TOPIC, w) for w, i in words.items()]
    value = C.coherence(docs, spark.createDataFrame(rows, "topic int, word string"))
    return spark.createDataFrame([(round(value, 6),)], "coherence double")


WINDOW_COUNTS = f"""{X.DOC_TOKENS},
top AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS id FROM (
  SELECT word, count(*) AS n FROM (SELECT file_id, unnest(list_distinct(words)) AS word FROM tok)
  GROUP BY word ORDER BY n DESC, word LIMIT {TOPIC_WORDS})),
hit AS (
  SELECT DISTINCT file_id, id, unnest(range(greatest(0, pos - 109), least(pos, greatest(n - 110, 0)) + 1)) AS win
  FROM (SELECT file_id, len(words) AS n, unnest(words) AS word, unnest(range(0, len(words))) AS pos FROM tok)
  JOIN top USING (word)),
joint AS (
  SELECT a.id AS a, b.id AS b, count(*) AS n FROM hit a JOIN hit b USING (file_id, win)
  WHERE a.id <= b.id GROUP BY a.id, b.id),
total AS (SELECT CAST(sum(greatest(1, len(words) - 109)) AS BIGINT) AS n FROM tok WHERE len(words) > 0)"""

COHERENCE = f"""WITH {WINDOW_COUNTS},
square AS (SELECT a, b, n FROM joint UNION SELECT b, a, n FROM joint),
p AS (
  SELECT x.id AS a, y.id AS b, coalesce(s.n, 0) / (SELECT n FROM total) AS pab,
    sx.n / (SELECT n FROM total) AS pa, sy.n / (SELECT n FROM total) AS pb, x.id // {WORDS_PER_TOPIC} AS topic
  FROM top x JOIN top y ON x.id // {WORDS_PER_TOPIC} = y.id // {WORDS_PER_TOPIC}
  LEFT JOIN square s ON s.a = x.id AND s.b = y.id
  JOIN square sx ON sx.a = x.id AND sx.b = x.id JOIN square sy ON sy.a = y.id AND sy.b = y.id),
npmi AS (SELECT topic, a, b, ln((pab + 1e-12) / (pa * pb)) / -ln(pab + 1e-12) AS v FROM p),
whole AS (SELECT topic, b, sum(v) AS v FROM npmi GROUP BY topic, b),
cosine AS (
  SELECT topic, a, sum(m.v * w.v) / (sqrt(sum(m.v * m.v)) * sqrt(sum(w.v * w.v))) AS c
  FROM npmi m JOIN whole w USING (topic, b) GROUP BY topic, a)
SELECT round(avg(score), 6) AS coherence FROM (SELECT topic, avg(c) AS score FROM cosine GROUP BY topic)"""


EPS = N.EPS


def _dot(left: str, right: str, k: int) -> str:
    return " + ".join(f"{left.format(j=j)} * {right.format(j=j)}" for j in range(k))


def _list(item: str, k: int, alias: str | None = None) -> str:
    return ", ".join(item.format(j=j) + (f" AS {alias.format(j=j)}" if alias else "") for j in range(k))


def _gram_sql(name: str, source: str, column: str, k: int) -> str:
    cells = ", ".join(f"sum({column}{i} * {column}{j}) AS g{i}_{j}" for i in range(k) for j in range(k))
    return f"{name} AS MATERIALIZED (SELECT {cells} FROM {source})"


def _weights_sql(name: str, bag: str, terms: str, gram: str, k: int, steps: int) -> str:
    """Document weights: a recursive table of one row per document and step."""
    mixed = [" + ".join(f"w{i} * g{i}_{j}" for i in range(k)) for j in range(k)]
    update = ", ".join(f"w{j} * p{j} / ({mixed[j]} + {EPS})" for j in range(k))
    return f"""{name}_p AS MATERIALIZED (
  SELECT file_id, {_list("sum(value * h{j})", k, "p{j}")} FROM {bag} JOIN {terms} USING (word) GROUP BY file_id),
{name}_steps AS (
  SELECT 0 AS step, file_id, {_list("p{j}", k)}, {_list(f"CAST(1.0 AS DOUBLE) / {k}", k, "w{j}")} FROM {name}_p
  UNION ALL SELECT step + 1, file_id, {_list("p{j}", k)}, {update} FROM {name}_steps, {gram} WHERE step < {steps}),
{name} AS MATERIALIZED (SELECT file_id, {_list("w{j}", k)} FROM {name}_steps WHERE step = {steps})"""


def nmf_ctes(bag: str, k: int = K, passes: int = 5, steps: int = 30) -> str:
    """The factorisation of a table file_id, word, value, pass by pass; the result is h_final."""
    start = "CAST(CAST('0x' || substr(md5(concat('42|{j}|', word)), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 + 0.5"
    parts = [f"h_0 AS MATERIALIZED (SELECT word, {_list(start, k, 'h{j}')} FROM (SELECT DISTINCT word FROM {bag}))"]
    for n in range(passes):
        parts.append(_gram_sql(f"gh_{n}", f"h_{n}", "h", k))
        parts.append(_weights_sql(f"w_{n}", bag, f"h_{n}", f"gh_{n}", k, steps))
        parts.append(_gram_sql(f"gw_{n}", f"w_{n}", "w", k))
        mixed = [" + ".join(f"h{i} * g{i}_{j}" for i in range(k)) for j in range(k)]
        update = ", ".join(f"h{j} * n{j} / ({mixed[j]} + {EPS}) AS h{j}" for j in range(k))
        name = "h_final" if n == passes - 1 else f"h_{n + 1}"
        parts.append(f"""n_{n} AS MATERIALIZED (
  SELECT word, {_list("sum(value * w{j})", k, "n{j}")} FROM {bag} JOIN w_{n} USING (file_id) GROUP BY word),
{name} AS MATERIALIZED (SELECT word, {update} FROM h_{n} JOIN n_{n} USING (word), gw_{n})""")
    return ",\n".join(parts)


def nmf_prob_ctes(bag: str, k: int = K) -> str:
    """Shares of at least 0.01 of the topics in the documents of a bag, as topic_prob."""
    total = _list("w{j}", k).replace(", ", " + ")
    return f"""{_gram_sql("g_final", "h_final", "h", k)},
{_weights_sql("w_final", bag, "h_final", "g_final", k, 50)},
shares AS (
  SELECT file_id, unnest(range(0, {k})) AS topic, unnest([{_list("w{j} / total", k)}]) AS share
  FROM (SELECT *, {total} AS total FROM w_final) WHERE total > 0),
topic_prob AS (
  SELECT file_id, CAST(topic AS INTEGER) AS topic, round(share, 4) AS prob FROM shares WHERE share >= 0.01)"""


# A term table has each word of a document once, so its bags are binary.
BODY_BAG = f"""{X.DOC_TOKENS},
bag AS MATERIALIZED (SELECT DISTINCT file_id, unnest(words) AS word, CAST(1.0 AS DOUBLE) AS value FROM tok)"""
BODY_NMF = f"{BODY_BAG},\n{nmf_ctes('bag')}"
SUBJECT_BAG = """subject_bag AS (SELECT DISTINCT file_id, unnest(words) AS word, CAST(1.0 AS DOUBLE) AS value FROM stok)"""
NMF_TOPICS = f"""WITH RECURSIVE {BODY_NMF},
long AS (
  SELECT word, unnest(range(0, {K})) AS topic, unnest([{_list("h{j} / (SELECT sum(h{j}) FROM h_final)", K)}]) AS prob
  FROM h_final)
SELECT CAST(topic AS INTEGER) AS topic, word, round(prob, 4) AS prob FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY prob DESC, word) AS r FROM long) WHERE r <= 15"""


def lda_ctes(bag: str, k: int, passes: int) -> str:
    """The updates of a table file_id, word, value, pass by pass; counts are words_final, docs_final."""
    alpha, beta = f"CAST({L.ALPHA_SUM / k!r} AS DOUBLE)", f"CAST({L.BETA!r} AS DOUBLE)"
    topic = f"CAST('0x' || substr(md5(concat_ws('|', '42', file_id, word)), 1, 8) AS BIGINT) % {k}"
    start = _list(f"CAST({topic} = {{j}} AS DOUBLE)", k, "g{j}")
    parts = [
        f"cells_0 AS MATERIALIZED (SELECT file_id, word, value, {start} FROM {bag})",
        f"size AS MATERIALIZED (SELECT count(DISTINCT word) * {beta} AS floor FROM {bag})",
    ]
    for n in range(passes + 1):
        end = "final" if n == passes else n
        parts += [
            f"words_{end} AS MATERIALIZED (SELECT word, {_list('sum(value * g{j})', k, 'n{j}')} FROM cells_{n} GROUP BY word)",
            f"docs_{end} AS MATERIALIZED (SELECT file_id, {_list('sum(value * g{j})', k, 'd{j}')} FROM cells_{n} GROUP BY file_id)",
            f"totals_{end} AS MATERIALIZED (SELECT {_list('sum(n{j})', k, 't{j}')} FROM words_{end})",
        ]
        if n < passes:
            around = _list(f"(n{{j}} - g{{j}} + {beta}) * (d{{j}} - g{{j}} + {alpha}) / (t{{j}} + floor - g{{j}})", k, "x{j}")
            total = _list("x{j}", k).replace(", ", " + ")
            parts.append(f"""cells_{n + 1} AS MATERIALIZED (
  SELECT file_id, word, value, {_list(f"x{{j}} / ({total})", k, "g{j}")} FROM (
    SELECT file_id, word, value, {around}
    FROM cells_{n} JOIN docs_{n} USING (file_id) JOIN words_{n} USING (word), totals_{n}, size))""")
    parts.append(f"""phi AS MATERIALIZED (
  SELECT word, {_list(f"(n{{j}} + {beta}) / (t{{j}} + floor)", k, "h{j}")} FROM words_final, totals_final, size)""")
    return ",\n".join(parts)


def lda_shares_ctes(docs: str, k: int) -> str:
    """w0..: smoothed shares of the topics from the counts of documents."""
    alpha = f"CAST({L.ALPHA_SUM / k!r} AS DOUBLE)"
    total = _list(f"d{{j}} + {alpha}", k).replace(", ", " + ")
    return f"theta AS MATERIALIZED (SELECT file_id, {_list(f'(d{{j}} + {alpha}) / ({total})', k, 'w{j}')} FROM {docs})"


LDA_PROB = f"""{lda_shares_ctes("docs_final", K)},
topic_prob AS (
  SELECT file_id, CAST(unnest(range(0, {K})) AS INTEGER) AS topic, round(unnest([{_list("w{j}", K)}]), 4) AS prob FROM theta)"""


_HASH = "CAST('0x' || substr(md5(concat_ws('|', '42', {0})), 1, 8) AS BIGINT)"
HALVES = f"""held AS MATERIALIZED (SELECT DISTINCT file_id FROM bag WHERE {_HASH.format("file_id")} % {P.HELD_OUT_IN} = 0),
fitted AS MATERIALIZED (SELECT * FROM bag WHERE file_id NOT IN (FROM held)),
given AS MATERIALIZED (SELECT * FROM bag WHERE file_id IN (FROM held) AND {_HASH.format("file_id, word")} % 2 = 0),
scored AS MATERIALIZED (SELECT * FROM bag WHERE file_id IN (FROM held) AND {_HASH.format("file_id, word")} % 2 <> 0)"""


def lda_perplexity_sql(k: int, steps: int = 5) -> tuple[str, str]:
    alpha = f"CAST({L.ALPHA_SUM / k!r} AS DOUBLE)"
    parts = [
        lda_ctes("fitted", k, LDA_PASSES),
        "known AS MATERIALIZED (SELECT * FROM given JOIN phi USING (word))",
        f"""counts_0 AS MATERIALIZED (
  SELECT file_id, {_list(f"sum(value) / {k}", k, "d{j}")} FROM known GROUP BY file_id)""",
    ]
    for n in range(steps):
        total = _list("x{j}", k).replace(", ", " + ")
        parts.append(f"""counts_{n + 1} AS MATERIALIZED (
  SELECT file_id, {_list(f"sum(value * (x{{j}} / ({total})))", k, "d{j}")} FROM (
    SELECT file_id, value, {_list(f"h{{j}} * (d{{j}} + {alpha})", k, "x{j}")} FROM known JOIN counts_{n} USING (file_id))
  GROUP BY file_id)""")
    parts.append(lda_shares_ctes(f"counts_{steps}", k))
    return f"""SELECT 'lda' AS model, CAST({k} AS INTEGER) AS k, round(exp(-sum(value * ln({_dot("w{j}", "h{j}", k)})) / sum(value)), 6) AS perplexity,
  sum(value) AS words FROM scored JOIN phi USING (word) JOIN theta USING (file_id)""", ",\n".join(parts)


def nmf_perplexity_sql(k: int) -> tuple[str, str]:
    even = f"CAST({P.EVEN!r} AS DOUBLE)"
    parts = f"""{nmf_ctes("fitted", k)},
{_gram_sql("g_final", "h_final", "h", k)},
{_weights_sql("w_final", "given", "h_final", "g_final", k, 50)},
mass AS MATERIALIZED (SELECT count(*) AS n, {_list("sum(h{j})", k, "s{j}")} FROM h_final),
weighed AS MATERIALIZED (SELECT * FROM (SELECT *, {_dot("w{j}", "s{j}", k)} AS m FROM w_final, mass) WHERE m > 0)"""
    return f"""SELECT 'nmf' AS model, CAST({k} AS INTEGER) AS k, round(exp(-sum(value * ln((1 - {even}) * ({_dot("w{j}", "h{j}", k)}) / m + {even} / n)) / sum(value)), 6) AS perplexity,
  sum(value) AS words FROM scored JOIN h_final USING (word) JOIN weighed USING (file_id)""", parts


def perplexity_sql(models: list[tuple[str, str]]) -> str:
    """One row a model; each has its own tables."""
    rows = [f"SELECT * FROM (WITH RECURSIVE {ctes} {select})" for select, ctes in models]
    return f"WITH RECURSIVE {BODY_BAG},\n{HALVES} " + "\nUNION ALL ".join(rows)


def lda_terms_sql(k: int, passes: int, n: int) -> str:
    """k, topic, word of the ``n`` heaviest words of each topic."""
    return f"""SELECT {k} AS k, topic, word FROM (WITH {lda_ctes("bag", k, passes)},
long AS (SELECT word, CAST(unnest(range(0, {k})) AS INTEGER) AS topic, unnest([{_list("h{j}", k)}]) AS prob FROM phi)
SELECT topic, word FROM long QUALIFY row_number() OVER (PARTITION BY topic ORDER BY prob DESC, word) <= {n})"""


def _tagged(sql: str, k: int) -> str:
    """The tables of a factorisation under names of their own."""
    return re.sub(r"\b((h|gh|w|gw|n|g)_(\d+|final)(_p|_steps)?|shares|topic_prob)\b", rf"\g<0>_k{k}", sql)


def nmf_terms_sql(k: int, n: int) -> str:
    """The same for a factorisation, whose tables are tagged."""
    shares = _list("h{j} / (SELECT sum(h{j}) FROM h_final)", k)
    long = f"""SELECT word, CAST(unnest(range(0, {k})) AS INTEGER) AS topic, unnest([{shares}]) AS prob FROM h_final"""
    return f"""SELECT {k} AS k, topic, word FROM ({_tagged(long, k)})
QUALIFY row_number() OVER (PARTITION BY topic ORDER BY prob DESC, word) <= {n}"""


def sweep_ctes(terms: list[str]) -> str:
    """Coherence of each model, as ``scores``. Windows are counted for the words of all topics at
    once; then each topic is scored."""
    union = "\nUNION ALL ".join(terms)
    return f"""terms AS MATERIALIZED ({union}),
top AS MATERIALIZED (SELECT word, row_number() OVER (ORDER BY word) AS id FROM (SELECT DISTINCT word FROM terms)),
hit AS MATERIALIZED (
  SELECT DISTINCT file_id, id, unnest(range(greatest(0, pos - 109), least(pos, greatest(n - 110, 0)) + 1)) AS win
  FROM (SELECT file_id, len(words) AS n, unnest(words) AS word, unnest(range(0, len(words))) AS pos FROM tok)
  JOIN top USING (word)),
pairs AS MATERIALIZED (SELECT DISTINCT x.id AS a, y.id AS b FROM terms s JOIN terms t USING (k, topic)
  JOIN top x ON x.word = s.word JOIN top y ON y.word = t.word),
joint AS MATERIALIZED (
  SELECT a, b, count(h.id) AS n FROM pairs JOIN hit g ON g.id = a LEFT JOIN hit h ON h.id = b AND h.file_id = g.file_id AND h.win = g.win
  GROUP BY a, b),
total AS (SELECT CAST(sum(greatest(1, len(words) - 109)) AS BIGINT) AS n FROM tok WHERE len(words) > 0),
p AS (
  SELECT s.k, s.topic, x.id AS a, y.id AS b, j.n / (SELECT n FROM total) AS pab,
    sx.n / (SELECT n FROM total) AS pa, sy.n / (SELECT n FROM total) AS pb
  FROM terms s JOIN terms t USING (k, topic) JOIN top x ON x.word = s.word JOIN top y ON y.word = t.word
  JOIN joint j ON j.a = x.id AND j.b = y.id JOIN joint sx ON sx.a = x.id AND sx.b = x.id JOIN joint sy ON sy.a = y.id AND sy.b = y.id),
npmi AS (SELECT k, topic, a, b, ln((pab + 1e-12) / (pa * pb)) / -ln(pab + 1e-12) AS v FROM p),
whole AS (SELECT k, topic, b, sum(v) AS v FROM npmi GROUP BY k, topic, b),
cosine AS (
  SELECT k, topic, a, sum(m.v * w.v) / (sqrt(sum(m.v * m.v)) * sqrt(sum(w.v * w.v))) AS c
  FROM npmi m JOIN whole w USING (k, topic, b) GROUP BY k, topic, a),
scores AS MATERIALIZED (
  SELECT CAST(k AS INTEGER) AS k, round(avg(score), 6) AS coherence
  FROM (SELECT k, topic, avg(c) AS score FROM cosine GROUP BY k, topic) GROUP BY k)"""


def best_model_sql(counts: list[int], n: int) -> str:
    """Dominant topics of the factorisation with the highest coherence."""
    models = ",\n".join(_tagged(f"{nmf_ctes('bag', k)},\n{nmf_prob_ctes('bag', k)}", k) for k in counts)
    found = "\nUNION ALL ".join(f"SELECT {k} AS k, * FROM topic_prob_k{k}" for k in counts)
    return f"""WITH RECURSIVE {BODY_BAG},
{models},
{sweep_ctes([nmf_terms_sql(k, n) for k in counts])},
best AS MATERIALIZED (SELECT k FROM scores WHERE coherence > 0 ORDER BY coherence DESC, k LIMIT 1),
found AS MATERIALIZED ({found})
SELECT file_id, topic, prob, k FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY prob DESC, topic) AS r FROM found JOIN best USING (k))
WHERE r = 1"""


_SHARED = V.EDGES.replace("edges AS", "all_edges AS", 1) + """, edges AS (
  SELECT DISTINCT * REPLACE (file_id % (SELECT count(*) FROM documents) AS file_id) FROM all_edges)"""


def lda_shares(spark, sf_dir):
    """What holds for every LDA model: each document with a word has one share of each topic, and
    they sum to 1, here to two places."""
    prob = lda_topic_prob(spark, sf_dir)
    return prob.groupBy("file_id").agg(
        F.count_distinct("topic").alias("topics"), F.round(F.sum("prob"), 2).alias("total")
    )


def lda_vectors(spark, sf_dir):
    """Bags of all tokens with their words as term ids."""
    docs = X.document_tokens(spark, sf_dir).repartition("file_id")
    bow = settle(T.bag_of_words(R.terms.long_words(docs)))
    return T.bow_cells(bow, settle(T.vocabulary(bow)))


def connection_graph(spark, sf_dir):
    """A model fitted over the mails of each connection, and the weighted graph it gives:
    node ids, frequency, and squashed frequency after the topic weights. The weights are tested
    by their sum."""
    docs = settle(X.document_tokens(spark, sf_dir))
    n = docs.count()
    body_tf = R.terms.term_frequency(docs)
    edges = settle(V.edges(spark, sf_dir).withColumn("file_id", F.col("file_id") % n))
    found = settle(G.connections(edges))
    bow = settle(G.communication_bags(found, edges, body_tf))
    prob = N.fit_nmf(bow, K, "connection_id").topic_prob(bow, "connection_id")
    graph = G.with_node_ids(E.weighted_graph(found, prob, K), settle(G.accounts(edges)))
    shares = F.aggregate(F.slice("attrs", 1, K), F.lit(0.0), lambda a, b: a + b)
    return graph.select(
        "sender_id", "recipient_id", "weight", F.size("attrs").alias("values"),
        F.element_at("attrs", -1).alias("strength"), (shares > 0.9).alias("has_topics"),
    )


def sampled_graph(spark, sf_dir):
    """The sampled-graph job with a fitted model; topics are tested by ``dynamic_graph_snapshots``."""
    tf = body_words(spark, sf_dir)
    model = N.fit_nmf(settle(T.bag_of_words(tf)), K)
    n = V.table(spark, sf_dir, "documents").count()
    edges = settle(V.edges(spark, sf_dir).distinct().withColumn("file_id", F.col("file_id") % n).distinct())
    nodes = settle(G.accounts(edges))
    pairs = settle(G.with_node_ids(G.monthly_edges(edges), nodes))
    found = dynamic_graph.sampled_snapshots(pairs, nodes, edges, tf, model)
    return found.select(
        "snapshot", "sender_id", "recipient_id", F.slice("attrs", K + 1, 4).alias("counts")
    )


def lda_sweep(spark, sf_dir):
    """Coherence of the LDA models of all topic counts tried for mails."""
    docs = settle(X.document_tokens(spark, sf_dir))
    bow = settle(T.bag_of_words(R.terms.term_frequency(docs).select("file_id", "word")))
    models = L.fit_sweep(bow, T.MAIL_TOPIC_COUNTS, passes=SWEEP_PASSES)
    terms = {model.k: model.topic_terms(topic_model.COHERENCE_TERMS) for model in models}
    scores = C.coherences(docs, terms)
    return spark.createDataFrame([(k, round(c, 6)) for k, c in scores.items()], "k int, coherence double")


def best_model(spark, sf_dir):
    """Topic count chosen by coherence, and the dominant topics of the chosen model."""
    docs = settle(X.document_tokens(spark, sf_dir))
    words = R.terms.term_frequency(docs).select("file_id", "word")
    found = topic_model.choose_nmf(words, docs, T.PAIR_TOPIC_COUNTS)
    return found.dominant_topic.withColumn("k", F.lit(found.k))


def dynamic_graph_snapshots(spark, sf_dir):
    """Monthly edge vectors with topics scored by a model of the mail bodies."""
    tf = body_words(spark, sf_dir)
    model = N.fit_nmf(settle(T.bag_of_words(tf)), K)
    n = V.table(spark, sf_dir, "documents").count()
    edges = settle(V.edges(spark, sf_dir).withColumn("file_id", F.col("file_id") % n))
    path = f"{scratch_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    dynamic_graph.build_snapshots(edges, tf, model, path)
    return spark.read.parquet(path).select(
        F.col("snapshot").cast("bigint"), "sender_id", "recipient_id", "attrs"
    )


QUERIES = {
    "bag_of_words": (
        bag_of_words,
        f"""WITH {X.DOC_TOKENS} SELECT file_id, count(DISTINCT word) AS words, count(*) AS tokens
FROM (SELECT file_id, unnest(words) AS word FROM tok) GROUP BY file_id""",
    ),
    "lda_topics": (
        lda_topics,
        f"""WITH {BODY_BAG},
{lda_ctes("bag", K, LDA_PASSES)},
{LDA_PROB},
leaders AS (SELECT DISTINCT topic FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY prob DESC, topic) AS r FROM topic_prob) WHERE r <= 2),
long AS (SELECT word, CAST(unnest(range(0, {K})) AS INTEGER) AS topic, unnest([{_list("h{j}", K)}]) AS prob FROM phi)
SELECT topic, word, round(prob, 4) AS prob FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY prob DESC, word) AS r FROM long)
WHERE r <= 15 AND topic IN (FROM leaders)""",
    ),
    "lda_topic_prob": (
        lda_topic_prob, f"WITH {BODY_BAG},\n{lda_ctes('bag', K, LDA_PASSES)},\n{LDA_PROB} SELECT * FROM topic_prob"
    ),
    "lda_perplexity": (
        lda_perplexity, f"SELECT k, perplexity FROM ({perplexity_sql([lda_perplexity_sql(K)])})"
    ),
    "perplexity_by_k": (
        perplexity_by_k,
        perplexity_sql([f(k) for k in PERPLEXITY_COUNTS for f in (lda_perplexity_sql, nmf_perplexity_sql)]),
    ),
    "nmf_topics": (nmf_topics, NMF_TOPICS),
    "nmf_topic_prob": (
        nmf_topic_prob, f"WITH RECURSIVE {BODY_NMF},\n{nmf_prob_ctes('bag')} SELECT * FROM topic_prob"
    ),
    "nmf_score": (
        nmf_score,
        f"""WITH RECURSIVE {BODY_NMF},
{X.SUBJECT_TOKENS},
{SUBJECT_BAG},
{nmf_prob_ctes('subject_bag')} SELECT * FROM topic_prob""",
    ),
    "lda_shares": (
        lda_shares,
        f"""WITH {X.DOC_TOKENS}
SELECT file_id, CAST({K} AS BIGINT) AS topics, CAST(1.0 AS DOUBLE) AS total FROM tok WHERE len(words) > 0""",
    ),
    "lda_vectors": (
        lda_vectors,
        f"""WITH {X.DOC_TOKENS}, words AS (SELECT file_id, unnest(words) AS word FROM tok),
vocab AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS term_id FROM (SELECT DISTINCT word FROM words))
SELECT file_id, term_id, CAST(count(*) AS DOUBLE) AS value FROM words JOIN vocab USING (word) GROUP BY file_id, term_id""",
    ),
    "connection_graph": (
        connection_graph,
        f"""WITH {V.EDGES}, {Q.ACCOUNTS}, {Q.CONNECTIONS}, {X.DOC_TOKENS},
talk AS (SELECT DISTINCT sender, recipient FROM edges
  JOIN tok ON tok.file_id = edges.file_id % (SELECT count(*) FROM documents) WHERE len(words) > 0)
SELECT s.node_id AS sender_id, r.node_id AS recipient_id, frequency AS weight, {K + 1} AS "values",
  round(1 / (1 + exp(-frequency)), 4) AS strength, talk.sender IS NOT NULL AS has_topics
FROM connections c JOIN accounts s ON s.account = c.sender JOIN accounts r ON r.account = c.recipient
LEFT JOIN talk ON talk.sender = c.sender AND talk.recipient = c.recipient""",
    ),
    "sampled_graph": (
        sampled_graph,
        f"""WITH {Q.SAMPLED_PAIRS.replace(V.EDGES, _SHARED, 1)}, {Q.ACCOUNTS},
sampled AS (
  SELECT * FROM (
    SELECT *, count(*) OVER (PARTITION BY sender, recipient) AS n,
      row_number() OVER (PARTITION BY sender, recipient
        ORDER BY md5(concat('42|', sender, '|', recipient, '|', file_id, '|', rec_cat)), file_id, rec_cat) AS pos
    FROM edges) WHERE pos <= (n * 75) // 100),
counted AS (
  SELECT sender, recipient, [CAST(max(n) AS DOUBLE), CAST(count(*) FILTER (rec_cat = 'TO') AS DOUBLE),
    CAST(count(*) FILTER (rec_cat = 'CC') AS DOUBLE), CAST(count(*) FILTER (rec_cat = 'BCC') AS DOUBLE)] AS counts
  FROM sampled GROUP BY sender, recipient)
SELECT snapshot, s.node_id AS sender_id, r.node_id AS recipient_id, counts
FROM sampled_pairs p JOIN counted USING (sender, recipient)
JOIN accounts s ON s.account = p.sender JOIN accounts r ON r.account = p.recipient""",
    ),
    "dominant_topic": (
        dominant_topic,
        f"""WITH {V.VECTORS} SELECT vec_id, topic, prob FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, topic) AS r FROM vectors) WHERE r = 1""",
    ),
    "topic_terms": (
        topic_terms,
        f"""WITH {V.VECTORS},
leaders AS (SELECT DISTINCT topic FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, topic) AS r FROM vectors) WHERE r <= 2),
weights AS (SELECT topic, concat('w', label) AS word, max(prob) AS prob
  FROM vectors JOIN embeddings USING (vec_id) GROUP BY ALL)
SELECT topic, word, prob FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY prob DESC, word) AS r FROM weights)
WHERE r <= 3 AND topic IN (SELECT topic FROM leaders)""",
    ),
    "best_k": (
        best_k,
        f"""WITH {V.VECTORS}
SELECT label AS k, max(prob) AS coherence FROM vectors JOIN embeddings USING (vec_id)
GROUP BY label ORDER BY coherence DESC, k LIMIT 1""",
    ),
    "window_counts": (
        window_counts,
        f"WITH {WINDOW_COUNTS} SELECT a, b, n FROM joint UNION ALL SELECT -1, -1, n FROM total",
    ),
    "coherence_cv": (coherence_cv, COHERENCE),
    "lda_sweep": (
        lda_sweep,
        f"""WITH {BODY_BAG},
{sweep_ctes([lda_terms_sql(k, SWEEP_PASSES, topic_model.COHERENCE_TERMS) for k in T.MAIL_TOPIC_COUNTS])}
SELECT k, coherence FROM scores""",
    ),
    "best_model": (best_model, best_model_sql(T.PAIR_TOPIC_COUNTS, topic_model.COHERENCE_TERMS)),
    "dynamic_graph_snapshots": (
        dynamic_graph_snapshots,
        f"""WITH RECURSIVE {Q.MONTHLY}, {Q.ACCOUNTS}, {BODY_NMF},
{nmf_prob_ctes('bag')},
wide AS (SELECT d.doc_id, {", ".join(
    f"CAST(round(coalesce(max(prob) FILTER (topic = {j}), 0) * 10000) AS BIGINT) AS a{j}" for j in range(K)
)} FROM documents d LEFT JOIN topic_prob t ON t.file_id = d.doc_id GROUP BY d.doc_id),
months AS (
  SELECT m.snapshot, s.node_id AS sender_id, r.node_id AS recipient_id, m.rec_cat, wide.*
  FROM windowed m JOIN accounts s ON s.account = sender JOIN accounts r ON r.account = recipient
  JOIN wide ON doc_id = file_id % (SELECT count(*) FROM documents))
SELECT snapshot, sender_id, recipient_id, [{_list(
    "CAST((2 * sum(a{j}) + count(*)) // (2 * count(*)) AS DOUBLE) / 10000.0", K
)}, CAST(count(*) AS DOUBLE), CAST(count(*) FILTER (rec_cat = 'TO') AS DOUBLE),
  CAST(count(*) FILTER (rec_cat = 'CC') AS DOUBLE), CAST(count(*) FILTER (rec_cat = 'BCC') AS DOUBLE)] AS attrs
FROM months GROUP BY snapshot, sender_id, recipient_id""",
    ),
}
