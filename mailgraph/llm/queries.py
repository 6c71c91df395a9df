"""Registered queries: each applies its operator to the whole of its table.

``QUERIES`` maps names to (query, SQL or None). SQL is None where it cannot express the operator
(BPE, zstandard, XXH64, trained models, the choice among equal packings); those queries are
compared with brute force in tests/llm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgraph.llm import (
    bpe,
    centroids,
    chat,
    embedding_dedup,
    langid,
    packing,
    quality,
    resample,
    sharding,
    simhash,
    substring,
    url_rules,
    vafile,
)
from mailgraph.llm.common import ready, table

TOKENIZER = "byte_bpe_50k.json"
SHARDS = 8
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(ready(spark), sf_dir, "documents")


def op1_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    encoded = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path)
    decoded = bpe.decode(encoded.select("doc_id", "ids"), path)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_vector_approximation_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(ready(spark), sf_dir, "embeddings"), every=20, k=20)


OP2_SQL = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS n
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_dot_product(q.n, d.n) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.n) = len(d.n)
  WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20"""


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "ratio", "bad_chunks",
    )


def op4_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return sharding.place(docs, sharding.layout(SHARDS), sharding.layout(SHARDS + 1))


def op5_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are of documents; a page is of the document whose number its path holds."""
    pages = table(ready(spark), sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    number = F.expr("try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS bigint)")
    labelled = pages.withColumn("doc_id", number).join(labels, "doc_id").select("url", "bad")
    return url_rules.judge(pages, URL_RULES, labelled)


def op6_schema_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(ready(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, [("user", said), ("assistant", said)])],
        "conv_id long, messages array<struct<role:string,content:string>>",
    )
    turns = chat.canonical(rows).unionByName(chat.canonical(extra))
    return chat.read_back(chat.format_turns(turns))


OP6_SQL = r"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?INST\]|/s>)', '\1\\\2\3', 'g'))
          + length(regexp_replace(text, '([<\[])(\\*)(/?INST\]|/s>)', '\1\\\2\3', 'g')) + 19 AS chars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


def op7_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op9_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = langid.held_out(F.col("doc_id"))
    model = langid.learn(docs.where(~held))
    judged = langid.predict(docs.select("doc_id", "text", held.alias("held_out")), model)
    return judged.select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op10_prefix_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


OP10_SQL = r"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
g AS (
  SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (
  SELECT g.r, i, array_to_string(w[i:i + 34], ' ') AS run FROM g JOIN d USING (r)),
m AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY run) AS n FROM h) WHERE n > 1),
gone AS (
  SELECT r, list(DISTINCT p ORDER BY p) AS ps
  FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM m) GROUP BY r),
k AS (
  SELECT d.r, count(*) FILTER (WHERE x.p IS NULL) AS left_words,
         string_agg(u.word, ' ' ORDER BY u.i) FILTER (WHERE x.p IS NULL) AS kept
  FROM d JOIN gone USING (r), LATERAL (SELECT unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i) u
  LEFT JOIN (SELECT r AS rr, unnest(ps) AS p FROM gone) x ON x.rr = d.r AND x.p = u.i
  GROUP BY d.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(coalesce(len(w) - left_words, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN k.r IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r"""


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "benchmark")
    return resample.resample(documents(spark, sf_dir), target)


# CRC-32, bit by bit: a byte is followed by seven zeros, each step shifts once.
OP11_SQL = r"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
own AS (SELECT r, unnest(w) AS word FROM d),
wanted AS (SELECT unnest(w) AS word FROM b),
vocab AS (
  SELECT word, xor(list_reduce(CAST([4294967295] || flatten(list_transform(range(0, length(hex(word)) // 2),
      lambda i: [CAST('0x' || hex(word)[2 * i + 1:2 * i + 2] AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS BIGINT[]),
    lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM own UNION SELECT word FROM wanted)),
s AS (SELECT bucket, count(*) AS s FROM own JOIN vocab USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM wanted JOIN vocab USING (word) GROUP BY bucket),
gain AS (
  SELECT v.bucket, floor(1000 * ln(
    CAST((coalesce(t, 0) + 1) * ((SELECT count(*) FROM own) + 10000) AS DOUBLE)
    / CAST((coalesce(s, 0) + 1) * ((SELECT count(*) FROM wanted) + 10000) AS DOUBLE))) AS g
  FROM (SELECT DISTINCT bucket FROM vocab) v LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
mean AS (
  SELECT r, floor(sum(g) / count(*)) AS weight FROM own JOIN vocab USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8)
      AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN mean USING (r)),
placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, r) AS rank
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM placed) // 100 THEN rank END AS rank
FROM scored LEFT JOIN placed USING (r)"""


def op12_laesa_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(ready(spark), sf_dir, "embeddings"))


def _centroids_sql(rounds: int, k: int, dims: int) -> str:
    """Rounds of all distances; ``floor`` of exact sums is a whole-number division."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS n
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), n) - 1 AS c, n FROM v
  QUALIFY c < {k})""",
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (
  SELECT r, c, distance FROM (
    SELECT r, c, CAST(list_sum(list_transform(list_zip(v.n, m.n), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
    FROM v CROSS JOIN c{n} m)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1)""")
        if n < rounds:
            parts.append(f"""s{n} AS MATERIALIZED (
  SELECT c, i, sum(x) AS total, count(*) AS n FROM (
    SELECT c, unnest(n) AS x, unnest(range(0, {dims})) AS i FROM a{n} JOIN v USING (r)) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (
  SELECT m.c, coalesce(u.n, m.n) AS n FROM c{n} m LEFT JOIN (
    SELECT c, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS n FROM s{n} GROUP BY c) u USING (c))""")
    return ",\n".join(parts)


OP12_SQL = f"""WITH {_centroids_sql(centroids.ROUNDS, centroids.CENTROIDS, centroids.DIMS)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.n, ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} a JOIN v USING (r) JOIN c{centroids.ROUNDS} m ON m.c = a.c"""


def op13_hyperplane_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(ready(spark), sf_dir, "embeddings"))


# All pairs. A pair right at the threshold is found with a chance of 99.5 %, so the two can differ.
OP13_SQL = """WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
u AS MATERIALIZED (
  SELECT r, vec_id, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS x FROM v
  WHERE len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) >= 0.9),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
named AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
counted AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v LEFT JOIN counted USING (r) JOIN named USING (r)"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_bpe_transducer": (op1_bpe_transducer, None),
    "op2_vector_approximation_topk": (op2_vector_approximation_topk, OP2_SQL),
    "op3_compression_bands": (op3_compression_bands, None),
    "op4_weighted_hash_tree": (op4_weighted_hash_tree, None),
    "op5_association_rules": (op5_association_rules, None),
    "op6_schema_fingerprints": (op6_schema_fingerprints, OP6_SQL),
    "op7_simhash_bk_trees": (op7_simhash_bk_trees, None),
    "op8_bin_completion": (op8_bin_completion, None),
    "op9_compression_language": (op9_compression_language, None),
    "op10_prefix_suffix_trees": (op10_prefix_suffix_trees, OP10_SQL),
    "op11_importance_resampling": (op11_importance_resampling, OP11_SQL),
    "op12_laesa_centroids": (op12_laesa_centroids, OP12_SQL),
    "op13_hyperplane_dedup": (op13_hyperplane_dedup, OP13_SQL),
    "pipeline": (pipeline, None),
}
