"""URL filter: fixed rules first, then association rules mined from labelled URLs.

A URL is a set of tokens: the labels of its host, the segments of its path, the names of its
query. FP-growth mines token combinations that go with bad pages; those of enough support and
confidence that say more than their parts become rules. Rules are found through an inverted
index: each stands under its rarest token, and only URLs that hold this token are looked at.

Tokens that occur in the same labelled URLs are mined as one: n of them would make 2^n equal
combinations. A rule has a slot for each of its tokens, filled by any token mined as that one, so
it says what the rules of all these combinations would say.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgraph.llm.common import lower_ascii
from mailgraph.session import settle

# A combination must occur in this share of the labelled URLs, and this share of them be bad.
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.7
# It must be bad this many times as often as any URL.
MIN_LIFT = 1.5
_BAD = "label:bad"
RULES = (
    "tokens array<string>, slots array<array<string>>, confidence double, support double,"
    " firsts array<string>"
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null URL and one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)://(.*)", 1))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; rules are (verdict, host/path)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rule_path = rule.partition("/")
        fits = (host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))
        fits = fits & F.startswith(path, F.lit(slash + rule_path))
        name = F.when(fits, F.lit(rule)).otherwise(name)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens; numbers count as one token, whatever they are."""

    def named(kind: str, values: Column) -> Column:
        values = F.filter(values, lambda v: v != "")
        return F.transform(
            values, lambda v: F.concat(F.lit(f"{kind}:"), F.regexp_replace(v, "[0-9]+", "0"))
        )

    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda v: F.split(v, "=")[0])
    every = F.concat(
        named("host", F.split(host, r"\.")), named("path", F.split(path, "/")), named("query", names)
    )
    return F.coalesce(F.array_distinct(every), F.array().cast("array<string>"))


def merged(baskets: DataFrame) -> DataFrame:
    """(token, name): tokens that occur in the same rows (``_row``, ``tokens``) share a name.

    Rows are compared by their number and two sums of 64-bit hashes.
    """
    held = baskets.select("_row", F.explode("tokens").alias("token"))
    hashes = [F.sum(F.xxhash64("_row", F.lit(n)).cast("decimal(38,0)")).alias(f"h{n}") for n in (1, 2)]
    where = settle(held.groupBy("token").agg(F.count("*").alias("n"), *hashes))
    names = where.groupBy("n", "h1", "h2").agg(F.min("token").alias("name"))
    return where.join(settle(names), ["n", "h1", "h2"]).select("token", "name")


def _surest_part(sets: DataFrame, found: DataFrame) -> DataFrame:
    """``tokens`` of the sets of which a proper part has a rule at least as sure as their own.

    Every part of a frequent set is frequent, so the surest rule of all parts is found size by
    size, from the sets with one token less.
    """
    rules = found.select("tokens", "confidence")
    sets = settle(sets.join(rules, "tokens", "left").withColumn("size", F.size("tokens")))
    longest = sets.agg(F.max("size")).first()[0] or 0
    below = sets.filter("size = 1").select("tokens", "confidence", F.lit(None).cast("double").alias("part"))
    levels = [below]
    for size in range(2, longest + 1):
        shorter = sets.filter(F.col("size") == size).select(
            F.col("tokens").alias("whole"), "confidence", F.explode("tokens").alias("left"), "tokens"
        )
        shorter = shorter.withColumn("tokens", F.array_except("tokens", F.array("left")))
        best = below.select("tokens", F.greatest("confidence", "part").alias("part"))
        below = shorter.join(best, "tokens").groupBy(F.col("whole").alias("tokens")).agg(
            F.max("confidence").alias("confidence"), F.max("part").alias("part")
        )
        below = settle(below)
        levels.append(below)
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return whole.where("part >= confidence").select("tokens")


def mine(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """Rules from rows (``tokens``, ``bad``): RULES, without those a part of which says as much."""
    spark = labelled.sparkSession
    rows = labelled.where("bad IS NOT NULL").select("tokens", "bad")
    rows = settle(rows.withColumn("_row", F.monotonically_increasing_id()))
    if rows.isEmpty():
        return spark.createDataFrame([], RULES)
    names = settle(merged(rows))
    one_name = rows.select("_row", F.explode("tokens").alias("token")).join(names, "token")
    baskets = one_name.groupBy("_row").agg(F.collect_set("name").alias("names"))
    items = F.coalesce("names", F.array().cast("array<string>"))
    items = F.when(F.col("bad"), F.array_append(items, F.lit(_BAD))).otherwise(items)
    baskets = settle(rows.join(baskets, "_row", "left").select(items.alias("items")))
    model = FPGrowth(
        itemsCol="items", minSupport=min_support, minConfidence=min_confidence
    ).fit(baskets)
    frequent = settle(model.freqItemsets)
    found = settle(
        model.associationRules.where(
            (F.size("consequent") == 1) & (F.col("consequent")[0] == _BAD) & (F.col("lift") >= MIN_LIFT)
        ).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    )
    with_bad = frequent.where(F.array_contains("items", _BAD) & (F.size("items") > 1))
    sets = with_bad.select(F.array_sort(F.array_except("items", F.array(F.lit(_BAD)))).alias("tokens"))
    kept = settle(found.join(_surest_part(sets, found), "tokens", "left_anti"))
    frequency = frequent.where(F.size("items") == 1).select(F.col("items")[0].alias("name"), "freq")
    slots = names.groupBy("name").agg(F.array_sort(F.collect_list("token")).alias("slot"))
    slots = settle(slots.join(frequency, "name"))
    filled = (
        kept.select("tokens", F.explode("tokens").alias("name"))
        .join(slots, "name")
        .groupBy("tokens")
        .agg(
            F.array_sort(F.collect_list("slot")).alias("slots"),
            F.min(F.struct("freq", "name", "slot"))["slot"].alias("firsts"),
        )
    )
    return settle(kept.join(filled, "tokens").select("tokens", "slots", "confidence", "support", "firsts"))


def matches(urls: DataFrame, rules: DataFrame, row: str = "_row") -> DataFrame:
    """(row, tokens and confidence of the surest rule) for the URLs that fill all slots of a rule."""
    held = urls.select(row, F.col("tokens").alias("held"), F.explode("tokens").alias("first"))
    index = rules.select("tokens", "slots", "confidence", F.explode("firsts").alias("first"))
    hits = held.join(index, "first").where(F.forall("slots", lambda slot: F.arrays_overlap(slot, F.col("held"))))
    best = F.max(F.struct("confidence", "tokens"))
    return hits.groupBy(row).agg(best.alias("best")).select(
        row, F.col("best.tokens").alias("mined"), F.col("best.confidence").alias("confidence")
    )


def judge(
    pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame, key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """(key, host, path, rule, verdict, mined, confidence) for every page.

    ``labelled`` has (url, bad). A page is blocked or allowed by the longest fixed rule that fits
    (``rule``, else null), then blocked by a mined rule (``mined``: the names of its tokens), else
    allowed.
    A null URL has empty host and path and no tokens, and is allowed. Equal rows give equal
    results; without labels nothing is mined; an empty table gives an empty one. Other columns
    are not read.
    """
    host, path = host_and_path(F.col("url"))

    def parsed(df: DataFrame) -> DataFrame:
        return df.withColumns({"host": host, "path": path}).withColumn(
            "tokens", tokens(F.col("url"), F.col("host"), F.col("path"))
        )

    mined = mine(parsed(labelled.select("url", "bad")))
    rows = parsed(pages.select(F.col(key).alias("_key"), F.col(url).alias("url")))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = settle(
        rows.select(
            "_key", "host", "path", "tokens", name.alias("rule"), verdict.alias("decided"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    found = matches(rows.where("decided IS NULL"), mined)
    by_rule = F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(found, "_row", "left").select(
        F.col("_key").alias(key), "host", "path", "rule",
        F.coalesce("decided", by_rule).alias("verdict"), "mined", "confidence",
    )
