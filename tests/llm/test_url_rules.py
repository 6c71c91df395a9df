"""Parsing and fixed rules against plain code; mining against counted combinations."""

from itertools import combinations, product

from pyspark.sql import functions as F

from mailgraph.llm import queries, url_rules


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def rule_of(host, path):
    best = None
    for verdict, rule in queries.URL_RULES:
        rule_host, _, rule_path = rule.partition("/")
        fits = (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path)
        if fits and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    out = queries.op5_association_rules(spark, sf_dir).collect()
    assert len(out) == len(urls)
    for row in out:
        host, path = parse(urls[row["page_id"]])
        best = rule_of(host, path)
        assert (row["host"], row["path"]) == (host, path)
        assert row["rule"] == (best and best[1]) and row["verdict"] in ("allow", "block")
        assert best is None or row["verdict"] == best[0]


def test_odd_urls(spark):
    odd = [None, "", "no scheme/x", "http://", "http://A.Example.ORG/es/x?y", "HTTP://example.org", "x://ÄB.org/#f",
           "http://org/", "http://xorg/", "http://example.org/en/12", "http://a.b.com?x=/de/", "a://b://c/d",
           "http://example.com/de/" + "x" * 100_000, "http://example.com/de/\nx"]
    df = spark.createDataFrame([(n, u) for n, u in enumerate(odd)] * 2, "page_id long, url string")
    labels = spark.createDataFrame([], "url string, bad boolean")
    out = url_rules.judge(df.withColumn("host", F.lit(1)), queries.URL_RULES, labels).collect()
    assert len(out) == 2 * len(odd)
    for row in out:
        host, path = parse(odd[row["page_id"]])
        best = rule_of(host, path)
        assert (row["host"], row["path"], row["rule"]) == (host, path, best and best[1])
        assert row["verdict"] == (best[0] if best else "allow")
    assert url_rules.judge(df.limit(0), queries.URL_RULES, labels).count() == 0


def counted_rules(rows):
    """Every combination, counted; without those a part of which is as sure."""
    base = sum(r["bad"] for r in rows) / len(rows)
    counted = {}
    for r in rows:
        for size in range(1, len(r["tokens"]) + 1):
            for c in combinations(sorted(r["tokens"]), size):
                n, bad = counted.get(c, (0, 0))
                counted[c] = (n + 1, bad + r["bad"])
    sure = {
        c: bad / n for c, (n, bad) in counted.items()
        if bad / len(rows) >= url_rules.MIN_SUPPORT and bad / n >= url_rules.MIN_CONFIDENCE
        and bad / n / base >= url_rules.MIN_LIFT
    }
    return {
        c for c in sure
        if not any(p in sure and sure[p] >= sure[c] for s in range(1, len(c)) for p in combinations(c, s))
    }


def check_rules(spark, urls):
    df = spark.createDataFrame(urls, "url string, bad boolean")
    host, path = url_rules.host_and_path(F.col("url"))
    rows = df.select("bad", url_rules.tokens(F.col("url"), host, path).alias("tokens")).collect()
    want = counted_rules(rows)
    mined = url_rules.mine(spark.createDataFrame(rows)).collect()
    # A rule stands for all ways to fill its slots.
    assert {tuple(sorted(c)) for r in mined for c in product(*r["slots"])} == want and want
    assert all(set(r["tokens"]) & set(r["firsts"]) for r in mined)
    out = url_rules.judge(df.withColumn("page_id", F.lit(1)), [], df)
    blocked = out.where("verdict = 'block'").count()
    assert blocked == sum(any(set(c) <= set(r["tokens"]) for c in want) for r in rows)
    return want


def test_mined_rules_equal_counted_ones(spark):
    sites = ["news", "shop", "spam"]
    urls = [(f"http://{s}.x.net/{p}/{n}?{q}=1", s == "spam" and p == "a" or (s, p, q) == ("shop", "b", "k"))
            for n in range(20) for s in sites for p in "abc" for q in ("id", "k")]
    check_rules(spark, urls)


def test_rules_of_five_tokens(spark):
    """Only all five segments together are bad, and any four of them are not."""
    urls = [("http://h/" + "/".join(x for n, x in enumerate("abcde") if bits >> n & 1), bits == 31)
            for bits in range(32) for _ in range(3)]
    want = check_rules(spark, urls)
    assert max(map(len, want)) == 5


def test_tokens_that_always_go_together(spark):
    """Eighteen segments that always come together would make 2^18 combinations."""
    many = "/".join(f"s{chr(97 + n)}" for n in range(18))
    urls = [(f"http://h/{many}/x", True)] * 10 + [("http://h/other/x", False)] * 30
    df = spark.createDataFrame(urls, "url string, bad boolean")
    pages = spark.createDataFrame([(1, "http://k/sc/y"), (2, "http://h/x"), (3, "http://h/other/sq")], "page_id long, url string")
    out = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, [], df).collect()}
    assert out == {1: "block", 2: "allow", 3: "block"}
