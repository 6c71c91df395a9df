"""De-duplication, nearest matches, numbering and sampling against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from mailgraph.operators import dedupe
from mailgraph.operators.dedupe import dedupe_messages
from mailgraph.operators.near import near_neighbours, nearest_within
from mailgraph.operators.numbering import dense_ids, position_in_group
from mailgraph.operators.runs import gap_runs, near_duplicate_runs
from mailgraph.operators.sampling import sample_in_group

MAILS = "file_id bigint, from_mail string, recipients array<string>, msg_time double"
EDGES = "sender string, recipient string, msg_time double"


def greedy(mails, existing, tol):
    kept, log, edges = [], {}, [(s, r, t) for s, r, t in existing]
    stored = len(edges)
    for file_id, sender, recipients, time in sorted(mails):
        near = [
            (abs(t - time), t) for s, r, t in edges if s == sender and r in recipients and abs(t - time) <= tol
        ]
        old = [
            (abs(t - time), t)
            for s, r, t in edges[:stored]
            if s == sender and r in recipients and abs(t - time) <= tol
        ]
        if near:
            log[file_id] = min(old or near)[1]
        else:
            kept.append(file_id)
            edges += [(sender, r, time) for r in recipients]
    return kept, log


def run(spark, mails, existing, tol, rows_per_run=100_000):
    stored = spark.createDataFrame(existing, EDGES) if existing else None
    kept, log = dedupe_messages(spark.createDataFrame(mails, MAILS), stored, tol, rows_per_run)
    return (
        sorted(r["file_id"] for r in kept.collect()),
        {r["file_id"]: r["prior_msg_time"] for r in log.collect()},
    )


@pytest.mark.parametrize(
    "seed, tol, rows_per_run, with_existing",
    [(1, 2.0, 100_000, False), (2, 2.0, 40, True), (3, 0.0, 100_000, True), (4, 5.5, 25, False)],
)
def test_random_mails_equal_the_loop(spark, seed, tol, rows_per_run, with_existing):
    rng = random.Random(seed)
    mails = [
        (i, rng.choice("ab"), rng.sample("uvwxyz", rng.randint(1, 3)), float(rng.randint(0, 120)))
        for i in range(150)
    ]
    existing = [
        (rng.choice("ab"), rng.choice("uvwxyz"), float(rng.randint(0, 120))) for _ in range(15)
    ] if with_existing else []
    assert run(spark, mails, existing, tol, rows_per_run) == greedy(mails, existing, tol)


@pytest.mark.parametrize("rows_per_run", [100_000, 30])
def test_one_long_run_of_mails(spark, rows_per_run):
    mails = [(i, "s", ["r"], i * 1.5) for i in range(120)]
    assert run(spark, mails, [], 2.0, rows_per_run) == greedy(mails, [], 2.0)


@pytest.mark.parametrize("order", ["rising", "falling", "mixed"])
def test_lines_of_mails_with_several_recipients(spark, order):
    """Plain lines, lines that share a sender, and one line that another recipient set cuts into."""
    rng = random.Random(order)
    times = {("s", "ab"): 0.0, ("s", "c"): 0.5, ("t", "ab"): 0.0, ("t", "b"): 40.0}
    rows = []
    for (sender, ends), start in times.items():
        at = start
        for _ in range(70):
            rows.append((sender, list(ends), at))
            at += rng.choice([0.0, 0.75, 1.25, 2.0, 2.5])
    rows.sort(key=lambda r: r[2], reverse=order == "falling")
    if order == "mixed":
        rng.shuffle(rows)
    mails = [(n, *row) for n, row in enumerate(rows)]
    assert run(spark, mails, [], 2.0) == greedy(mails, [], 2.0)


def test_rounds_grow_with_the_logarithm_of_a_line(spark):
    n = 30_000
    edges = spark.range(n).select(
        F.col("id").alias("file_id"), F.lit("s").alias("sender"), F.lit("r").alias("recipient"),
        (F.col("id") * 1.5).alias("msg_time"),
    )
    lines, rest = dedupe._plain_lines(edges, 2.0)
    assert rest.isEmpty()
    nodes = lines.select("line", "at")
    marked, rounds = dedupe.follow(dedupe._next_outside(nodes, 2.0), nodes.groupBy("line").agg(F.min("at").alias("at")))
    # Every second mail is kept: 15,000 of them in one line.
    assert marked.count() == n // 2 and rounds == 14


def plain_runs(rows, tol):
    out, run, before = {}, 0, None
    for key, time, tie in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        same = before is not None and before[0] == key and time - before[1] <= tol
        run += not same
        out[tie] = (run, before[2] if same else None)
        before = key, time, tie
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_gap_runs_over_partition_borders(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), float(rng.randint(0, 400)), n) for n in range(600)]
    rows += [("lone", 1.0, 1000), ("hot", None, 1001)]
    df = spark.createDataFrame(rows, "k string, t double, n bigint")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["n"]: (r["run"], r["prior"]) for r in gap_runs(df, ["k"], "t", 2.0, "n").collect()}
        whole = near_duplicate_runs(df, "k", "t", 2.0, "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = plain_runs([r for r in rows if r[1] is not None], 2.0)
    assert found == want
    sizes = {}
    for run, _ in want.values():
        sizes[run] = sizes.get(run, 0) + 1
    assert {r["run"]: r["mails"] for r in whole} == {run: n for run, n in sizes.items() if n > 1}
    assert gap_runs(df.limit(0), ["k"], "t", 2.0, "n").count() == 0


def test_small_cases(spark):
    mails = [(1, "s", ["r"], 0.0), (2, "s", ["r"], 1.5), (3, "s", ["r"], 3.0)]
    assert run(spark, mails, [], 2.0) == ([1, 3], {2: 0.0})
    mails = [(1, "s", ["r1"], 0.0), (2, "s", ["r1", "r2"], 1.0), (3, "s", ["r2"], 1.0)]
    assert run(spark, mails, [], 2.0) == ([1, 3], {2: 0.0})
    mails = [(1, "s", ["r", "r"], 0.0), (2, "t", ["r"], 0.0), (3, "s", [], 0.0)]
    assert run(spark, mails, [], 2.0) == ([1, 2, 3], {})


def test_many_copies_of_one_mail(spark):
    mails = [(i, "s", ["r", "q"], 7.0) for i in range(3000)]
    kept, log = run(spark, mails, [], 2.0)
    assert kept == [0] and len(log) == 2999


@pytest.mark.parametrize("tol", [0.0, 3.0])
def test_nearest_within(spark, tol):
    rng = random.Random(5)
    left = [(i, rng.choice("ab"), float(rng.randint(0, 60))) for i in range(80)]
    right = [(rng.choice("ab"), float(rng.randint(0, 60))) for _ in range(20)]
    found = nearest_within(
        spark.createDataFrame(left, "id int, k string, t double"),
        spark.createDataFrame(right, "k string, t double"),
        ["k"], "t", tol,
    )
    expected = {}
    for i, k, t in left:
        near = sorted((abs(t - u), u) for key, u in right if key == k and abs(t - u) <= tol)
        if near:
            expected[i] = near[0][1]
    assert {r["id"]: r["prior_time"] for r in found.collect()} == expected


def test_near_neighbours(spark):
    rows = [(1, "a", 0.0), (2, "a", 2.0), (3, "a", 9.0), (4, "b", 9.0), (5, "b", 9.0)]
    found = near_neighbours(spark.createDataFrame(rows, "id int, k string, t double"), ["k"], "t", 2.0)
    assert sorted((r["id"], r["gap"]) for r in found.collect()) == [(1, 2.0), (2, 2.0), (4, 0.0), (5, 0.0)]


def test_numbers_without_gaps(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    rows = dense_ids(df, ["v"], "n", start=1).collect()
    assert sorted((r["n"], r["v"]) for r in rows) == [(i + 1, i) for i in range(5000)]


def test_positions_in_a_hot_group(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
        (F.col("id") * 31 % 6000).alias("v"),
    )
    rows = position_in_group(df, ["g"], ["v"], "pos", "size").collect()
    groups = {}
    for r in sorted(rows, key=lambda r: (r["g"], r["v"])):
        groups.setdefault(r["g"], []).append(r)
    nulls = df.withColumn("g", F.nullif("g", F.lit("hot")))
    lost = position_in_group(nulls, ["g"], ["v"], "pos", "size").filter("g is null").collect()
    assert sorted(r["pos"] for r in lost) == list(range(1, 2001)) and {r["size"] for r in lost} == {2000}
    for members in groups.values():
        assert [r["pos"] for r in members] == list(range(1, len(members) + 1))
        assert {r["size"] for r in members} == {len(members)}


def test_sample_sizes_and_repeatability(spark):
    df = spark.range(1000).select(F.concat(F.lit("g"), F.col("id") % 7).alias("g"), "id")
    first = sample_in_group(df, ["g"], ["id"], 75)
    again = sample_in_group(df.repartition(13), ["g"], ["id"], 75)
    assert sorted(first.collect()) == sorted(again.collect())
    for row in first.groupBy("g", "group_size").count().collect():
        assert row["count"] == row["group_size"] * 75 // 100
    nulls = sample_in_group(df.withColumn("g", F.nullif("g", F.lit("g3"))), ["g"], ["id"], 75)
    assert nulls.filter("g is null").count() == 143 * 75 // 100
    single = sample_in_group(df.filter("id = 3"), ["g"], ["id"], 75)
    assert single.isEmpty()
    other = sample_in_group(df, ["g"], ["id"], 75, seed=7)
    assert sorted(first.collect()) != sorted(other.collect())


@pytest.mark.parametrize("sorted_rows, bins", [(4096, 256), (20, 4), (3, 256)])
def test_sample_equals_sorted_digests(spark, monkeypatch, sorted_rows, bins):
    """Large groups, small ones, a null one and repeated rows, by selection and by sorting."""
    import hashlib

    from mailgraph.operators import sampling

    monkeypatch.setattr(sampling, "SORTED_ROWS", sorted_rows)
    monkeypatch.setattr(sampling, "BINS", bins)
    rng = random.Random(bins)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), n) for n in range(700)]
    rows += [("hot", 5), ("same", 1), ("same", 1), ("same", 1), ("same", 1), ("one", 1)]
    df = spark.createDataFrame(rows, "g string, id bigint")
    found = sorted(((r["g"], r["id"], r["group_size"]) for r in sample_in_group(df, ["g"], ["id"], 60).collect()), key=str)
    want = []
    for g in {g for g, _ in rows}:
        ids = [n for h, n in rows if h == g]
        text = lambda n: hashlib.md5("|".join(["42", *([g] if g else []), str(n)]).encode()).hexdigest()  # noqa: E731, B023
        want += [(g, n, len(ids)) for n in sorted(ids, key=text)[: len(ids) * 60 // 100]]
    assert found == sorted(want, key=str)
