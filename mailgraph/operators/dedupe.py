"""Time-tolerant removal of repeated mails; the first to arrive wins.

A mail is dropped when one of its recipients already has a kept mail from the same sender
within the tolerance. A dropped mail suppresses nothing. Arrival order is ``file_id`` order.

Mails are first cut into runs of a pair whose times follow each other within the tolerance. Most
runs are plain lines: all their mails go to the same recipients, and they arrived in the order of
their times (or in the reverse order). There each mail points to the next one outside its
tolerance, and the mails kept are those that the pointers reach from the first one. Pointers are
doubled, so a line of N mails takes log N rounds, whatever its length and however it is dealt.

The mixed rest equals taking, again and again, every mail that arrived before all undecided mails
it conflicts with, keeping it, and dropping what conflicts with it. Each round is joins and
aggregations over the undecided rows only; dense heaps of mails collapse in the first rounds, and
in each round every task also decides, inside one bounded time-sorted partition, all it can
without knowing its neighbours.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailgraph.operators.near import cell_of, nearest_within, reach
from mailgraph.operators.runs import gap_runs
from mailgraph.session import settle

PAIR = ["sender", "recipient"]
LOG_COLUMNS = ["file_id", "prior_msg_time", "msg_time", "time_diff"]
ROWS_PER_RUN = 100_000


def mail_edges(mails: DataFrame) -> DataFrame:
    return mails.select(
        "file_id",
        F.col("from_mail").alias("sender"),
        F.explode_outer("recipients").alias("recipient"),
        "msg_time",
    ).filter("recipient is not null")


def _contested(edges: DataFrame, tol: float) -> DataFrame:
    """Edges with another mail's edge in the same or a neighbouring cell."""
    edges = edges.withColumn("cell", cell_of(F.col("msg_time"), tol))
    spans = edges.groupBy(*PAIR, "cell").agg(F.min("file_id").alias("lo"), F.max("file_id").alias("hi"))
    near = (
        spans.withColumn("cell", F.explode(reach(F.col("cell"), tol)))
        .groupBy(*PAIR, "cell")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .filter("lo < hi")
        .select(*PAIR, "cell")
    )
    return edges.join(settle(near), [*PAIR, "cell"])


def _plain_lines(contested: DataFrame, tol: float) -> tuple[DataFrame, DataFrame]:
    """(line, at, file_id) of the mails of plain lines, and the contested edges of all others.

    ``at`` rises in the order of arrival. A run is plain if its mails share their contested
    recipients; a mail is, if all its runs are. The other runs of a plain run's mails hold these
    mails, too, so plain mails conflict with none of the rest.
    """
    edges = contested.select("file_id", *PAIR, "msg_time").distinct()
    runs = gap_runs(edges, PAIR, "msg_time", tol, "file_id")
    goes_on = F.col("prior").isNotNull()
    shape = runs.groupBy("run").agg(
        (F.min("file_id") < F.max("file_id")).alias("shared"),
        F.bool_and(~goes_on | (F.col("prior") < F.col("file_id"))).alias("rising"),
        F.bool_and(~goes_on | (F.col("prior") > F.col("file_id"))).alias("falling"),
    )
    shape = settle(shape.filter("shared").drop("shared"))
    shared = settle(runs.drop("prior").join(shape, "run"))
    ends = settle(
        shared.groupBy("file_id").agg(F.sort_array(F.collect_set("recipient")).alias("ends"))
    )
    one_way = F.bool_and(F.col("rising")) | F.bool_and(F.col("falling"))
    plain = shared.join(ends, "file_id").groupBy("run").agg(
        ((F.min("ends") == F.max("ends")) & one_way).alias("plain")
    )
    at = F.when(F.col("rising"), F.col("msg_time")).otherwise(-F.col("msg_time"))
    verdict = shared.join(settle(plain), "run").groupBy("file_id").agg(
        F.bool_and("plain").alias("plain"),
        F.min_by("run", "recipient").alias("line"),
        F.min_by(at.cast("double"), "recipient").alias("at"),
    )
    verdict = settle(verdict)
    rest = shared.join(verdict.filter("not plain").select("file_id"), "file_id", "left_semi")
    rest = rest.select("file_id", *PAIR, "msg_time", cell_of(F.col("msg_time"), tol).alias("cell"))
    return verdict.filter("plain").select("line", "at", "file_id"), rest


def _next_outside(nodes: DataFrame, tol: float) -> DataFrame:
    """(line, at, to): the first time of the line that is more than ``tol`` later.

    Inside a run it is less than two tolerances away, so it lies in the cell of ``at + tol`` or
    in the one after. Windows run over the distinct times of one cell.
    """
    limit = F.col("at") + tol
    known = nodes.select("line", "at", F.lit(True).alias("known"), F.col("at").alias("t"))
    asked = nodes.select("line", "at", F.lit(False).alias("known"), limit.alias("t"))
    cells = known.unionByName(asked).withColumn("cell", cell_of(F.col("t"), tol))
    line = Window.partitionBy("line", "cell").orderBy("t", F.desc("known"))
    following = F.first(F.when(F.col("known"), F.col("t")), True)
    here = cells.withColumn("to", following.over(line.rowsBetween(1, Window.unboundedFollowing)))
    firsts = known.withColumn("cell", cell_of(F.col("t"), tol) - 1)
    firsts = settle(firsts.groupBy("line", "cell").agg(F.min("t").alias("later")))
    found = here.filter("not known").join(firsts, ["line", "cell"], "left")
    return found.select("line", "at", F.coalesce("to", "later").alias("to")).filter("to is not null")


def follow(jumps: DataFrame, heads: DataFrame) -> tuple[DataFrame, int]:
    """All (line, at) that the pointers (line, at, to) reach from the heads, and the rounds taken.

    After n rounds a pointer leads 2^n steps on and the first 2^n nodes of each line are marked.
    """
    marked, jumps, rounds = settle(heads), settle(jumps), 0
    while not jumps.isEmpty():
        rounds += 1
        ahead = marked.join(jumps, ["line", "at"]).select("line", F.col("to").alias("at"))
        marked = settle(marked.unionByName(ahead))
        on = jumps.select("line", F.col("at").alias("to"), F.col("to").alias("on"))
        jumps = settle(jumps.join(on, ["line", "to"]).select("line", "at", F.col("on").alias("to")))
    return marked, rounds


def _decide_lines(mails: DataFrame, tol: float) -> DataFrame:
    """(file_id, kept) of the mails of plain lines. Of equal times the first to arrive counts."""
    nodes = settle(mails.groupBy("line", "at").agg(F.min("file_id").alias("file_id")))
    heads = nodes.groupBy("line").agg(F.min("at").alias("at"))
    jumps = _next_outside(nodes.select("line", "at"), tol) if tol > 0 else None
    marked = follow(jumps, heads)[0] if jumps is not None else settle(heads)
    kept = nodes.join(marked, ["line", "at"], "left_semi").select("file_id", F.lit(True).alias("kept"))
    return settle(mails.select("file_id").join(settle(kept), "file_id", "left").fillna(False, "kept"))


def _first_arrivals(pending: DataFrame, tol: float) -> DataFrame:
    """Mails that arrived before every undecided mail around each of their edges."""
    first = (
        pending.groupBy(*PAIR, "cell")
        .agg(F.min("file_id").alias("first"))
        .withColumn("cell", F.explode(reach(F.col("cell"), tol)))
        .groupBy(*PAIR, "cell")
        .agg(F.min("first").alias("first"))
    )
    return (
        pending.join(settle(first), [*PAIR, "cell"])
        .groupBy("file_id")
        .agg(F.bool_and(F.col("file_id") == F.col("first")).alias("wins"))
        .filter("wins")
        .select("file_id")
    )


def _decide_run(batches: Iterator[pd.DataFrame], tol: float, parts: int) -> Iterator[pd.DataFrame]:
    """Mails of one time-sorted partition that are certainly kept."""
    frames = [b for b in batches if len(b)]
    if not frames:
        return
    run = pd.concat(frames, ignore_index=True)
    first, last = run.iloc[0], run.iloc[-1]
    unsure_head = first.part > 0
    unsure_tail = first.part < parts - 1
    # Per pair the sorted times of earlier mails that are kept, and of those not decidable here.
    kept, open_ = defaultdict(list), defaultdict(list)

    def near(times: list[float], t: float) -> bool:
        at = bisect_left(times, t - tol)
        return at < len(times) and times[at] <= t + tol

    winners = []
    for row in run.sort_values("file_id").itertuples(index=False):
        pairs = [(row.sender, r) for r in row.recipients]
        if any(near(kept[p], row.msg_time) for p in pairs):
            continue
        at_edge = (
            unsure_head and row.sender == first.sender and row.msg_time <= first.msg_time + tol
        ) or (unsure_tail and row.sender == last.sender and row.msg_time >= last.msg_time - tol)
        sure = not at_edge and not any(near(open_[p], row.msg_time) for p in pairs)
        if sure:
            winners.append(row.file_id)
        for p in pairs:
            insort((kept if sure else open_)[p], row.msg_time)
    yield pd.DataFrame({"file_id": pd.Series(winners, dtype="int64")})


def _run_winners(pending: DataFrame, tol: float, parts: int) -> DataFrame:
    mails = pending.groupBy("file_id", "sender", "msg_time").agg(
        F.collect_set("recipient").alias("recipients")
    )
    order = ["sender", "msg_time", "file_id"]
    runs = mails.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    runs = runs.withColumn("part", F.spark_partition_id())
    return runs.mapInPandas(partial(_decide_run, tol=tol, parts=parts), "file_id bigint")


def _losers(pending: DataFrame, winners: DataFrame, tol: float) -> DataFrame:
    """Undecided mails in conflict with a kept mail that arrived before.

    Kept mails of a pair are more than ``tol`` apart, so a cell holds at most one of them and
    an edge meets at most three.
    """
    kept = pending.join(winners, "file_id", "left_semi").select(
        *PAIR,
        F.col("file_id").alias("kept_id"),
        F.col("msg_time").alias("kept_time"),
        F.explode(reach(F.col("cell"), tol)).alias("cell"),
    )
    kept = kept.distinct()
    conflict = (F.col("kept_id") < F.col("file_id")) & (
        F.abs(F.col("msg_time") - F.col("kept_time")) <= tol
    )
    return pending.join(kept, [*PAIR, "cell"]).filter(conflict)


def dedupe_messages(
    mails: DataFrame,
    existing_edges: DataFrame | None = None,
    tol: float = 2.0,
    rows_per_run: int = ROWS_PER_RUN,
) -> tuple[DataFrame, DataFrame]:
    """Split mails (file_id, from_mail, recipients, msg_time, …) into kept ones and a log.

    The log has one row per dropped mail with the nearest earlier-arrived kept time.
    """
    edges = mail_edges(mails)
    log = None
    if existing_edges is not None:
        # Of the history only the time span of the batch and its senders can matter.
        span = edges.agg(F.min("msg_time") - tol, F.max("msg_time") + tol).first()
        stored = existing_edges.select(*PAIR, F.col("msg_time").cast("double"))
        stored = stored.filter(F.col("msg_time").between(*span))
        stored = stored.join(settle(edges.select("sender").distinct()), "sender", "left_semi")
        hits = nearest_within(edges, stored, PAIR, "msg_time", tol)
        log = settle(_nearest_per_mail(hits.withColumnRenamed("prior_time", "prior_msg_time")))
        edges = edges.join(log.select("file_id"), "file_id", "left_anti")

    contested = settle(_contested(edges, tol))
    if contested.isEmpty():
        if log is None:
            log = mails.sparkSession.createDataFrame(
                [], "file_id bigint, prior_msg_time double, msg_time double, time_diff double"
            )
        return mails.join(log.select("file_id"), "file_id", "left_anti"), log
    lines, rest = _plain_lines(contested, tol)
    pending, decided, round_no = settle(rest), [_decide_lines(lines, tol)], 0
    while left := pending.count():
        round_no += 1
        parts = -(-left // rows_per_run)
        winners = _first_arrivals(pending, tol).unionByName(_run_winners(pending, tol, parts))
        winners = settle(winners.distinct())
        losers = _losers(pending, winners, tol).select("file_id").distinct()
        done = settle(
            winners.withColumn("kept", F.lit(True))
            .unionByName(losers.withColumn("kept", F.lit(False)))
        )
        decided.append(done)
        pending = settle(pending.join(done, "file_id", "left_anti"))
        if round_no % 50 == 0:
            decided = [settle(_all(decided))]

    verdict = _all(decided)
    kept_ids = verdict.filter("kept").select("file_id")
    dropped = contested.join(verdict.filter("not kept"), "file_id", "left_semi")
    near = _losers(
        dropped.unionByName(contested.join(kept_ids, "file_id", "left_semi")), kept_ids, tol
    )
    in_batch = _nearest_per_mail(
        near.withColumn("prior_msg_time", F.col("kept_time")).withColumn(
            "time_diff", F.abs(F.col("msg_time") - F.col("kept_time"))
        )
    )
    log = in_batch if log is None else log.unionByName(in_batch)
    kept = mails.join(log.select("file_id"), "file_id", "left_anti")
    return kept, log


def _all(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _nearest_per_mail(hits: DataFrame) -> DataFrame:
    nearest = F.min(F.struct("time_diff", "prior_msg_time", "msg_time")).alias("hit")
    return hits.groupBy("file_id").agg(nearest).select(
        "file_id", "hit.prior_msg_time", "hit.msg_time", "hit.time_diff"
    )
