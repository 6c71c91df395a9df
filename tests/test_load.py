"""Loading archives: files, increments, repeated batches, streams, exports and snapshots."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mailgraph.operators import edge_attrs, exports, graph
from mailgraph.plans import mail_etl
from mailgraph.sources import mail_files, tables
from mailgraph.streaming import mail_stream


def write_mail(root, user, folder, name, to="b@x", sent="14:37:31", body="some words", subject="Hi there"):
    place = root / user / folder
    place.mkdir(parents=True, exist_ok=True)
    text = (
        f"Date: Thu, 27 Dec 2001 {sent} -0800\r\nFrom: {user}@x\r\nTo: {to}\r\nSubject: {subject}\r\n"
        f"X-From: {user.title()} Z <{user}@x>\r\nX-To: Bee\r\nX-cc: \r\n\r\n{body}"
    )
    (place / name).write_bytes(text.encode("latin-1"))


@pytest.fixture
def archive(tmp_path):
    root = tmp_path / "mails"
    write_mail(root, "ann", "sent", "1.", body="café au lait")
    write_mail(root, "ann", "sent", "2.", sent="14:37:33")
    write_mail(root, "ann", "sent_items", "1.", to="b@x, c@x", sent="15:00:00")
    write_mail(root, "bob", "inbox", "1.", body="12 34")
    return root


def table(spark, folder, name):
    return mail_etl.stored_table(spark, folder, name)


def test_scan_and_folders(spark, archive):
    files = mail_files.scan_mail_files(spark, str(archive))
    assert files.count() == 4
    assert files.filter("text like '%café%' and text not like '%\r%'").count() == 1
    chosen = mail_files.select_folders(files, ["sent"])
    assert {(r["user_folder"], r["file_name"]) for r in chosen.collect()} == {("ann", "1."), ("ann", "2.")}
    merged = mail_files.merge_folders(mail_files.with_folders(files))
    names = sorted((r["user_folder"], r["merged_name"]) for r in merged.collect())
    assert names == [("ann", "1."), ("ann", "20000"), ("ann", "20001")]


def test_stop_words(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("the \n and\nthe\n")
    found = mail_files.load_stop_words(spark, str(tmp_path / "stops.txt"))
    assert sorted(r["word"] for r in found.collect()) == ["and", "the"]


def test_load_and_increment(spark, archive, tmp_path):
    out = str(tmp_path / "tables")
    mail_etl.load_archive(spark, str(archive), out, stop_words=["au"])
    assert table(spark, out, "mail_list").count() == 3
    assert table(spark, out, "emails").count() == 2
    assert table(spark, out, "edges").count() == 3
    log = table(spark, out, "duplicate_log").collect()
    assert [(r["time_diff"]) for r in log] == [2.0]
    assert table(spark, out, "unprocessed_log").count() == 1
    words = {r["word"] for r in table(spark, out, "body_tf").collect()}
    assert words == {"café", "lait", "some", "words"}
    # A near copy of a stored mail and a new mail arrive.
    write_mail(archive, "ann", "sent", "3.", sent="14:37:30")
    write_mail(archive, "ann", "sent", "4.", sent="18:00:00")
    mail_etl.load_archive(spark, str(archive), out)
    assert table(spark, out, "mail_list").count() == 5
    assert table(spark, out, "emails").count() == 3
    assert table(spark, out, "duplicate_log").count() == 2
    ids = [r["file_id"] for r in table(spark, out, "mail_list").collect()]
    assert len(set(ids)) == 5


def test_failed_batch_is_written_over(spark, archive, tmp_path, monkeypatch):
    out = str(tmp_path / "tables")
    real = mail_etl.append_table

    def fail(*args, **kwargs):
        raise RuntimeError("lost")

    monkeypatch.setattr(mail_etl, "append_table", fail)
    with pytest.raises(RuntimeError):
        mail_etl.load_archive(spark, str(archive), out)
    assert table(spark, out, "edges") is None
    monkeypatch.setattr(mail_etl, "append_table", real)
    mail_etl.load_archive(spark, str(archive), out)
    assert table(spark, out, "edges").count() == 3
    files = mail_files.scan_mail_files(spark, str(archive))
    mail_etl.load_batch(files, out, token="t")
    before = table(spark, out, "unprocessed_log").count()
    mail_etl.load_batch(files, out, token="t")
    assert table(spark, out, "unprocessed_log").count() == before


def test_stream_of_files(spark, archive, tmp_path):
    out, checkpoint = str(tmp_path / "tables"), str(tmp_path / "checkpoint")

    def go():
        stream = mail_stream.mail_file_stream(spark, str(archive), files_per_batch=3)
        mail_stream.start_loading(stream, out, checkpoint).awaitTermination()

    go()
    assert table(spark, out, "mail_list").count() == 3
    write_mail(archive, "cat", "sent", "1.", sent="10:00:00")
    go()
    assert table(spark, out, "mail_list").count() == 4
    assert table(spark, out, "emails").filter("from_mail = 'cat@x'").count() == 1


def test_lemmas_before_stop_words(spark, archive):
    files = mail_files.scan_mail_files(spark, str(archive))
    forms = spark.createDataFrame([("words", "word")], "form string, lemma string")
    numbers = mail_etl.file_numbers(files)
    found = mail_etl.build_tables(mail_etl.read_messages(files, numbers, ["word"], forms))
    assert {r["word"] for r in found.body_tf.collect()} == {"café", "au", "lait", "some"}


def test_term_tables(spark, tmp_path):
    tf = spark.createDataFrame(
        [(1, "a", 1, 0.5, None), (1, "b", 1, 0.5, None), (2, "a", 2, 1.0, None)],
        "file_id bigint, word string, abs_tf bigint, rel_tf double, status string",
    )
    mail_etl.build_term_tables(tf, str(tmp_path), "body")
    idf = {r["word"]: r["idf"] for r in spark.read.parquet(f"{tmp_path}/body_idf").collect()}
    assert idf == {"a": 0.0, "b": 0.4055}
    value = {r["word"]: r["tf_idf"] for r in spark.read.parquet(f"{tmp_path}/body_tfidf").collect()}
    assert value == {"a": 0.0, "b": 0.2028}
    marked = tables.mark_status(tf, spark.createDataFrame([("a",)], "word string"), "word")
    assert sorted((r["word"], r["status"]) for r in marked.collect()) == [("a", "OK"), ("a", "OK"), ("b", None)]


def export_mails(spark, archive):
    files = mail_files.select_folders(mail_files.scan_mail_files(spark, str(archive)), ["sent", "sent_items"])
    return exports.export_mails(mail_files.split_mail(files))


def test_export_documents(spark, archive, tmp_path):
    mails = export_mails(spark, archive)
    records = exports.sender_export(mails, "subjects_labelled").collect()
    assert {tuple(r["from"]) for r in records} == {("ann@x", "Ann Z ", "AZ")}
    by_recipient = {}
    for r in sorted(records, key=lambda r: r["position"]):
        by_recipient.setdefault(r["to"]["email"], []).append(r["subject"])
    assert by_recipient["b@x, c@x"] == ["Hi there (Thu 27 Dec 2001 15:00:00)"]
    assert len(by_recipient["b@x"]) == 2 and sorted(r["position"] for r in records) == [1, 1, 2]
    full = exports.sender_export(mails, "latest_full").collect()
    assert {r["to"]["email"]: r["to"]["body"] for r in full} == {"b@x": "some words", "b@x, c@x": "some words"}
    with pytest.raises(ValueError):
        exports.sender_export(mails, "other")
    # Written once; a second run finds the user exported.
    path = str(tmp_path / "exports")
    documents = exports.sender_export(mails, "latest_counted")
    assert tables.unexported(documents, path).count() == 2
    tables.write_exports(documents, path)
    written = [json.loads(x) for p in (tmp_path / "exports").rglob("*.json") for x in p.read_text().splitlines()]
    assert len(written) == 2 and {w["from"]["name"] for w in written} == {"Ann Z "}
    assert written[0]["to"]["subject"]["sub_count"] == "2"
    assert tables.unexported(documents, path).isEmpty()
    records = exports.sender_export(mails, "subjects_jsonl").collect()
    assert sum(r["from"] is not None for r in records) == 1 and len(records) == 4


EDGES = "file_id bigint, sender string, recipient string, msg_time double, mail_cat string, rec_cat string"


def edge(file_id, when, sender="a", recipient="b", cat="TO"):
    seconds = F.unix_timestamp(F.lit(when).cast("timestamp"))
    return file_id, sender, recipient, when, "INIT", cat


def edge_frame(spark, rows):
    df = spark.createDataFrame(rows, EDGES.replace("msg_time double", "msg_time string"))
    return df.withColumn("msg_time", F.unix_timestamp(F.col("msg_time").cast("timestamp")).cast("double"))


def test_month_windows(spark):
    rows = [
        edge(1, "2001-01-10 06:00:00"),  # before the first month end: in no window
        edge(2, "2001-02-28 06:00:00"),  # exactly on a month end: in two windows
        edge(3, "2001-03-05 00:00:00"),
        edge(4, "2001-03-31 07:00:00"),  # after that day's boundary: next window
        edge(5, "2001-06-30 06:00:00", "", "b"),  # no sender
        edge(6, "2001-07-02 00:00:00"),  # after the last month end
    ]
    found = graph.monthly_edges(edge_frame(spark, rows)).orderBy("snapshot").collect()
    assert [(r["snapshot"], r["mails"]) for r in found] == [(0, 1), (1, 2), (2, 1)]


def test_edge_vectors(spark, tmp_path):
    rows = [
        edge(1, "2001-01-01 00:00:00"),
        edge(2, "2001-02-05 00:00:00"),
        edge(3, "2001-02-06 00:00:00", cat="CC"),
        edge(4, "2001-04-01 00:00:00"),
    ]
    topics = spark.createDataFrame(
        [(2, 0.5, 0.5), (3, 0.0001, 0.0)], "file_id bigint, topic_0 double, topic_1 double"
    )
    edges = edge_frame(spark, rows)
    (mean,) = edge_attrs.snapshot_attributes(edges, topics, 2).collect()
    assert mean["attrs"] == [0.2501, 0.25, 2.0, 1.0, 1.0, 0.0]
    (last,) = edge_attrs.snapshot_attributes(edges, topics, 2, reduce="last").collect()
    assert last["attrs"] == [0.0001, 0.0, 2.0, 0.0, 1.0, 0.0]
    pairs = spark.createDataFrame([(7, "a", "b"), (8, "x", "y")], "snapshot bigint, sender string, recipient string")
    (sampled,) = edge_attrs.sampled_attributes(pairs, edges, topics, 2, percent=75).collect()
    assert sampled["snapshot"] == 7 and sampled["attrs"][2] == 4.0 and sum(sampled["attrs"][3:]) == 3.0
    single = edges.filter("file_id = 1")
    assert edge_attrs.sampled_attributes(pairs, single, topics, 2).isEmpty()
    path = str(tmp_path / "snapshots")
    tables.write_snapshots(graph.monthly_edges(edges), path)
    assert spark.read.parquet(path).filter("snapshot = 0").count() == 1


def test_graph_statistics(spark):
    rows = [("a", "b"), ("b", "a"), ("a", "a"), ("b", "c")]
    edges = spark.createDataFrame(rows, "sender string, recipient string")
    assert graph.graph_stats(edges).first().asDict() == {"nodes": 3, "edges": 3, "self_loops": 1, "density": 1.0}
    assert {r["account"]: r["degree"] for r in graph.degrees(edges).collect()} == {"a": 3, "b": 2, "c": 1}
    near = sorted((r["account"], r["neighbour"]) for r in graph.neighbours(edges).collect())
    assert near == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
    ids = graph.with_node_ids(edges, graph.accounts(edges.filter("sender <> 'b'")))
    assert ids.filter("recipient_id is null").count() == 1


def test_stop_words_from_a_file(spark, tmp_path):
    from mailgraph.sources.mail_files import stop_word_list

    (tmp_path / "stops.txt").write_text("ship\n the \n\nship\n")
    assert stop_word_list(spark, str(tmp_path / "stops.txt")) == ["ship", "the"]


def test_lemmas_keep_order_repeats_and_empty_documents(spark):
    from mailgraph.operators.messages import lemmatise

    rows = [(1, ["ships", "sail", "ships"]), (2, []), (3, None), (4, ["sail"])]
    docs = spark.createDataFrame(rows, "file_id bigint, tokens array<string>")
    lemmas = spark.createDataFrame([("ships", "ship")], "form string, lemma string")
    found = {r["file_id"]: r["tokens"] for r in lemmatise(docs, lemmas).collect()}
    assert found == {1: ["ship", "sail", "ship"], 2: [], 3: [], 4: ["sail"]}


def test_second_load_leaves_the_history_in_place(spark, archive, tmp_path, capsys):
    """The links of earlier loads are met by an increment without being shuffled."""
    folder = str(tmp_path / "tables")
    mail_etl.load_batch(mail_files.scan_mail_files(spark, str(archive)), folder)
    known = mail_etl.known_links(spark, folder)
    files = mail_files.scan_mail_files(spark, str(archive))
    assert known.count() == files.count() and mail_etl.new_files(files, known).isEmpty()
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    before = [spark.conf.get(name) for name in names]
    spark.conf.set(names[0], "-1")
    spark.conf.set(names[1], "false")
    try:
        mail_etl.new_files(files, known).explain("formatted")
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    tree = capsys.readouterr().out.split("\n\n")[0].splitlines()
    scan = next(n for n, line in enumerate(tree) if "Scan parquet" in line and "links" in line)
    depth = tree[scan].index("Scan parquet")
    above = [line for line in tree[:scan] if line.strip(" :+-*").startswith("Exchange")]
    # The only exchange is on the side of the batch: it stands beside the table's branch, not above.
    assert len(above) == 1 and tree.index(above[0]) < scan and ":" in above[0][:depth]


def test_links_of_a_failed_load_are_not_known(spark, archive, tmp_path, monkeypatch):
    folder = str(tmp_path / "tables")
    def fail(*args):
        raise OSError("no space")
    monkeypatch.setattr(mail_etl, "append_table", fail)
    with pytest.raises(OSError):
        mail_etl.load_batch(mail_files.scan_mail_files(spark, str(archive)), folder)
    monkeypatch.undo()
    assert mail_etl.known_links(spark, folder) is None
    mail_etl.load_batch(mail_files.scan_mail_files(spark, str(archive)).limit(1), folder)
    assert mail_etl.known_links(spark, folder).count() == 1
    mail_etl.load_batch(mail_files.scan_mail_files(spark, str(archive)), folder)
    links = [r["file_link"] for r in mail_etl.known_links(spark, folder).collect()]
    assert len(links) == len(set(links)) == mail_files.scan_mail_files(spark, str(archive)).count()


def test_growing_tables_equal_a_recount(spark, tmp_path):
    """Three loads, the last one with mails of earlier months and an earlier first mail."""
    from mailgraph.operators import terms
    from mailgraph.plans import growing

    rng = random.Random(3)
    rows = [(n, f"p{rng.randint(0, 9)}", f"q{rng.randint(0, 9)}", float(rng.randint(0, 40_000_000))) for n in range(500)]
    day = 86400.0
    # Mails around month ends, at the second at which windows turn and beside it.
    rows += [(500 + n, "p1", "q1", 30 * day + 7 + n - 2) for n in range(5)] + [(600, "", "q1", 1e6), (601, "p1", "q2", 7.0)]
    edges = spark.createDataFrame(rows, "file_id bigint, sender string, recipient string, msg_time double")
    tf = spark.createDataFrame([(n % 90, f"w{rng.randint(0, 40)}") for n in range(900)], "file_id bigint, word string").distinct()
    parts = [edges.filter("file_id < 200"), edges.filter("file_id >= 200 and file_id < 601"), edges.filter("file_id = 601")]
    seen = {}
    for n, part in enumerate(parts):
        growing.add_edges(part, f"{tmp_path}/graph")
        growing.add_terms(tf.filter(f"file_id % 3 = {n}"), f"{tmp_path}/terms")
        for row in growing.accounts_after_loads(spark, f"{tmp_path}/graph").collect():
            assert seen.setdefault(row["account"], row["node_id"]) == row["node_id"]
    assert sorted(seen.values()) == list(range(len(seen)))
    pairs = {(r["sender"], r["recipient"]): r["frequency"] for r in growing.connections_after_loads(spark, f"{tmp_path}/graph").collect()}
    assert pairs == {(r["sender"], r["recipient"]): r["frequency"] for r in graph.pair_frequency(edges).collect()}
    months = growing.monthly_edges_after_loads(spark, f"{tmp_path}/graph")
    assert sorted(months.collect()) == sorted(graph.monthly_edges(edges).collect())
    idf = growing.idf_after_loads(spark, f"{tmp_path}/terms")
    assert sorted(idf.collect()) == sorted(terms.idf(tf).collect())
    frozen = growing.idf_after_loads(spark, f"{tmp_path}/terms", frozen=True)
    first = terms.idf(tf.filter("file_id % 3 = 0"))
    assert frozen.count() == idf.count() and first.exceptAll(frozen).isEmpty()


def test_a_load_that_failed_leaves_growing_tables_as_they_were(spark, tmp_path, monkeypatch):
    from mailgraph.plans import growing

    tf = spark.createDataFrame([(1, "a"), (2, "b")], "file_id bigint, word string")
    growing.add_terms(tf.filter("file_id = 1"), str(tmp_path))
    def fail(*args):
        raise OSError("no space")
    monkeypatch.setattr(growing, "append_table", fail)
    with pytest.raises(OSError):
        growing.add_terms(tf.filter("file_id = 2"), str(tmp_path))
    assert [r["word"] for r in growing.idf_after_loads(spark, str(tmp_path)).collect()] == ["a"]
    monkeypatch.undo()
    growing.add_terms(tf.filter("file_id = 2"), str(tmp_path))
    assert sorted(r["df"] for r in growing.idf_after_loads(spark, str(tmp_path)).collect()) == [1, 1]


def test_growing_tables_follow_the_loads(spark, archive, tmp_path):
    from mailgraph.operators import terms
    from mailgraph.plans import growing

    folder = str(tmp_path / "tables")
    files = mail_files.scan_mail_files(spark, str(archive)).cache()
    for part in (files.limit(2), files):
        mail_etl.load_batch(part, folder)
        mail_etl.grow(spark, folder)
    mail_etl.grow(spark, folder)
    whole = terms.idf(mail_etl.stored_table(spark, folder, "body_tf"))
    assert sorted(growing.idf_after_loads(spark, f"{folder}/body_growth").collect()) == sorted(whole.collect())
    names = {r["account"] for r in growing.accounts_after_loads(spark, f"{folder}/graph_growth").collect()}
    assert names == {r["account"] for r in graph.account_names(mail_etl.stored_table(spark, folder, "edges")).collect()}
