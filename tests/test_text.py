"""Hand-made header and body cases."""

import time

import pytest
from pyspark.sql import functions as F

from mailgraph.functions import body as B
from mailgraph.functions import headers as H
from mailgraph.functions import tokens as T
from mailgraph.operators import messages as M
from mailgraph.operators import terms
from mailgraph.sources import mail_files as S


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("keep -----Original Message and more", "keep "),
        ("hi\nSincerely\nme", "hi\n"),
        ("a Best Regards, b", "a Best "),
        ("a Kind regard, b", "a "),
        ("x This e-mail is the property of Enron and", "x "),
        ("a/1/2/,b/3", "a/1/2b"),
        ("a <!-- c --> b", "a  b"),
        ("a <!-- c \n --> b", "a "),
        ("a <b>c", "a "),
        ("a < b", "a < b"),
        ("--Returned x", ""),
        ("mail me@x.org now", "mail  now"),
        ("a@b.com%x@y.org!", "!"),
        ("a@b.com_x@y.org!", "@y.org!"),
        ("see Start Date: 1", "see "),
        ("EOL Delivery Date: x", "EOL "),
        ("COB NStart Date: x", "COB N"),
        ("EOL Day", ""),
        ("PARSING FILEnergy", ""),
        ("a=b", "a"),
        ("well-known", "well"),
        ("*bold* _x_", "bold x"),
        ("", ""),
    ],
)
def test_clean_body(spark, text, expected):
    assert one(spark, lambda X: B.clean_body(X), text) == expected


def test_slash_pairs_delete_the_last_pair_everywhere(spark):
    # The runs end in '/,' and '//' - each is then deleted wherever it stands.
    assert one(spark, lambda X: B.clean_body(X), "a/,b c/1/,d e//f") == "ab c/1d ef"


def test_long_slash_runs_do_not_overflow(spark):
    assert one(spark, lambda X: B.clean_body(X), "a" + "/" * 200_000 + "b") == "ab"


def test_export_body(spark):
    assert one(spark, lambda X: B.export_body(X), "Ab\t*c_d <!-- x --> 12 é\n²") == "abc_d é ²"
    assert one(spark, lambda X: B.export_body(X, drop_underscore=True), "a_b") == "ab"
    assert one(spark, lambda X: B.export_body(X), "") == "Null"
    assert one(spark, lambda X: B.export_body(X), None) == "Null"


def test_word_count(spark):
    assert one(spark, lambda X: B.word_count(X), "né à 12_b") == 3


@pytest.mark.parametrize(
    "text, words",
    [
        ("Don't panic, it's U.S. policy.", ["do", "panic", "it", "policy"]),
        ("I cannot and gonna", ["i", "can", "not", "and", "gon", "na"]),
        ("'quoted' (word) a/b x1 42", ["quoted", "word"]),
        ("no break «ça»", ["no", "break", "ça"]),
        ("'s", []),
        ("123 456", []),
    ],
)
def test_tokens(spark, text, words):
    assert one(spark, lambda X: T.tokens(X), text) == words


def test_stop_words_keep_repeats(spark):
    def kept(x):
        return T.without_stop_words(T.tokens(x), ["the"])

    assert one(spark, kept, "the cat the cat") == ["cat", "cat"]


def test_names(spark):
    assert one(spark, lambda X: H.strip_addresses(X), "O'Neil <a@x.org>") == "O'Neil "
    assert one(spark, lambda X: H.strip_addresses(X), "J @ ACME Doe </O=X>") == "J  Doe "
    assert one(spark, lambda X: H.clean_header(X), '"A\tB\\ (c)\n') == "AB c"
    assert one(spark, lambda X: H.clean_header(X), "") is None
    assert one(spark, lambda X: H.clean_export_header(X), "1 Jan 2001 -0800 (PST), x") == "1 Jan 2001 x"
    assert one(spark, lambda X: H.sender_initials(X), "Ann  Bee") == "AB"
    assert one(spark, lambda X: H.recipient_initials(X, F.lit("zed@x")), "'Ann _bee @") == "Ab"
    assert one(spark, lambda X: H.recipient_initials(X, F.lit("zed@x")), None) == "ze"


@pytest.mark.parametrize(
    "subject, plain, fixed",
    [("RE: x", "RE", "RE"), ("fw:x", "FWD", "FWD"), ("Fwd: x", "INIT", "FWD"), ("", "INIT", "INIT"), ("rE: x", "INIT", "INIT")],
)
def test_category(spark, subject, plain, fixed):
    assert one(spark, lambda X: H.mail_category(X), subject) == plain
    assert one(spark, lambda X: H.mail_category(X, True), subject) == fixed


def test_dates_ids_and_recipients(spark):
    assert one(spark, lambda X: H.mail_epoch(X), "Thu, 27 Dec 2001 14:37:31 -0800 (PST)") == 1009463851.0
    assert one(spark, lambda X: H.mail_epoch(X), "27 Dec 2001 4:37:31") == 1009427851.0
    assert one(spark, lambda X: H.mail_epoch(X), "yesterday") is None
    for text in ["Mon, 14 May 2001 16:39 -0700", "Mon, 14 May 01 16:39:00 -0700", "Mon,  14  May 2001  16:39:00",
                 "Mon May 14 16:39:00 2001", "14 MAY 2001 16:39:00", "Mon, 14-May-2001 16:39:00"]:
        assert one(spark, lambda X: H.mail_epoch(X), text) == 989858340.0
    assert one(spark, lambda X: H.mail_epoch(X), "31 February 2001 00:00:00") == 983577600.0
    assert one(spark, lambda X: H.mail_epoch(X), "1 Jan 69 00:00:00") == -31536000.0
    assert one(spark, lambda X: H.mail_epoch(X), "14 Foo 2001 16:39:00") is None


def test_headers_end_at_the_first_other_line(spark):
    def split(text):
        row = S.split_mail(spark.createDataFrame([(text,)], "text string")).first()
        return row["from_header"], row["x_to"], row["raw_body"]

    assert split("From: a\nX-To: b\n\nbody\n\nmore") == ("a", "b", "body\n\nmore")
    assert split("From: a\nstray line\nX-To: b\n\nbody") == ("a", None, "stray line\nX-To: b\n\nbody")
    assert split("From: a\n folded\nX-To: b") == ("a\n folded", "b", "")
    assert split("\nFrom: a") == (None, None, "From: a")
    assert split("no header\nat all") == (None, None, "no header\nat all")
    assert split("") == (None, None, "")


def test_long_runs_take_linear_time(spark):
    """A megabyte of one kind of character; with quadratic patterns this would take hours."""
    runs = ["-" * 1_000_000, "<" * 1_000_000, "a" * 1_000_000, "<!-" * 300_000, "Ab9+/" * 200_000]
    df = spark.createDataFrame([(r,) for r in runs], "text string")
    start = time.monotonic()
    kept = df.select(F.length(B.clean_body(F.col("text"))).alias("n"), H.strip_addresses(F.col("text")).alias("s")).collect()
    assert time.monotonic() - start < 60
    assert [r["s"] for r in kept] == runs
    assert kept[2]["n"] == 1_000_000 and kept[0]["n"] == 0
    assert one(spark, lambda X: H.message_id(F.lit("a"), F.lit(1009463851.0)), "") == "a:1009463851.0"
    assert one(spark, lambda X: H.split_recipients(X), "a@x, \n\t<b@x>,") == ["a@x", "b@x", ""]
    assert one(spark, lambda X: H.split_recipients(X), None) == []
    assert one(spark, lambda X: H.escape_path(X), "a/b\\c") == "a//b//c"


BASE = {"From": "a@x", "To": "b@x", "Subject": "S", "Date": "Thu, 27 Dec 2001 14:37:31 -0800",
        "X-From": "A", "X-To": "B", "X-cc": ""}


def mail(body="words here", drop=(), **changes):
    headers = {**BASE, **{k.replace("_", "-"): v for k, v in changes.items()}}
    lines = [f"{k}: {v}" for k, v in headers.items() if k not in drop]
    return "\n".join(lines) + "\n\n" + body


CASES = [
    (mail(), None, "valid"),
    (mail(drop=["Subject"]), "no subject", "rejected"),
    (mail(Subject=""), None, "valid"),
    (mail(drop=["X-To"]), "no x-to", "rejected"),
    (mail(X_To="<b@x>", drop=["X-cc"]), "no recipient name", "rejected"),
    (mail(X_To="<b@x>", X_cc="C"), None, "valid"),
    (mail(drop=["X-From"]), "no x-from", "rejected"),
    (mail(Date="soon"), "bad date", "rejected"),
    (mail(Content_Type="multipart/mixed; boundary=x"), "multipart", "rejected"),
    (mail(body=""), "empty body", "rejected"),
    (mail(body="12 34"), None, "unprocessed"),
    (mail(drop=["From"]), None, "no sender"),
    (mail(drop=["To"]), None, "no recipient"),
    (mail(drop=["To"], Bcc="z@x"), None, "valid"),
]


def test_status_ladder(spark):
    rows = [(i, f"r/u/f/{i}", text) for i, (text, _, _) in enumerate(CASES)]
    files = spark.createDataFrame(rows, "file_id bigint, path string, text string")
    found = M.with_status(M.with_tokens(M.to_messages(S.split_mail(files)))).orderBy("file_id").collect()
    assert [(r["reject_reason"], r["status"]) for r in found] == [c[1:] for c in CASES]
    assert found[5]["to_name"] == "C"


def test_header_rules(spark):
    text = "TO: one@x,\n two@x\nto: other@x\nSubject:  a\n  b\nX-cc:\n\nTo: body@x\n\nend"
    row = S.split_mail(spark.createDataFrame([(text,)], "text string")).first()
    assert row["to_header"] == "one@x,\n two@x"
    assert row["subject_header"] == "a\n  b"
    assert row["x_cc"] == "" and row["x_from"] is None
    assert row["raw_body"] == "To: body@x\n\nend"


def test_thousands_of_folded_recipients(spark):
    text = "To: " + ",\n\t".join(f"u{i}@x" for i in range(20_000)) + "\n\nbody"
    split = S.split_mail(spark.createDataFrame([(text,)], "text string"))
    assert split.select(F.size(H.split_recipients(F.col("to_header")))).first()[0] == 20_000


def test_lemmas(spark):
    docs = spark.createDataFrame([(1, ["cats", "ran", "cats"]), (2, [])], "file_id bigint, tokens array<string>")
    forms = spark.createDataFrame([("cats", "cat"), ("ran", "run")], "form string, lemma string")
    rows = {r["file_id"]: r["tokens"] for r in M.lemmatise(docs, forms).collect()}
    assert rows == {1: ["cat", "run", "cat"], 2: []}


def test_term_frequency_counts_equal_ids_together_and_deals_documents_once(spark):
    rows = [(1, ["a", "b", "a"]), (1, ["a", "c", "c"]), (1, ["a"]), (None, ["b"]), (None, ["b"]), (2, None), (3, [])]
    docs = spark.createDataFrame(rows, "file_id long, tokens array<string>")
    found = terms.term_frequency(docs)
    assert {(r["file_id"], r["word"], r["abs_tf"], r["rel_tf"]) for r in found.collect()} == {
        (1, "a", 3, 1.0), (1, "b", 1, 0.3333), (1, "c", 2, 0.6667), (1, "a", 1, 1.0), (None, "b", 2, 2.0)
    }
    plan = terms.term_frequency(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(file_id") == plan.count("Exchange ") == 1


def test_bodies_are_cleaned_and_cut_to_tokens_in_one_python_pass(spark):
    """A chain of patterns took some 130 ns a character and pattern on each text."""
    text = "/1/2a 5x@c.org<!-- x --> b-- a@b.com5y@c.org don't cannot 'tis ÉTÉ\x1cx ok <p>gone"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "--Original"), (4, "COB NStart Date: x")], "id int, text string")
    found = docs.select("id", T.tokens(B.clean_body(F.col("text"))).alias("tokens"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan
    assert {r["id"]: r["tokens"] for r in found.collect()}[2] is None
