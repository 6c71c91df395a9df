"""Sender exports: who a user wrote to, with subjects or the latest mail.

Grouping is by user folder and cleaned recipient header. An export is flat at every size: one
record for each sender, recipient and, for the subjects, dated subject with its position. So a
sender or a recipient with a large share of all mails is many records and no long array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgraph.functions import body as B
from mailgraph.functions import headers as H
from mailgraph.operators.joins import null_safe_join
from mailgraph.operators.numbering import position_in_group
from mailgraph.session import settle

RECIPIENT = ["user_folder", "to_key"]
SHAPES = ("subjects", "subjects_labelled", "subjects_jsonl", "latest_full", "latest_counted")

# Files are read in numeric name order; other names come last, in text order.
FILE_ORDER = ["file_number", "file_name"]


def export_mails(parsed: DataFrame) -> DataFrame:
    """Cleaned columns of the exports from ``split_mail`` output with folder columns.

    Mails without subject, date, sender name or recipient name header get a ``reject_reason``.
    """
    clean = H.clean_export_header
    to_name = clean(H.strip_addresses(F.col("x_to")))
    cc_name = clean(H.strip_addresses(F.col("x_cc")))
    reason = (
        F.when(F.col("x_from").isNull(), "no x-from")
        .when(F.col("subject_header").isNull(), "no subject")
        .when(F.col("date_header").isNull(), "no date")
        .when(F.col("x_to").isNull(), "no x-to")
        .when(H.first_filled(to_name).isNull() & F.col("x_cc").isNull(), "no recipient name")
    )
    number = F.regexp_extract("file_name", r"^(\d{1,18})\.?$", 1).try_cast("bigint")
    return parsed.select(
        "user_folder",
        "file_name",
        F.coalesce(number, F.lit(2**62)).alias("file_number"),
        F.col("from_header").alias("from_email"),
        clean(H.strip_addresses(F.col("x_from"))).alias("from_name"),
        F.coalesce(H.first_filled(clean(F.col("to_header"))), F.col("cc_header")).alias("to_key"),
        H.first_filled(F.col("to_header"), F.col("cc_header")).alias("to_email"),
        H.first_filled(to_name, cc_name).alias("to_name"),
        F.coalesce(clean(F.col("subject_header")), F.lit("")).alias("subject"),
        F.coalesce(clean(F.col("date_header")), F.lit("")).alias("date"),
        F.col("raw_body").alias("body"),
        reason.alias("reject_reason"),
    )


def _usable(mails: DataFrame) -> DataFrame:
    return mails.filter("reject_reason is null and to_key is not null")


def senders(mails: DataFrame) -> DataFrame:
    """One row per user: address, name and label of the last file."""
    last = F.max_by(F.struct("from_email", "from_name"), F.struct(*FILE_ORDER)).alias("last")
    return (
        mails.filter("reject_reason is null")
        .groupBy("user_folder")
        .agg(last)
        .select("user_folder", "last.*", H.sender_initials(F.col("last.from_name")).alias("from_label"))
    )


def latest_mails(mails: DataFrame, drop_underscore: bool = False) -> DataFrame:
    """The last mail per user and recipient, with label, cleaned body and counts."""
    fields = ["to_email", "to_name", "subject", "date", "body", "file_name"]
    last = F.max_by(F.struct(*fields), F.struct(*FILE_ORDER)).alias("last")
    latest = _usable(mails).groupBy(*RECIPIENT).agg(last).select(*RECIPIENT, "last.*")
    return latest.withColumns(
        {
            "to_label": H.recipient_initials(F.col("to_name"), F.col("to_email")),
            "body": B.export_body(F.col("body"), drop_underscore),
        }
    ).withColumns(
        {"sub_count": B.word_count(F.col("subject")), "body_count": B.word_count(F.col("body"))}
    )


def subject_lines(mails: DataFrame) -> DataFrame:
    """All dated subjects per user and recipient, numbered in file order."""
    lines = _usable(mails).select(
        *RECIPIENT, *FILE_ORDER, H.dated_subject(F.col("subject"), F.col("date")).alias("line")
    )
    return position_in_group(lines, RECIPIENT, FILE_ORDER, "position")


def recipient_subjects(mails: DataFrame) -> DataFrame:
    """Dated subjects per user and recipient with their position, from 1, in file order.

    Address, name and label are those of the recipient's last mail.
    """
    last = F.max_by(F.struct("to_email", "to_name"), F.struct(*FILE_ORDER)).alias("last")
    named = _usable(mails).groupBy(*RECIPIENT).agg(last).select(*RECIPIENT, "last.*")
    return null_safe_join(subject_lines(mails), settle(named), RECIPIENT).select(
        *RECIPIENT,
        "to_email",
        "to_name",
        H.recipient_initials(F.col("to_name"), F.col("to_email")).alias("to_label"),
        F.col("position").cast("bigint").alias("position"),
        F.col("line").alias("subject"),
    )


def sender_export(mails: DataFrame, shape: str) -> DataFrame:
    """Records of one of the five shapes, each with the user folder and the sender as ``from``.

    ``subjects``, ``subjects_labelled``: recipient ``to``, position and dated subject.
    ``subjects_jsonl``: a head record for each sender, without recipient, then the same with
    ``from`` left out; addresses and names are pairs.
    ``latest_full``, ``latest_counted``: one record for each recipient with the latest mail.
    """
    if shape not in SHAPES:
        raise ValueError(f"unknown export shape: {shape}")
    heads = senders(mails)
    if shape == "subjects_jsonl":
        pair = F.lit(None).cast("array<string>")
        head = heads.select(
            "user_folder",
            F.array("from_email", "from_name").alias("from"),
            pair.alias("to"),
            F.lit(None).cast("bigint").alias("position"),
            F.lit(None).cast("string").alias("subject"),
        )
        rows = recipient_subjects(mails).select(
            "user_folder", pair.alias("from"), F.array("to_email", "to_name").alias("to"), "position", "subject"
        )
        return head.unionByName(rows)
    person = [F.col("to_email").alias("email"), F.col("to_name").alias("name")]
    label = F.col("to_label").alias("label")
    if shape == "subjects":
        rows = recipient_subjects(mails)
        fields = [F.struct(*person).alias("to"), "position", "subject"]
    elif shape == "subjects_labelled":
        rows = recipient_subjects(mails)
        fields = [F.struct(*person, label).alias("to"), "position", "subject"]
    elif shape == "latest_full":
        rows = latest_mails(mails)
        fields = [F.struct(*person, label, "subject", "date", "body").alias("to")]
    else:
        rows = latest_mails(mails, True)
        subject = F.struct(
            F.col("subject").alias("sub"), "date", F.col("sub_count").cast("string").alias("sub_count")
        )
        main = F.struct(
            F.col("body").alias("main_body"),
            F.col("body_count").cast("string").alias("body_count"),
            F.col("file_name").alias("filename"),
        )
        fields = [F.struct(*person, label, subject.alias("subject"), main.alias("body")).alias("to")]
    sender = [F.col("from_email").alias("email"), F.col("from_name").alias("name")]
    if shape != "subjects":
        sender.append(F.col("from_label").alias("label"))
    return null_safe_join(rows, settle(heads), ["user_folder"]).select(
        "user_folder", F.struct(*sender).alias("from"), *fields
    )
