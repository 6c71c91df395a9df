"""From parsed headers to messages, their status, and the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgraph.functions import body as B
from mailgraph.functions import headers as H
from mailgraph.functions import tokens as T

RECIPIENT_LISTS = {"TO": "to", "CC": "cc", "BCC": "bcc"}


def to_messages(parsed: DataFrame, fix_fwd: bool = False) -> DataFrame:
    """Messages with ``reject_reason`` from the output of ``split_mail``.

    A mail the tables cannot hold is kept with its reason instead of vanishing.
    """
    subject = F.col("subject_header")
    named_to = H.clean_header(H.strip_addresses(F.col("x_to")))
    named_cc = H.clean_header(H.strip_addresses(F.col("x_cc")))
    multipart = F.col("content_type").rlike(r"(?i)^\s*multipart/")
    messages = parsed.withColumns(
        {
            "subject": F.when(subject == "", "").otherwise(H.clean_header(subject)),
            "to": H.split_recipients(F.col("to_header")),
            "cc": H.split_recipients(F.col("cc_header")),
            "bcc": H.split_recipients(F.col("bcc_header")),
            "from_mail": F.nullif(F.col("from_header"), F.lit("")),
            "from_name": H.clean_header(H.strip_addresses(F.col("x_from"))),
            "to_name": H.first_filled(named_to, named_cc),
            "msg_time": H.mail_epoch(F.col("date_header")),
            "body": F.col("raw_body"),
        }
    )
    named = H.first_filled(named_to).isNotNull()
    reason = (
        F.when(subject.isNull(), "no subject")
        .when(F.col("x_to").isNull(), "no x-to")
        .when(~named & F.col("x_cc").isNull(), "no recipient name")
        .when(F.col("x_from").isNull(), "no x-from")
        .when(F.col("msg_time").isNull(), "bad date")
        .when(multipart, "multipart")
        .when(F.col("raw_body") == "", "empty body")
    )
    return (
        messages.withColumn("reject_reason", reason)
        .withColumn("mail_cat", H.mail_category(F.col("subject"), fix_fwd))
        .withColumn("recipients", F.concat("cc", "bcc", "to"))
        .drop("from_header", "to_header", "cc_header", "bcc_header", "subject_header",
              "date_header", "x_from", "x_to", "x_cc", "content_type", "raw_body")
    )


def with_tokens(messages: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """Add body and subject tokens, without stop words."""
    stops = stop_words or []
    return messages.withColumns(
        {
            "body_tokens": T.without_stop_words(T.tokens(B.clean_body(F.col("body"))), stops),
            "subject_tokens": T.without_stop_words(T.tokens(B.clean_body(F.col("subject"))), stops),
        }
    )


def lemmatise(docs: DataFrame, lemmas: DataFrame, words: str = "tokens") -> DataFrame:
    """Replace each token by its dictionary lemma; ``lemmas`` has form and lemma, one per form.

    ``docs`` is read twice and should be a stored table with one row per file_id. Only the
    distinct forms of a document that the dictionary holds are grouped; tokens stay in place.
    """
    forms = docs.select("file_id", F.explode(F.array_distinct(words)).alias("form"))
    changes = (
        forms.join(lemmas.select("form", "lemma"), "form")
        .groupBy("file_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("form", "lemma"))).alias("_lemmas"))
    )
    tokens = F.coalesce(F.col(words), F.array().cast("array<string>"))
    mapped = F.transform(tokens, lambda w: F.coalesce(F.element_at("_lemmas", w), w))
    return docs.join(changes, "file_id", "left").withColumn(words, mapped).drop("_lemmas")


def with_status(messages: DataFrame) -> DataFrame:
    """Validity ladder: parsed, has body tokens, has a sender, has a recipient."""
    status = (
        F.when(F.col("reject_reason").isNotNull(), "rejected")
        .when(F.size("body_tokens") == 0, "unprocessed")
        .when(F.col("from_mail").isNull(), "no sender")
        .when(F.size("recipients") == 0, "no recipient")
        .otherwise("valid")
    )
    return messages.withColumn("status", status)


def unprocessed_log(messages: DataFrame) -> DataFrame:
    link = H.escape_path(F.col("path")).alias("file_link")
    return messages.filter("status = 'unprocessed'").select("file_id", link)


def recipients_table(kept: DataFrame) -> DataFrame:
    """One row per mail, recipient and category; empty addresses are kept."""
    parts = [
        kept.select("file_id", F.explode(column).alias("recipient"), F.lit(cat).alias("rec_cat"))
        for cat, column in RECIPIENT_LISTS.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def edges_table(kept: DataFrame) -> DataFrame:
    """One row per mail and recipient with sender, time and both categories."""
    lists = F.array(
        *[
            F.struct(F.lit(cat).alias("rec_cat"), F.col(column).alias("members"))
            for cat, column in RECIPIENT_LISTS.items()
        ]
    )
    return (
        kept.select("file_id", "from_mail", "msg_time", "mail_cat", F.explode(lists).alias("l"))
        .select(
            "file_id",
            F.col("from_mail").alias("sender"),
            F.explode("l.members").alias("recipient"),
            "msg_time",
            "mail_cat",
            F.col("l.rec_cat").alias("rec_cat"),
        )
    )


def mail_list_table(mails: DataFrame) -> DataFrame:
    return mails.select(
        "file_id",
        H.message_id(F.col("from_mail"), F.col("msg_time")).alias("msgid"),
        H.escape_path(F.col("path")).alias("file_link"),
    )


def emails_table(kept: DataFrame) -> DataFrame:
    return kept.select(
        "file_id", "from_mail", F.col("msg_time").alias("date"), "mail_cat", "subject"
    )
