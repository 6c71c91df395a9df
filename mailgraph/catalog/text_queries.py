"""Header and body expressions, tokens and message parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailgraph.catalog import views as V
from mailgraph.functions import body as B
from mailgraph.functions import headers as H
from mailgraph.functions import tokens as T
from mailgraph.operators import messages as M
from mailgraph.session import settle
from mailgraph.sources import mail_files as S

STOP_WORDS = ["the", "and", "die", "der", "les", "le", "la", "que"]
LEMMAS = [("ores", "ore"), ("ist", "sein"), ("sont", "être"), ("eres", "ere"), ("the", "a")]


def clean_ctes(source: str, name: str = "cleaned") -> str:
    """CTEs cleaning the ``text`` column of ``source`` (file_id, text) like a mail body."""

    def cut(x: str, markers: list[str]) -> str:
        for marker in markers:
            x = f"regexp_replace({x}, '{marker}.*', '', 's')"
        return x

    first = ["-*Original", "Sincerely", "Regards,", "Cordially,", "Thanks,", "Kind regard,",
             "This e-mail is the property of Enron"]
    last = ["Start Date:", "LOG MESSAGES:", "Delivery Date:", "PARSING FILE", "-*Energy", "COB NS",
            "EOL D", "=", "-"]
    fold = "list_reduce(regexp_extract_all(x, '{p}', {g}), lambda acc, m: replace(acc, m, ''), x)"
    return rf"""{name}_1 AS (SELECT file_id, {cut("translate(text, '*_', '')", first)} AS x FROM {source}),
{name}_2 AS (SELECT file_id, {fold.format(p=r"(/[^\p{L}\p{Nl}\p{No}_])+", g=1)} AS x FROM {name}_1),
{name}_3 AS (SELECT file_id, {fold.format(p=r"<!--?[^\n]*-->", g=0)} AS x FROM {name}_2),
{name}_4 AS (SELECT file_id, {cut("x", ["<[^>]*>", "-*Returned", "-*Forwarded"])} AS x FROM {name}_3),
{name}_5 AS (SELECT file_id, {fold.format(p=r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", g=0)} AS x FROM {name}_4),
{name} AS (SELECT file_id, {cut("x", last)} AS x FROM {name}_5)"""


def token_ctes(source: str, name: str = "tok") -> str:
    """CTEs turning ``x`` of ``source`` into the list ``words``."""
    splits = "x"
    for head, tail in [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")]:
        splits = f"replace({splits}, ' {head}{tail} ', ' {head}  {tail} ')"
    return rf"""{name}_1 AS (SELECT file_id, concat('  ', regexp_replace(lower(x),
    '[\s\p{{Z}},:;@#$%&?!()\[\]{{}}<>"«»“”‘’„]+', '  ', 'g'), '  ') AS x FROM {source}),
{name}_2 AS (SELECT file_id, regexp_replace(x, '[''`.]+ ', ' ', 'g') AS x FROM {name}_1),
{name}_3 AS (SELECT file_id, regexp_replace(x, '(?:n''t|''s|''re|''ve|''ll|''d|''m) ', ' ', 'g') AS x FROM {name}_2),
{name}_4 AS (SELECT file_id, regexp_replace(x, ' [''`.]+', ' ', 'g') AS x FROM {name}_3),
{name} AS (SELECT file_id, list_filter(string_split({splits}, ' '),
    lambda w: regexp_full_match(w, '\p{{L}}+')) AS words FROM {name}_4)"""


DOCS = "docs AS (SELECT doc_id AS file_id, text FROM documents)"
DOC_TOKENS = f"{DOCS},\n{clean_ctes('docs')},\n{token_ctes('cleaned')}"
SUBJECTS = """subjects AS (SELECT file_id,
  CASE WHEN s = '' THEN '' ELSE translate(s, concat(chr(10), chr(9), '"\\()'), '') END AS text
  FROM (SELECT file_id, ltrim(subject, concat(' ', chr(9))) AS s FROM mails))"""
SUBJECT_TOKENS = (
    f"{V.MAILS},\n{SUBJECTS},\n{clean_ctes('subjects', 'scleaned')},\n{token_ctes('scleaned', 'stok')}"
)


def documents(spark, sf_dir):
    docs = V.spread(V.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.withColumnRenamed("doc_id", "file_id")


def document_tokens(spark, sf_dir):
    words = T.tokens(B.clean_body(F.col("text")))
    return documents(spark, sf_dir).select("file_id", words.alias("tokens"))


def mail_category(spark, sf_dir):
    category = H.mail_category(F.col("subject")).alias("mail_cat")
    fixed = H.mail_category(F.col("subject"), fix_fwd=True).alias("mail_cat_fwd")
    return V.mails(spark, sf_dir).select("file_id", category, fixed)


def message_ids(spark, sf_dir):
    ids = H.recipient_message_ids(F.col("sender"), F.col("msg_time"), F.array("recipient"))[0]
    mail = H.message_id(F.col("sender"), F.col("msg_time"))
    return V.edges(spark, sf_dir).select("file_id", mail.alias("msgid"), ids.alias("recipient_msgid"))


def path_escape(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        H.escape_path(F.col("url")).alias("file_link"),
        H.path_part(F.col("url"), 1).alias("base_name"),
    )


def split_headers(spark, sf_dir):
    lists = V.mails(spark, sf_dir).select(
        "file_id",
        F.posexplode(
            F.concat(H.split_recipients(F.col("cc_hdr")), H.split_recipients(F.col("to_hdr")))
        ).alias("pos", "recipient"),
    )
    return lists


def header_extract(spark, sf_dir):
    messages = M.to_messages(S.split_mail(V.raw_mails(spark, sf_dir)))
    return messages.select(
        "file_id",
        "from_mail",
        "from_name",
        "to_name",
        "subject",
        "mail_cat",
        F.col("msg_time").cast("bigint").alias("msg_time"),
        F.array_join("recipients", "|").alias("recipients"),
        "body",
        "reject_reason",
    )


HEADER_EXTRACT = f"""WITH {V.MAILS},
s AS (SELECT *, ltrim(subject, concat(' ', chr(9))) AS subj FROM mails)
SELECT file_id, from_mail, concat('User ', file_id % 50, ' ONeil ') AS from_name,
  concat('Person ''', d.lang, ' ', d.source, ' ') AS to_name,
  CASE WHEN subj = '' THEN '' ELSE translate(subj, concat(chr(10), chr(9), '"\\()'), '') END AS subject,
  CASE WHEN substr(translate(subj, concat(chr(10), chr(9), '"\\()'), ''), 1, 3) IN ('RE:', 'Re:', 're:') THEN 'RE'
       WHEN substr(translate(subj, concat(chr(10), chr(9), '"\\()'), ''), 1, 3) IN ('FW:', 'Fw:', 'fw:') THEN 'FWD'
       ELSE 'INIT' END AS mail_cat,
  sent AS msg_time,
  concat(CASE WHEN cc_hdr IS NULL THEN '' ELSE concat(cc_hdr, '|') END,
         replace(replace(replace(replace(to_hdr, ',', '|'), ' ', ''), '<', ''), '>', '')) AS recipients,
  body,
  CASE WHEN body = '' THEN 'empty body' END AS reject_reason
FROM s JOIN documents d ON d.doc_id = file_id"""


def name_clean(spark, sf_dir):
    rows = V.mails(spark, sf_dir)
    to_name = H.clean_export_header(H.strip_addresses(F.col("x_to")))
    return rows.select(
        "file_id",
        H.clean_header(H.strip_addresses(F.col("x_from"))).alias("from_name"),
        H.clean_header(H.strip_addresses(F.col("x_to"))).alias("to_name"),
        to_name.alias("export_name"),
        H.clean_header(H.strip_addresses(F.col("body"))).alias("body_name"),
    )


_STRIP = """list_reduce(regexp_extract_all({x}, '{p}', 0), lambda acc, m: replace(acc, m, ''), {x})"""
NAME_CLEAN = (
    f"WITH {V.MAILS},\nsrc AS (SELECT file_id, unnest([1, 2, 3]) AS kind, unnest([x_from, x_to, body]) AS x FROM mails),\n"
    + "\n".join(
        f"n{i + 1} AS (SELECT file_id, kind, {_STRIP.format(x='x', p=p)} AS x FROM {'src' if i == 0 else f'n{i}'}),"
        for i, p in enumerate(
            [
                r"<?[^\s\p{Z}\x0B\x1C-\x1F\x{85}]+@[^\s\p{Z}\x0B\x1C-\x1F\x{85}]+>?",
                r"@[\s\p{Z}][\p{L}\p{N}_]+",
                r"</?[^\s\p{Z}\x0B\x1C-\x1F\x{85}]+>",
            ]
        )
    )
    + r"""
c AS (SELECT file_id, kind, CASE WHEN x <> '' THEN translate(x, concat(chr(10), chr(9), '"\()'), '') END AS y,
  CASE WHEN x <> '' THEN replace(replace(replace(replace(translate(x, concat(chr(10), chr(9), '"\,'), ''),
       ' (PST)', ''), ' (PDT)', ''), ' -0800', ''), ' -0700', '') END AS z FROM n3)
SELECT file_id, max(CASE WHEN kind = 1 THEN y END) AS from_name, max(CASE WHEN kind = 2 THEN y END) AS to_name,
  max(CASE WHEN kind = 2 THEN z END) AS export_name, max(CASE WHEN kind = 3 THEN y END) AS body_name
FROM c GROUP BY file_id"""
)


def name_initials(spark, sf_dir):
    rows = V.mails(spark, sf_dir)
    name = F.translate("x_to", "()", "")
    return rows.select(
        "file_id",
        H.sender_initials(F.col("x_from")).alias("from_label"),
        H.recipient_initials(name, F.col("from_mail")).alias("to_label"),
        H.recipient_initials(F.col("cc_hdr"), F.col("from_mail")).alias("cc_label"),
        H.dated_subject(F.col("subject"), F.col("from_mail")).alias("dated"),
    )


NAME_INITIALS = f"""WITH {V.MAILS}
SELECT file_id,
  array_to_string(list_transform(string_split(x_from, ' '), lambda w: substr(w, 1, 1)), '') AS from_label,
  array_to_string(list_transform(string_split(translate(x_to, '()', ''), ' '), lambda w:
    CASE WHEN substr(w, 1, 1) IN ('''', '-', '_', '\\', '/', '<', '>', '@') THEN substr(w, 2, 1)
         ELSE substr(w, 1, 1) END), '') AS to_label,
  CASE WHEN cc_hdr <> '' THEN substr(cc_hdr, 1, 1) ELSE substr(from_mail, 1, 2) END AS cc_label,
  concat(subject, ' (', from_mail, ')') AS dated
FROM mails"""


def body_clean(spark, sf_dir):
    return documents(spark, sf_dir).select("file_id", B.clean_body(F.col("text")).alias("body"))


def body_clean_export(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "file_id",
        B.export_body(F.col("text")).alias("body"),
        B.export_body(F.col("text"), drop_underscore=True).alias("counted_body"),
    )


BODY_CLEAN_EXPORT = rf"""WITH {DOCS},
l AS (SELECT file_id, text, translate(lower(text), concat(chr(9), '*'), '') AS a,
        translate(lower(text), concat(chr(9), '*_'), '') AS b FROM docs)
SELECT file_id,
  CASE WHEN text <> '' THEN regexp_replace(regexp_replace(a, '<!--?[^\n]*?-->', ' ', 'g'),
    '[^\p{{L}}\p{{Nl}}\p{{No}}_]+', ' ', 'g') ELSE 'Null' END AS body,
  CASE WHEN text <> '' THEN regexp_replace(regexp_replace(b, '<!--?[^\n]*?-->', ' ', 'g'),
    '[^\p{{L}}\p{{Nl}}\p{{No}}_]+', ' ', 'g') ELSE 'Null' END AS counted_body
FROM l"""


def word_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("file_id", B.word_count(F.col("text")).alias("words"))


def tokens(spark, sf_dir):
    docs = document_tokens(spark, sf_dir)
    kept = T.without_stop_words(F.col("tokens"), STOP_WORDS)
    return docs.select("file_id", F.array_join(kept, " ").alias("words"))


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def unprocessed(spark, sf_dir):
    """Mails whose body cleans to no token, with the link they are logged under."""
    parsed = M.to_messages(S.split_mail(V.odd_mails(spark, sf_dir)))
    return M.unprocessed_log(M.with_status(M.with_tokens(parsed)))


def lemmas(spark, sf_dir):
    """Document tokens with dictionary lemmas put in."""
    dictionary = spark.createDataFrame(LEMMAS, "form string, lemma string")
    mapped = M.lemmatise(settle(document_tokens(spark, sf_dir)), dictionary)
    return mapped.select("file_id", F.array_join("tokens", " ").alias("words"))


_LEMMA_CASE = " ".join(f"WHEN '{form}' THEN '{lemma}'" for form, lemma in LEMMAS)


def status_ladder(spark, sf_dir):
    parsed = M.to_messages(S.split_mail(V.odd_mails(spark, sf_dir)))
    ladder = M.with_status(M.with_tokens(parsed))
    return ladder.groupBy("status", "reject_reason").agg(F.count("*").alias("mails"))


QUERIES = {
    "mail_category": (
        mail_category,
        f"""WITH {V.MAILS} SELECT file_id,
  CASE WHEN substr(subject, 1, 3) IN ('RE:', 'Re:', 're:') THEN 'RE'
       WHEN substr(subject, 1, 3) IN ('FW:', 'Fw:', 'fw:') THEN 'FWD' ELSE 'INIT' END AS mail_cat,
  CASE WHEN substr(subject, 1, 3) IN ('RE:', 'Re:', 're:') THEN 'RE'
       WHEN substr(subject, 1, 3) IN ('FW:', 'Fw:', 'fw:') OR substr(subject, 1, 4) IN ('Fwd:', 'fwd:')
       THEN 'FWD' ELSE 'INIT' END AS mail_cat_fwd
FROM mails""",
    ),
    "message_ids": (
        message_ids,
        f"""WITH {V.EDGES} SELECT file_id,
  concat(sender, ':', CAST(CAST(msg_time AS BIGINT) AS VARCHAR), '.0') AS msgid,
  concat(sender, ':', recipient, ':', CAST(CAST(msg_time AS BIGINT) AS VARCHAR), '.0') AS recipient_msgid
FROM edges""",
    ),
    "path_escape": (
        path_escape,
        r"""SELECT page_id, replace(replace(url, '/', '//'), '\', '//') AS file_link,
  string_split(url, '/')[-1] AS base_name FROM pages""",
    ),
    "recipient_split": (
        split_headers,
        f"""WITH {V.MAILS},
l AS (SELECT file_id, list_concat(CASE WHEN cc_hdr <> '' THEN string_split(cc_hdr, ',') ELSE [] END,
                                  string_split(to_hdr, ',')) AS r FROM mails)
SELECT file_id, CAST(i - 1 AS INTEGER) AS pos, translate(r[i], ' <>', '') AS recipient
FROM (SELECT file_id, r, unnest(range(1, len(r) + 1)) AS i FROM l)""",
    ),
    "header_extract": (header_extract, HEADER_EXTRACT),
    "name_clean": (name_clean, NAME_CLEAN),
    "name_initials": (name_initials, NAME_INITIALS),
    "body_clean": (body_clean, f"WITH {DOCS},\n{clean_ctes('docs')}\nSELECT file_id, x AS body FROM cleaned"),
    "body_clean_export": (body_clean_export, BODY_CLEAN_EXPORT),
    "word_counts": (
        word_counts,
        r"""SELECT doc_id AS file_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS BIGINT) AS words
FROM documents""",
    ),
    "tokens": (
        tokens,
        f"""WITH {DOC_TOKENS}
SELECT file_id, array_to_string(list_filter(words, lambda w: w NOT IN ({_STOPS})), ' ') AS words FROM tok""",
    ),
    "lemmas": (
        lemmas,
        f"""WITH {DOC_TOKENS}
SELECT file_id, array_to_string(list_transform(words, lambda w: CASE w {_LEMMA_CASE} ELSE w END), ' ') AS words
FROM tok""",
    ),
    "unprocessed": (
        unprocessed,
        f"""WITH {V.ODD_MAILS}, {clean_ctes('odd')}, {token_ctes('cleaned')}
SELECT file_id, concat('odd//', file_id) AS file_link
FROM tok JOIN odd USING (file_id) WHERE len(words) = 0 AND {V.ODD_REASON} IS NULL""",
    ),
    "status_ladder": (
        status_ladder,
        f"""WITH {V.ODD_MAILS}, {clean_ctes('odd')}, {token_ctes('cleaned')},
r AS (SELECT file_id, words, {V.ODD_REASON} AS reject_reason FROM tok JOIN odd USING (file_id))
SELECT CASE WHEN reject_reason IS NOT NULL THEN 'rejected' WHEN len(words) = 0 THEN 'unprocessed'
    WHEN file_id % 11 = 1 THEN 'no sender' WHEN file_id % 11 = 2 THEN 'no recipient' ELSE 'valid' END AS status,
  reject_reason, count(*) AS mails
FROM r GROUP BY 1, 2""",
    ),
}
