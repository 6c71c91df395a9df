"""Header values: cleaning, splitting, categories, names, dates and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailgraph.functions import fixed

# `<a@b>`, then `@ word`, then any other tag. Each pattern is listed first and every hit is
# then removed as plain text, so a hit also disappears where it is part of a longer word.
# Python's \w and \S are Unicode-aware; the classes spell that out.
_NOT_SPACE = r"[^\s\p{Z}\x0B\x1C-\x1F\x85]"
# An address or a tag is looked for once in a run without blanks, from its start or from its
# first `<`: what is not found there is not found further on either, and long runs stay linear.
_ADDRESS_PATTERNS = [
    (rf"(?<!{_NOT_SPACE})<?{_NOT_SPACE}+@{_NOT_SPACE}+>?", 0),
    (r"@[\s\p{Z}][\p{L}\p{N}_]+", 0),
    (rf"(?<!{_NOT_SPACE}){_NOT_SPACE[:-1]}<]*+(</?{_NOT_SPACE}+>)", 1),
]


def remove_hits(text: Column, pattern: str, group: int = 0) -> Column:
    """List all matches, then delete each as literal text, one after the other."""

    def without(x: Column) -> Column:
        hits = F.regexp_extract_all(x, F.lit(pattern), F.lit(group))
        return F.aggregate(hits, x, lambda left, hit: F.replace(left, hit, F.lit("")))

    # The text is used twice; as a lambda argument it is still computed once.
    return F.transform(F.array(text), without)[0]


def header_lines(block: Column, names: list[str]) -> Column:
    """All headers with one of the names as an array of (name in lower case, value), by one scan.

    ``block`` starts with a newline. Continuation lines stay in the value.
    """
    wanted = "|".join(names)
    pattern = rf"(?i)\n((?:{wanted}):[^\n]*+(?:\n[ \t][^\n]*+)*+)"
    found = F.regexp_extract_all(block, F.lit(pattern), F.lit(1))

    def pair(line: Column) -> Column:
        name = F.substring_index(line, ":", 1)
        value = F.ltrim(F.substr(line, F.length(name) + 2), F.lit(" \t"))
        return F.struct(F.lower(name).alias("name"), value.alias("value"))

    return F.transform(found, pair)


def header_value(lines: Column, name: str) -> Column:
    """Raw value of the first header called ``name`` of ``header_lines``; NULL when there is none."""
    return F.get(F.filter(lines, lambda line: line["name"] == name.lower()), F.lit(0))["value"]


def clean_header(value: Column) -> Column:
    """Header clean-up of the mail tables. Empty input gives NULL."""
    return F.when(value != "", F.translate(value, '\n\t"\\()', ""))


def clean_export_header(value: Column) -> Column:
    """Header clean-up of the sender exports. Empty input gives NULL."""
    cleaned = F.translate(value, '\n\t"\\,', "")
    for suffix in fixed.ZONE_SUFFIXES:
        cleaned = F.replace(cleaned, F.lit(suffix), F.lit(""))
    return F.when(value != "", cleaned)


def strip_addresses(name: Column) -> Column:
    """Remove mail addresses and tags from a display name."""
    for pattern, group in _ADDRESS_PATTERNS:
        name = remove_hits(name, pattern, group)
    return name


def first_filled(*values: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def split_recipients(header: Column) -> Column:
    """Addresses of a recipient header. A trailing comma leaves an empty address."""
    parts = F.transform(F.split(header, ","), lambda r: F.regexp_replace(r, r"[\s<>]", ""))
    return F.when(header != "", parts).otherwise(F.array().cast("array<string>"))


def mail_category(subject: Column, fix_fwd: bool = False) -> Column:
    """INIT, RE or FWD by the first three characters of the subject.

    ``Fwd:`` has four characters and so counts as INIT unless ``fix_fwd`` is set.
    """
    start = F.substring(subject, 1, 3)
    forward = start.isin(fixed.FORWARD_PREFIXES)
    if fix_fwd:
        forward = forward | F.substring(subject, 1, 4).isin(fixed.LONG_FORWARD_PREFIXES)
    return F.when(start.isin(fixed.REPLY_PREFIXES), "RE").when(forward, "FWD").otherwise("INIT")


# Groups: day, month, year, hour, minute, second; and month, day, hour, minute, second, year.
_DAY_FIRST = r"(\d{1,2})[\s-]+([a-z]{3,9})\.?,?[\s-]+(\d{4}|\d{2}),?\s+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?"
_YEAR_LAST = r"([a-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?\s+(?:[a-z]{1,5}\s+)?(\d{4})"


def mail_epoch(date: Column) -> Column:
    """Epoch seconds of a mail date. The zone offset is ignored; NULL when malformed.

    Seconds may be missing, years have two digits (from 69 on they are of the last century),
    months their full name, and the year may come last. Days beyond a month's end run on into
    the next month.
    """
    text = F.lower(date)
    short = F.array(*[F.lit(m[:3]) for m in fixed.MONTHS])

    # Each pattern runs once; what it has matched is taken apart at its separators.
    def matched(hit: Column) -> Column:
        late = F.regexp_extract(text, _YEAR_LAST, 0)
        parts = F.split(F.when(hit != "", hit).otherwise(late), "[^a-z0-9]+")
        return F.struct((hit != "").alias("day_first"), parts.alias("parts"))

    def epoch(found: Column) -> Column:
        parts, day_first = found["parts"], found["day_first"]

        def part(early: int, late: int) -> Column:
            return F.get(parts, F.when(day_first, early).otherwise(late))

        def number(value: Column) -> Column:
            return value.try_cast("int")

        # With the year last a zone may stand where the second else does.
        year = F.when(day_first, F.get(parts, F.lit(2))).otherwise(F.element_at(parts, -1))
        second = F.when(F.size(parts) > 5, number(part(5, 4)))
        name, year = part(1, 0), number(year)
        known = name.isin(fixed.MONTHS) | (F.length(name) == 3)
        month = F.array_position(short, F.substring(name, 1, 3)).cast("int")
        year = F.when(year < 69, year + 2000).when(year < 100, year + 1900).otherwise(year)
        first = F.make_date(year, F.when(known & (month > 0), month), F.lit(1))
        days = F.unix_date(first).cast("bigint") + number(part(0, 1)) - 1
        clock = number(part(3, 2)) * 3600 + number(part(4, 3)) * 60 + F.coalesce(second, F.lit(0))
        return (days * 86400 + clock).cast("double")

    hit = F.transform(F.array(F.regexp_extract(text, _DAY_FIRST, 0)), matched)
    return F.transform(hit, epoch)[0]


def time_text(epoch: Column) -> Column:
    """Whole epoch seconds as text with one decimal, e.g. ``1009463851.0``."""
    return F.concat(epoch.cast("bigint").cast("string"), F.lit(".0"))


def message_id(sender: Column, epoch: Column) -> Column:
    return F.concat_ws(":", sender, time_text(epoch))


def recipient_message_ids(sender: Column, epoch: Column, recipients: Column) -> Column:
    return F.transform(recipients, lambda r: F.concat_ws(":", sender, r, time_text(epoch)))


def escape_path(path: Column) -> Column:
    doubled = F.replace(path, F.lit("/"), F.lit("//"))
    return F.replace(doubled, F.lit("\\"), F.lit("//"))


def path_part(path: Column, from_end: int) -> Column:
    """Part of a path counted from its end; 1 is the file name."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def sender_initials(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, " "), lambda w: F.substring(w, 1, 1)), "")


def recipient_initials(name: Column, address: Column) -> Column:
    """Initials of a name, skipping one leading special character per word.

    Without a name the first two characters of the address are used.
    """
    initials = F.transform(
        F.split(name, " "),
        lambda w: F.when(
            F.substring(w, 1, 1).isin(fixed.SKIPPED_INITIALS), F.substring(w, 2, 1)
        ).otherwise(F.substring(w, 1, 1)),
    )
    return F.when(name != "", F.array_join(initials, "")).otherwise(F.substring(address, 1, 2))


def dated_subject(subject: Column, date: Column) -> Column:
    return F.concat(subject, F.lit(" ("), date, F.lit(")"))
