"""Mail archives on a file system: scanning, folder choice, folder merge, header extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgraph.functions import fixed
from mailgraph.functions import headers as H
from mailgraph.operators.joins import null_safe_join
from mailgraph.operators.numbering import position_in_group

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def as_text(content: Column) -> Column:
    """Latin-1 bytes as text with line ends as a text-mode reader gives them."""
    return F.regexp_replace(F.decode(content, "ISO-8859-1"), "\r\n?", "\n")


def scan_mail_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """One row per file below ``root``: path, text. ``glob`` prunes by file name at listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", as_text(F.col("content")).alias("text"))


def with_folders(files: DataFrame) -> DataFrame:
    """Add user folder, mail folder and file name taken from ``<root>/<user>/<folder>/<name>``."""
    path = F.col("path")
    return files.withColumns(
        {
            "user_folder": H.path_part(path, 3),
            "folder": H.path_part(path, 2),
            "file_name": H.path_part(path, 1),
        }
    )


def select_folders(files: DataFrame, folders: list[str]) -> DataFrame:
    """Files whose parent directory is one of ``folders``."""
    return with_folders(files).filter(F.col("folder").isin(folders))


def merge_folders(
    files: DataFrame,
    source: str = fixed.SENT_FOLDER,
    target: str = fixed.SENT_ITEMS_FOLDER,
    first_number: int = fixed.FIRST_MERGED_NUMBER,
) -> DataFrame:
    """``target`` files under their own names plus ``source`` files renumbered per user.

    Adds ``merged_name``. Users are numbered independently from ``first_number`` on, in file
    name order; one very large user is numbered by many tasks.
    """
    stay = files.filter(F.col("folder") == target).withColumn("merged_name", F.col("file_name"))
    move = files.filter(F.col("folder") == source)
    placed = position_in_group(
        move.select("user_folder", "file_name"), ["user_folder"], ["file_name"], "position"
    )
    names = placed.select(
        "user_folder",
        "file_name",
        (F.col("position") + (first_number - 1)).cast("string").alias("merged_name"),
    )
    # A path of two parts has no user; such files are one group.
    moved = null_safe_join(move, names, ["user_folder", "file_name"])
    return stay.unionByName(moved).withColumn("folder", F.lit(target))


HEADER_NAMES = {
    "from_header": "From",
    "to_header": "To",
    "cc_header": "Cc",
    "bcc_header": "Bcc",
    "subject_header": "Subject",
    "date_header": "Date",
    "x_from": "X-From",
    "x_to": "X-To",
    "x_cc": "X-cc",
    "content_type": "Content-Type",
}


# The line end before the first line that is no `name:`, no continuation and no `From ` line.
NO_HEADER = r"\n(?!From |[!-9;-~]*+:|[ \t])"


def split_mail(files: DataFrame, text: str = "text") -> DataFrame:
    """Replace the raw text by one column per header and ``raw_body``.

    Headers end at the first line that is neither a header nor a continuation; if it is empty,
    the body starts after it, else with it. A missing header is NULL, an empty one is ''.
    """
    lines = F.concat(F.lit("\n"), F.col(text))
    end = F.regexp_instr(lines, F.lit(NO_HEADER))
    marked = files.withColumns({"_lines": lines, "_end": end})
    ended = F.col("_end") > 0
    block = F.when(ended, F.expr("substring(_lines, 1, _end - 1)")).otherwise(F.col("_lines"))
    rest = F.when(ended, F.expr("substring(_lines, _end + 1)")).otherwise(F.lit(""))
    lines = H.header_lines(block, list(HEADER_NAMES.values()))
    halves = marked.withColumns({"_headers": lines, "_rest": rest})
    columns = {
        name: H.header_value(F.col("_headers"), header) for name, header in HEADER_NAMES.items()
    }
    empty_line = F.startswith("_rest", F.lit("\n"))
    columns["raw_body"] = F.when(empty_line, F.expr("substring(_rest, 2)")).otherwise(F.col("_rest"))
    return halves.withColumns(columns).drop("_lines", "_end", "_headers", "_rest", text)


def load_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """Stop words from a text file, one per line."""
    return spark.read.text(path).select(F.trim("value").alias("word")).distinct()


def stop_word_list(spark: SparkSession, path: str) -> list[str]:
    """The stop words of a file as the list that loads take: a language has a few hundred."""
    return sorted(row["word"] for row in load_stop_words(spark, path).collect() if row["word"])
