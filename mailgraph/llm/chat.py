"""Chat formatting: layouts known by a fingerprint of their fields, one template, a loss mask.

Records of conversations come as prompts with answers, instructions with inputs, lists of
messages, or one row for each turn. A hash over the nested field paths of a record names its
layout, and the layout says declaratively where the turns are. All end up as the same rows:
a conversation and its turns (role, text).
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``fields``: DDL of what the layout needs. ``turns``: SQL for the list of (role, text), or,
    with ``order``, for the (role, text) of one row, rows of equal id being one conversation."""

    name: str
    fields: str
    turns: str
    id: str = "conv_id"
    order: str | None = None


def _said(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', {text})"


LAYOUTS = [
    Layout("turn rows", "conv_id long, turn long, role string, text string",
           _said("role", "text"), order="turn"),
    Layout("messages", "conv_id long, messages array<struct<role:string,content:string>>",
           f"transform(messages, m -> {_said('m.role', 'm.content')})"),
    Layout("senders", "conv_id long, conversations array<struct<from:string,value:string>>",
           "transform(conversations, m -> " + _said(
               "CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END",
               "m.value") + ")"),
    Layout("prompt", "conv_id long, prompt string, response string",
           f"array({_said('\"user\"', 'prompt')}, {_said('\"assistant\"', 'response')})"),
    Layout("prompt with system", "conv_id long, system string, prompt string, response string",
           f"array({_said('\"system\"', 'system')}, {_said('\"user\"', 'prompt')},"
           f" {_said('\"assistant\"', 'response')})"),
    Layout("instruction", "conv_id long, instruction string, input string, output string",
           "array(" + _said('"user"', "CASE WHEN coalesce(input, '') = '' THEN instruction"
                            " ELSE concat(coalesce(instruction, ''), '\\n\\n', input) END")
           + f", {_said('\"assistant\"', 'output')})"),
]


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested paths with the kind of their value: ``messages[].role:text``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [f"{at}:{'number' if isinstance(kind, T.NumericType) else 'text'}"]


def record_paths(value, at: str = "") -> list[str]:
    """The same for one record read from JSON. Null is text: it may be missing anywhere."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in record_paths(v, f"{at}.{k}" if at else k)]
    if isinstance(value, list):
        return [p for v in value for p in record_paths(v, f"{at}[]")]
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return [f"{at}:{'number' if number else 'text'}"]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def _layout_paths(layout: Layout) -> list[str]:
    return schema_paths(T._parse_datatype_string(layout.fields))


def layout_table(layouts: list[Layout] = LAYOUTS) -> dict[str, tuple[str, frozenset[str]]]:
    """Name and paths of the layouts by their fingerprint."""
    paths = {layout.name: frozenset(_layout_paths(layout)) for layout in layouts}
    return {fingerprint(list(p)): (name, p) for name, p in paths.items()}


def pick(paths: list[str], table: dict[str, tuple[str, frozenset[str]]]) -> str | None:
    """The layout with the fingerprint of the paths, fields that no layout knows left out; else
    the one with the most paths among those that are all there; else none."""
    known = frozenset().union(*(p for _, p in table.values()))
    exact = table.get(fingerprint([p for p in paths if p in known]))
    inside = [(len(p), name) for name, p in table.values() if p <= set(paths)]
    return exact[0] if exact else max(inside, default=(0, None))[1]


def _clean(turns: Column) -> Column:
    return F.transform(
        F.coalesce(turns, F.array().cast(TURNS)),
        lambda t: F.struct(
            F.coalesce(t["role"], F.lit("")).alias("role"),
            F.coalesce(t["text"], F.lit("")).alias("text"),
        ),
    )


def canonical(df: DataFrame, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, turns) of a table whose schema selects the layout.

    Turn rows are ordered by turn, then role and text, and equal rows stay; null ids are one
    conversation. A conversation is one value of the result, so its turns meet in one task.
    Null roles and texts are empty. Fields that no layout knows are ignored.
    """
    name = pick(schema_paths(df.schema), layout_table(layouts))
    layout = next((one for one in layouts if one.name == name), None)
    if layout is None:
        raise ValueError(f"no layout has the fields {df.columns}")
    key = F.col(layout.id).alias("conv_id")
    if layout.order is None:
        return df.select(key, _clean(F.expr(layout.turns)).alias("turns"))
    rows = df.select(
        key, F.struct(F.col(layout.order).alias("turn"), F.expr(layout.turns).alias("said")).alias("t")
    )
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: t["said"])
    return rows.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", _clean(F.col("turns")).alias("turns"))


def canonical_json(df: DataFrame, record: str, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, turns, layout) of JSON records, each of which may have another layout.

    Turn rows are left out as they are no whole conversations: put them into a table. Records
    without a layout, null and broken ones come back with null turns and layout. Equal records
    give equal rows, an empty table an empty one. Other columns are not read.
    """
    whole = [layout for layout in layouts if layout.order is None]
    known = layout_table(whole)

    def name_of(text: str | None) -> str | None:
        try:
            return pick(record_paths(json.loads(text)), known)
        except (TypeError, ValueError):
            return None

    def named(batches):
        for batch in batches:
            names = [name_of(value) for value in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string())], ["r", "layout"])

    rows = df.select(F.col(record).alias("r")).mapInArrow(named, "r string, layout string")
    ids, turns = F.lit(None).cast("long"), F.lit(None).cast(TURNS)
    for n, layout in enumerate(whole):
        here = F.col("layout") == layout.name
        rows = rows.withColumn(f"f{n}", F.when(here, F.from_json("r", layout.fields)))
    for n, layout in enumerate(whole):
        # The layout's expressions read its own fields.
        inner = f"element_at(transform(array(f{n}), f -> struct({_scoped(layout, 'f')})), 1)"
        here = F.col("layout") == layout.name
        ids = F.when(here, F.expr(f"f{n}.{layout.id}")).otherwise(ids)
        turns = F.when(here, _clean(F.expr(f"{inner}.turns"))).otherwise(turns)
    return rows.select(ids.alias("conv_id"), turns.alias("turns"), "layout")


def _scoped(layout: Layout, name: str) -> str:
    names = T._parse_datatype_string(layout.fields).names
    scoped = re.sub(r"(?<![.\w'\"])(" + "|".join(names) + r")(?![\w'\"(])", rf"{name}.\1", layout.turns)
    return f"{scoped} AS turns"


@dataclass(frozen=True)
class Template:
    """A turn is start + role + middle + text + stop. The three marks hold no backslash."""

    start: str = "[INST] "
    middle: str = " [/INST]"
    stop: str = "</s>"
    controls: tuple[str, ...] = ("[INST]", "[/INST]", "</s>")
    learned: str = "assistant"

    def _pattern(self) -> str:
        first = "".join(re.escape(c) for c in sorted({c[0] for c in self.controls}))
        rest = "|".join(re.escape(c[1:]) for c in self.controls)
        return rf"([{first}]){{}}(\\*)({rest})"

    def escaped(self, text: Column) -> Column:
        """A backslash goes behind the first character of control strings, also of those that
        have some there already; so no control string is left, and the way back is unique."""
        return F.regexp_replace(text, self._pattern().format(""), r"$1\\$2$3")

    def unescaped(self, text: str) -> str:
        return re.sub(self._pattern().format(r"\\"), r"\1\2\3", text)


def format_turns(df: DataFrame, template: Template = Template(), turns: str = "turns") -> DataFrame:
    """Append ``formatted`` and ``mask``: runs of characters (learned, length) that make up
    ``formatted``, learned ones being the texts of the learned role.

    Null turns and no turns give an empty text and an empty mask. Roles and texts must not be null
    (``canonical`` makes them empty). Columns of ``df`` named ``formatted`` or ``mask`` are
    replaced, and one named ``_escaped`` is left out; others stay. Equal rows give equal results,
    an empty table an empty one.
    """
    marks = [F.lit(m) for m in (template.start, template.middle, template.stop)]
    sizes = [len(m) for m in (template.start, template.middle, template.stop)]

    def run(learned: Column, length: Column) -> Column:
        return F.struct(learned.alias("learned"), length.cast("int").alias("length"))

    escaped = F.transform(
        turns,
        lambda t: F.struct(
            template.escaped(t["role"]).alias("role"), template.escaped(t["text"]).alias("text"),
            (t["role"] == template.learned).alias("learned"),
        ),
    )
    parts = F.transform("_escaped", lambda t: F.concat(marks[0], t["role"], marks[1], t["text"], marks[2]))
    runs = F.flatten(
        F.transform(
            "_escaped",
            lambda t: F.array(
                run(F.lit(False), F.length(t["role"]) + sizes[0] + sizes[1]),
                run(t["learned"], F.length(t["text"])),
                run(F.lit(False), F.lit(sizes[2])),
            ),
        )
    )
    return (
        df.withColumn("_escaped", escaped)
        .withColumns({"formatted": F.concat_ws("", parts), "mask": runs})
        .drop("_escaped")
    )


def read_turns(formatted: str, template: Template = Template()) -> list[tuple[str, str]]:
    """Roles and texts from a formatted conversation."""
    out = []
    for part in formatted.split(template.stop)[:-1]:
        role, _, text = part[len(template.start) :].partition(template.middle)
        out.append((template.unescaped(role), template.unescaped(text)))
    return out


def read_learned(formatted: str, mask: list[dict], template: Template = Template()) -> list[str]:
    """The texts under the mask."""
    at, out = 0, []
    for run in mask:
        if run["learned"]:
            out.append(template.unescaped(formatted[at : at + run["length"]]))
        at += run["length"]
    return out


def read_back(df: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from
    ``formatted`` and ``mask`` alone.

    An empty text has no turns. Equal rows, also of one id, are read each by itself; a null id
    stays null; an empty table gives an empty one. Other columns are not read.
    """

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def read(batches):
        for batch in batches:
            rows = []
            for formatted, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_turns(formatted, template)
                learned = "".join(read_learned(formatted, mask, template))
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((len(turns), digest(said), len(learned), digest(learned), len(formatted)))
            columns = zip(*rows) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return df.select("conv_id", "formatted", "mask").mapInArrow(
        read,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
        " formatted_chars long",
    )
