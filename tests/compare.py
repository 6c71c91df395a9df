"""Runs a registered query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(frame, columns):
    return sorted(
        (tuple(_plain(v) for v in row) for row in frame[columns].itertuples(index=False, name=None)),
        key=repr,
    )


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(
        (tuple(_plain(row[c]) for c in columns) for row in df.collect()), key=repr
    )


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted((tuple(_plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]",
}


def sql_types(sql: str, sf_dir: str) -> dict[str, str]:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
