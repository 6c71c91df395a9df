"""Joins in which null is a key like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on ``keys``, null equal to null; the keys come once, from the left."""
    names = {key: f"_right_{key}" for key in keys}
    same = F.lit(True)
    for key, name in names.items():
        same = same & F.col(key).eqNullSafe(F.col(name))
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())
