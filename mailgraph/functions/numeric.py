"""Rounding and scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio4(part: Column, whole: Column) -> Column:
    """``part / whole`` of two whole numbers, rounded half up to 4 places without float error."""
    scaled = F.call_function("div", part * 20000 + whole, whole * 2)
    return scaled / F.lit(10000.0)


def units4(x: Column) -> Column:
    """A 4-place number as a whole number of ten-thousandths."""
    return F.round(x * 10000).cast("bigint")


def product4(a: Column, b: Column) -> Column:
    """Product of two 4-place numbers, rounded to 4 places in decimal arithmetic."""
    exact = a.cast("decimal(12,4)") * b.cast("decimal(12,4)")
    return F.round(exact, 4).cast("double")


def smooth_idf(n_docs: Column, doc_freq: Column) -> Column:
    return F.round(F.log((n_docs + 1) / (doc_freq + 1)), 4)


def squash(x: Column) -> Column:
    """Logistic squash to (0, 1), 4 places."""
    return F.round(1 / (1 + F.exp(-x)), 4)
