"""Bins of continuous values and ids of categories. Missing is NULL throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest category id; larger values count as unknown.
MAX_CATEGORY = 4294967294


def finite(x: Column) -> Column:
    """``x``, or NULL if it is NaN or infinite."""
    x = x.cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def bin_code(edges: Column, x: Column) -> Column:
    """How many edges are <= x; NULL for missing values. Bins are closed below and open above."""
    value = finite(x)
    return F.when(value.isNotNull(), F.size(F.filter(edges, lambda e: e <= value)))


def bin_bounds(edges: Column, code: Column) -> Column:
    """struct(lower, upper) of a bin, NULL where open; NULL if there is no such bin."""
    lower = F.when(code > 0, F.get(edges, code - 1))
    upper = F.when(code < F.size(edges), F.get(edges, code))
    return F.when((code >= 0) & (code <= F.size(edges)), F.struct(lower.alias("lower"), upper.alias("upper")))


def to_category(x: Column) -> Column:
    """Category id of a double: rounded half up if finite and not negative, NULL (unknown) otherwise."""
    value = finite(x)
    return F.when((value >= 0) & (F.round(value) <= MAX_CATEGORY), F.round(value).cast("long"))


def in_interval(x: Column, lower: Column, upper: Column) -> Column:
    """lower <= x < upper with NULL bounds open; missing values are outside."""
    value = finite(x)
    inside = (lower.isNull() | (value >= lower)) & (upper.isNull() | (value < upper))
    return F.coalesce(value.isNotNull() & inside, F.lit(False))


def goes_left(code: Column, state: Column, prefix: bool) -> Column:
    """Side of a coded row: code <= state for ordered cuts, code = state otherwise; missing is right."""
    return F.coalesce(code <= state if prefix else code == state, F.lit(False))
