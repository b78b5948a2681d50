"""Impurity of class counts, of moments and of values. Empty groups have impurity 0."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(counts: Sequence[Column]) -> Column:
    out = counts[0]
    for c in counts[1:]:
        out = out + c
    return out


def gini(counts: Sequence[Column], n: Column | None = None) -> Column:
    """1 - sum p^2. ``n`` may count rows of no class, too."""
    n = total(counts) if n is None else n
    return F.when(n > 0, F.lit(1.0) - total([(c / n) * (c / n) for c in counts])).otherwise(0.0)


def entropy(counts: Sequence[Column], n: Column | None = None) -> Column:
    """-sum p log2 p over the classes that occur."""
    n = total(counts) if n is None else n
    terms = [F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0) for c in counts]
    return F.when(n > 0, total(terms)).otherwise(0.0)


def variance(n: Column, s: Column, q: Column) -> Column:
    """Population variance from count, sum and sum of squares; rounding never makes it negative."""
    mean = F.try_divide(s, n)
    return F.when(n > 0, F.greatest(F.try_divide(q, n) - mean * mean, F.lit(0.0))).otherwise(0.0)


def mae(values: Column) -> Column:
    """Mean absolute deviation of an array from its median (the midpoint for an even number of values)."""

    # What a lambda names is computed once; written out, the sort would be repeated for each value.
    def around(v: Column) -> Column:
        n = F.size(v)
        median = (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2
        spread = F.transform(F.array(median), lambda m: F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x - m)) / n)
        return F.when(n > 0, F.get(spread, F.lit(0))).otherwise(0.0)

    return F.get(F.transform(F.array(F.array_sort(values)), around), F.lit(0))


CLASS_CRITERIA: dict[str, Callable] = {"gini": gini, "entropy": entropy}
VALUE_CRITERIA = ("mse", "variance", "mae")
