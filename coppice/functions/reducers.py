"""One number from the scores of a candidate's folds. Each reducer maps the statistics' columns to a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REDUCERS = ("mean", "median", "trimmed_mean", "signal_to_noise", "mean_minus_lambda_std")


def fold_stats(score: str = "gain") -> list[Column]:
    """Aggregates of a group of fold scores: scores (sorted), mean, median, std (population), n_success."""
    s = F.col(score)
    return [
        F.array_sort(F.collect_list(s)).alias("scores"),
        F.avg(s).alias("mean"),
        F.median(s).alias("median"),
        F.stddev_pop(s).alias("std"),
        F.count(s).alias("n_success"),
    ]


def trimmed_mean(scores: Column, frac: float) -> Column:
    """Mean without floor(n * frac) scores at each end, but at most (n - 1) div 2."""
    n = F.size(scores)
    k = F.least(F.floor(n * F.lit(float(frac))), F.floor((n - 1) / 2)).cast("int")
    kept = F.slice(scores, k + 1, n - 2 * k)
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), n - 2 * k)


def reducer(name: str | Callable[..., Column], frac: float = 0.1, eps: float = 1e-12, lam: float = 1.0) -> Column:
    """Over the columns of ``fold_stats``. A callable gets them by name and returns a column."""
    if callable(name):
        return name(**{c: F.col(c) for c in ("scores", "mean", "median", "std", "n_success")})
    forms = {
        "mean": lambda: F.col("mean"),
        "median": lambda: F.col("median"),
        "trimmed_mean": lambda: trimmed_mean(F.col("scores"), frac),
        "signal_to_noise": lambda: F.try_divide(F.col("mean"), F.col("std") + F.lit(float(eps))),
        "mean_minus_lambda_std": lambda: F.col("mean") - F.lit(float(lam)) * F.col("std"),
    }
    if name not in forms:
        raise ValueError(f"aggregator must be one of {REDUCERS}, got {name!r}")
    return forms[name]()
