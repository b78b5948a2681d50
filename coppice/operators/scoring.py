"""Cross-validated scores of candidate splits, for all nodes and features of a level at once.

All scoring starts from a small table of cells: sums of *measures* for each (node, feature, fold, code). The measures
are one count for each class, or count, sum and sum of squares of a target. What follows never touches rows again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import criteria, metrics, reducers

#: Code of the cell of missing values: after every state, so never on the left of a cut.
MISSING = 2147483647
GROUP = ["node", "feature"]


def class_measures(n_classes: int, y: str = "y") -> dict[str, Column]:
    return {f"c{i}": F.count_if(F.col(y) == i) for i in range(n_classes)}


def moment_measures(y: str = "y") -> dict[str, Column]:
    return {"n": F.count(F.col(y)), "s": F.sum(F.col(y)), "q": F.sum(F.col(y) * F.col(y))}


def unpivot(rows: DataFrame, codes: str, keep: list[str]) -> DataFrame:
    """A row for each feature of an array of codes."""
    return rows.select(*keep, F.posexplode(codes).alias("feature", "code"))


def fold_cells(coded: DataFrame, measures: dict[str, Column], keep_missing: bool) -> DataFrame:
    """Measures by (node, feature, fold, code); missing codes form one cell, or are left out."""
    if keep_missing:
        coded = coded.withColumn("code", F.coalesce("code", F.lit(MISSING)).cast("long"))
    else:
        coded = coded.where("code is not null").withColumn("code", F.col("code").cast("long"))
    return coded.groupBy(*GROUP, "fold", "code").agg(*(m.alias(name) for name, m in measures.items()))


def dense(cells: DataFrame, states: DataFrame, names: list[str]) -> DataFrame:
    """Cells for every code of a feature in every fold, so that no fold lacks a prefix. Small: no row of data is here."""
    codes = cells.select(*GROUP, "code").union(states.select(*GROUP, F.col("state").alias("code"))).distinct()
    folds = cells.select(*GROUP, "fold").distinct()
    grid = codes.join(folds, GROUP)
    return grid.join(cells, [*GROUP, "fold", "code"], "left").select(*GROUP, "fold", "code", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def sides(grid: DataFrame, names: list[str], ordered: Column) -> DataFrame:
    """Left measures l_* (a prefix of codes for ordered features, one code for others) and totals t_*."""
    every = W.partitionBy(*GROUP, "fold")
    upto = every.orderBy("code").rowsBetween(W.unboundedPreceding, 0)
    left = [F.when(ordered, F.sum(n).over(upto)).otherwise(F.col(n)).alias(f"l_{n}") for n in names]
    return grid.select(*GROUP, "fold", "code", *left, *(F.sum(n).over(every).alias(f"t_{n}") for n in names))


def _impurity(names: list[str], criterion: str | Callable[..., Column]) -> Callable[[Callable[[str], Column]], tuple[Column, Column]]:
    """(rows, impurity) of a side, given how to get a measure of it. A callable gets the class counts and their sum, or a
    target's count, sum and sum of squares, and returns a column."""
    if names[0] == "n":
        of = criterion if callable(criterion) else criteria.variance
        return lambda get: (get("n"), of(*(get(x) for x in "nsq")))
    if callable(criterion):
        return lambda get: ((n := criteria.total([get(x) for x in names])), criterion([get(x) for x in names], n))
    if criterion not in criteria.CLASS_CRITERIA:
        raise ValueError(f"criterion must be one of {sorted(criteria.CLASS_CRITERIA)}, got {criterion!r}")
    return lambda get: ((n := criteria.total([get(x) for x in names])), criteria.CLASS_CRITERIA[criterion]([get(x) for x in names], n))


def impurity_gains(split: DataFrame, names: list[str], criterion) -> DataFrame:
    """(node, feature, fold, code, gain); folds with an empty side are left out."""
    of = _impurity(names, criterion)
    nt, it = of(lambda x: F.col(f"t_{x}"))
    nl, il = of(lambda x: F.col(f"l_{x}"))
    nr, ir = of(lambda x: F.col(f"t_{x}") - F.col(f"l_{x}"))
    gain = F.when((nl > 0) & (nr > 0), it - (nl * il + nr * ir) / nt)
    return split.select(*GROUP, "fold", "code", gain.alias("gain")).where("gain is not null")


def objective_gains(split: DataFrame, n_classes: int, objective, average: str, pos_label: int, beta: float) -> DataFrame:
    """Gain of a metric over the parent's majority prediction. Measures v_* are validation, w_* training counts;
    sides predict their training majority; folds in which a side lacks either kind of row are left out."""
    get = lambda side, kind: [F.col(f"{side}_{kind}{i}") for i in range(n_classes)]
    less = lambda a, b: [x - y for x, y in zip(a, b, strict=True)]
    tv, tw, lv, lw = get("t", "v"), get("t", "w"), get("l", "v"), get("l", "w")
    rv, rw = less(tv, lv), less(tw, lw)
    value = lambda groups: metrics.metric(metrics.confusion(groups), objective, average, pos_label, beta)
    gain = value([(metrics.argmax(lw), lv), (metrics.argmax(rw), rv)]) - value([(metrics.argmax(tw), tv)])
    full = [criteria.total(x) > 0 for x in (lv, rv, lw, rw)]
    return split.select(*GROUP, "fold", "code", F.when(full[0] & full[1] & full[2] & full[3], gain).alias("gain")).where("gain is not null")


def with_training(grid: DataFrame, n_classes: int) -> DataFrame:
    """Validation counts v_* and training counts w_* (the same code's counts in the other folds)."""
    others = W.partitionBy(*GROUP, "code")
    return grid.select(
        *GROUP, "fold", "code", *(F.col(f"c{i}").alias(f"v{i}") for i in range(n_classes)), *((F.sum(f"c{i}").over(others) - F.col(f"c{i}")).alias(f"w{i}") for i in range(n_classes))
    )


def mae_gains(coded: DataFrame, states: DataFrame, ordered: Column) -> DataFrame:
    """Gains of mean absolute deviation. Not additive over cells: each validation row meets each state of its feature."""
    coded = coded.withColumn("code", F.coalesce("code", F.lit(MISSING)).cast("long"))
    met = coded.join(F.broadcast(states), GROUP).withColumn("left", F.when(ordered, F.col("code") <= F.col("state")).otherwise(F.col("code") == F.col("state")))
    keys = [*GROUP, "fold", "state"]
    med = lambda by: F.median("y").over(W.partitionBy(*by))
    met = met.withColumn("_a", F.abs(F.col("y") - med([*keys, "left"]))).withColumn("_t", F.abs(F.col("y") - med(keys)))
    left = F.col("left")
    out = met.groupBy(*keys).agg(
        F.count("*").alias("nt"), F.count_if(left).alias("nl"), F.avg("_t").alias("it"), F.avg(F.when(left, F.col("_a"))).alias("il"), F.avg(F.when(~left, F.col("_a"))).alias("ir")
    )
    nr = F.col("nt") - F.col("nl")
    gain = F.col("it") - (F.col("nl") * F.col("il") + nr * F.col("ir")) / F.col("nt")
    return out.where((F.col("nl") > 0) & (nr > 0)).select(*GROUP, "fold", F.col("state").alias("code"), gain.alias("gain"))


def candidates(gains: DataFrame, states: DataFrame, aggregator="mean", frac: float = 0.1, eps: float = 1e-12, lam: float = 1.0) -> DataFrame:
    """(node, feature, state, scores, mean, median, std, n_success, score); states without any fold are left out."""
    keys = [*GROUP, "state"]
    stats = gains.withColumnRenamed("code", "state").join(states.select(*keys), keys).groupBy(*keys).agg(*reducers.fold_stats("gain"))
    return stats.withColumn("score", reducers.reducer(aggregator, frac, eps, lam))


def select_best(scored: DataFrame) -> DataFrame:
    """Each node's candidate of the best score; scores that are not finite are out; ties: lowest feature, then state.

    Scores are compared to 12 decimals, since distributed sums differ in their last bits.
    """
    order = W.partitionBy("node").orderBy(F.round("score", 12).desc(), "feature", "state")
    return scored.where(F.abs("score") < float("inf")).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
