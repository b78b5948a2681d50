"""Level-wise growth: a few jobs a level, whatever the number of nodes; the driver holds nodes and winners only.

Rows stay where they are. A row's node is an expression of the tree so far, so lineage does not grow with depth, and
rows of finished nodes drop out of every job.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import criteria
from ..functions.binning import bin_code, finite, to_category
from ..functions.metrics import AVERAGES, OBJECTIVES
from ..functions.reducers import REDUCERS
from ..operators import scoring
from ..operators.folds import assign_folds
from ..operators.quantiles import quantile_edges
from .nodes import Node, preorder, route


@dataclass(frozen=True)
class Growth:
    """All parameters of a fit; the defaults are those of the estimators."""

    n_classes: int = 0  # 0: regression
    criterion: object = "gini"  # a name, or a callable as in scoring.impurity_gains
    objective: object = None  # a name, or a callable over a Confusion
    average: str = "binary"
    pos_label: int = 1
    beta: float = 1.0
    max_depth: int | None = 8
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    min_impurity_decrease: float = 0.0
    n_bins: int = 8
    cv_folds: int = 5
    cv_seed: int = 42
    cv_shuffle: bool = True
    mode: str = "strict"
    split_style: str = "threshold"
    aggregator: object = "mean"
    agg_frac: float = 0.1
    agg_eps: float = 1e-12
    agg_lambda: float = 1.0
    categorical: tuple[int, ...] = ()

    def check(self) -> None:
        kinds = ("gini", "entropy") if self.n_classes else criteria.VALUE_CRITERIA
        for name, value, allowed in (
            ("criterion", kinds[0] if callable(self.criterion) else self.criterion, kinds), ("mode", self.mode, ("strict", "fast")), ("split_style", self.split_style, ("threshold", "bin", "bin_membership")),
            ("objective", None if callable(self.objective) else self.objective, (None, *OBJECTIVES)), ("average", self.average, AVERAGES), ("aggregator", self.aggregator if isinstance(self.aggregator, str) else REDUCERS[0], REDUCERS),
        ):
            if value not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, got {value!r}")
        if self.n_bins < 2:
            raise ValueError("n_bins must be >= 2")
        if self.cv_folds < 2:
            raise ValueError("cv_folds must be >= 2")
        if self.criterion == "mae" and self.mode == "fast":
            raise ValueError("criterion 'mae' needs mode 'strict': its impurity has no additive statistics")


def prepared(rows: DataFrame, features: list[str], categorical: tuple[int, ...], label, row_id) -> DataFrame:
    """(row_id, y, x): features as an array of doubles in which missing values and unknown categories are NULL."""
    x = [to_category(F.col(f"`{c}`")).cast("double") if i in categorical else finite(F.col(f"`{c}`")) for i, c in enumerate(features)]
    return rows.select(row_id.alias("row_id"), label.alias("y"), F.array(*x).alias("x"))


#: Copies of a row that one task numbers.
_COPIES = 10_000


def told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` of ``prepared`` with copies of a row numbered from 0 in their row_id, so that they spread over the folds.

    Equal rows are interchangeable: they are counted, and each count is spread out again in blocks, so that a row that
    makes up most of the table is neither sorted nor written out by one task.
    """
    counted = rows.groupBy("row_id", "y", "x").agg(F.count("*").alias("_n"))
    blocks = counted.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(_COPIES).cast("long")))).repartition("row_id", "_at")
    number = F.explode(F.sequence("_at", F.least(F.col("_at") + _COPIES, "_n") - 1)).alias("_i")
    return blocks.select("row_id", "y", "x", number).select(F.concat_ws(":", "row_id", F.col("_i").cast("string")).alias("row_id"), "y", "x")


def _edge_arrays(edges: DataFrame, keys: list[str], d: int) -> DataFrame:
    """One row for each key with an array of edge arrays by feature; features without edges have an empty one."""
    by = F.map_from_entries(F.collect_list(F.struct("feature", "edges")))
    empty = F.expr("cast(array() as array<double>)")
    return edges.groupBy(*keys).agg(by.alias("_m")).select(*keys, F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), empty)).alias("edges"))


def _coded(edges, x, categorical):
    """Codes of all features: bins by the given edge arrays; a category's code is its id."""
    cats = F.array(*(F.lit(i) for i in categorical)) if categorical else F.expr("cast(array() as array<int>)")
    return F.transform(x, lambda v, i: F.when(F.array_contains(cats, i), v.cast("long")).otherwise(bin_code(F.get(edges, i), v).cast("long")))


class Grower:
    def __init__(self, rows: DataFrame, d: int, p: Growth):
        p.check()
        self.rows, self.d, self.p, self.spark = rows, d, p, rows.sparkSession
        self.measures = scoring.class_measures(p.n_classes) if p.n_classes else scoring.moment_measures()
        self.names = list(self.measures)
        self.held: list[DataFrame] = []
        cut = p.split_style == "threshold"
        self.ordered = (~F.col("feature").isin(*p.categorical) if p.categorical else F.lit(True)) if cut else F.lit(False)
        self.continuous = ~F.col("feature").isin(*p.categorical) if p.categorical else F.lit(True)

    def _hold(self, df: DataFrame) -> DataFrame:
        """Persisted until the level is done."""
        self.held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.held[-1]

    def _global_edges(self) -> list[list[float]]:
        cells = self.rows.select(F.posexplode("x").alias("feature", "v")).where(self.continuous)
        found = {r["feature"]: r["edges"] for r in quantile_edges(cells, ["feature"], "v", self.p.n_bins).collect()}
        return [list(found.get(i, [])) for i in range(self.d)]

    def _stats(self, root: Node) -> None:
        """Rows, class shares or mean, and purity of each open leaf, from one aggregation."""
        extra = [F.min("y").alias("lo"), F.max("y").alias("hi")]
        here = route(self.rows, root, "x", "node")
        here = here.where(F.col("node") >= 0)
        rows = here.groupBy("node").agg(F.count("*").alias("rows"), *(m.alias(k) for k, m in self.measures.items()), *extra).collect()
        leaves = {n.key: n for n in preorder(root) if n.is_leaf and n.key >= 0}
        for r in rows:
            n = leaves[r["node"]]
            n.n_samples, n.pure = r["rows"], r["lo"] == r["hi"]
            if self.p.n_classes:
                whole = sum(r[k] for k in self.names)
                n.proba = [r[k] / whole if whole else 0.0 for k in self.names]
            else:
                n.value = r["s"] / r["n"] if r["n"] else math.nan

    def _score_fast(self, level: DataFrame, edges: list[list[float]]) -> DataFrame:
        p = self.p
        coded = scoring.unpivot(level, "codes", ["node", "fold", "y"])
        cells = self._hold(scoring.fold_cells(coded, self.measures, keep_missing=False))
        states = cells.select("node", "feature", F.col("code").alias("state")).distinct()
        top = F.get(F.array(*(F.lit(len(e)) for e in edges)), F.col("feature"))
        states = states.where(~self.ordered | (F.col("state") < top))
        grid = scoring.dense(cells, states, self.names)
        if p.objective:
            names = [f"{k}{i}" for k in "vw" for i in range(p.n_classes)]
            split = scoring.sides(scoring.with_training(grid, p.n_classes), names, self.ordered)
            gains = scoring.objective_gains(split, p.n_classes, p.objective, p.average, p.pos_label, p.beta)
        else:
            gains = scoring.impurity_gains(scoring.sides(grid, self.names, self.ordered), self.names, p.criterion)
        return scoring.candidates(gains, states, p.aggregator, p.agg_frac, p.agg_eps, p.agg_lambda)

    def _score_strict(self, level: DataFrame, edges: DataFrame) -> DataFrame:
        p, keys = self.p, ["node", "view"]
        arrays = _edge_arrays(edges, keys, self.d)
        nothing = F.transform(F.sequence(F.lit(0), F.lit(self.d - 1)), lambda i: F.expr("cast(array() as array<double>)"))

        def coded(rows: DataFrame, view) -> DataFrame:
            joined = rows.withColumn("view", view.cast("int")).join(F.broadcast(arrays), keys, "left")
            return scoring.unpivot(joined.withColumn("codes", _coded(F.coalesce("edges", nothing), F.col("x"), p.categorical)), "codes", ["node", "fold", "y"])

        states = coded(level, F.lit(-1)).where("code is not null").select("node", "feature", F.col("code").alias("state")).distinct()
        states = self._hold(states)
        val = coded(level, F.col("fold"))
        if p.criterion == "mae" and not p.n_classes:
            return scoring.candidates(scoring.mae_gains(val, states, self.ordered), states, p.aggregator, p.agg_frac, p.agg_eps, p.agg_lambda)
        cells = scoring.fold_cells(val, self.measures, keep_missing=True)
        if p.objective:
            folds = F.explode(F.sequence(F.lit(0), F.least(F.lit(p.cv_folds), F.col("_n")).cast("int") - 1)).alias("other")
            sizes = level.groupBy("node").agg(F.count("*").alias("_n"))
            spread = level.join(F.broadcast(sizes), "node").select("node", "y", "x", F.col("fold").alias("own"), folds).where("other <> own")
            train = scoring.fold_cells(coded(spread.withColumnRenamed("other", "fold"), F.col("fold")), self.measures, keep_missing=True)
            c = range(p.n_classes)
            named = lambda df, kind: df.select("node", "feature", "fold", "code", *(F.col(f"c{i}").alias(f"{kind}{i}") for i in c))
            cells = named(cells, "v").join(named(train, "w"), ["node", "feature", "fold", "code"], "full")
            names = [f"{k}{i}" for k in "vw" for i in c]
            cells = cells.select("node", "feature", "fold", "code", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))
            split = scoring.sides(scoring.dense(cells, states, names), names, self.ordered)
            gains = scoring.objective_gains(split, p.n_classes, p.objective, p.average, p.pos_label, p.beta)
        else:
            gains = scoring.impurity_gains(scoring.sides(scoring.dense(cells, states, self.names), self.names, self.ordered), self.names, p.criterion)
        return scoring.candidates(gains, states, p.aggregator, p.agg_frac, p.agg_eps, p.agg_lambda)

    def _rule(self, winner, edges: list[float]) -> dict | None:
        """A winner's split by the edges of its node (strict) or of all rows (fast); None if it has no finite cut."""
        feature, state = int(winner["feature"]), int(winner["state"])
        if feature in self.p.categorical:
            return {"feature": feature, "is_categorical": True, "category": state}
        if state > len(edges):
            return None
        upper = edges[state] if state < len(edges) else math.inf
        if self.p.split_style == "threshold":
            return None if math.isinf(upper) else {"feature": feature, "lower": -math.inf, "upper": upper}
        return {"feature": feature, "lower": edges[state - 1] if state else -math.inf, "upper": upper}

    def run(self) -> Node:
        p = self.p
        self.rows = self.rows.persist(StorageLevel.MEMORY_AND_DISK)
        fast = None
        try:
            root, serial, parents = Node(), 0, []
            if p.mode == "fast":
                fast = self._global_edges()
                arrays = F.array(*(F.array(*map(F.lit, e)) if e else F.expr("cast(array() as array<double>)") for e in fast))
                plain, self.rows = self.rows, self.rows.withColumn("codes", _coded(arrays, F.col("x"), p.categorical)).persist(StorageLevel.MEMORY_AND_DISK)
            while True:
                self._stats(root)
                for n in parents:
                    if min(n.left.n_samples, n.right.n_samples) < max(p.min_samples_leaf, 1):
                        n.left = n.right = None
                        n.key = -1
                leaves = [n for n in preorder(root) if n.is_leaf and n.key >= 0]
                opened = [n for n in leaves if n.n_samples >= max(p.min_samples_split, 2) and (p.max_depth is None or n.depth < p.max_depth) and not n.pure]
                for n in leaves:
                    if n not in opened:
                        n.key = -1
                if not opened:
                    break
                level = route(self.rows, root, "x", "node").where(F.col("node") >= 0)
                level = assign_folds(level, p.cv_folds, p.cv_seed, p.cv_shuffle).persist(StorageLevel.MEMORY_AND_DISK)
                if p.mode == "fast":
                    scored, edges_of = self._score_fast(level, fast), lambda w: fast[w["feature"]]
                else:
                    cells = level.select("node", "fold", F.posexplode("x").alias("feature", "v")).where(self.continuous)
                    edges = quantile_edges(cells, ["node", "feature"], "v", p.n_bins, "fold", p.cv_folds)
                    edges = self._hold(edges)
                    scored = self._score_strict(level, edges)
                    own = {(r["node"], r["feature"]): list(r["edges"]) for r in edges.where("view = -1").collect()}
                    edges_of = lambda w: own.get((w["node"], w["feature"]), [])
                winners = {r["node"]: r for r in scoring.select_best(scored).select("node", "feature", "state", "score").collect()}
                for kept in (level, *self.held):
                    kept.unpersist()
                self.held.clear()
                parents = []
                for n in opened:
                    w = winners.get(n.key)
                    rule = self._rule(w, edges_of(w)) if w and w["score"] > p.min_impurity_decrease else None
                    n.key = -1
                    if rule:
                        for k, v in rule.items():
                            setattr(n, k, v)
                        n.left, n.right = Node(depth=n.depth + 1, key=serial + 1), Node(depth=n.depth + 1, key=serial + 2)
                        serial += 2
                        parents.append(n)
                if not parents:
                    break
            return root
        finally:
            self.rows.unpersist()
            if fast is not None:
                plain.unpersist()


def grow(rows: DataFrame, d: int, params: Growth) -> Node:
    """rows: (row_id, y, x) of ``prepared``. Inner nodes keep their row counts, as the sum of their children."""
    return Grower(rows, d, params).run()
