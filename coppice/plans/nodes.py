"""Trees as lists of nodes in preorder, and their routing as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binning import finite

SCHEMA = (
    "id int, is_leaf boolean, children_left long, children_right long, feature long, is_categorical boolean, lower double, "
    "upper double, category long, n_samples long, predicted_class long, proba array<double>, value double"
)
#: Levels of a tree that one expression tests; deeper trees take several steps, to keep generated code small.
STEP_LEVELS = 6


@dataclass
class Node:
    n_samples: int = 0
    proba: list[float] = field(default_factory=list)
    value: float = math.nan
    feature: int = -1
    is_categorical: bool = False
    lower: float = math.nan
    upper: float = math.nan
    category: int = -1
    left: Node | None = None
    right: Node | None = None
    depth: int = 0
    key: int = 0  # while growing: the number of an open leaf, -1 for finished nodes
    pure: bool = True  # while growing: whether all targets are equal

    @property
    def is_leaf(self) -> bool:
        return self.left is None

    @property
    def predicted_class(self) -> int:
        return self.proba.index(max(self.proba)) if self.proba else -1


def preorder(root: Node | None) -> list[Node]:
    out, stack = [], [root] if root else []
    while stack:
        node = stack.pop()
        out.append(node)
        if not node.is_leaf:
            stack += [node.right, node.left]
    return out


def depth(root: Node | None) -> int:
    return max((n.depth for n in preorder(root)), default=0)


def n_leaves(root: Node | None) -> int:
    return sum(n.is_leaf for n in preorder(root))


def to_rows(root: Node | None) -> list[dict]:
    """A row for each node; leaves and inner nodes have placeholders in each other's fields."""
    nodes = preorder(root)
    at = {id(n): i for i, n in enumerate(nodes)}
    rows = []
    for i, n in enumerate(nodes):
        leaf = n.is_leaf
        rows.append(
            {
                "id": i, "is_leaf": leaf, "children_left": -1 if leaf else at[id(n.left)], "children_right": -1 if leaf else at[id(n.right)],
                "feature": -1 if leaf else n.feature, "is_categorical": not leaf and n.is_categorical, "lower": math.nan if leaf else n.lower,
                "upper": math.nan if leaf else n.upper, "category": -1 if leaf else n.category, "n_samples": n.n_samples,
                "predicted_class": n.predicted_class if leaf else -1, "proba": list(n.proba) if leaf else [], "value": n.value if leaf else math.nan,
            }
        )
    return rows


def from_rows(rows: list[dict]) -> Node | None:
    rows = sorted(rows, key=lambda r: r["id"])
    nodes = [Node(r["n_samples"], list(r["proba"] or []), r["value"], r["feature"], r["is_categorical"], r["lower"], r["upper"], r["category"]) for r in rows]
    for r, n in zip(rows, nodes, strict=True):
        if not r["is_leaf"]:
            n.left, n.right = nodes[r["children_left"]], nodes[r["children_right"]]
    for n in nodes:  # parents come before children
        for c in (n.left, n.right):
            if c:
                c.depth = n.depth + 1
    return nodes[0] if nodes else None


def to_frame(spark: SparkSession, root: Node | None) -> DataFrame:
    return spark.createDataFrame([tuple(r.values()) for r in to_rows(root)], SCHEMA)


def to_dict(root: Node | None, classifier: bool) -> dict:
    """Arrays by field, as for plotting or pickling."""
    rows = to_rows(root)
    drop = {"id", "value"} if classifier else {"id", "predicted_class", "proba"}
    out = {k: [r[k] for r in rows] for k in SCHEMA_NAMES if k not in drop}
    out["node_count"] = len(rows)
    if classifier:
        out["n_classes"] = max((len(r["proba"]) for r in rows), default=0)
    return out


def from_dict(tree: dict) -> Node | None:
    fields = {"predicted_class": -1, "proba": [], "value": math.nan}
    n = tree["node_count"]
    return from_rows([{"id": i} | {k: tree[k][i] if k in tree else fields.get(k) for k in SCHEMA_NAMES if k != "id"} for i in range(n)])


SCHEMA_NAMES = [p.split()[0] for p in SCHEMA.split(", ")]


def condition(node: Node, x: Column) -> Column:
    """Whether a row goes left; never NULL, and false for missing values and unknown categories."""
    v = finite(F.get(x, F.lit(node.feature)))
    if node.is_categorical:
        return F.coalesce(v == float(node.category), F.lit(False))
    tests = v.isNotNull()
    if math.isfinite(node.lower):
        tests = tests & (v >= node.lower)
    if math.isfinite(node.upper):
        tests = tests & (v < node.upper)
    return F.coalesce(tests, F.lit(False))


def route(rows: DataFrame, root: Node, x: str, out: str, label=lambda node: node.key) -> DataFrame:
    """``rows`` with ``out``: the label of the leaf that each row reaches."""

    def test(node: Node, levels: int) -> Column:
        if node.is_leaf or not levels:
            return F.lit(at[id(node)])
        return F.when(condition(node, F.col(x)), test(node.left, levels - 1)).otherwise(test(node.right, levels - 1))

    nodes = preorder(root)
    at = {id(n): i for i, n in enumerate(nodes)}
    rows = rows.withColumn(out, test(root, STEP_LEVELS))
    for top in range(STEP_LEVELS, max(n.depth for n in nodes), STEP_LEVELS):
        step = None
        for n in nodes:
            if n.depth == top and not n.is_leaf:
                step = (step or F).when(F.col(out) == at[id(n)], test(n, STEP_LEVELS))
        if step is not None:
            rows = rows.withColumn(out, step.otherwise(F.col(out)))
    labels = [label(n) for n in nodes]
    return rows if labels == list(range(len(nodes))) else rows.withColumn(out, F.get(F.lit(labels), F.col(out)))
