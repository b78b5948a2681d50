"""The Spark fit against the plain model, over modes, styles, criteria, metrics and aggregators."""

import math
import random

import pytest

from coppice.estimators import TreeClassifier, TreeRegressor
from coppice.plans.nodes import Node

from .model import fit


def data(n=90, seed=0, classes=2):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        label = r.randrange(classes)
        a = label + r.gauss(0, 0.6) if r.random() > 0.1 else None
        b = float(r.randrange(6))
        c = float(r.choice([0, 1, 2]) if r.random() > 0.3 else label)
        rows.append((a, b, c, label))
    return rows


def shape(node: Node, classifier: bool):
    if node.is_leaf:
        return {"n": node.n_samples, "value": pytest.approx(node.proba if classifier else node.value)}
    rule = ("cat", node.feature, float(node.category)) if node.is_categorical else ("num", node.feature, node.lower, node.upper)
    return {"rule": rule, "left": shape(node.left, classifier), "right": shape(node.right, classifier)}


CASES = [
    dict(),
    dict(mode="fast"),
    dict(style="bin"),
    dict(mode="fast", style="bin", criterion="entropy"),
    dict(how="median", min_leaf=5),
    dict(how="trimmed_mean", mode="fast"),
    dict(how="signal_to_noise", mode="fast"),
    dict(how="mean_minus_lambda_std"),
    dict(objective="f1", mode="fast"),
    dict(objective="recall", average="macro"),
    dict(objective="precision", average="weighted", mode="fast", style="bin"),
    dict(objective="fbeta", beta=2.0, average="micro"),
    dict(objective="accuracy"),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: "-".join(map(str, c.values())) or "default")
def test_classifier_matches_model(spark, case):
    classes = 3 if case.get("average") else 2
    rows = data(classes=classes, seed=len(str(case)))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, a double, b double, c double, label int")
    want = fit([r[:3] for r in rows], [r[3] for r in rows], categorical=(2,), k_classes=classes, max_depth=2, n_bins=6, folds=4, **case)
    names = {"style": "splitStyle", "how": "aggregator", "min_leaf": "minSamplesLeaf"}
    est = TreeClassifier(featuresCols=["a", "b", "c"], categoricalFeatures=[2], idCol="id", maxDepth=2, nBins=6, cvFolds=4, **{names.get(k, k): v for k, v in case.items()})
    model = est.fit(df.repartition(3))
    assert want == shape(model.root, True)


@pytest.mark.parametrize("case", [dict(), dict(mode="fast"), dict(criterion="mae"), dict(style="bin", criterion="variance")], ids=str)
def test_regressor_matches_model(spark, case):
    rows = [(a, b, c, float(2 * label + (b > 3))) for a, b, c, label in data(70, 5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, a double, b double, c double, label double")
    case = {"criterion": "mse"} | case
    want = fit([r[:3] for r in rows], [r[3] for r in rows], categorical=(2,), max_depth=2, n_bins=5, folds=3, **case)
    names = {"style": "splitStyle"}
    est = TreeRegressor(featuresCols=["a", "b", "c"], categoricalFeatures=[2], idCol="id", maxDepth=2, nBins=5, cvFolds=3, **{names.get(k, k): v for k, v in case.items()})
    assert want == shape(est.fit(df).root, False)


def test_one_leaf_cases(spark):
    for labels, xs in (([1] * 5, range(5)), ([0], [1.0]), ([0, 1] * 10, [math.nan] * 20)):
        df = spark.createDataFrame([(i, float(x), y) for i, (x, y) in enumerate(zip(xs, labels))], "id long, x double, label int")
        model = TreeClassifier(featuresCols=["x"], idCol="id").fit(df)
        assert model.depth == 0 and model.numLeaves == 1 and model.transform(df).count() == len(labels)
