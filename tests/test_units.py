"""Exact values of the building blocks."""

import math

import pytest
from pyspark.sql import functions as F

from coppice import parity
from coppice.functions import binning, criteria, metrics, reducers
from coppice.operators import encode, folds, quantiles, scoring
from coppice.plans import nodes as trees
from coppice.plans.grow import Growth
from coppice.render import export_graphviz, export_text

from .model import folds_of


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, column):
    return one.select(column.alias("v")).first()["v"]


def lits(*xs):
    return [F.lit(x) for x in xs]


def doubles(xs):
    return F.array(*(F.lit(float(x)) for x in xs)) if xs else F.expr("cast(array() as array<double>)")


def test_criteria(one):
    got = one.select(
        criteria.gini(lits(2, 2)), criteria.gini(lits(4, 0)), criteria.gini(lits(1, 1, 1)), criteria.gini(lits(0, 0)),
        criteria.entropy(lits(1, 1)), criteria.entropy(lits(0, 4)), criteria.entropy(lits(3, 1)), criteria.entropy(lits(0, 0)),
        criteria.variance(*lits(2, 4.0, 10.0)), criteria.variance(*lits(3, 15.0, 75.0)), criteria.variance(*lits(4, 20.0, 200.0)), criteria.variance(*lits(0, 0.0, 0.0)),
        criteria.mae(doubles([0, 0, 10, 10])), criteria.mae(doubles([1, 2, 3])), criteria.mae(doubles([])),
    ).first()
    h = -(0.75 * math.log2(0.75) + 0.25 * math.log2(0.25))
    assert list(got) == pytest.approx([0.5, 0, 2 / 3, 0, 1, 0, h, 0, 1, 0, 25, 0, 5, 2 / 3, 0], abs=1e-9)


@pytest.mark.parametrize("n_bins,want", [(2, [5]), (5, [2, 4, 6, 8]), (1, None)])
def test_edges(spark, n_bins, want):
    df = spark.createDataFrame([(0, float(v)) for v in [*range(10), math.nan, math.inf]], "g int, v double")
    got = quantiles.quantile_edges(df, ["g"], "v", n_bins).collect()
    assert [r["edges"] for r in got] == ([want] if want else [])
    assert quantiles.quantile_edges(df.where("v > 1e300"), ["g"], "v", 4).count() == 0


def test_edges_of_folds_match_model(spark):
    from .model import edges_of

    rows = [(i % 3, float((i * 37) % 11), i % 4) for i in range(50)] + [(0, None, 1)]
    df = spark.createDataFrame(rows, "g int, v double, f int")
    for r in quantiles.quantile_edges(df, ["g"], "v", 6, "f", 4, ranges=3).collect():
        assert r["edges"] == edges_of([v for g, v, f in rows if g == r["g"] and f != r["view"]], 6)


def test_bins(one):
    e = doubles([2, 4, 6, 8])
    codes = one.select(*(binning.bin_code(e, F.lit(float(x))).alias(f"c{i}") for i, x in enumerate((1, 3, 4, 9, math.nan, math.inf)))).first()
    assert list(codes) == [0, 1, 2, 4, None, None]
    bounds = one.select(*(binning.bin_bounds(e, F.lit(b)).alias(f"b{b}") for b in (0, 2, 4, 5))).first()
    assert [b and tuple(b) for b in bounds] == [(None, 2.0), (4.0, 6.0), (8.0, None), None]
    inside = one.select(*(binning.in_interval(F.lit(float(x)), F.lit(1.0), F.lit(3.0)).alias(f"i{i}") for i, x in enumerate((0.5, 1, 2.9, 3, math.nan)))).first()
    assert list(inside) == [False, True, True, False, False]
    cats = one.select(*(binning.to_category(F.lit(float(x))).alias(f"t{i}") for i, x in enumerate((0.5, 2.4, -0.1, -1, math.nan, 4294967295, 4294967294)))).first()
    assert list(cats) == [1, 2, None, None, None, None, 4294967294]


def test_reducers(spark):
    def reduced(scores, *args):
        df = spark.createDataFrame([(float(s),) for s in scores], "gain double")
        return df.agg(*reducers.fold_stats()).select(reducers.reducer(*args)).first()[0]

    assert reduced([1, 2, 3], "mean") == 2
    assert reduced([1, 2, 3, 4], "median") == 2.5
    assert reduced([1, 2, 3, 4, 100], "trimmed_mean", 0.25) == 3
    assert reduced([1, 2, 3, 4, 100], "trimmed_mean", 0.0) == 22
    assert reduced([1, 2, 3], "signal_to_noise", 0.1, 0.0) == pytest.approx(2 / math.sqrt(2 / 3))
    assert reduced([1, 2, 3], "mean_minus_lambda_std") == pytest.approx(2 - math.sqrt(2 / 3))
    assert reduced([1, 2, 3], lambda **s: F.array_max(s["scores"])) == 3
    with pytest.raises(ValueError):
        reducers.reducer("sum")


def test_metrics(one):
    cm = metrics.confusion([(F.lit(1), lits(2, 8)), (F.lit(0), lits(5, 1))])
    assert one.select(*cm.tp, *cm.fp, *cm.fn, *cm.support, cm.total).first()[:] == (5, 8, 1, 2, 2, 1, 7, 9, 16)
    want = {
        ("precision", "binary", 1): 0.8, ("precision", "binary", 0): 5 / 6, ("precision", "macro", 1): (5 / 6 + 0.8) / 2, ("precision", "micro", 1): 13 / 16,
        ("precision", "weighted", 1): (7 * 5 / 6 + 9 * 0.8) / 16, ("recall", "binary", 1): 8 / 9, ("f1", "binary", 1): 16 / 19, ("accuracy", "binary", 1): 13 / 16, ("f1", "binary", 9): 0,
    }
    for (name, average, pos), v in want.items():
        assert value(one, metrics.metric(cm, name, average, pos)) == pytest.approx(v, abs=1e-9)
    assert value(one, metrics.metric(cm, "fbeta", "binary", 1, 2.0)) == pytest.approx(40 / 46)
    three = metrics.confusion([(F.lit(0), lits(6, 2, 0)), (F.lit(1), lits(1, 5, 1)), (F.lit(2), lits(0, 0, 4))])
    assert value(one, metrics.metric(three, "recall", "macro")) == pytest.approx((6 / 7 + 5 / 7 + 4 / 5) / 3)
    nothing = metrics.confusion([(F.lit(0), lits(0, 0))])
    assert all(value(one, metrics.metric(nothing, m)) == 0 for m in metrics.OBJECTIVES)


def test_select_best(spark):
    df = spark.createDataFrame([(0, 3, 5, 0.5), (0, 1, 9, 0.5), (0, 1, 2, 0.5), (1, 0, 0, math.nan), (1, 0, 1, -math.inf)], "node int, feature int, state int, score double")
    assert [(r["feature"], r["state"]) for r in scoring.select_best(df).collect()] == [(1, 2)]
    assert scoring.select_best(df.where("node = 1")).count() == 0


@pytest.mark.parametrize("n,k", [(10, 5), (3, 10), (12, 5), (1, 4)])
def test_folds(spark, n, k):
    df = spark.createDataFrame([(i, g) for g in (0, 1) for i in range(g * 100, g * 100 + n)], "row_id long, node int")
    got = {r["row_id"]: r["fold"] for r in folds.assign_folds(df.repartition(3), k, 7).collect()}
    for g in (0, 1):
        ids = [i for i in got if i // 100 == g]
        assert {i: got[i] for i in ids} == folds_of(ids, k, 7)[0]
    plain = {r["row_id"]: r["fold"] for r in folds.assign_folds(df.where("node = 0"), k, shuffle=False).collect()}
    assert [plain[i] for i in range(n)] == sorted(plain.values()) and len(set(plain.values())) == min(n, k)


def test_parity_folds():
    got = parity.shuffled_folds(list(range(12)), 5, 42)
    assert sorted(list(got.values()).count(f) for f in range(5)) == [2, 2, 2, 3, 3]
    assert parity.shuffled_folds([4, 9], 5, 1, shuffle=False) == {4: 0, 9: 1}
    assert parity.SplitMix64(0).next() == 0xE220A8397B1DCDAF


def test_dense_index(spark):
    df = spark.createDataFrame([(7,), (2,), (7,), (2,), (None,)], "c int")
    assert sorted((r["c"], r["code"]) for r in encode.encoded(df, "c").where("c is not null").collect()) == [(2, 0), (2, 0), (7, 1), (7, 1)]


def tree():
    leaf = lambda p, n, d: trees.Node(n_samples=n, proba=[1 - p, p], depth=d)
    left = trees.Node(n_samples=6, feature=1, is_categorical=True, category=4, depth=1, left=leaf(0.25, 4, 2), right=leaf(1.0, 2, 2))
    return trees.Node(n_samples=10, feature=0, lower=-math.inf, upper=2.5, left=left, right=leaf(0.5, 4, 1))


def test_render_and_tables(spark):
    text = export_text(tree(), ["a", "b"], ["no", "yes"])
    assert text.splitlines()[:3] == ["if a < 2.5:", "  if b == 4:", "    class=no n=4 proba=[0.750, 0.250]"]
    assert text.splitlines()[-2:] == ["else:  # not (a < 2.5)", "  class=no n=4 proba=[0.500, 0.500]"]
    dot = export_graphviz(tree(), ["a", 'b"'])
    assert '0 [label="a < 2.5\\nn=10"]' in dot and 'b\\" == 4' in dot and '0 -> 1 [label="true"] ;' in dot
    assert export_text(None) == "(empty tree)" and "empty" in export_graphviz(None)
    d = trees.to_dict(tree(), True)
    assert d["children_left"] == [1, 2, -1, -1, -1] and d["children_right"] == [4, 3, -1, -1, -1] and d["node_count"] == 5
    assert export_text(trees.from_dict(d)) == export_text(tree())
    back = trees.from_rows([r.asDict() for r in trees.to_frame(spark, tree()).collect()])
    assert trees.depth(back) == 2 and trees.n_leaves(back) == 3 and export_text(back) == export_text(tree())


def test_deep_route(spark):
    node = trees.Node(depth=20, key=20)
    for d in range(19, -1, -1):
        node = trees.Node(feature=0, lower=-math.inf, upper=float(d), depth=d, left=trees.Node(depth=d + 1, key=d), right=node)
    stack = [(node, 0)]
    while stack:
        n, d = stack.pop()
        n.depth = d
        stack += [(c, d + 1) for c in (n.left, n.right) if c]
    df = spark.createDataFrame([([float(i)], i) for i in range(-1, 25)] + [([None], 99)], "x array<double>, i int")
    got = {r["i"]: r["leaf"] for r in trees.route(df, node, "x", "leaf").collect()}
    assert got == {i: min(i + 1, 20) for i in range(-1, 25)} | {99: 20}


@pytest.mark.parametrize("bad", [dict(mode="x"), dict(n_bins=1), dict(cv_folds=1), dict(aggregator="max"), dict(criterion="mse"), dict(split_style="x"), dict(objective="auc"), dict(average="x")])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        Growth(n_classes=2, **bad).check()


def test_mae_needs_strict():
    with pytest.raises(ValueError):
        Growth(criterion="mae", mode="fast").check()


def test_mae_by_group_of_odd_and_large_groups(spark, tmp_path):
    import time

    from coppice.queries import QUERIES

    rows = [(1, float(v * 7919 % 30_000)) for v in range(30_000)] + [(2, None), (2, None), (3, 4.0), (3, None), (3, 1.0), (None, 2.0), (None, 2.0), (None, 8.0), (4, math.inf), (4, 1.0), (4, 2.0), (5, math.nan), (5, 1.0)]
    spark.createDataFrame(rows, "p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    begun = time.time()
    got = {r["p_size"]: r["impurity"] for r in QUERIES["mae_by_group"](spark, str(tmp_path)).collect()}
    assert time.time() - begun < 60  # sorting the group for each of its values took minutes
    assert math.isnan(got.pop(5)) and got == {1: 7500.0, 2: None, 3: 1.5, None: 2.0, 4: math.inf}
