"""The estimators inside pyspark.ml: pipelines, saving, streams, odd rows."""

import math

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from coppice.estimators import TreeClassifier, TreeRegressor
from coppice.functions import criteria, metrics
from coppice.operators.encode import dense_index
from coppice.operators.folds import assign_folds
from coppice.plans.grow import prepared, told_apart
from coppice.streaming.score import score_stream


@pytest.fixture(scope="module")
def separable(spark):
    rows = [(i, 0.01 * i + (3 if i >= 60 else 0), "b" if i >= 60 else "a", 10.0 if i >= 60 else 0.0) for i in range(120)]
    return spark.createDataFrame(rows, "id long, x double, label string, y double").cache()


def stump(**p):
    return TreeClassifier(**{"featuresCols": ["x"], "idCol": "id", "maxDepth": 1, "mode": "fast", "nBins": 16} | p)


def test_fit_save_load_stream(spark, separable, tmp_path):
    model = stump(logProbabilityCol="logs").fit(separable)
    assert model.score(separable) > 0.95 and model.classes_ == ["a", "b"]
    model.write().save(f"{tmp_path}/m")
    again = type(model).load(f"{tmp_path}/m")
    assert again.toText() == model.toText() == model.toDebugString and again.classes_ == model.classes_
    odd = spark.createDataFrame([(1, math.nan), (2, None), (3, math.inf), (4, 0.0)], "id long, x double")
    out = {r["id"]: r for r in again.transform(odd).collect()}
    assert len({out[i]["prediction"] for i in (1, 2, 3)}) == 1 and out[4]["prediction"] == "a"
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in out.values())
    assert all((p == 0) == (v == -math.inf) for r in out.values() for p, v in zip(r["probability"], r["logs"]))
    separable.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(separable.schema).parquet(f"{tmp_path}/in")
    score_stream(model, stream, "parquet", f"{tmp_path}/cp", f"{tmp_path}/out").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").where("prediction = label").count() == model.transform(separable).where("prediction = label").count()


def test_pipeline_and_cross_validation(spark, separable, tmp_path):
    numbered = separable.withColumn("num", (separable["label"] == "b").cast("double"))
    est = stump(labelCol="num")
    pipe = Pipeline(stages=[est]).fit(numbered)
    pipe.write().save(f"{tmp_path}/p")
    assert PipelineModel.load(f"{tmp_path}/p").transform(numbered).count() == 120
    grid = ParamGridBuilder().addGrid(est.nBins, [4, 16]).build()
    evaluator = MulticlassClassificationEvaluator(labelCol="num", metricName="accuracy")
    assert max(CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=evaluator, numFolds=2, seed=1).fit(numbered).avgMetrics) > 0.9
    assert est.copy({est.maxDepth: 2}).getOrDefault("maxDepth") == 2


def test_regression(separable):
    for criterion, mode in (("mse", "fast"), ("mae", "strict")):
        model = TreeRegressor(featuresCols=["x"], labelCol="y", idCol="id", maxDepth=1, criterion=criterion, mode=mode, nBins=16).fit(separable)
        p = [r["prediction"] for r in model.transform(separable).orderBy("id").collect()]
        assert p[0] < 1 and p[-1] > 9 and model.score(separable) > 0.8


def test_recall_takes_all(separable):
    model = stump(objective="recall", posLabel=1).fit(separable)
    assert model.transform(separable).where("label = 'b' and prediction = 'a'").count() == 0


def test_errors(spark, separable):
    with pytest.raises(ValueError):
        stump(categoricalFeatures=[3]).fit(separable)
    with pytest.raises(ValueError):
        stump().fit(separable.limit(0))
    with pytest.raises(ValueError):
        TreeRegressor(featuresCols=["x"], labelCol="x").fit(spark.createDataFrame([(1.0,), (math.nan,)], "x double"))
    with pytest.raises(ValueError):
        stump().fit(separable).transform(separable.drop("x"))


def test_callable_criterion_and_objective(separable):
    plain, mine = stump(), stump()
    mine.custom_criterion = lambda counts, n: criteria.gini(counts, n)
    assert mine.fit(separable).toText() == plain.fit(separable).toText()
    plain, mine = stump(objective="accuracy"), stump()
    mine.custom_objective = lambda cm: metrics.safe_div(criteria.total(cm.tp) * 1.0, cm.total)
    assert mine.fit(separable).toText() == plain.fit(separable).toText()
    of = dict(featuresCols=["x"], labelCol="y", idCol="id", maxDepth=1, mode="fast")
    plain, mine = TreeRegressor(**of), TreeRegressor(**of)
    mine.custom_criterion = criteria.variance
    assert mine.fit(separable).toText() == plain.fit(separable).toText()


def test_no_features():
    with pytest.raises(ValueError, match="featuresCols is empty"):
        TreeClassifier(featuresCols=[])._growth()


@pytest.mark.parametrize("pieces", [1, 7])
def test_equal_rows_spread_over_folds(spark, pieces):
    rows = spark.createDataFrame([(i % 3, int(i % 3 == 1)) for i in range(120)], "c int, y int").repartition(pieces)
    kept = told_apart(prepared(rows, ["c"], (0,), F.col("y"), F.col("c").cast("string"))).cache()
    assert sorted(r["row_id"] for r in kept.collect()) == sorted(f"{c}:{n}" for c in range(3) for n in range(40))
    folds = assign_folds(kept.withColumn("node", F.lit(0)), 5, 7).groupBy("fold").count().collect()
    assert [r["count"] for r in folds] == [24] * 5


def test_dense_index_in_ranges(spark):
    rows = spark.createDataFrame([(f"v{i * 7919 % 1000}",) for i in range(3000)] + [(None,)], "v string")
    want = {v: i for i, v in enumerate(sorted({f"v{i}" for i in range(1000)}))}
    assert {r["v"]: r["code"] for r in dense_index(rows, "v").collect()} == want
    assert dense_index(rows.where("v is null"), "v").count() == 0
