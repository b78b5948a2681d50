"""``pyspark.ml`` estimators and models of cross-validated trees."""

from __future__ import annotations

import json
import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.binning import finite, to_category
from .plans import nodes as trees
from .plans.grow import Growth, grow, prepared, told_apart
from .render import export_graphviz, export_text

_INT, _FLOAT, _STR, _BOOL = TypeConverters.toInt, TypeConverters.toFloat, TypeConverters.toString, TypeConverters.toBoolean


class _TreeParams(Params):
    featuresCols = Param(Params._dummy(), "featuresCols", "feature columns, in order", TypeConverters.toListString)
    categoricalFeatures = Param(Params._dummy(), "categoricalFeatures", "positions of features that hold category ids", TypeConverters.toListInt)
    labelCol = Param(Params._dummy(), "labelCol", "label column", _STR)
    idCol = Param(Params._dummy(), "idCol", "column of unique row keys; empty: a hash of the row's features and label, numbered where rows are equal", _STR)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column", _STR)
    criterion = Param(Params._dummy(), "criterion", "impurity", _STR)
    maxDepth = Param(Params._dummy(), "maxDepth", "largest depth; negative: no bound", _INT)
    minSamplesSplit = Param(Params._dummy(), "minSamplesSplit", "rows that a node needs to be split", _INT)
    minSamplesLeaf = Param(Params._dummy(), "minSamplesLeaf", "rows that both children need", _INT)
    minImpurityDecrease = Param(Params._dummy(), "minImpurityDecrease", "score that a split must exceed", _FLOAT)
    nBins = Param(Params._dummy(), "nBins", "quantile bins", _INT)
    cvFolds = Param(Params._dummy(), "cvFolds", "folds of each node", _INT)
    cvSeed = Param(Params._dummy(), "cvSeed", "seed of the folds", _INT)
    cvShuffle = Param(Params._dummy(), "cvShuffle", "draw folds at random instead of by row key", _BOOL)
    mode = Param(Params._dummy(), "mode", "strict: bins from training folds; fast: bins once from all rows", _STR)
    splitStyle = Param(Params._dummy(), "splitStyle", "threshold, or bin (one bin against the rest)", _STR)
    aggregator = Param(Params._dummy(), "aggregator", "how fold scores become one", _STR)
    aggFrac = Param(Params._dummy(), "aggFrac", "share cut at each end by trimmed_mean", _FLOAT)
    aggEps = Param(Params._dummy(), "aggEps", "added to the deviation by signal_to_noise", _FLOAT)
    #: Callables that replace the parameter of the same name; a saved estimator keeps none, a model needs none.
    custom_aggregator = custom_criterion = None
    aggLambda = Param(Params._dummy(), "aggLambda", "weight of the deviation in mean_minus_lambda_std", _FLOAT)

    def _defaults(self, **more) -> None:
        self._setDefault(
            labelCol="label", idCol="", predictionCol="prediction", categoricalFeatures=[], maxDepth=8, minSamplesSplit=2, minSamplesLeaf=1, minImpurityDecrease=0.0, nBins=8,
            cvFolds=5, cvSeed=42, cvShuffle=True, mode="strict", splitStyle="threshold", aggregator="mean", aggFrac=0.1, aggEps=1e-12, aggLambda=1.0, **more,
        )

    def _get(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def _growth(self, **more) -> Growth:
        d = len(self._get("featuresCols"))
        if not d:
            raise ValueError("featuresCols is empty")
        categorical = tuple(sorted(set(self._get("categoricalFeatures"))))
        if any(not 0 <= i < d for i in categorical):
            raise ValueError(f"categoricalFeatures must be positions below {d}, got {list(categorical)}")
        depth = self._get("maxDepth")
        return Growth(
            criterion=self.custom_criterion or self._get("criterion"), max_depth=None if depth < 0 else depth, min_samples_split=self._get("minSamplesSplit"), min_samples_leaf=self._get("minSamplesLeaf"),
            min_impurity_decrease=self._get("minImpurityDecrease"), n_bins=self._get("nBins"), cv_folds=self._get("cvFolds"), cv_seed=self._get("cvSeed"), cv_shuffle=self._get("cvShuffle"),
            mode=self._get("mode"), split_style=self._get("splitStyle"), aggregator=self.custom_aggregator or self._get("aggregator"), agg_frac=self._get("aggFrac"),
            agg_eps=self._get("aggEps"), agg_lambda=self._get("aggLambda"), categorical=categorical, **more,
        )

    def _rows(self, df: DataFrame, label, categorical) -> DataFrame:
        names = self._get("featuresCols")
        key = F.col(f"`{self._get('idCol')}`") if self._get("idCol") else F.md5(F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("?")) for c in [*names, self._get("labelCol")])).cast("binary"))
        rows = prepared(df, names, categorical, label, key)
        return rows if self._get("idCol") else told_apart(rows)

    @staticmethod
    def _need_rows(n: int) -> None:
        if not n:
            raise ValueError("there are no rows to fit")


class _TreeModel(Model, _TreeParams, MLReadable, MLWritable):
    root: trees.Node | None = None
    classes_: list | None = None

    @property
    def depth(self) -> int:
        return trees.depth(self.root)

    @property
    def numLeaves(self) -> int:
        return trees.n_leaves(self.root)

    def nodes(self, spark: SparkSession | None = None) -> DataFrame:
        return trees.to_frame(spark or SparkSession.getActiveSession(), self.root)

    def toDict(self) -> dict:
        return trees.to_dict(self.root, self.classes_ is not None)

    def toText(self, feature_names=None, class_names=None) -> str:
        return export_text(self.root, feature_names or self._get("featuresCols"), class_names or self.classes_)

    def toDot(self, feature_names=None, class_names=None) -> str:
        return export_graphviz(self.root, feature_names or self._get("featuresCols"), class_names or self.classes_)

    @property
    def toDebugString(self) -> str:
        return self.toText()

    def _routed(self, df: DataFrame) -> tuple[DataFrame, list[trees.Node]]:
        missing = [c for c in self._get("featuresCols") if c not in df.columns]
        if missing:
            raise ValueError(f"feature columns are missing: {missing}")
        names, categorical = self._get("featuresCols"), set(self._get("categoricalFeatures"))
        expr = F.array(*(finite(F.col(f"`{c}`")) if i not in categorical else to_category(F.col(f"`{c}`")).cast("double") for i, c in enumerate(names)))
        found = trees.preorder(self.root)
        at = {id(n): i for i, n in enumerate(found)}
        return trees.route(df.withColumn("_x", expr), self.root, "_x", "_leaf", lambda n: at[id(n)]).drop("_x"), found

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: _TreeModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        DefaultParamsWriter.saveMetadata(self.model, path, spark, extraMetadata={"classes": json.dumps(self.model.classes_)})
        trees.to_frame(spark, self.model.root).coalesce(1).write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = SparkSession.getActiveSession()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls()
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        model.classes_ = json.loads(meta["classes"])
        model.root = trees.from_rows([r.asDict() for r in spark.read.parquet(f"{path}/nodes").collect()])
        return model


class TreeClassificationModel(_TreeModel):
    probabilityCol = Param(Params._dummy(), "probabilityCol", "class probabilities", _STR)
    logProbabilityCol = Param(Params._dummy(), "logProbabilityCol", "logarithms of the probabilities; none if empty", _STR)

    def __init__(self):
        super().__init__()
        self._defaults(criterion="gini", probabilityCol="probability", logProbabilityCol="")

    def _transform(self, df: DataFrame) -> DataFrame:
        out, found = self._routed(df)
        values = [self.classes_[n.predicted_class] if n.is_leaf else self.classes_[0] for n in found]
        out = out.withColumn(self._get("predictionCol"), F.get(F.lit(values), F.col("_leaf")))
        proba = F.get(F.array(*(F.array(*(F.lit(float(p)) for p in n.proba)) if n.is_leaf else F.expr("cast(array() as array<double>)") for n in found)), F.col("_leaf"))
        out = out.withColumn(self._get("probabilityCol"), proba)
        if self._get("logProbabilityCol"):
            logs = F.transform(F.col(self._get("probabilityCol")), lambda p: F.when(p > 0, F.log(p)).otherwise(F.lit(-math.inf)))
            out = out.withColumn(self._get("logProbabilityCol"), logs)
        return out.drop("_leaf")

    def score(self, df: DataFrame) -> float:
        """Accuracy."""
        return self.transform(df).select(F.avg((F.col(self._get("predictionCol")) == F.col(self._get("labelCol"))).cast("double"))).first()[0]


class TreeRegressionModel(_TreeModel):
    def __init__(self):
        super().__init__()
        self._defaults(criterion="mse")

    def _transform(self, df: DataFrame) -> DataFrame:
        out, found = self._routed(df)
        return out.withColumn(self._get("predictionCol"), F.get(F.lit([float(n.value) for n in found]), F.col("_leaf"))).drop("_leaf")

    def score(self, df: DataFrame) -> float:
        """Coefficient of determination."""
        y, p = F.col(self._get("labelCol")).cast("double"), F.col(self._get("predictionCol"))
        r = self.transform(df).select(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)).first()
        return 1 - r[0] / r[1] if r[1] else (1.0 if not r[0] else 0.0)


class TreeClassifier(Estimator, _TreeParams, MLReadable, MLWritable):
    """Labels of any ordered type; ``classes_`` of the model is their sorted list. Rows without a label are an error."""

    probabilityCol = TreeClassificationModel.probabilityCol
    logProbabilityCol = TreeClassificationModel.logProbabilityCol
    objective = Param(Params._dummy(), "objective", "metric to grow by instead of impurity; none if empty", _STR)
    average = Param(Params._dummy(), "average", "binary, micro, macro or weighted", _STR)
    posLabel = Param(Params._dummy(), "posLabel", "position of the positive class among the sorted labels", _INT)
    beta = Param(Params._dummy(), "beta", "beta of fbeta", _FLOAT)
    custom_objective = None

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._defaults(criterion="gini", probabilityCol="probability", logProbabilityCol="", objective="", average="binary", posLabel=1, beta=1.0)
        self._set(**self._input_kwargs)

    def setParams(self, **kwargs):
        return self._set(**kwargs)

    def _fit(self, df: DataFrame) -> TreeClassificationModel:
        label = F.col(f"`{self._get('labelCol')}`")
        classes = sorted(r[0] for r in df.select(label).distinct().limit(10_001).collect() if r[0] is not None)
        if len(classes) > 10_000:
            raise ValueError("more than 10,000 classes")
        if df.where(label.isNull()).limit(1).count():
            raise ValueError("rows without a label")
        self._need_rows(len(classes))
        pos = self._get("posLabel")
        growth = self._growth(n_classes=len(classes), objective=self.custom_objective or self._get("objective") or None, average=self._get("average"), pos_label=pos if 0 <= pos < len(classes) else 0, beta=self._get("beta"))
        index = F.array_position(F.lit(classes), label).cast("int") - 1
        model = self._copyValues(TreeClassificationModel()._resetUid(self.uid))
        model.root, model.classes_ = grow(self._rows(df, index, growth.categorical), len(self._get("featuresCols")), growth), classes
        return model

    def write(self):
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls):
        return DefaultParamsReader(cls)


class TreeRegressor(Estimator, _TreeParams, MLReadable, MLWritable):
    """Labels are doubles; missing ones are an error."""

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._defaults(criterion="mse")
        self._set(**self._input_kwargs)

    def setParams(self, **kwargs):
        return self._set(**kwargs)

    def _fit(self, df: DataFrame) -> TreeRegressionModel:
        label = F.col(f"`{self._get('labelCol')}`").cast("double")
        bad, n = df.select(F.count_if(finite(label).isNull()), F.count("*")).first()
        if bad:
            raise ValueError("labels that are not finite")
        self._need_rows(n)
        growth = self._growth()
        model = self._copyValues(TreeRegressionModel()._resetUid(self.uid))
        model.root = grow(self._rows(df, label, growth.categorical), len(self._get("featuresCols")), growth)
        return model

    def write(self):
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls):
        return DefaultParamsReader(cls)
