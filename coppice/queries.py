"""Queries of the tree operators over the driver's tables, each with DuckDB SQL where SQL can express it.

Doubles are rounded to 6 decimals on both sides. Folds are drawn from md5(seed:n:row_id) in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .estimators import TreeClassifier, TreeRegressor
from .functions import binning, criteria, metrics, reducers
from .operators import encode, folds, quantiles, scoring
from .plans import nodes as trees
from .plans.grow import Growth, Grower, _coded
from .sources.tables import LINEITEM_SQL, lineitem_rows, read

SEED, K, BINS = 42, 5, 8
FEATURES = ("quantity", "price", "discount")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _r(c, name: str):
    return F.round(c, 6).alias(name)


# ---------------------------------------------------------------- bins and encodings


def _cells(spark, d):
    return lineitem_rows(spark, d).select("row_id", F.posexplode(F.array(*FEATURES)).alias("feature", "v"))


_CELLS_SQL = f"WITH {LINEITEM_SQL}, cells AS (" + " UNION ALL ".join(f"SELECT row_id, {i} AS feature, {c} AS v FROM rows" for i, c in enumerate(FEATURES)) + ")"


def _edges_sql(n: int, source: str = "cells", group: str = "feature") -> str:
    return f"""ranked AS (SELECT {group}, v, row_number() OVER (PARTITION BY {group} ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY {group}) AS m FROM {source} WHERE isfinite(v)),
edges AS (SELECT {group}, list(v ORDER BY i) AS edges FROM ranked JOIN range(1, {n}) t(i) ON r = least(i * m // {n}, m - 1) GROUP BY {group})"""


def _quantile(n):
    def run(spark, d):
        return quantiles.quantile_edges(_cells(spark, d), ["feature"], "v", n).select(F.col("feature").cast("long").alias("feature"), F.posexplode("edges").alias("i", "edge")).withColumn("i", F.col("i").cast("long"))

    return run


def _quantile_sql(n):
    return _CELLS_SQL + f", {_edges_sql(n)} SELECT CAST(feature AS BIGINT) AS feature, CAST(i - 1 AS BIGINT) AS i, edges[i] AS edge FROM (SELECT feature, edges, unnest(range(1, {n})) AS i FROM edges)"


_add("quantile_edges", _quantile(BINS), _quantile_sql(BINS))
_add("quantile_edges_dups", _quantile(64), _quantile_sql(64))


def _with_edges(spark, d):
    cells = _cells(spark, d)
    edges = quantiles.quantile_edges(cells, ["feature"], "v", BINS)
    return cells.join(F.broadcast(edges), "feature", "left").withColumn("code", binning.bin_code(F.col("edges"), F.col("v")))


_CODES_SQL = _CELLS_SQL + f", {_edges_sql(BINS)}, coded AS (SELECT row_id, feature, v, edges, CASE WHEN isfinite(v) THEN len(list_filter(edges, lambda e: e <= v)) END AS code FROM cells LEFT JOIN edges USING (feature))"

_add(
    "bin_codes",
    lambda s, d: _with_edges(s, d).groupBy(F.col("feature").cast("long").alias("feature"), F.coalesce("code", F.lit(-1)).cast("long").alias("code")).agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total")),
    _CODES_SQL + " SELECT CAST(feature AS BIGINT) AS feature, CAST(coalesce(code, -1) AS BIGINT) AS code, count(*) AS n, round(sum(v), 2) AS total FROM coded GROUP BY ALL",
)


def _bounds(spark, d):
    edges = quantiles.quantile_edges(_cells(spark, d), ["feature"], "v", BINS)
    codes = edges.select(F.col("feature").cast("long").alias("feature"), "edges", F.explode(F.sequence(F.lit(0), F.lit(BINS))).alias("code"))
    return codes.select("feature", F.col("code").cast("long").alias("code"), binning.bin_bounds(F.col("edges"), F.col("code")).alias("b")).select("feature", "code", F.col("b").isNotNull().alias("exists"), "b.lower", "b.upper")


_add(
    "bin_bounds",
    _bounds,
    _CELLS_SQL
    + f", {_edges_sql(BINS)} SELECT CAST(feature AS BIGINT) AS feature, code, code <= len(edges) AS exists, CASE WHEN code BETWEEN 1 AND len(edges) THEN edges[code] END AS lower, CASE WHEN code < len(edges) THEN edges[code + 1] END AS upper FROM (SELECT feature, edges, unnest(range(0, {BINS + 1})) AS code FROM edges)",
)
_add(
    "missing_codes",
    lambda s, d: _with_edges(s, d).groupBy(F.col("feature").cast("long").alias("feature")).agg(F.count_if(F.col("code").isNull()).alias("n_missing"), F.count("code").alias("n_coded")),
    _CODES_SQL + " SELECT CAST(feature AS BIGINT) AS feature, count(*) FILTER (code IS NULL) AS n_missing, count(code) AS n_coded FROM coded GROUP BY 1",
)
_add(
    "present_states",
    lambda s, d: encode.present_states(_with_edges(s, d).withColumn("node", F.lit(0))).select(*(F.col(c).cast("long").alias(c) for c in ("node", "feature", "state"))),
    _CODES_SQL + " SELECT DISTINCT 0::BIGINT AS node, CAST(feature AS BIGINT) AS feature, CAST(code AS BIGINT) AS state FROM coded WHERE code IS NOT NULL",
)
_add(
    "categorical_index",
    lambda s, d: encode.encoded(read(s, d, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "p_brand", F.col("code").cast("long").alias("code")),
    "SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part",
)
_add(
    "label_encode",
    lambda s, d: encode.dense_index(read(s, d, "customer"), "c_mktsegment").select("c_mktsegment", F.col("code").cast("long").alias("code")),
    "SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)",
)
_add(
    "to_category",
    lambda s, d: read(s, d, "customer").select("c_custkey", F.coalesce(binning.to_category(F.col("c_acctbal") / 100), F.lit(-1)).alias("category")),
    "SELECT c_custkey, CASE WHEN c_acctbal / 100 >= 0 THEN CAST(floor(c_acctbal / 100 + 0.5) AS BIGINT) ELSE -1 END AS category FROM customer",
)

# ---------------------------------------------------------------- folds


def _folded(spark, d, k=K, shuffle=True, node="0"):
    return folds.assign_folds(lineitem_rows(spark, d).withColumn("node", F.expr(node)), k, SEED, shuffle)


def _folds_sql(k=K, shuffle=True, node="0", source="rows"):
    order = f"md5(concat_ws(':', '{SEED}', n, row_id)), row_id" if shuffle else "row_id"
    return f"folded AS (SELECT *, CAST(ntile({k}) OVER (PARTITION BY node ORDER BY {order}) - 1 AS INT) AS fold FROM (SELECT *, count(*) OVER (PARTITION BY node) AS n FROM (SELECT *, {node} AS node FROM {source})))"


_FOLD_OUT = lambda df: df.select("row_id", F.col("node").cast("long").alias("node"), F.col("fold").cast("long").alias("fold"))
_FOLD_SQL = " SELECT row_id, CAST(node AS BIGINT) AS node, CAST(fold AS BIGINT) AS fold FROM folded"
_add("kfold_shuffled", lambda s, d: _FOLD_OUT(_folded(s, d)), f"WITH {LINEITEM_SQL}, {_folds_sql()}" + _FOLD_SQL)
_add("kfold_ordered", lambda s, d: _FOLD_OUT(_folded(s, d, shuffle=False)), f"WITH {LINEITEM_SQL}, {_folds_sql(shuffle=False)}" + _FOLD_SQL)
_add("kfold_by_node", lambda s, d: _FOLD_OUT(_folded(s, d, 7, node="flag")), f"WITH {LINEITEM_SQL}, {_folds_sql(7, node='flag')}" + _FOLD_SQL)


def _small(spark, d):
    rows = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("row_id"), F.col("n_regionkey").alias("node"))
    return _FOLD_OUT(folds.assign_folds(rows, 12, SEED))


_add("kfold_small_n", _small, "WITH " + _folds_sql(12, node="n_regionkey", source="(SELECT CAST(n_nationkey AS VARCHAR) AS row_id, n_regionkey FROM nation)") + _FOLD_SQL)

# ---------------------------------------------------------------- impurity


def _by_group(expr):
    def run(spark, d):
        flags = lineitem_rows(spark, d).groupBy(F.col("status").cast("long").alias("status"))
        return flags.agg(*(m.alias(k) for k, m in scoring.class_measures(3, "flag").items())).select("status", _r(expr([F.col(f"c{i}") for i in range(3)]), "impurity"))

    return run


_SHARES = f"WITH {LINEITEM_SQL}, c AS (SELECT status, flag, count(*) AS n FROM rows GROUP BY ALL), p AS (SELECT status, n / sum(n) OVER (PARTITION BY status) AS p FROM c)"
_add("gini_by_group", _by_group(criteria.gini), _SHARES + " SELECT CAST(status AS BIGINT) AS status, round(1 - sum(p * p), 6) AS impurity FROM p GROUP BY 1")
_add("entropy_by_group", _by_group(criteria.entropy), _SHARES + " SELECT CAST(status AS BIGINT) AS status, round(-sum(p * log2(p)), 6) AS impurity FROM p GROUP BY 1")
_add(
    "variance_by_group",
    lambda s, d: lineitem_rows(s, d).groupBy(F.col("flag").cast("long").alias("flag")).agg(*(m.alias(k) for k, m in scoring.moment_measures("quantity").items())).select("flag", _r(criteria.variance(F.col("n"), F.col("s"), F.col("q")), "impurity")),
    f"WITH {LINEITEM_SQL} SELECT CAST(flag AS BIGINT) AS flag, round(sum(quantity * quantity) / count(*) - (sum(quantity) / count(*)) ** 2, 6) AS impurity FROM rows GROUP BY 1",
)


def _mae_by_group(spark, d):
    """Each group's median is searched by its ranks, so no group has to fit one row."""
    part = read(spark, d, "part").select(F.struct("p_size").alias("g"), "p_retailprice")  # a struct, as null is a group, too
    middle = quantiles.medians(part, ["g"], "p_retailprice")
    off = F.abs(F.col("p_retailprice") - F.col("median"))
    return part.join(F.broadcast(middle), "g", "left").groupBy(F.col("g.p_size").alias("p_size")).agg(_r(F.avg(off), "impurity"))


_add(
    "mae_by_group",
    _mae_by_group,
    "SELECT p_size, round(avg(abs(p_retailprice - m)), 6) AS impurity FROM (SELECT *, median(p_retailprice) OVER (PARTITION BY p_size) AS m FROM part) GROUP BY 1",
)

# ---------------------------------------------------------------- histograms and gains at the root


def _grower(spark, d, **p):
    growth = Growth(n_classes=p.pop("n_classes", 2), cv_folds=K, cv_seed=SEED, n_bins=BINS, **p)
    return Grower(lineitem_rows(spark, d), 4, growth)


#: Features 0..2 are continuous, 3 (status) is a category.
def _bare(spark, d, label="big"):
    return lineitem_rows(spark, d).select("row_id", F.lit(0).alias("node"), F.col(label).alias("y"), F.array(*(F.col(c).cast("double") for c in (*FEATURES, "status"))).alias("x"))


def _level(spark, d, label="big"):
    return folds.assign_folds(_bare(spark, d, label), K, SEED)


def _fast_coded(spark, d, label="big"):
    rows = _bare(spark, d, label)
    level = folds.assign_folds(rows, K, SEED)
    cells = rows.select(F.posexplode("x").alias("feature", "v")).where("feature < 3")
    found = {r["feature"]: r["edges"] for r in quantiles.quantile_edges(cells, ["feature"], "v", BINS).collect()}
    edges = [list(found.get(i, [])) for i in range(4)]
    arrays = F.array(*(F.array(*map(F.lit, e)) if e else F.expr("cast(array() as array<double>)") for e in edges))
    return level.withColumn("codes", _coded(arrays, F.col("x"), (3,))), edges


_FAST_SQL = f"""WITH {LINEITEM_SQL}, {_folds_sql()},
raw AS ({" UNION ALL ".join(f"SELECT row_id, fold, big, flag, quantity, cents, {i} AS feature, CAST({c} AS DOUBLE) AS v FROM folded" for i, c in enumerate((*FEATURES, "status")))}),
{_edges_sql(BINS, "(SELECT feature, v FROM raw WHERE feature < 3)")},
coded AS (SELECT raw.*, CASE WHEN feature = 3 THEN CAST(v AS BIGINT) WHEN isfinite(v) THEN len(list_filter(edges, lambda e: e <= v)) END AS code FROM raw LEFT JOIN edges USING (feature))"""


def _class_hist(spark, d):
    coded, _ = _fast_coded(spark, d)
    cells = scoring.fold_cells(scoring.unpivot(coded, "codes", ["node", "fold", "y"]), scoring.class_measures(2), False)
    return cells.select(*(F.col(c).cast("long").alias(c) for c in ("feature", "fold", "code", "c0", "c1")))


_add("fold_class_histogram", _class_hist, _FAST_SQL + " SELECT CAST(feature AS BIGINT) AS feature, CAST(fold AS BIGINT) AS fold, CAST(code AS BIGINT) AS code, count(*) FILTER (big = 0) AS c0, count(*) FILTER (big = 1) AS c1 FROM coded WHERE code IS NOT NULL GROUP BY 1, 2, 3")


def _moment_hist(spark, d):
    coded, _ = _fast_coded(spark, d, "cents")
    cells = scoring.fold_cells(scoring.unpivot(coded, "codes", ["node", "fold", "y"]), {"n": F.count("y"), "s": F.sum("y")}, False)
    return cells.select(*(F.col(c).cast("long").alias(c) for c in ("feature", "fold", "code", "n", "s")))


_add("fold_moment_histogram", _moment_hist, _FAST_SQL + " SELECT CAST(feature AS BIGINT) AS feature, CAST(fold AS BIGINT) AS fold, CAST(code AS BIGINT) AS code, count(*) AS n, CAST(sum(cents) AS BIGINT) AS s FROM coded WHERE code IS NOT NULL GROUP BY 1, 2, 3")


def _gains(style, criterion, label="big", classes=2, features=(0, 1, 2)):
    def run(spark, d):
        coded, edges = _fast_coded(spark, d, label)
        measures = scoring.class_measures(classes) if classes else scoring.moment_measures()
        ordered = (F.col("feature") < 3) if style == "threshold" else F.lit(False)
        cells = scoring.fold_cells(scoring.unpivot(coded, "codes", ["node", "fold", "y"]).where(F.col("feature").isin(*features)), measures, False)
        states = cells.select("node", "feature", F.col("code").alias("state")).distinct().where(~ordered | (F.col("state") < BINS - 1))
        split = scoring.sides(scoring.dense(cells, states, list(measures)), list(measures), ordered)
        gains = scoring.impurity_gains(split, list(measures), criterion)
        scored = scoring.candidates(gains, states)
        return scored

    return run


def _score_out(df):
    return df.select(*(F.col(c).cast("long").alias(c) for c in ("feature", "state", "n_success")), _r(F.col("score"), "score"))


def _gain_sql(style, criterion, y="big", classes=2, features="0, 1, 2", extra=None):
    side = "CASE WHEN feature < 3 THEN c.code <= s.state ELSE c.code = s.state END" if style == "threshold" else "c.code = s.state"
    top = f"WHERE feature = 3 OR state < {BINS - 1}" if style == "threshold" else ""
    if classes:
        imp = {"gini": "1 - sum((n / t) ** 2)", "entropy": "-sum(CASE WHEN n > 0 THEN n / t * log2(n / t) ELSE 0 END)"}[criterion]
        per = f"""h AS (SELECT feature, state, fold, l, y, count(*) AS n FROM sided GROUP BY ALL),
i AS (SELECT feature, state, fold, l, any_value(t) AS t, {imp} AS imp FROM (SELECT *, sum(n) OVER (PARTITION BY feature, state, fold, l) AS t FROM h) GROUP BY ALL),
w AS (SELECT feature, state, fold, any_value(t) AS t, {imp} AS imp FROM (SELECT *, sum(n) OVER (PARTITION BY feature, state, fold) AS t FROM (SELECT feature, state, fold, y, sum(n) AS n FROM h GROUP BY ALL)) GROUP BY ALL)"""
    else:
        imp = "greatest(sum(y * y) / count(*) - (sum(y) / count(*)) ** 2, 0)"
        per = f"i AS (SELECT feature, state, fold, l, count(*) AS t, {imp} AS imp FROM sided GROUP BY ALL), w AS (SELECT feature, state, fold, count(*) AS t, {imp} AS imp FROM sided GROUP BY ALL)"
    return (
        _FAST_SQL
        + f""", states AS (SELECT DISTINCT feature, code AS state FROM coded WHERE code IS NOT NULL AND feature IN ({features})), st AS (SELECT * FROM states {top}),
sided AS (SELECT s.feature, s.state, c.fold, c.{y} AS y, {side} AS l FROM coded c JOIN st s USING (feature) WHERE c.code IS NOT NULL),
{per},
g AS (SELECT w.feature, w.state, w.fold, w.imp - sum(i.t * i.imp) / any_value(w.t) AS gain FROM w JOIN i USING (feature, state, fold) GROUP BY w.feature, w.state, w.fold, w.imp HAVING count(*) = 2)"""
        + (extra or " SELECT CAST(feature AS BIGINT) AS feature, CAST(state AS BIGINT) AS state, count(*) AS n_success, round(avg(gain), 6) AS score FROM g GROUP BY 1, 2")
    )


for _style in ("threshold", "bin"):
    for _criterion in ("gini", "entropy"):
        _add(f"gain_{_style}_{_criterion}", (lambda f: lambda s, d: _score_out(f(s, d)))(_gains(_style, _criterion)), _gain_sql(_style, _criterion))
    _add(f"gain_{_style}_variance", (lambda f: lambda s, d: _score_out(f(s, d)))(_gains(_style, "mse", "quantity", 0, (1, 2))), _gain_sql(_style, "mse", "quantity", 0, "1, 2"))
_add("gain_category", (lambda f: lambda s, d: _score_out(f(s, d)))(_gains("threshold", "gini", "flag", 3, (3,))), _gain_sql("threshold", "gini", "flag", 3, "3"))


def _stats(spark, d):
    return _gains("threshold", "gini")(spark, d).select(F.col("feature").cast("long").alias("feature"), F.col("state").cast("long").alias("state"), *(_r(F.col(c), c) for c in ("mean", "median", "std")), "n_success")


_add("fold_stats", _stats, _gain_sql("threshold", "gini", extra=" SELECT CAST(feature AS BIGINT) AS feature, CAST(state AS BIGINT) AS state, round(avg(gain), 6) AS mean, round(median(gain), 6) AS median, round(stddev_pop(gain), 6) AS std, count(*) AS n_success FROM g GROUP BY 1, 2"))

_AGG_SQL = {
    "mean": "avg(gain)", "median": "median(gain)", "signal_to_noise": "avg(gain) / (stddev_pop(gain) + 0.001)", "mean_minus_lambda_std": "avg(gain) - 2 * stddev_pop(gain)",
    "trimmed_mean": "list_sum(list_sort(list(gain))[1 + least(floor(count(*) * 0.25), (count(*) - 1) // 2)::INT : count(*)::INT - least(floor(count(*) * 0.25), (count(*) - 1) // 2)::INT]) / (count(*) - 2 * least(floor(count(*) * 0.25), (count(*) - 1) // 2))",
}
for _name, _sql in _AGG_SQL.items():
    _add(
        f"agg_{_name}",
        (lambda how: lambda s, d: _score_out(_gains("threshold", "gini")(s, d).drop("score").withColumn("score", reducers.reducer(how, 0.25, 0.001, 2.0))))(_name),
        _gain_sql("threshold", "gini", extra=f" SELECT CAST(feature AS BIGINT) AS feature, CAST(state AS BIGINT) AS state, count(*) AS n_success, round({_sql}, 6) AS score FROM g GROUP BY 1, 2"),
    )
_add(
    "select_best",
    lambda s, d: _score_out(scoring.select_best(_gains("threshold", "gini")(s, d))),
    _gain_sql("threshold", "gini", extra=" SELECT CAST(feature AS BIGINT) AS feature, CAST(state AS BIGINT) AS state, count(*) AS n_success, round(avg(gain), 6) AS score FROM g GROUP BY 1, 2 ORDER BY round(avg(gain), 12) DESC, feature, state LIMIT 1"),
)

# ---------------------------------------------------------------- metrics


def _confused(spark, d):
    """One row: n_p_y counts of rows predicted p of class y, by a fixed rule on price."""
    rows = lineitem_rows(spark, d).withColumn("p", F.when(F.col("price") < 30000, 0).when(F.col("price") < 60000, 1).otherwise(2))
    return rows.agg(*(F.count_if((F.col("p") == p) & (F.col("flag") == y)).alias(f"n_{p}_{y}") for p in range(3) for y in range(3)))


def _confusion():
    return metrics.confusion([(F.lit(p), [F.col(f"n_{p}_{y}") for y in range(3)]) for p in range(3)])


_CONFUSION_SQL = f"""WITH {LINEITEM_SQL}, p AS (SELECT flag AS y, CASE WHEN price < 30000 THEN 0 WHEN price < 60000 THEN 1 ELSE 2 END AS p FROM rows),
k AS (SELECT c, count(*) FILTER (p = c AND y = c) AS tp, count(*) FILTER (p = c AND y <> c) AS fp, count(*) FILTER (p <> c AND y = c) AS fn, count(*) FILTER (y = c) AS support FROM p, (VALUES (0), (1), (2)) v(c) GROUP BY c)"""


def _matrix(spark, d):
    cm = _confusion()
    one = _confused(spark, d).select(F.explode(F.array(*(F.struct(F.lit(c).cast("long").alias("c"), cm.tp[c].alias("tp"), cm.fp[c].alias("fp"), cm.fn[c].alias("fn"), cm.support[c].alias("support")) for c in range(3)))).alias("r"))
    return one.select("r.*")


_add("confusion_matrix", _matrix, _CONFUSION_SQL + " SELECT CAST(c AS BIGINT) AS c, tp, fp, fn, support FROM k")
_METRIC_SQL = {
    "precision": "{tp} / ({tp} + {fp})", "recall": "{tp} / ({tp} + {fn})", "f1": "2 * {tp} / (2 * {tp} + {fp} + {fn})", "fbeta": "5 * {tp} / (5 * {tp} + 4 * {fn} + {fp})",
}
for _m, _form in _METRIC_SQL.items():
    _each = _form.format(tp="tp", fp="fp", fn="fn")
    for _a, _from in {
        "binary": f"SELECT {_each} AS v FROM k WHERE c = 1", "macro": f"SELECT avg({_each}) AS v FROM k", "weighted": f"SELECT sum(support * ({_each})) / sum(support) AS v FROM k",
        "micro": f"SELECT {_form.format(tp='sum(tp)', fp='sum(fp)', fn='sum(fn)')} AS v FROM k",
    }.items():
        _add(
            f"{_m}_{_a}",
            (lambda m, a: lambda s, d: _confused(s, d).select(_r(metrics.metric(_confusion(), m, a, 1, 2.0), "value")))(_m, _a),
            _CONFUSION_SQL + f" SELECT round(v, 6) AS value FROM ({_from})",
        )
_add("accuracy", lambda s, d: _confused(s, d).select(_r(metrics.metric(_confusion(), "accuracy"), "value")), _CONFUSION_SQL + " SELECT round(sum(tp) / sum(support), 6) AS value FROM k")


def _objective(style):
    def run(spark, d):
        coded, _ = _fast_coded(spark, d)
        ordered = (F.col("feature") < 3) if style == "threshold" else F.lit(False)
        cells = scoring.fold_cells(scoring.unpivot(coded, "codes", ["node", "fold", "y"]), scoring.class_measures(2), False)
        states = cells.select("node", "feature", F.col("code").alias("state")).distinct().where(~ordered | (F.col("state") < BINS - 1))
        names = ["v0", "v1", "w0", "w1"]
        split = scoring.sides(scoring.with_training(scoring.dense(cells, states, ["c0", "c1"]), 2), names, ordered)
        return _score_out(scoring.candidates(scoring.objective_gains(split, 2, "f1", "binary", 1, 1.0), states))

    return run


_OBJECTIVE_TAIL = f""",
q AS (SELECT feature, state, f AS fold, l, count(*) FILTER (fold = f AND big = 0) AS v0, count(*) FILTER (fold = f AND big = 1) AS v1,
             count(*) FILTER (fold <> f AND big = 0) AS w0, count(*) FILTER (fold <> f AND big = 1) AS w1 FROM sided, range({K}) t(f) GROUP BY ALL),
m AS (SELECT feature, state, fold, sum(CASE WHEN w1 > w0 THEN v1 ELSE 0 END) AS tp, sum(CASE WHEN w1 > w0 THEN v0 ELSE 0 END) AS fp, sum(CASE WHEN w1 > w0 THEN 0 ELSE v1 END) AS fn,
             sum(w1) > sum(w0) AS p, sum(v0) AS t0, sum(v1) AS t1 FROM q GROUP BY ALL HAVING count(*) = 2 AND min(v0 + v1) > 0 AND min(w0 + w1) > 0),
g AS (SELECT feature, state, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END - CASE WHEN p AND t1 > 0 THEN 2 * t1 / (2 * t1 + t0) ELSE 0 END AS gain FROM m)
SELECT CAST(feature AS BIGINT) AS feature, CAST(state AS BIGINT) AS state, count(*) AS n_success, round(avg(gain), 6) AS score FROM g GROUP BY 1, 2"""


def _objective_sql(style):
    side = "CASE WHEN feature < 3 THEN c.code <= s.state ELSE c.code = s.state END" if style == "threshold" else "c.code = s.state"
    top = f"AND (feature = 3 OR code < {BINS - 1})" if style == "threshold" else ""
    return (
        _FAST_SQL
        + f", st AS (SELECT DISTINCT feature, code AS state FROM coded WHERE code IS NOT NULL {top}), sided AS (SELECT s.feature, s.state, c.fold, c.big, {side} AS l FROM coded c JOIN st s USING (feature) WHERE c.code IS NOT NULL)"
        + _OBJECTIVE_TAIL
    )


_add("objective_gain_threshold", _objective("threshold"), _objective_sql("threshold"))
_add("objective_gain_bin", _objective("bin"), _objective_sql("bin"))

# ---------------------------------------------------------------- strict scoring


def _strict_edges(level):
    cells = level.select("node", "fold", F.posexplode("x").alias("feature", "v")).where("feature < 3")
    return quantiles.quantile_edges(cells, ["node", "feature"], "v", BINS, "fold", K)


_STRICT_RAW = f"""WITH {LINEITEM_SQL}, {_folds_sql()},
raw AS ({" UNION ALL ".join(f"SELECT row_id, fold, big, {i} AS feature, CAST({c} AS DOUBLE) AS v FROM folded" for i, c in enumerate(FEATURES))}),
seen AS (SELECT view, feature, v FROM raw, range(-1, {K}) t(view) WHERE fold <> view AND isfinite(v)),
ranked AS (SELECT view, feature, v, row_number() OVER (PARTITION BY view, feature ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY view, feature) AS m FROM seen),
edges AS (SELECT view, feature, list(v ORDER BY i) AS edges FROM ranked JOIN range(1, {BINS}) t(i) ON r = least(i * m // {BINS}, m - 1) GROUP BY ALL)"""
_add(
    "strict_fold_edges",
    lambda s, d: _strict_edges(_level(s, d)).select(*(F.col(c).cast("long").alias(c) for c in ("view", "feature")), F.posexplode("edges").alias("i", "edge")).withColumn("i", F.col("i").cast("long")),
    _STRICT_RAW + f" SELECT view, CAST(feature AS BIGINT) AS feature, i - 1 AS i, edges[i] AS edge FROM (SELECT view, feature, edges, unnest(range(1, {BINS})) AS i FROM edges)",
)
_STRICT_SQL = (
    _STRICT_RAW
    + """,
st AS (SELECT DISTINCT feature, len(list_filter(edges, lambda e: e <= v)) AS state FROM raw JOIN edges USING (feature) WHERE view = -1 AND isfinite(v)),
coded AS (SELECT raw.feature, fold, view, big, CASE WHEN isfinite(v) THEN len(list_filter(edges, lambda e: e <= v)) END AS code FROM raw JOIN edges USING (feature) WHERE view >= 0)"""
)


def _strict(**p):
    def run(spark, d):
        level = _level(spark, d).withColumn("x", F.slice("x", 1, 3))
        g = Grower(level, 3, Growth(n_classes=2, cv_folds=K, cv_seed=SEED, n_bins=BINS, **p))
        return _score_out(g._score_strict(level, _strict_edges(level)))

    return run


_add(
    "strict_gain_gini",
    _strict(),
    _STRICT_SQL
    + """, sided AS (SELECT s.feature, s.state, c.fold, c.big AS y, coalesce(c.code <= s.state, false) AS l FROM coded c JOIN st s USING (feature) WHERE c.fold = c.view),
i AS (SELECT feature, state, fold, l, count(*) AS t, 1 - (avg(y) ** 2 + (1 - avg(y)) ** 2) AS imp FROM sided GROUP BY ALL),
w AS (SELECT feature, state, fold, count(*) AS t, 1 - (avg(y) ** 2 + (1 - avg(y)) ** 2) AS imp FROM sided GROUP BY ALL),
g AS (SELECT w.feature, w.state, w.imp - sum(i.t * i.imp) / any_value(w.t) AS gain FROM w JOIN i USING (feature, state, fold) GROUP BY w.feature, w.state, w.fold, w.imp HAVING count(*) = 2)
SELECT CAST(feature AS BIGINT) AS feature, CAST(state AS BIGINT) AS state, count(*) AS n_success, round(avg(gain), 6) AS score FROM g GROUP BY 1, 2""",
)
_add(
    "strict_objective_gain",
    _strict(objective="f1"),
    _STRICT_SQL
    + _OBJECTIVE_TAIL.replace(
        ",\nq AS",
        ", sided AS (SELECT s.feature, s.state, c.fold, c.view, c.big, coalesce(c.code <= s.state, false) AS l FROM coded c JOIN st s USING (feature)),\nq AS",
        1,
    ).replace(f"FROM sided, range({K}) t(f) GROUP", "FROM (SELECT *, view AS f FROM sided) GROUP"),
)


def _strict_mae(spark, d):
    rows = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("row_id"), F.lit(0).alias("node"), F.col("p_retailprice").alias("y"), F.array(F.col("p_size").cast("double")).alias("x"))
    level = folds.assign_folds(rows, 3, SEED)
    cells = level.select("node", "fold", F.posexplode("x").alias("feature", "v"))
    edges = quantiles.quantile_edges(cells, ["node", "feature"], "v", 4, "fold", 3)
    g = Grower(level, 1, Growth(criterion="mae", cv_folds=3, cv_seed=SEED, n_bins=4))
    return _score_out(g._score_strict(level, edges))


_add(
    "strict_gain_mae",
    _strict_mae,
    f"WITH {_folds_sql(3, source='(SELECT CAST(p_partkey AS VARCHAR) AS row_id, p_retailprice AS y, CAST(p_size AS DOUBLE) AS v FROM part)')},"
    + """
seen AS (SELECT view, v FROM folded, range(-1, 3) t(view) WHERE fold <> view),
ranked AS (SELECT view, v, row_number() OVER (PARTITION BY view ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY view) AS m FROM seen),
edges AS (SELECT view, list(v ORDER BY i) AS edges FROM ranked JOIN range(1, 4) t(i) ON r = least(i * m // 4, m - 1) GROUP BY ALL),
st AS (SELECT DISTINCT len(list_filter(edges, lambda e: e <= v)) AS state FROM folded, edges WHERE view = -1),
sided AS (SELECT state, fold, y, len(list_filter(edges, lambda e: e <= v)) <= state AS l FROM folded JOIN edges ON fold = view, st),
a AS (SELECT *, median(y) OVER (PARTITION BY state, fold, l) AS m, median(y) OVER (PARTITION BY state, fold) AS mt FROM sided),
i AS (SELECT state, fold, l, count(*) AS t, avg(abs(y - m)) AS imp FROM a GROUP BY ALL), w AS (SELECT state, fold, count(*) AS t, avg(abs(y - mt)) AS imp FROM a GROUP BY ALL),
g AS (SELECT w.state, w.imp - sum(i.t * i.imp) / any_value(w.t) AS gain FROM w JOIN i USING (state, fold) GROUP BY w.state, w.fold, w.imp HAVING count(*) = 2)
SELECT 0::BIGINT AS feature, CAST(state AS BIGINT) AS state, count(*) AS n_success, round(avg(gain), 6) AS score FROM g GROUP BY 2""",
)

# ---------------------------------------------------------------- routing, prediction, trees


def _leaf(depth, key, **f):
    return trees.Node(depth=depth, key=key, **f)


def _fixed(kind="class"):
    """quantity < 20 ? (20000 <= price < 60000 ? A : B) : (status == 1 ? C : D)"""
    make = (lambda d, k, p: _leaf(d, k, proba=[1 - p, p])) if kind == "class" else (lambda d, k, p: _leaf(d, k, value=p))
    inf = float("inf")
    left = trees.Node(feature=1, lower=20000.0, upper=60000.0, depth=1, left=make(2, 0, 0.25), right=make(2, 1, 0.75))
    right = trees.Node(feature=3, is_categorical=True, category=1, depth=1, left=make(2, 2, 0.5), right=make(2, 3, 1.0))
    return trees.Node(feature=0, lower=-inf, upper=20.0, left=left, right=right)


_ROUTED_SQL = f"WITH {LINEITEM_SQL}, routed AS (SELECT *, CASE WHEN quantity < 20 THEN CASE WHEN price >= 20000 AND price < 60000 THEN 0 ELSE 1 END ELSE CASE WHEN status = 1 THEN 2 ELSE 3 END END AS leaf FROM rows)"


def _routed(spark, d):
    rows = lineitem_rows(spark, d).withColumn("x", F.array(*(F.col(c).cast("double") for c in (*FEATURES, "status"))))
    return trees.route(rows, _fixed(), "x", "leaf")


_add("route_rows", lambda s, d: _routed(s, d).select("row_id", F.col("leaf").cast("long").alias("leaf")), _ROUTED_SQL + " SELECT row_id, CAST(leaf AS BIGINT) AS leaf FROM routed")
_add(
    "leaf_regression_mean",
    lambda s, d: _routed(s, d).groupBy(F.col("leaf").cast("long").alias("leaf")).agg(F.count("*").alias("n"), _r(F.sum("cents") / F.count("*"), "value")),
    _ROUTED_SQL + " SELECT CAST(leaf AS BIGINT) AS leaf, count(*) AS n, round(sum(cents) / count(*), 6) AS value FROM routed GROUP BY 1",
)
_add(
    "leaf_class_shares",
    lambda s, d: _routed(s, d).groupBy(F.col("leaf").cast("long").alias("leaf")).agg(*(_r(F.count_if(F.col("flag") == c) / F.count("*"), f"p{c}") for c in range(3))),
    _ROUTED_SQL + " SELECT CAST(leaf AS BIGINT) AS leaf, " + ", ".join(f"round(count(*) FILTER (flag = {c}) / count(*), 6) AS p{c}" for c in range(3)) + " FROM routed GROUP BY 1",
)


def _model(kind="class"):
    from .estimators import TreeClassificationModel, TreeRegressionModel

    model = TreeClassificationModel() if kind == "class" else TreeRegressionModel()
    model._set(featuresCols=[*FEATURES, "status"], categoricalFeatures=[3], labelCol="big")
    model.root, model.classes_ = _fixed(kind), [0, 1] if kind == "class" else None
    return model


_add(
    "score_accuracy",
    lambda s, d: _model().transform(lineitem_rows(s, d)).agg(_r(F.avg((F.col("prediction") == F.col("big")).cast("double")), "accuracy")),
    _ROUTED_SQL + " SELECT round(avg(CAST(CAST(leaf IN (1, 3) AS INT) = big AS INT)), 6) AS accuracy FROM routed",
)


def _r2(spark, d):
    df = _model("value").transform(lineitem_rows(spark, d))
    return df.agg(_r(1 - F.sum((F.col("big") - F.col("prediction")) ** 2) / (F.var_pop("big") * F.count("*")), "r2"))


_add("score_r2", _r2, _ROUTED_SQL + ", p AS (SELECT big, CASE leaf WHEN 0 THEN 0.25 WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 ELSE 1 END::DOUBLE AS v FROM routed) SELECT round(1 - sum((big - v) ** 2) / (var_pop(big) * count(*)), 6) AS r2 FROM p")


def _classifier(**p):
    defaults = {"featuresCols": [*FEATURES, "status"], "categoricalFeatures": [3], "labelCol": "big", "idCol": "row_id", "mode": "fast", "nBins": BINS}
    return TreeClassifier(**defaults | p)


_STUMP_SQL = (
    _gain_sql("threshold", "gini", features="0, 1, 2, 3", extra=", best AS (SELECT feature, state FROM (SELECT feature, state, avg(gain) AS score FROM g GROUP BY 1, 2) ORDER BY round(score, 12) DESC, feature, state LIMIT 1)")
    + """, cut AS (SELECT best.feature, edges[state + 1] AS edge FROM best JOIN edges USING (feature)),
side AS (SELECT row_id, big, coalesce(v < edge, false) AS l FROM raw JOIN cut USING (feature)),
leaf AS (SELECT l, count(*) AS n, avg(big) AS p FROM side GROUP BY l)"""
)
_add(
    "stump_predict",
    lambda s, d: (lambda rows: _classifier(maxDepth=1).fit(rows).transform(rows).select("row_id", F.col("prediction").cast("long").alias("prediction"), _r(F.get("probability", F.lit(1)), "p1")))(lineitem_rows(s, d)),
    _STUMP_SQL + " SELECT row_id, CAST(CAST(p > 0.5 AS INT) AS BIGINT) AS prediction, round(p, 6) AS p1 FROM side JOIN leaf USING (l)",
)
_add(
    "stump_nodes",
    lambda s, d: _classifier(maxDepth=1).fit(lineitem_rows(s, d)).nodes(s).select(F.col("id").cast("long").alias("id"), "is_leaf", "feature", F.when(~F.col("is_leaf"), F.round("upper", 6)).alias("edge"), F.col("n_samples").alias("n")),
    _STUMP_SQL + " SELECT 0::BIGINT AS id, false AS is_leaf, CAST(feature AS BIGINT) AS feature, round(edge, 6) AS edge, (SELECT CAST(sum(n) AS BIGINT) FROM leaf) AS n FROM cut UNION ALL SELECT CASE WHEN l THEN 1 ELSE 2 END, true, -1, NULL, n FROM leaf",
)


def _nodes(**p):
    return lambda s, d: _classifier(**p).fit(lineitem_rows(s, d)).nodes(s)


_add("tree_nodes_fast", _nodes(maxDepth=4))
_add("tree_nodes_strict", _nodes(maxDepth=2, mode="strict"))
_add("tree_nodes_objective", _nodes(maxDepth=3, objective="f1"))
_add("tree_predict", lambda s, d: (lambda rows: _classifier(maxDepth=3).fit(rows).transform(rows).select("row_id", "prediction", "probability"))(lineitem_rows(s, d)))


def _regression(spark, d):
    part = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_partkey").cast("double").alias("part"), F.col("p_retailprice").alias("price"))
    model = TreeRegressor(featuresCols=["part", "size"], labelCol="price", idCol="p_partkey", mode="fast", maxDepth=3).fit(part)
    return model.transform(part).select("p_partkey", _r(F.col("prediction"), "prediction"))


_add("tree_regression", _regression)
