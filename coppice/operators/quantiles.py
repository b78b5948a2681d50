"""Exact quantile edges, and edges of every training fold, without a single-task sort.

Edge i of n_bins is the value of rank min(i * m div n_bins, m - 1) among the m finite values; equal edges stay.

Values are cut into ranges at approximate quantiles (a mergeable sketch). Exact counts of the ranges tell which range
holds each rank; only those ranges are sorted, each in a task of its own. A training fold's ranks come from the same
counts: all rows less the fold's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.binning import finite

#: Ranges that a group's values are cut into.
RANGES = 64


#: Cuts are searched in two steps: among every STEP-th one, then among those up to the next.
STEP = 8


def _range(cuts: Column, coarse: Column, v: Column) -> Column:
    """The number of cuts that are not above the value."""
    k = F.size(F.filter(coarse, lambda c: c <= v))
    return STEP * k + F.size(F.filter(F.slice(cuts, STEP * k + 1, F.lit(STEP - 1)), lambda c: c <= v))


def quantile_edges(cells: DataFrame, group: list[str], value: str, n_bins: int, fold: str | None = None, k: int = 0, ranges: int = RANGES) -> DataFrame:
    """(group, view, edges): view -1 is over all rows, view f over the rows outside fold f.

    Groups without a finite value, and n_bins < 2, give no row: their edges are empty. What is broadcast has at most
    ``ranges`` numbers for each group; groups are nodes and features, not data.
    """
    spark = cells.sparkSession
    views = [-1, *range(k)] if fold else [-1]
    if n_bins < 2:
        return spark.createDataFrame([], StructType([*cells.select(*group).schema.fields, StructField("view", IntegerType()), StructField("edges", ArrayType(DoubleType()))]))
    rows = cells.select(*group, finite(F.col(value)).alias("_v"), *([F.col(fold).alias("_f")] if fold else [])).where("_v is not null")
    cuts = rows.groupBy(*group).agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("_cuts"))
    cuts = cuts.withColumn("_coarse", F.filter("_cuts", lambda c, i: i % STEP == STEP - 1))
    ranged = rows.join(F.broadcast(cuts), group).withColumn("_r", _range(F.col("_cuts"), F.col("_coarse"), F.col("_v"))).drop("_cuts", "_coarse")
    counted = [F.count("*").alias("n_-1"), *(F.count_if(F.col("_f") == f).alias(f"n_{f}") for f in views[1:])]
    sizes = ranged.groupBy(*group, "_r").agg(*counted)
    before = W.partitionBy(*group).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)

    def of(view: int, name: str = "n"):
        return F.col(f"`{name}_-1`") if view < 0 else F.col(f"`{name}_-1`") - F.col(f"{name}_{view}")

    placed = sizes.select(*group, "_r", F.array(*(F.struct(F.lit(v).alias("view"), of(v).alias("n"), F.coalesce(F.sum(of(v)).over(before), F.lit(0)).alias("off"), F.sum(of(v)).over(whole).alias("m")) for v in views)).alias("_s"))
    wanted = placed.select(*group, "_r", F.explode("_s").alias("s")).select(*group, "_r", "s.*", F.explode(F.sequence(F.lit(1), F.lit(n_bins - 1))).alias("i"))
    rank = F.least(F.floor(F.col("i") * F.col("m") / n_bins), F.col("m") - 1)
    wanted = wanted.where("m > 0").withColumn("rank", rank.cast("long") - F.col("off")).where("rank >= 0 and rank < n").select(*group, "_r", "view", "i", "rank")
    keys = wanted.select(*group, "_r").distinct()
    values = ranged.join(F.broadcast(keys), [*group, "_r"]).groupBy(*group, "_r", "_v").agg(*counted)
    upto = W.partitionBy(*group, "_r").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    running = values.select(*group, "_r", "_v", *(F.col(f"`n_{v}`") for v in views), *(F.sum(F.col(f"`n_{v}`")).over(upto).alias(f"c_{v}") for v in views))
    found = running.join(wanted, [*group, "_r"])
    count = F.coalesce(*(F.when(F.col("view") == v, of(v)) for v in views))
    upper = F.coalesce(*(F.when(F.col("view") == v, of(v, "c")) for v in views))
    found = found.withColumn("_hi", upper).withColumn("_n", count).where("rank < _hi and rank >= _hi - _n")
    edges = F.transform(F.array_sort(F.collect_list(F.struct("i", "_v"))), lambda p: p["_v"])
    return found.groupBy(*group, "view").agg(edges.alias("edges"))


def medians(cells: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, median): the midpoint of the two middle values. Nulls don't count; NaN and infinities are the outermost.

    With two bins the edge of m values has rank m div 2; that of the negated values has rank (m - 1) div 2 from below.
    Groups without a value give no row."""
    v, most = F.col(value).cast("double"), F.lit(1.7976931348623157e308)
    ends = F.when(v.isNotNull(), F.greatest(F.least(v, most), -most))  # null stays null: least and greatest skip it
    signed = F.explode(F.array(*(F.struct(F.lit(s).alias("_sign"), (ends * s).alias("_value")) for s in (1, -1)))).alias("_s")
    both = cells.select(*group, signed).select(*group, "_s.*")
    return quantile_edges(both, [*group, "_sign"], "_value", 2, ranges=16).groupBy(*group).agg(F.sum(F.col("edges")[0] / 2 * F.col("_sign")).alias("median"))
