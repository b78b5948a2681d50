"""Dense ids of categories and labels: sorted distinct values, joined back as a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .folds import splitters

#: A list of distinct values is broadcast below this many; beyond it the join shuffles.
BROADCAST_VALUES = 1_000_000


def dense_index(rows: DataFrame, column: str) -> DataFrame:
    """(column, code) with codes 0, 1, ... in the order of the values; missing values have none.

    The values are cut into ranges, which are counted and then numbered each in a task of its own.
    """
    distinct = rows.select(column).where(F.col(column).isNotNull()).distinct()
    cuts = splitters(distinct, column)
    placed = distinct.withColumn("_range", F.size(F.filter(F.lit(cuts), lambda c: c <= F.col(column))) if cuts else F.lit(0))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(W.partitionBy("_range").orderBy(column)) - 1
    out = placed.withColumn("_at", at).join(F.broadcast(counts.select("_range", before.alias("_before"))), "_range")
    return out.select(column, (F.col("_at") + F.col("_before")).cast("int").alias("code"))


def encoded(rows: DataFrame, column: str, out: str = "code") -> DataFrame:
    """``rows`` with the dense index of ``column``; NULL for missing values."""
    index = dense_index(rows, column).withColumnRenamed("code", out).persist()
    small = index.count() <= BROADCAST_VALUES
    return rows.join(F.broadcast(index) if small else index, column, "left")


def present_states(cells: DataFrame) -> DataFrame:
    """(node, feature, state): the codes that occur."""
    return cells.where("code is not null").select("node", "feature", F.col("code").alias("state")).distinct()
