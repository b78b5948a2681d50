"""Fold assignment: each node's rows in a seeded order, cut into k blocks of which the first n mod k are one longer.

The order is that of md5(seed:n:row_id), n being the node's rows, so folds are redrawn at every node and depend on
neither partitioning nor row order. Only the k - 1 rows at which blocks start have to be found: the order's first
three hexadecimal digits are counted, and only rows that share theirs with a block start are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_DIGITS = 3
#: Without shuffling: least number of ranges of row ids that are counted, rows of a range beyond it, and ids sampled to
#: choose them.
_RANGES, _RANGE_ROWS, _SAMPLE = 64, 1_000_000, 20_000


def order_key(row_id: Column, n: Column, seed: int, shuffle: bool) -> Column:
    """The place of a row in its node's order, as a string (or the row's id without shuffling)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), n.cast("string"), row_id.cast("string")).cast("binary")) if shuffle else row_id


def effective_k(n: Column, k: int) -> Column:
    return F.least(F.lit(max(k, 2)), n)


def splitters(rows: DataFrame, row_id: str) -> list:
    """Ids that cut the rows into ranges of like size; a sample decides how even they are, not the result."""
    n = rows.count()
    share, ranges = min(1.0, _SAMPLE / max(n, 1)), max(_RANGES, n // _RANGE_ROWS)
    found = sorted(r[0] for r in rows.select(row_id).sample(share, seed=0).limit(2 * _SAMPLE).collect())
    return sorted(set(found[:: max(1, len(found) // ranges)]))[: ranges - 1]


def assign_folds(rows: DataFrame, k: int = 5, seed: int = 42, shuffle: bool = True, node: str = "node", row_id: str = "row_id") -> DataFrame:
    """``rows`` with ``fold``, an integer from 0. Nodes of fewer than k rows have a fold for each row.

    What is broadcast has a row for each node, or for each of its k - 1 block starts: its size is that of a tree's level.
    """
    if k < 1:
        raise ValueError("k must be positive")
    sizes = rows.groupBy(node).agg(F.count("*").alias("_n"))
    keyed = rows.join(F.broadcast(sizes), node).withColumn("_key", F.struct(order_key(F.col(row_id), F.col("_n"), seed, shuffle).alias("key"), F.col(row_id).alias("id")))
    if shuffle:
        head = F.substring(F.col("_key.key"), 1, _DIGITS)
    else:
        cuts = splitters(rows, row_id)
        head = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col(row_id))) if cuts else F.lit(0)
    keyed = keyed.withColumn("_head", head)
    counts = keyed.groupBy(node, "_n", "_head").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy(node).orderBy("_head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kk = effective_k(F.col("_n"), k)
    base, more = F.floor(F.col("_n") / kk), F.col("_n") % kk
    starts = F.transform(F.sequence(F.lit(1), kk.cast("int") - 1), lambda f: f * base + F.least(f.cast("long"), more))
    starts = F.when(kk > 1, starts).otherwise(F.expr("cast(array() as array<bigint>)"))
    held = counts.select(node, "_head", "_n", "_c", before.alias("_b")).withColumn("_starts", F.filter(starts, lambda s: (s >= F.col("_b")) & (s < F.col("_b") + F.col("_c"))))
    held = held.where(F.size("_starts") > 0).select(node, "_head", "_b", "_starts")
    near = keyed.join(F.broadcast(held), [node, "_head"])
    rank = F.col("_b") + F.row_number().over(W.partitionBy(node, "_head").orderBy("_key")) - 1
    bounds = near.withColumn("_rank", rank).where(F.array_contains("_starts", F.col("_rank"))).groupBy(node).agg(F.array_sort(F.collect_list("_key")).alias("_bounds"))
    out = keyed.join(F.broadcast(bounds), node, "left")
    fold = F.size(F.filter(F.coalesce("_bounds", F.array()), lambda b: b <= F.col("_key")))
    return out.withColumn("fold", fold).select(*rows.columns, "fold")
