"""Connected components by alternating large-star and small-star rounds, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import rejoin, table

#: From this many edges on, the minima of a round are written before they are joined, so a root's nodes can be split.
MANY_EDGES = 2_000_000


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[:]


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, root) for every node of the given undirected edges; root is the smallest node it can reach.

    Null ends, loops and repeated edges do not matter; no edges give no rows. rows: the edges at most, if known. Every
    round is two aggregations and two joins by key with one row a key, written to the shared folder; rounds grow with
    the logarithm of the longest path.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = table(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows)
    before, state = None, _state(now)
    while state[0] and state != before:
        join = DataFrame.join if state[0] < MANY_EDGES else rejoin
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = join(both.where("b > a"), low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = table(large, "large-star", 2 * state[0])
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = join(large, low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = table(hung.union(low.select("a", F.col("m").alias("b"))).distinct(), "small-star", 2 * state[0])
        before, state = state, _state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
