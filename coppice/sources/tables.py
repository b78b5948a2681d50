"""The driver's tables, and training rows derived from them.

A row's key is made of its own columns, so it is the same in every engine and run and needs no global numbering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, big (0/1: a revenue above 50,000), flag (0..2), price, and four features; discount has missing values."""
    t = read(spark, sf_dir, "lineitem")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return t.select(
        F.concat_ws("-", *(F.col(c).cast("string") for c in LINE_KEY), day.cast("string")).alias("row_id"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) > 50000).cast("int").alias("big"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("flag"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("discount"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("status"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
    )


#: The same rows in DuckDB, as a common table expression.
LINEITEM_SQL = """rows AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS row_id,
         CAST(l_extendedprice * (1 - l_discount) > 50000 AS INT) AS big,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag,
         l_quantity AS quantity, l_extendedprice AS price, CASE WHEN l_linenumber <> 3 THEN l_discount END AS discount,
         CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS status, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem)"""
