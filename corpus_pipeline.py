"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

Near duplicates are judged on five-word shingles at a similarity of 0.8 or more; one document of each group stays. The
mix repeats documents (a row for each pass) and cuts at most one document of each source to meet its target.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm._common import WS_CLASS, keys_join, numbered, scratch, table
from coppice.llm.exact_dedup import exact_dedup
from coppice.llm.jaccard_join import jaccard_components
from coppice.llm.quality_classifier import keep_good
from coppice.llm.sentencepiece_codec import encode
from coppice.llm.source_mix import mix_sources


def _stage(f):
    """A stage's input is written, so the tables that the stage before it made can go when it starts."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scratch(docs):
            return f(spark, docs, sf_dir)

    return run


def _staying(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    kept = table(decisions.where("kept").select(F.col("rid").alias("__rid")), "kept")
    return keys_join(rows, kept, "__rid", "left_semi").drop("__rid")


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    rows = numbered(docs)
    return _staying(rows, exact_dedup(rows, rid_col="__rid")[0])


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates; texts without words all stay."""
    rows = numbered(docs)
    return _staying(rows, jaccard_components(rows, words=5, percent=80, rid_col="__rid")[0])


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each whole pass over a document, and a shortened one where a source's target ends inside it."""
    rows = numbered(docs)
    takes = mix_sources(rows, rid_col="__rid").where("taken > 0")
    takes = takes.select(F.col("rid").alias("__rid"), F.explode(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")))).alias("__pass"), "size", "taken")
    takes = takes.select("__rid", F.least(F.col("size"), F.col("taken") - F.col("__pass") * F.col("size")).cast("int").alias("__words"), (F.col("taken") - F.col("__pass") * F.col("size") < F.col("size")).alias("__cut"))
    out = rows.join(takes, "__rid")
    words = F.filter(F.split("text", WS_CLASS + "+"), lambda w: w != "")
    cut = {"text": F.when(F.col("__cut"), F.array_join(F.slice(words, 1, F.col("__words")), " ")).otherwise(F.col("text"))}
    out = out.withColumns(cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__cut"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text."""
    return encode(docs, drop=("text",))


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("jaccard_join", near),
    ("source_mix", mix),
    ("sentencepiece", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
