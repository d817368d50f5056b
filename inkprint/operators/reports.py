"""Corpus and signal reports: small grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.functions.text import word_count


def split_report(df: DataFrame) -> DataFrame:
    """Rows, class counts and class percentages per split."""
    g = df.groupBy("split").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("label") == 0).alias("human"),
        F.count_if(F.col("label") == 1).alias("ai"))
    pct = lambda n: F.lit(100.0) * F.col(n) / F.col("total")
    return g.select("split", "total", "human", "ai",
                    pct("human").alias("human_pct"), pct("ai").alias("ai_pct"))


def coverage(df: DataFrame) -> DataFrame:
    """Machine rows by generator and human rows by source, largest first."""
    kind = F.when(F.col("label") == 1, "model").otherwise("source")
    name = F.when(F.col("label") == 1, F.col("model")).otherwise(F.col("source"))
    return (df.groupBy(kind.alias("kind"), name.alias("name"))
            .agg(F.count("*").alias("n")).orderBy("kind", F.desc("n"), "name"))


def source_counts(df: DataFrame) -> DataFrame:
    """Rows per source and label with subtotals and the grand total."""
    return (df.rollup("source", "label").agg(F.count("*").alias("n"))
            .select(F.coalesce("source", F.lit("all")).alias("source"),
                    F.coalesce(F.col("label").cast("string"), F.lit("all")).alias("label"),
                    "n"))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def length_stats(df: DataFrame, budget: int, group: str, col: str = "text") -> DataFrame:
    """Token-length mean, maximum and the share cut at the budget."""
    n = word_count(F.col(col))
    return df.groupBy(group).agg(
        F.avg(n).alias("mean_tokens"), F.max(n).alias("max_tokens"),
        F.avg(F.when(n >= budget, 100.0).otherwise(0.0)).alias("truncated_pct"))


def signal_distribution(df: DataFrame, col: str) -> DataFrame:
    """Mean, population deviation, minimum and maximum."""
    return df.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"),
                  F.min(col).alias("min"), F.max(col).alias("max"))


def dataset_statistics(df: DataFrame) -> DataFrame:
    """Total and per-split sizes with whole percentages, in one aggregate."""
    sizes = df.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")])
    part = lambda s: F.struct(F.lit(s).alias("part"), F.col(s).alias("n"),
                              F.round(F.lit(100.0) * F.col(s) / F.col("total")).alias("pct"))
    return sizes.select(F.inline(F.array(*[part(s) for s in ("total", "train", "val", "test")])))
