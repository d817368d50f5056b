"""Sinks: splits, keyed caches, small reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.functions.lexicons import FEATURE_NAMES
from inkprint.functions.stylometry import with_stylometry


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per split. CSV quotes and escapes so that newlines survive."""
    writer = df.write.mode("overwrite").partitionBy("split")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("quoteAll", True)
    writer.format(fmt).save(path)


def feature_set_id(names) -> str:
    return hashlib.md5(",".join(names).encode()).hexdigest()[:12]


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def cached_features(df: DataFrame, path: str, names=FEATURE_NAMES, text_col: str = "text") -> DataFrame:
    """Features keyed on ``fp``; only texts not yet stored are computed.

    The path carries a digest of the feature names, so another feature set, or
    another corpus, never reads stale values.
    """
    spark, home = df.sparkSession, f"{path}/features-{feature_set_id(names)}"
    have = _stored(spark, home)
    todo = df.select("fp", text_col)
    if have is not None:
        todo = todo.join(have.select("fp"), "fp", "left_anti")
    # Equal texts meet after the features are computed: numbers move, not text.
    with_stylometry(todo, text_col, names).drop(text_col).dropDuplicates(["fp"]).write.mode(
        "append").parquet(home)
    return df.select("fp").dropDuplicates().join(spark.read.parquet(home).dropDuplicates(["fp"]), "fp")


def cached_signal(df: DataFrame, path: str, name: str, compute) -> DataFrame:
    """(fp, name), one row per distinct ``fp`` of ``df``; ``compute`` sees each new one once.

    Two writers at the same time may store a key twice; reading takes one of them.
    """
    spark, home = df.sparkSession, f"{path}/signal-{name}"
    have = _stored(spark, home)
    todo = df.dropDuplicates(["fp"])
    todo = todo if have is None else todo.join(have.select("fp"), "fp", "left_anti")
    compute(todo).select("fp", name).write.mode("append").parquet(home)
    return df.select("fp").distinct().join(spark.read.parquet(home).dropDuplicates(["fp"]), "fp")


def with_signal(df: DataFrame, signal: DataFrame | None, name: str, neutral: float) -> DataFrame:
    """Join a stored signal on ``fp``; missing rows, or no table, give neutral."""
    if signal is None:
        return df.withColumn(name, F.lit(neutral))
    return df.join(signal.select("fp", name).dropDuplicates(["fp"]), "fp", "left").withColumn(
        name, F.coalesce(name, F.lit(neutral)))


def write_importances(df: DataFrame, path: str) -> None:
    """A ranked (feature, importance) table, a few dozen rows, as one CSV."""
    df.orderBy(F.desc("importance"), "feature").coalesce(1).write.mode("overwrite").option(
        "header", True).csv(path)


def write_feature_list(spark: SparkSession, names, path: str) -> None:
    spark.createDataFrame([(json.dumps(list(names)),)], "value string").coalesce(1).write.mode(
        "overwrite").text(path)


def read_feature_list(spark: SparkSession, path: str) -> list[str]:
    return json.loads(spark.read.text(path).first()["value"])


def summary_lines(metrics: DataFrame) -> DataFrame:
    """A fixed-width text line per signal from the metrics table."""
    return metrics.select("signal", F.format_string(
        "%-14s %8.4f %10.4f %12.4f %10.4f", "signal", "f1", "auc_roc", "precision", "recall"
    ).alias("line"))


def write_summary(metrics: DataFrame, path: str) -> None:
    summary_lines(metrics).orderBy("signal").select("line").coalesce(1).write.mode(
        "overwrite").text(path)
