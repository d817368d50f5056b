"""Calibration, normalisation and fusion of the four signals, joined by key."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.config import FusionConfig
from inkprint.operators import isotonic, perceptron

# The columns of the fusion matrix, in order.
MATRIX = ("semantic_cal", "stylometric_cal", "ratio_signal", "formality")


def unsaturated(c: Column, cap: float = FusionConfig.saturation) -> Column:
    """Cut the semantic score below the saturation cliff before calibration."""
    return F.least(c, F.lit(cap))


def with_neutral(df: DataFrame, cfg: FusionConfig = FusionConfig(), ratio: float = 1.0) -> DataFrame:
    """Missing signals take their neutral values."""
    neutral = {"semantic": cfg.neutral_probability, "stylometric": cfg.neutral_probability,
               "ratio": ratio, "formality": cfg.neutral_formality}
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in neutral.items()})


def fit_isotonic(val: DataFrame, score: str, label: str = "label") -> isotonic.Isotonic:
    """Monotone calibration on labelled rows."""
    return isotonic.fit(val, score, label)


def calibrated(df: DataFrame, model: isotonic.Isotonic, score: str, out: str) -> DataFrame:
    """Apply a calibrator; scores outside its range get its end values."""
    return df.withColumn(out, model.apply(F.col(score)))


def exact_percentiles(df: DataFrame, col: str, at: list[float], accuracy: int = 100_000) -> list[float]:
    """Percentiles with linear interpolation, exact at any size.

    A sketch brackets each wanted rank by four times its own error, ten ranks at
    least; only the distinct values inside the brackets, a sliver of the data, are
    then ranked, each bracket apart and all in one pass. A few numbers per
    percentile reach the driver.
    """
    d = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    n = d.count()
    if n == 0:
        raise ValueError(f"no values in {col}")
    slack = max(4.0 / accuracy, 10.0 / n)
    probes = [p for q in at for p in (max(q - slack, 0.0), min(q + slack, 1.0))]
    found = d.agg(F.percentile_approx("x", probes, accuracy).alias("b"), F.min("x").alias("lo"),
                  F.max("x").alias("hi")).first()
    # A probe at an end of the scale stands for the end itself.
    edge = lambda p, v: found["lo"] if p <= 0 else found["hi"] if p >= 1 else v
    ends = [edge(p, v) for p, v in zip(probes, found["b"])]
    brackets = list(zip(ends[::2], ends[1::2]))
    below = d.agg(*[F.count_if(F.col("x") < low).alias(f"b{i}") for i, (low, _) in enumerate(brackets)]).first()
    own = F.array_compact(F.array(*[F.when(F.col("x").between(low, high), F.lit(i))
                                    for i, (low, high) in enumerate(brackets)]))
    inside = d.select("x", F.explode(own).alias("i")).groupBy("i", "x").agg(F.count("*").alias("c"))
    ranked = inside.withColumn("end", F.sum("c").over(Window.partitionBy("i").orderBy("x")))
    wanted = [((n - 1) * q, math.floor((n - 1) * q)) for q in at]
    at_rank = lambda i, k: F.min(F.when((F.col("i") == i) & (F.col("end") + below[f"b{i}"] > k), F.col("x")))
    got = ranked.agg(*[x for i, (_, k) in enumerate(wanted) for x in (
        at_rank(i, k).alias(f"a{i}"), at_rank(i, min(k + 1, n - 1)).alias(f"z{i}"))]).first()
    return [got[f"a{i}"] + (rank - k) * (got[f"z{i}"] - got[f"a{i}"]) for i, (rank, k) in enumerate(wanted)]


def ratio_signal(ratio: Column, p_low: float, p_high: float,
                 floor: float = FusionConfig.spread_floor) -> Column:
    """Percentile-normalised and inverted: a low ratio gives a high signal."""
    spread = F.lit(p_high - p_low + floor)
    x = (ratio - F.lit(p_low)) / spread
    return F.lit(1.0) - F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def signal_matrix(base: DataFrame, tables: list[DataFrame], key: str = "fp") -> DataFrame:
    """Signals joined by key; a row missing from a table stays, with nulls."""
    return reduce(lambda a, b: a.join(b, key, "left"), tables, base)


def fit_fusion(rows: DataFrame, names=MATRIX, cfg: FusionConfig = FusionConfig(),
               label: str = "label") -> perceptron.Head:
    """Small perceptron over the signal columns, fitted on train rows and stopped by val rows (``split``)."""
    return perceptron.fit(rows, list(names), label, cfg)


def interactions(df: DataFrame, names=MATRIX) -> tuple[DataFrame, list[str]]:
    """Signal-by-formality products for the linear baseline."""
    crossed = {f"{n}_x_formality": F.col(n) * F.col("formality") for n in names if n != "formality"}
    return df.withColumns(crossed), [*names, *crossed]


def fit_linear_fusion(train: DataFrame, names=MATRIX, label: str = "label") -> LogisticRegressionModel:
    d, columns = interactions(train, names)
    d = VectorAssembler(inputCols=columns, outputCol="_x").transform(d).select(label, "_x")
    return LogisticRegression(featuresCol="_x", labelCol=label, probabilityCol="_prob",
                              rawPredictionCol="_raw", predictionCol="_pred", maxIter=100).fit(d)


def fused(df: DataFrame, model, names=MATRIX, out: str = "final_prob", linear: bool = False) -> DataFrame:
    """Fused probability of the machine class."""
    if not linear:
        return df.withColumn(out, model.probability([F.col(n) for n in names]))
    d, columns = interactions(df, names)
    d = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep").transform(d)
    d = model.transform(d).withColumn(out, vector_to_array("_prob")[1])
    return d.drop("_x", "_raw", "_prob", "_pred", *[c for c in columns if c not in names])


@dataclass
class FusionMeta:
    """What scoring needs besides the models."""

    p_low: float
    p_high: float
    names: tuple[str, ...] = MATRIX
