"""Evaluation on (signal, label, score) rows: exact, distributed, all signals at once.

Curves and areas need scores in global order. Rows first collapse to distinct
scores; prefix sums then run on three levels (coarse bucket, fine bucket,
score), so no task sees a whole signal and the order never depends on sampling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.functions.stats import safe_ratio

COARSE = 1 << 12
FINE = 1 << 24


def long_signals(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """One row per document and signal."""
    return df.unpivot(keep, columns, "signal", "score")


def predicted(score: Column, threshold: float = 0.5) -> Column:
    return F.when(score >= threshold, 1).otherwise(0)


def confusion(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """TN, FP, FN, TP per signal."""
    p, y = predicted(F.col("score"), threshold), F.col("label")
    cell = lambda t, q: F.count_if((y == t) & (p == q))
    return df.groupBy("signal").agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def threshold_metrics(cells: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from confusion cells; 0 on empty."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cells.select(
        "signal", "tn", "fp", "fn", "tp",
        safe_ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, tp + fn).alias("recall"),
        safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def error_rates(cells: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cells.select("signal", safe_ratio(fp, fp + tn).alias("fp_rate"),
                        safe_ratio(fn, fn + tp).alias("fn_rate"))


def normalised_confusion(cells: DataFrame) -> DataFrame:
    """Confusion cells divided by their true-class totals."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cells.select(
        "signal",
        safe_ratio(tn, tn + fp).alias("tn_share"), safe_ratio(fp, tn + fp).alias("fp_share"),
        safe_ratio(fn, fn + tp).alias("fn_share"), safe_ratio(tp, fn + tp).alias("tp_share"))


def score_counts(df: DataFrame) -> DataFrame:
    """Positives and negatives at each distinct score."""
    return df.groupBy("signal", "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"),
        F.count_if(F.col("label") == 0).alias("neg"))


def _bucket(levels: int) -> Column:
    return F.greatest(F.lit(0), F.least(
        F.lit(levels - 1), F.floor(F.col("score") * F.lit(float(levels))))).cast("bigint")


def from_the_top(counts: DataFrame) -> DataFrame:
    """Add ``pos_above`` and ``neg_above``: totals at strictly higher scores."""
    leaf = counts.withColumn("_fine", _bucket(FINE)).withColumn(
        "_coarse", F.floor(F.col("_fine") / F.lit(FINE // COARSE)).cast("bigint"))

    def above(df, part, order, tag):
        w = Window.partitionBy("signal", *part).orderBy(F.desc(order)).rowsBetween(
            Window.unboundedPreceding, -1)
        return df.withColumns({
            f"_{k}{tag}": F.coalesce(F.sum(k).over(w), F.lit(0)) for k in ("pos", "neg")})

    fine = leaf.groupBy("signal", "_coarse", "_fine").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    coarse = fine.groupBy("signal", "_coarse").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # At most 4,096 rows per signal.
    coarse = above(coarse, [], "_coarse", "3").drop("pos", "neg")
    fine = above(fine, ["_coarse"], "_fine", "2").drop("pos", "neg")
    fine = fine.join(F.broadcast(coarse), ["signal", "_coarse"]).drop("_coarse")
    out = above(leaf, ["_fine"], "score", "1").drop("_coarse").join(fine, ["signal", "_fine"])
    total = lambda k: sum((F.col(f"_{k}{t}") for t in "23"), F.col(f"_{k}1"))
    return out.select("signal", "score", "pos", "neg",
                      total("pos").alias("pos_above"), total("neg").alias("neg_above"))


def areas(df: DataFrame) -> DataFrame:
    """AUC-ROC with ties counted half, and step-wise average precision."""
    c = from_the_top(score_counts(df))
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    upto_pos = F.col("pos_above") + F.col("pos")
    upto_all = upto_pos + F.col("neg_above") + F.col("neg")
    g = c.groupBy("signal").agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
        F.sum(pos * (F.col("neg_above") + neg / 2)).alias("_lost"),
        F.sum(pos * upto_pos / upto_all).alias("_gain"))
    return g.select(
        "signal",
        F.when((F.col("_p") > 0) & (F.col("_n") > 0),
               1 - F.col("_lost") / (F.col("_p").cast("double") * F.col("_n"))).alias("auc_roc"),
        F.when(F.col("_p") > 0, F.col("_gain") / F.col("_p")).alias("auc_pr"))


def binary_metrics(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Everything per signal: cells, threshold metrics and both areas."""
    return threshold_metrics(confusion(df, threshold)).join(areas(df), "signal")


def comparison_table(df: DataFrame, order: list[str]) -> DataFrame:
    """F1, AUC, precision and recall in the given signal order."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("signal"))
    return binary_metrics(df).select(
        place.alias("place"), "signal", "f1", "auc_roc", "precision", "recall"
    ).orderBy("place")


def _with_totals(df: DataFrame) -> DataFrame:
    # One row per signal.
    totals = df.groupBy("signal").agg(
        F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") == 0).alias("_n"))
    return from_the_top(score_counts(df)).join(F.broadcast(totals), "signal")


def roc_points(df: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score; the origin is implied."""
    return _with_totals(df).select(
        "signal", F.col("score").alias("threshold"),
        safe_ratio(F.col("neg_above") + F.col("neg"), F.col("_n")).alias("fpr"),
        safe_ratio(F.col("pos_above") + F.col("pos"), F.col("_p")).alias("tpr"))


def pr_points(df: DataFrame) -> DataFrame:
    """(threshold, precision, recall) at every distinct score."""
    upto = F.col("pos_above") + F.col("pos")
    return _with_totals(df).select(
        "signal", F.col("score").alias("threshold"),
        safe_ratio(upto, upto + F.col("neg_above") + F.col("neg")).alias("precision"),
        safe_ratio(upto, F.col("_p")).alias("recall"))


def score_histogram(df: DataFrame, bins: int = 60, fixed_range: bool = False) -> DataFrame:
    """Density per class over that class's own range, or over [0, 1]."""
    if fixed_range:
        d = df.withColumns({"_lo": F.lit(0.0), "_hi": F.lit(1.0)})
    else:
        # One row per signal and class.
        ends = df.groupBy("signal", "label").agg(
            F.min("score").alias("_lo"), F.max("score").alias("_hi"))
        d = df.join(F.broadcast(ends), ["signal", "label"])
    # A one-value class gets the unit-wide range around that value.
    flat = F.col("_lo") == F.col("_hi")
    d = d.withColumn("lo", F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")))
    d = d.withColumn("_w", (F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi"))
                            - F.col("lo")) / bins)
    place = F.floor((F.col("score") - F.col("lo")) / F.col("_w"))
    d = d.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)).cast("bigint"))
    g = d.groupBy("signal", "label", "bin").agg(
        F.count("*").alias("n"), F.max("_w").alias("_w"))
    # At most signals * 2 * bins rows from here on.
    whole = Window.partitionBy("signal", "label")
    return g.select("signal", "label", "bin", "n",
                    (F.col("n") / (F.sum("n").over(whole) * F.col("_w"))).alias("density"))


def class_prior(df: DataFrame) -> DataFrame:
    return df.groupBy("signal").agg(F.avg(F.col("label").cast("double")).alias("prior"))


def _per_class(pairs: DataFrame) -> DataFrame:
    """(cls, support, said, hit); as small as the number of classes."""
    cells = pairs.groupBy("label", "pred").agg(F.count("*").alias("n"))
    none = F.lit(0).cast("bigint")
    right = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(none)
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"),
                 none.alias("said"), right.alias("hit")),
        F.struct(F.col("pred").alias("cls"), none.alias("support"),
                 F.col("n").alias("said"), none.alias("hit")))))
    return sides.groupBy("cls").agg(
        *[F.sum(k).alias(k) for k in ("support", "said", "hit")]).select(
        F.col("cls").cast("string").alias("cls"), "support", "said", "hit",
        safe_ratio(F.col("hit"), F.col("said")).alias("precision"),
        safe_ratio(F.col("hit"), F.col("support")).alias("recall"),
        safe_ratio(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"))


def class_report(pairs: DataFrame) -> DataFrame:
    """Per-class precision, recall, F1, support, plus macro and weighted rows.

    ``pairs`` holds (label, pred).
    """
    per = _per_class(pairs)
    names = ("precision", "recall", "f1")
    weight = F.col("support").cast("double")
    macro = per.agg(F.sum("support").alias("support"), *[F.avg(k).alias(k) for k in names])
    weighted = per.agg(F.sum("support").alias("_s"), *[
        safe_ratio(F.sum(F.col(k) * weight), F.sum(weight)).alias(k) for k in names])
    return (
        per.select("cls", "support", *names)
        .unionByName(macro.withColumn("cls", F.lit("macro avg")))
        .unionByName(weighted.withColumnRenamed("_s", "support")
                     .withColumn("cls", F.lit("weighted avg"))))


def multiclass_summary(pairs: DataFrame) -> DataFrame:
    """Accuracy and macro F1."""
    return _per_class(pairs).agg(
        safe_ratio(F.sum("hit"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"))
