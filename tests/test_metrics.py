import random

import pytest
from pyspark.sql import functions as F

from inkprint.operators import metrics


def rows(spark, pairs, signal="s"):
    return spark.createDataFrame([(signal, y, float(p)) for y, p in pairs], "signal string, label int, score double")


def test_published_confusion(spark):
    cells = spark.createDataFrame([("e", 12_265, 587, 658, 12_194)], "signal string, tn long, fp long, fn long, tp long")
    m = metrics.threshold_metrics(cells).first()
    e = metrics.error_rates(cells).first()
    assert [round(m[k], 4) for k in ("precision", "recall", "f1")] == [0.9541, 0.9488, 0.9514]
    assert round(100 * e["fp_rate"], 2) in (4.57, 4.56, 4.58) and round(100 * e["fn_rate"], 2) == 5.12


def brute(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for t in sorted({p for _, p in pairs}, reverse=True):
        tp = sum(p >= t for p in pos)
        fp = sum(p >= t for p in neg)
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
    return auc, ap


@pytest.mark.parametrize("grid", [7, 1000, 10**9])
def test_areas_against_brute_force(spark, grid):
    rng = random.Random(grid)
    pairs = [(y, round((rng.random() + 0.3 * y) / 1.3 * grid) / grid) for y in (rng.randint(0, 1) for _ in range(300))]
    got = metrics.areas(rows(spark, pairs)).first()
    assert (got["auc_roc"], got["auc_pr"]) == pytest.approx(brute(pairs))


def test_auc_is_invariant_under_monotone_maps(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(0, 1), rng.random()) for _ in range(200)]
    a = metrics.areas(rows(spark, pairs)).first()["auc_roc"]
    b = metrics.areas(rows(spark, [(y, p**3 * 40 - 7) for y, p in pairs])).first()["auc_roc"]
    assert a == pytest.approx(b)


def test_one_class_and_empty(spark):
    one = rows(spark, [(1, 0.2), (1, 0.7)])
    m = metrics.binary_metrics(one).first()
    assert m["auc_roc"] is None and m["precision"] == 1.0 and m["recall"] == 0.5
    assert metrics.binary_metrics(one.where("label = 5")).count() == 0


def test_threshold_is_inclusive(spark):
    assert metrics.confusion(rows(spark, [(1, 0.5), (0, 0.4999)])).first()["tp"] == 1


def test_histogram_of_a_constant_class(spark):
    h = metrics.score_histogram(rows(spark, [(1, 0.4)] * 5 + [(0, 0.0), (0, 1.0)]))
    assert h.agg(F.sum("n")).first()[0] == 7
    ends = {r["bin"] for r in h.where("label = 0").collect()}
    assert ends == {0, 59}


def test_missing_class_in_report(spark):
    pairs = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "label int, pred int")
    got = {r["cls"]: r for r in metrics.class_report(pairs).collect()}
    assert got["1"]["f1"] == 0.0 and got["macro avg"]["support"] == 3
    assert metrics.multiclass_summary(pairs).first()["accuracy"] == pytest.approx(2 / 3)
