import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.config import FusionConfig
from inkprint.operators import fusion, isotonic


def pools(points):
    """Least-squares monotone fit by repeated pooling."""
    at = {}
    for x, y in points:
        at.setdefault(x, []).append(y)
    blocks = []
    for x in sorted(at):
        blocks.append(([x], at[x]))
        while len(blocks) > 1 and np.mean(blocks[-2][1]) >= np.mean(blocks[-1][1]):
            xs, ys = blocks.pop()
            blocks[-1] = (blocks[-1][0] + xs, blocks[-1][1] + ys)
    return {x: float(np.mean(ys)) for xs, ys in blocks for x in xs}


def test_isotonic_equals_pooling_and_clips(spark):
    rng = random.Random(3)
    points = [(round(rng.random() * 40) / 40, rng.randint(0, 1)) for _ in range(400)]
    d = spark.createDataFrame(points, "p double, label int")
    model = fusion.fit_isotonic(d, "p")
    got = {r["p"]: r["c"] for r in fusion.calibrated(d, model, "p", "c").collect()}
    want = pools(points)
    assert got == pytest.approx(want)
    ends = spark.createDataFrame([(-5.0,), (5.0,)], "p double")
    low, high = [r["c"] for r in fusion.calibrated(ends, model, "p", "c").orderBy("p").collect()]
    assert (low, high) == pytest.approx((want[min(want)], want[max(want)]))


def test_calibration_is_monotone(spark):
    d = spark.range(500).select((F.col("id") / 500).alias("p"), (F.rand(1) < F.col("id") / 500).cast("int").alias("label"))
    model = fusion.fit_isotonic(d, "p")
    cal = [r["c"] for r in fusion.calibrated(d, model, "p", "c").orderBy("p").collect()]
    assert all(a <= b + 1e-12 for a, b in zip(cal, cal[1:]))


@pytest.mark.parametrize("n", [1, 2, 3, 99, 1_000, 400_000])
def test_percentiles_equal_numpy(spark, n):
    values = np.random.default_rng(n).normal(size=n).round(4)
    d = spark.createDataFrame([(float(v),) for v in values], "x double") if n < 10_000 else \
        spark.range(n).select(F.round(F.randn(7), 5).alias("x"))
    if n >= 10_000:
        values = np.array([r[0] for r in d.collect()])
    got = fusion.exact_percentiles(d, "x", [0.05, 0.95])
    assert got == pytest.approx(list(np.percentile(values, [5, 95])))


def test_ratio_signal_is_inverted_and_clipped(spark):
    d = spark.createDataFrame([(0.5,), (1.0,), (2.0,), (9.0,)], "r double")
    got = [r[0] for r in d.select(fusion.ratio_signal(F.col("r"), 1.0, 3.0)).collect()]
    assert got == pytest.approx([1.0, 1.0, 0.5, 0.0], abs=1e-6)


def test_saturation(spark):
    d = spark.createDataFrame([(0.98,), (0.99,), (1.0,)], "p double")
    assert [r[0] for r in d.select(fusion.unsaturated(F.col("p"))).collect()] == [0.98, 0.99, 0.99]


def test_signals_join_by_key_not_position(spark):
    base = spark.createDataFrame([("a",), ("b",), ("c",)], "fp string")
    one = spark.createDataFrame([("c", 0.3), ("a", 0.1)], "fp string, semantic double")
    two = spark.createDataFrame([("b", 0.7)], "fp string, ratio double")
    m = fusion.signal_matrix(base, [one, two]).withColumns(
        {"stylometric": F.lit(None).cast("double"), "formality": F.lit(None).cast("double")})
    got = {r["fp"]: (r["semantic"], r["ratio"], r["formality"]) for r in fusion.with_neutral(m).collect()}
    assert got == {"a": (0.1, 1.0, 0.5), "b": (0.5, 0.7, 0.5), "c": (0.3, 1.0, 0.5)}


def test_heads_learn_a_separable_signal(spark):
    d = spark.range(400).select(
        (F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"),
        *[(F.rand(i) * 0.4 + 0.6 * (F.col("id") % 2)).alias(n) for i, n in enumerate(fusion.MATRIX)])
    quick = lambda d: fusion.fit_fusion(d, cfg=FusionConfig(batch_rows=16, rate=0.01))
    for fit, linear in ((quick, False), (fusion.fit_linear_fusion, True)):
        scored = fusion.fused(d, fit(d), linear=linear)
        right = scored.where((F.col("final_prob") >= 0.5) == (F.col("label") == 1)).count()
        assert right > 390


@pytest.mark.parametrize("group", [2, 7, 100])
def test_groups_of_any_size_pool_alike(spark, group):
    """Seams, runs of falling means over many groups, and one pool for all."""
    rng = random.Random(group)
    cases = [[(x / 90, int(rng.random() < x / 90)) for x in range(90)], [(x / 60, int(x < 30)) for x in range(60)],
             [(x / 50, int(x > 20)) for x in range(50)], [(0.5, 1), (0.5, 0)], [(0.1, 1)]]
    for points in cases:
        d = spark.createDataFrame(points, "p double, label int").repartition(4)
        model = isotonic.fit(d, "p", "label", group)
        want = pools(points)
        assert np.interp(list(want), model.x, model.y) == pytest.approx(list(want.values()))
        assert (np.diff(model.y) >= 0).all() and len(set(model.y.tolist())) == len(set(want.values()))


def test_calibration_without_rows_and_of_nulls(spark):
    d = spark.createDataFrame([(None, 1), (0.2, None)], "p double, label int")
    model = isotonic.fit(d, "p", "label")
    assert [r["c"] for r in fusion.calibrated(d, model, "p", "c").collect()][0] is None
    model = isotonic.Isotonic(np.array([0.0, 1.0]), np.array([0.0, 0.5]))
    assert [r["c"] for r in fusion.calibrated(d, model, "p", "c").collect()] == [None, pytest.approx(0.1)]
