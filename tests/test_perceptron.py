"""The fusion head against a plain loop; stopping and the best state; jobs and one task alike."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.config import FusionConfig
from inkprint.operators import perceptron as p

CFG = FusionConfig(hidden=(6, 4), dropout=(0.2, 0.1), max_iter=6, batch_rows=40, rate=0.02, patience=3)


def made(n=300, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 3))
    return x, (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.2, size=n) > 0.8).astype(int), rng.choice(["train", "train", "val", "test"], n)


def frame(spark, x, y, split):
    return spark.createDataFrame([(*map(float, v), int(t), str(s)) for v, t, s in zip(x, y, split)],
                                 "a double, b double, c double, label int, split string").coalesce(1)


def plain(x, y, split, cfg):
    """The textbook loop row by row: forward, chain rule, Adam, patience."""
    # The block numbers rows of train and val together, in their order.
    use = np.isin(split, ["train", "val"])
    x, y, val = x[use], y[use].astype(float), split[use] == "val"
    uid = np.arange(len(x))
    shapes = [(3, 6), (6, 4), (4, 1)]
    flat = p.first_weights([(a + 1, b) for a, b in shapes], cfg.seed)
    layers, at = [], 0
    for a, b in shapes:
        layers.append([flat[at:at + a * b].reshape(a, b).copy(), flat[at + a * b:at + a * b + b].copy()])
        at += (a + 1) * b
    moments = [[np.zeros_like(w), np.zeros_like(w)] for layer in layers for w in layer]
    steps, time, best, losses = -(-int((~val).sum()) // cfg.batch_rows), 0, None, []
    for epoch in range(cfg.max_iter):
        batch_of = p.mixed(uid, cfg.seed * 104_729 + epoch + 1) % np.uint64(steps)
        keep = [p.kept_units(uid, epoch, i, u, d, cfg.seed) for i, (u, d) in enumerate(zip(cfg.hidden, cfg.dropout))]
        for step in range(steps):
            rows = [i for i in uid if not val[i] and batch_of[i] == step]
            grads = [np.zeros_like(w) for layer in layers for w in layer]
            for i in rows:
                (w1, b1), (w2, b2), (w3, b3) = layers
                z1 = x[i] @ w1 + b1
                a1 = np.maximum(z1, 0) * keep[0][i]
                z2 = a1 @ w2 + b2
                a2 = np.maximum(z2, 0) * keep[1][i]
                out = 1 / (1 + np.exp(-(a2 @ w3 + b3)))
                d3 = out - y[i]
                d2 = (w3 @ d3) * keep[1][i] * (z2 > 0)
                d1 = (w2 @ d2) * keep[0][i] * (z1 > 0)
                for g, v in zip(grads, (np.outer(x[i], d1), d1, np.outer(a1, d2), d2, np.outer(a2, d3), d3)):
                    g += v
            time += 1
            for w, g, m in zip([w for layer in layers for w in layer], grads, moments):
                g = g / len(rows)
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                w -= cfg.rate * (m[0] / (1 - 0.9**time)) / (np.sqrt(m[1] / (1 - 0.999**time)) + 1e-8)
        z = np.maximum(np.maximum(x[val] @ layers[0][0] + layers[0][1], 0) @ layers[1][0] + layers[1][1], 0) @ layers[2][0] + layers[2][1]
        out = 1 / (1 + np.exp(-z[:, 0]))
        losses.append(float(-np.mean(y[val] * np.log(out) + (1 - y[val]) * np.log(1 - out))))
        if losses[-1] == min(losses):
            best = np.concatenate([np.concatenate([w.reshape(-1), b]) for w, b in layers])
        elif epoch - int(np.argmin(losses)) >= cfg.patience:
            break
    return best, losses


def test_equals_a_plain_loop(spark):
    x, y, split = made()
    head = p.fit(frame(spark, x, y, split), ["a", "b", "c"], "label", CFG)
    best, losses = plain(x, y, split, CFG)
    assert head.losses == pytest.approx(losses, abs=1e-6) and len(losses) == CFG.max_iter
    assert head.flat == pytest.approx(best, abs=1e-6)


def test_stops_and_restores_the_best_state(spark):
    """Labels without a pattern: the val loss rises again, and the weights kept are those of the best epoch."""
    x, _, split = made(200)
    y = np.random.default_rng(8).integers(0, 2, 200)
    cfg = FusionConfig(**{**CFG.__dict__, "max_iter": 60, "rate": 0.2})
    head = p.fit(frame(spark, x, y, split), ["a", "b", "c"], "label", cfg)
    best = int(np.argmin(head.losses))
    assert len(head.losses) == best + 1 + cfg.patience < 60
    val = split == "val"
    got = p.loss_units(head.flat, p.shapes(3, cfg.hidden), x[val], y[val]) / (1 << 24) / val.sum()
    assert got == pytest.approx(head.losses[best])


def test_jobs_and_one_task_fit_the_same_head(spark, monkeypatch):
    monkeypatch.setattr(p, "BLOCK_ROWS", 16)
    d = frame(spark, *made(120))
    quick = {**CFG.__dict__, "max_iter": 2}
    one = p.fit(d, ["a", "b", "c"], "label", FusionConfig(**quick))
    many = p.fit(d, ["a", "b", "c"], "label", FusionConfig(**{**quick, "rows_in_task": 0}))
    assert one.to_dict() == many.to_dict()


def test_scores_and_files(spark):
    x, y, split = made(80)
    d = frame(spark, x, y, split)
    head = p.Head.from_dict(p.fit(d, ["a", "b", "c"], "label", CFG).to_dict())
    got = [r[0] for r in d.select(head.probability([F.col(c) for c in "abc"])).collect()]
    assert got == pytest.approx((1 / (1 + np.exp(-head.margins(x)))).tolist())
    assert p.fit(d.where("false"), ["a", "b", "c"], "label", CFG).losses == []


@pytest.mark.parametrize("rows_in_task", [1, 45, 119])
def test_steps_whose_rows_one_task_may_hold_are_one_job(spark, monkeypatch, rows_in_task):
    """The same head, with a job for some steps (or for each, if a batch is too large) and one for each epoch's loss."""
    from pyspark import RDD

    monkeypatch.setattr(p, "BLOCK_ROWS", 16)
    x, y, split = made(240)
    d = frame(spark, x, y, split)
    quick = {**CFG.__dict__, "max_iter": 2}
    one = p.fit(d, ["a", "b", "c"], "label", FusionConfig(**quick))
    jobs, reduced = [], RDD.treeReduce
    monkeypatch.setattr(RDD, "treeReduce", lambda r, f, *a: jobs.append("step") or reduced(r, f, *a))
    monkeypatch.setattr(RDD, "partitionBy", lambda r, *a, real=RDD.partitionBy: jobs.append("steps") or real(r, *a))
    many = p.fit(d, ["a", "b", "c"], "label", FusionConfig(**{**quick, "rows_in_task": rows_in_task}))
    train = int((split == "train").sum())
    steps = -(-train // CFG.batch_rows)
    held = rows_in_task // -(-train // steps)
    assert one.to_dict() == many.to_dict() and steps > 2
    assert jobs == (["steps"] * 2 * -(-steps // held) if held else ["step"] * 2 * steps)
