"""Boosted trees against a plain round, and the ways of growing them against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.config import StyloConfig
from inkprint.operators import boosting as b

CFG = StyloConfig(trees=6, depth=4, step=0.3, max_bins=16, patience=3)


def made(n=600, features=4, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, features)), 2)
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + rng.normal(scale=0.5, size=n) > 0).astype(int)
    return x, y, rng.choice(["train", "train", "train", "val"], n)


def frame(spark, x, y, split, parts=5):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(*map(float, v), int(t), str(s)) for v, t, s in zip(x, y, split)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", label int, split string").repartition(parts), names


def plain_tree(bins, g, h, columns, cfg, depth=0):
    """Exact search over every cut, node by node: (feature, bin, left, right) or a leaf's value."""
    shrunk = lambda v: np.sign(v) * max(abs(v) - cfg.l1, 0)
    score = lambda g, h: shrunk(g) ** 2 / (h + cfg.l2)
    value = -shrunk(g.sum()) / (h.sum() + cfg.l2) * cfg.step
    best = (0, None)
    if depth < cfg.depth:
        for c in columns:
            for cut in range(bins[:, c].max(initial=0)):
                left = bins[:, c] <= cut
                if min(h[left].sum(), h[~left].sum()) < cfg.min_child_weight:
                    continue
                gain = score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum()) - score(g.sum(), h.sum())
                if gain >= cfg.gamma and gain > best[0] + 1e-9:
                    best = (gain, c, cut, left)
    if best[1] is None:
        return value
    _, c, cut, left = best
    return c, cut, *(plain_tree(bins[s], g[s], h[s], columns, cfg, depth + 1) for s in (left, ~left))


def as_plain(tree, node=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    return int(tree.feature[node]), int(tree.bin[node]), as_plain(tree, 2 * node + 1), as_plain(tree, 2 * node + 2)


def same(a, b_):
    if isinstance(a, tuple) and isinstance(b_, tuple):
        return a[:2] == b_[:2] and same(a[2], b_[2]) and same(a[3], b_[3])
    return not isinstance(a, tuple) and not isinstance(b_, tuple) and a == pytest.approx(b_, abs=1e-6)


def test_a_round_equals_a_plain_one(spark):
    x, y, split = made()
    d, names = frame(spark, x, y, split, 1)
    cfg = StyloConfig(**{**CFG.__dict__, "trees": 2, "row_fraction": 1.0, "feature_fraction": 0.75})
    model = b.Fit(d, names, "label", cfg).run()
    train = split == "train"
    bins, margin = model.binned(x[train]), np.zeros(train.sum())
    for number, tree in enumerate(model.trees):
        p = 1 / (1 + np.exp(-margin))
        columns = b.drawn_columns(number, len(names), cfg)
        assert len(columns) == 3
        assert same(as_plain(tree), plain_tree(bins, p - y[train], p * (1 - p), columns.tolist(), cfg))
        margin += tree.value[tree.leaves(bins)]
    # Leaf values, thresholds and penalties really act.
    assert any((t.feature >= 0).sum() > 2 for t in model.trees)


@pytest.mark.parametrize("rows_in_task", [0, 150, 400])
def test_trees_do_not_depend_on_how_they_are_grown(spark, monkeypatch, rows_in_task):
    monkeypatch.setattr(b, "REWRITE", 2)
    x, y, split = made()
    d, names = frame(spark, x, y, split)
    d = d.cache()
    one = b.Fit(d, names, "label", CFG).run()
    other = b.Fit(d, names, "label", StyloConfig(**{**CFG.__dict__, "rows_in_task": rows_in_task})).run()
    assert one.to_dict() == other.to_dict() and len(one.trees) > 2


def test_jobs_of_few_rounds_are_one_fit(spark):
    x, y, split = made()
    d, names = frame(spark, x, y, split, 1)
    whole = b.Fit(d, names, "label", CFG).run()
    assert whole.to_dict() == b.Fit(d, names, "label", StyloConfig(**{**CFG.__dict__, "rounds_per_job": 2})).run().to_dict()


def test_patience_keeps_the_best_rounds(spark):
    x, y, split = made(300)
    y = np.random.default_rng(9).integers(0, 2, 300)  # nothing to learn: the loss on val rows soon rises
    d, names = frame(spark, x, y, split, 1)
    fit = b.Fit(d, names, "label", StyloConfig(**{**CFG.__dict__, "trees": 60, "gamma": 0.0, "min_child_weight": 1.0}))
    model = fit.run()
    losses = fit.model.losses
    assert len(losses) < 60 and len(losses) - b.best_round(losses) == CFG.patience
    assert len(model.trees) == b.best_round(losses) and min(losses) == losses[len(model.trees) - 1]


def test_scores_and_files(spark):
    x, y, split = made()
    d, names = frame(spark, x, y, split, 1)
    model = b.Fit(d, names, "label", CFG).run()
    again = b.Boosted.from_dict(model.to_dict())
    got = np.array([r["p"] for r in d.select(again.probability([F.col(n) for n in names]).alias("p")).collect()])
    want = 1 / (1 + np.exp(-model.margins(model.binned(np.array([[r[n] for n in names] for r in d.collect()])))))
    assert got == pytest.approx(want)
    assert model.importances().sum() == pytest.approx(1) and model.importances().argmax() == 0


def test_nothing_to_fit(spark):
    x, y, split = made(20)
    d, names = frame(spark, x, y, split, 1)
    assert b.Fit(d.where("false"), names, "label", CFG).run().trees == []
    empty = b.Fit(d, [], "label", CFG).run()
    assert all((t.feature < 0).all() for t in empty.trees)
    nothing = b.Boosted([np.zeros(0)] * 4)
    assert [r[0] for r in d.limit(2).select(nothing.probability([F.col(n) for n in names])).collect()] == [0.5, 0.5]


def test_only_the_smaller_of_two_siblings_is_counted(monkeypatch):
    x, y, _ = made(4000)
    cfg = StyloConfig(**{**CFG.__dict__, "depth": 6, "min_child_weight": 1.0})
    bins = b.Boosted([np.quantile(v, np.arange(1, 16) / 16) for v in x.T]).binned(x)
    g, h = b.gradients(np.zeros(len(y)), y)
    counted, count = [], b._count
    monkeypatch.setattr(b, "_count", lambda s, slots, of, drawn, g, h, node, *rest: (
        counted.append(int((of[node] >= 0).sum())), count(s, slots, of, drawn, g, h, node, *rest)))
    tree, columns = b.Tree.empty(6), np.arange(x.shape[1])
    b.grow(tree, 0, bins, g, h, columns, 16, cfg)
    assert same(as_plain(tree), plain_tree(bins, g / b._ONE, h / b._ONE, columns.tolist(), cfg))
    assert counted[0] == 4000 and len(counted) == 6 and max(counted[1:]) <= 2000


def test_the_loss_of_a_round_comes_with_the_next_rounds_first_job(spark, monkeypatch):
    x, y, split = made()
    d, names = frame(spark, x, y, split)
    d = d.cache()
    asked, real = [], b.Fit._val_loss
    monkeypatch.setattr(b.Fit, "_val_loss", lambda fit: asked.append(len(fit.model.trees)) or real(fit))
    cfg = StyloConfig(**{**CFG.__dict__, "rows_in_task": 150})
    fit = b.Fit(d, names, "label", cfg)
    fit.run()
    assert asked == [CFG.trees] and len(fit.model.losses) == CFG.trees and fit.loaded is None
    # Patience ends a fit after as many rounds as where one task has all rows.
    y = np.random.default_rng(9).integers(0, 2, len(y))
    noise = frame(spark, x, y, split)[0].cache()
    cfg = {**CFG.__dict__, "trees": 40, "gamma": 0.0, "min_child_weight": 1.0}
    one, many = (b.Fit(noise, names, "label", StyloConfig(**{**cfg, "rows_in_task": n})) for n in (200_000, 150))
    assert one.run().to_dict() == many.run().to_dict() and one.model.losses == many.model.losses and len(one.model.losses) < 40


def test_a_worker_adds_only_the_trees_that_are_new_to_it(monkeypatch):
    x, y, _ = made(50)
    bins = b.Boosted([np.quantile(v, np.arange(1, 16) / 16) for v in x.T]).binned(x)
    g, h = b.gradients(np.zeros(len(y)), y)
    trees = []
    for columns in ([0], [1], [2]):
        trees.append(b.Tree.empty(3))
        b.grow(trees[-1], 0, bins, g, h, np.array(columns), 16, StyloConfig(**{**CFG.__dict__, "depth": 3, "min_child_weight": 0.1}))
    uid, written, used, leaves = np.arange(50), np.linspace(-1, 1, 50), [], b.Tree.leaves
    monkeypatch.setattr(b, "_KEPT", b.OrderedDict())
    monkeypatch.setattr(b.Tree, "leaves", lambda tree, *a: used.append(tree) or leaves(tree, *a))

    def fit(trees, held):
        out = object.__new__(b.Fit)
        out.token, out.held, out.model = "t", held, b.Boosted([], trees)
        return out

    want = written
    for n in range(1, 4):
        want = want + trees[n - 1].value[leaves(trees[n - 1], bins)]
        used.clear()
        assert (fit(trees[:n], 7)._margins(uid, bins, written) == want).all() and used == [trees[n - 1]]
    # Kept margins that a job can't start from are not used.
    assert (fit([], 7)._margins(uid, bins, written) == written).all()
    assert (fit([], 20)._margins(uid, bins, written) == written).all()
    monkeypatch.setattr(b, "KEPT_BLOCKS", 2)
    for first in range(5):
        fit([], 0)._margins(uid + 100 * first, bins, written)
    assert len(b._KEPT) == 2


def test_hessians_and_rows_add_up_exactly_in_one_number():
    rng = np.random.default_rng(5)
    n = b.BLOCK_ROWS
    bins, slot = rng.integers(0, 256, (n, 3)).astype(np.uint8), rng.integers(0, 2, n)
    bins[:, 2], slot[: n - 1] = 255, 0  # one cell with all but a row
    g, h = rng.integers(-(1 << 24), 1 << 24, n).astype(float), np.full(n, float(1 << 22))
    got = b.histograms(bins, g, h, slot, 2, 256)
    for i in range(3):
        for plane, weight in enumerate((g, h, np.ones(n))):
            want = np.bincount(slot * 256 + bins[:, i].astype(int), weight, 512).reshape(2, 256)
            assert (got[plane, i] == want).all()
    assert b.bin_type([np.zeros(255)]) is np.uint8 and b.bin_type([np.zeros(256)]) is np.int16
