"""Gradient-boosted trees with Newton leaves, grown from summed histograms.

Feature values become bins once. A round draws rows and columns, turns margins into
gradients and Hessians, and grows one tree level by level: histograms of both per
(node, feature, bin) are summed over all tasks, and the split with the highest gain

  T(GL)^2 / (HL + l2) + T(GR)^2 / (HR + l2) - T(G)^2 / (H + l2),   T(g) = sign(g) max(|g| - l1, 0)

is taken if it reaches ``gamma`` and both sides have a Hessian of ``min_child_weight``.
A leaf's value is -T(G) / (H + l2) times the step.

Large nodes are split by jobs: tasks sum histograms of their blocks, a shuffle by feature
adds them up and finds each feature's best split, and only those reach the driver. Rows
of a node of at most ``rows_in_task`` go to one task, which grows the rest of that
subtree; if all rows are that few, a task does whole rounds. Gradients are
whole multiples of 2^-24, so sums are exact and the trees are the same whichever way they
were grown and however the rows were dealt. Margins are written every few rounds, so a
lost executor costs a job and not the fit; between writings a worker keeps those of the
blocks it saw last and adds the trees that are new to it. The written blocks are held in
memory, or on local disk, for the jobs that read them.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.config import StyloConfig
from inkprint.session import materialise

BLOCK_ROWS = 1 << 13
REWRITE = 20  # rounds between two writings of the margins
KEPT_BLOCKS = 256  # blocks whose margins a worker keeps: 16 MB
_ONE = float(1 << 24)  # gradients are counted in units of 1 / _ONE


@dataclass
class Tree:
    """Heap-numbered: the children of node i are 2 i + 1 and 2 i + 2; feature -1 marks a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int16), np.zeros(n, np.int16), np.zeros(n), np.zeros(n))

    def listed(self) -> list[list]:
        """Places, features, bins, values and gains of the nodes that are there."""
        kept = np.flatnonzero((self.feature >= 0) | (self.value != 0))
        return [a[kept].tolist() for a in (np.arange(len(self.feature)), self.feature, self.bin, self.value, self.gain)]

    def leaves(self, bins: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row, or the open node that it has come to."""
        node = np.zeros(len(bins), np.int64) if start is None else start
        flat, first = np.ascontiguousarray(bins).reshape(-1), np.arange(len(bins)) * bins.shape[1]
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return node
            right = flat[first + np.maximum(feature, 0)] > self.bin[node]
            node = np.where(inner, 2 * node + 1 + right, node)


@dataclass
class Boosted:
    """The trees of a fit: cut points of every feature, and one tree a round."""

    cuts: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def binned(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, values.T)], 1).astype(np.int16) if len(
            self.cuts) else np.zeros((len(values), 0), np.int16)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        total = np.zeros(len(bins))
        for tree in self.trees:
            total += tree.value[tree.leaves(bins)]
        return total

    def probability(self, columns: list[Column]) -> Column:
        """Probability of label 1 from feature columns, a batch of rows at a time."""
        model = self

        @F.pandas_udf("double")
        def score(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-model.margins(model.binned(rows.to_numpy(np.float64))))))

        return score(F.struct(*[c.cast("double").alias(f"f{i}") for i, c in enumerate(columns)]))

    def importances(self) -> np.ndarray:
        """Mean gain of each feature's splits, as shares of their sum."""
        total, count = np.zeros(len(self.cuts)), np.zeros(len(self.cuts))
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(total, tree.feature[inner], tree.gain[inner])
            np.add.at(count, tree.feature[inner], 1)
        mean = total / np.maximum(count, 1)
        return mean / mean.sum() if mean.sum() > 0 else mean

    def first(self, rounds: int) -> Boosted:
        return Boosted(self.cuts, self.trees[:rounds], self.losses[:rounds])

    def to_dict(self) -> dict:
        return {"cuts": [c.tolist() for c in self.cuts], "losses": self.losses,
                "size": len(self.trees[0].feature) if self.trees else 1, "trees": [t.listed() for t in self.trees]}

    @classmethod
    def from_dict(cls, d: dict) -> Boosted:
        out = cls([np.array(c) for c in d["cuts"]], [], d["losses"])
        for at, feature, bin_, value, gain in d["trees"]:
            n = d["size"]
            tree = Tree(np.full(n, -1, np.int16), np.zeros(n, np.int16), np.zeros(n), np.zeros(n))
            tree.feature[at], tree.bin[at], tree.value[at], tree.gain[at] = feature, bin_, value, gain
            out.trees.append(tree)
        return out


# --- one round, in numpy ---------------------------------------------------------------


def gradients(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the log loss, as whole numbers of units."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - label) * _ONE), np.maximum(np.rint(p * (1 - p) * _ONE), 1)


def loss_units(margin: np.ndarray, label: np.ndarray) -> int:
    return int(np.rint(np.logaddexp(0, np.where(label > 0, -margin, margin)) * _ONE).sum())


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64 evenly spread bits of each number, other ones for each salt."""
    x = x.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def drawn_rows(uid: np.ndarray, number: int, cfg: StyloConfig) -> np.ndarray:
    """The rows of a round, by a hash of the row's number, the round and the seed."""
    return mixed(uid, cfg.seed * 1_000_003 + number + 1) < np.uint64(min(int(cfg.row_fraction * 2.0**64), (1 << 64) - 1))


def drawn_columns(number: int, features: int, cfg: StyloConfig) -> np.ndarray:
    """The columns of a round's tree: one draw for the whole tree."""
    size = max(1, int(cfg.feature_fraction * features))
    return np.sort(np.random.default_rng([cfg.seed, number]).permutation(features)[:size])


def histograms(bins: np.ndarray, g: np.ndarray, h: np.ndarray, slot: np.ndarray, slots: int, width: int) -> np.ndarray:
    """Sums of (gradient, Hessian, rows) by (feature, slot, bin), a column of ``bins`` at a time.

    At most ``BLOCK_ROWS`` rows: then a Hessian and a row, in one number, add up without rounding.
    """
    features, size = bins.shape[1], slots * width
    sums, base, columns = np.empty((3, features, size)), slot * width, np.ascontiguousarray(bins.T)
    both, unit = h * (2 * BLOCK_ROWS) + 1, 2 * BLOCK_ROWS
    for i in range(features):
        at = base + columns[i]
        sums[0, i], sums[2, i] = np.bincount(at, g, size), np.bincount(at, both, size)
    np.floor_divide(sums[2], unit, out=sums[1])
    sums[2] -= sums[1] * unit
    return sums.reshape(3, features, slots, width)


def _shrunk(g, cfg):
    return np.sign(g) * np.maximum(np.abs(g) - cfg.l1, 0)


def _score(g, h, cfg):
    out = np.abs(g)
    out -= cfg.l1
    np.maximum(out, 0, out=out)
    out *= out
    out /= h + cfg.l2
    return out


def best_splits(sums: np.ndarray, cfg: StyloConfig) -> np.ndarray:
    """(gain, bin, left G, left H, left rows, G, H, rows) of the best split of each (feature, slot); no gain is -inf.

    Rows are 0 where ``sums`` has only gradients and Hessians.
    """
    left = np.cumsum(sums, 2)
    whole = left[:, :, -1]
    g, h = left[0] / _ONE, left[1] / _ONE
    all_g, all_h = whole[0][:, None] / _ONE, whole[1][:, None] / _ONE
    right = all_h - h
    gain = _score(g, h, cfg)
    gain += _score(all_g - g, right, cfg)
    gain -= _score(all_g, all_h, cfg)
    gain[(h < cfg.min_child_weight) | (right < cfg.min_child_weight) | (gain < max(cfg.gamma, 1e-6))] = -np.inf
    at, slot = gain.argmax(1), np.arange(len(gain))
    out, planes = np.zeros((len(gain), 8)), len(sums)
    out[:, 0], out[:, 1], out[:, 2:2 + planes], out[:, 5:5 + planes] = gain[slot, at], at, left[:, slot, at].T, whole.T
    return out


def leaf_value(g: np.ndarray, h: np.ndarray, cfg: StyloConfig) -> np.ndarray:
    return -_shrunk(g / _ONE, cfg) / (h / _ONE + cfg.l2) * cfg.step


def put(tree: Tree, nodes: list[int], found: np.ndarray, features: np.ndarray, cfg: StyloConfig, depth: int) -> list[tuple[int, int]]:
    """Split ``nodes`` by their best features (found: feature, slot, 8 figures); (child, rows) of those to go on with."""
    best = found[:, :, 0].argmax(0)
    more = []
    for slot, node in enumerate(nodes):
        gain, at, lg, lh, ln, g, h, n = found[best[slot], slot]
        if gain == -np.inf:
            tree.value[node] = leaf_value(g, h, cfg)
            continue
        tree.feature[node], tree.bin[node], tree.gain[node], tree.value[node] = features[best[slot]], at, gain, 0
        for child, cg, ch, cn in ((2 * node + 1, lg, lh, ln), (2 * node + 2, g - lg, h - lh, n - ln)):
            tree.value[child] = leaf_value(cg, ch, cfg)
            if depth + 1 < cfg.depth and ch / _ONE >= 2 * cfg.min_child_weight:
                more.append((child, int(cn)))
    return more


def depth_of(node: int) -> int:
    return (node + 1).bit_length() - 1


CELLS = 1 << 16  # histogram cells that are searched at once: they stay in a core's cache


def grow(tree: Tree, root: int, bins: np.ndarray, g: np.ndarray, h: np.ndarray,
         columns: np.ndarray, width: int, cfg: StyloConfig) -> None:
    """Grow the subtree of ``root`` in place from all of its rows.

    Of two siblings only the smaller one is counted: the larger one's sums are the parent's
    less those. Sums are whole numbers, so the difference is exact.
    """
    drawn = [np.ascontiguousarray(bins[:, c]) for c in columns]
    node, rows = np.full(len(g), root), np.arange(len(g))
    level, depth, above = [root], depth_of(root), None
    while level:
        slots = len(level)
        sums = np.empty((2, len(columns), slots, width))
        slot_of = np.full(len(tree.feature), -1)
        if above is None:
            slot_of[root] = 0
            _count(sums, [0], slot_of, drawn, g, h, node, rows, width)
        else:
            sizes, place = np.bincount(node, minlength=len(tree.feature)), {n: i for i, n in enumerate(level)}
            parents = sorted({(n - 1) // 2 for n in level})
            small = [2 * p + 1 if sizes[2 * p + 1] <= sizes[2 * p + 2] else 2 * p + 2 for p in parents]
            slot_of[small] = np.arange(len(small))
            counted = np.empty((2, len(columns), len(small), width))
            _count(counted, range(len(small)), slot_of, drawn, g, h, node, rows, width)
            for i, (parent, child) in enumerate(zip(parents, small)):
                other = 4 * parent + 3 - child
                if child in place:
                    sums[:, :, place[child]] = counted[:, :, i]
                if other in place:
                    np.subtract(above[0][:, :, above[1][parent]], counted[:, :, i], out=sums[:, :, place[other]])
        found, step = np.empty((len(columns), slots, 8)), max(1, CELLS // (slots * width))
        for at in range(0, len(columns), step):
            found[at:at + step] = best_splits(sums[:, at:at + step].reshape(2, -1, width), cfg).reshape(-1, slots, 8)
        above = sums, {n: i for i, n in enumerate(level)}
        level = [c for c, _ in put(tree, level, found, columns, cfg, depth)]
        depth += 1
        # Rows of the nodes that were split go to the children; those of leaves are through.
        feature = tree.feature[node]
        open_ = feature >= 0
        rows, node, feature = rows[open_], node[open_], feature[open_]
        node = 2 * node + 1 + (bins[rows, feature] > tree.bin[node])


def _count(sums, slots, slot_of, drawn, g, h, node, rows, width) -> None:
    """Put the sums of gradients and Hessians of the nodes with a slot into ``sums``."""
    slot = slot_of[node]
    here = slot >= 0
    rows, base, size = rows[here], slot[here] * width, len(slots) * width
    g, h = g[rows], h[rows]
    for i, column in enumerate(drawn):
        at = base + column[rows]
        sums[0, i], sums[1, i] = np.bincount(at, g, size).reshape(-1, width), np.bincount(at, h, size).reshape(-1, width)


# --- rows in blocks ----------------------------------------------------------------------


def cut_points(train: DataFrame, names: list[str], cfg: StyloConfig) -> list[np.ndarray]:
    """At most ``max_bins - 1`` cuts per feature: equal steps in rank, distinct values once."""
    if not names:
        return []
    at = [i / cfg.max_bins for i in range(1, cfg.max_bins)]
    row = train.agg(*[F.percentile_approx(n, at, 20_000).alias(f"c{i}") for i, n in enumerate(names)]).first()
    return [np.unique(np.array(c if c is not None else [], float)) for c in row]


def blocks(rows: DataFrame, names: list[str], label: str, model: Boosted) -> DataFrame:
    """Written blocks of binned rows: uid, bins, label, val and margin as bytes."""
    kind = bin_type(model.cuts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))], 1).astype(float) \
                if names else np.zeros((len(batch), 0))
            for at in range(0, len(batch), BLOCK_ROWS):
                part = slice(at, at + BLOCK_ROWS)
                label_, val, uid = (batch.column(c).to_numpy(zero_copy_only=False)[part] for c in ("_label", "_val", "_uid"))
                yield block(uid.astype(np.int64), model.binned(values[part]).astype(kind), label_.astype(float), val.astype(np.uint8), np.zeros(len(uid)))

    d = rows.select(*[F.col(n).cast("double").alias(f"_f{i}") for i, n in enumerate(names)],
                    F.col(label).cast("double").alias("_label"), (F.col("split") == "val").cast("int").alias("_val"),
                    F.monotonically_increasing_id().alias("_uid"))
    return materialise(d.mapInArrow(work, _BLOCK), "boosting-blocks")


def bin_type(cuts: list[np.ndarray]) -> type:
    """The narrowest type that holds the bins."""
    return np.uint8 if all(len(c) < 256 for c in cuts) else np.int16


_BLOCK = "rows long, train long, uid binary, bins binary, label binary, val binary, margin binary"


def block(uid, bins, label, val, margin) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{
        "rows": len(uid), "train": int((val == 0).sum()), "uid": uid.tobytes(), "bins": bins.tobytes(),
        "label": label.tobytes(), "val": val.tobytes(), "margin": margin.tobytes()}],
        pa.schema([("rows", pa.int64()), ("train", pa.int64()), *[(n, pa.binary()) for n in ("uid", "bins", "label", "val", "margin")]]))


def opened(batches: Iterator[pa.RecordBatch], features: int, kind: type) -> Iterator[tuple]:
    """(uid, bins, label, val, margin) of every block."""
    for batch in batches:
        for row in batch.select(["uid", "bins", "label", "val", "margin"]).to_pylist():
            uid = np.frombuffer(row["uid"], np.int64)
            yield (uid, np.frombuffer(row["bins"], kind).reshape(len(uid), features), np.frombuffer(row["label"]), np.frombuffer(row["val"], np.uint8) > 0, np.frombuffer(row["margin"]))


_KEPT: OrderedDict = OrderedDict()  # in a worker: (fit, first row of a block) -> trees added, margins


class Fit:
    """A fit in progress: blocks of rows, the trees so far, and how many of them the written margins hold."""

    def __init__(self, rows: DataFrame, names: list[str], label: str, cfg: StyloConfig):
        self.cfg, self.features = cfg, len(names)
        self.model = Boosted(cut_points(rows.where(F.col("split") == "train"), names, cfg))
        self.width, self.kind = max((len(c) + 1 for c in self.model.cuts), default=1), bin_type(self.model.cuts)
        self.token = uuid.uuid4().hex
        self.table = blocks(rows, names, label, self.model)
        size = self.table.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("train"), F.lit(0)).alias("train"),
                              F.count("*").alias("blocks")).first()
        # Each of these tasks adds up some columns; more than run at once only wait for each other.
        cores = self.table.sparkSession.sparkContext.defaultParallelism
        self.rows, self.train, self.tasks = size["rows"], size["train"], max(1, min(size["blocks"], len(names), cores))
        self.val, self.held, self.loaded = self.rows - self.train, 0, None

    def run(self) -> Boosted:
        """Rounds until the loss on val rows has not improved for ``patience`` of them; the best prefix."""
        try:
            return self._run()
        finally:
            self._unload()

    def _run(self) -> Boosted:
        cfg, model = self.cfg, self.model
        while len(model.trees) < cfg.trees and self.train and self.features and not stopped(model.losses, cfg.patience):
            if self.rows <= cfg.rows_in_task:
                self._rounds_in_task(min(cfg.rounds_per_job, cfg.trees - len(model.trees)))
            else:
                self._round()
                if len(model.trees) - self.held >= REWRITE:
                    self._rewrite()
        if self.val and len(model.losses) < len(model.trees):
            model.losses.append(self._val_loss())
        return model.first(best_round(model.losses)) if self.val else model

    # All rows in one task.

    def _rounds_in_task(self, rounds: int) -> None:
        cfg, model, width, held = self.cfg, self.model, self.width, self.held
        features, state, kind = self.features, self.model.to_dict(), self.kind

        def work(batches):
            parts = list(opened(batches, features, kind))
            if not parts:
                return
            uid, bins, label, val, margin = (np.concatenate(x) for x in zip(*parts))
            done = Boosted.from_dict(state)
            for tree in done.trees[held:]:
                margin = margin + tree.value[tree.leaves(bins)]
            train = ~val
            while len(done.trees) < len(state["trees"]) + rounds and not stopped(done.losses, cfg.patience):
                number = len(done.trees)
                tree, columns = Tree.empty(cfg.depth), drawn_columns(number, features, cfg)
                use = train & drawn_rows(uid, number, cfg)
                g, h = gradients(margin[use], label[use])
                grow(tree, 0, bins[use], g, h, columns, width, cfg)
                margin = margin + tree.value[tree.leaves(bins)]
                done.trees.append(tree)
                if val.any():
                    done.losses.append(loss_units(margin[val], label[val]) / _ONE / int(val.sum()))
            yield pa.RecordBatch.from_pylist(
                [{"number": i, "tree": _packed(t.listed()), "loss": done.losses[i] if done.losses else None}
                 for i, t in enumerate(done.trees) if i >= len(state["trees"])], _TREES)

        found = self.table.repartition(1).mapInArrow(work, "number long, tree binary, loss double").collect()
        self._take(sorted((r["number"], r["tree"], r["loss"]) for r in found))

    def _take(self, found: list[tuple]) -> None:
        n = (2 << self.cfg.depth) - 1
        for _, tree, loss in found:
            self.model.trees.append(_unpacked(tree, n))
            if loss is not None:
                self.model.losses.append(loss)

    # Rows over many tasks.

    def _loaded(self):
        """The written blocks as arrays, held until they are written anew."""
        if self.loaded is None:
            features, kind = self.features, self.kind

            def work(rows):
                for uid, bins, label, val, margin in rows:
                    uid = np.frombuffer(uid, np.int64)
                    yield (uid, np.frombuffer(bins, kind).reshape(len(uid), features), np.frombuffer(label),
                           np.frombuffer(val, np.uint8) > 0, np.frombuffer(margin))

            self.loaded = self.table.select("uid", "bins", "label", "val", "margin").rdd.mapPartitions(work).persist(
                StorageLevel.MEMORY_AND_DISK)
        return self.loaded

    def _unload(self) -> None:
        if self.loaded is not None:
            self.loaded.unpersist()
        self.loaded = None

    def _margins(self, uid: np.ndarray, bins: np.ndarray, margin: np.ndarray) -> np.ndarray:
        """Margins of a block after the trees so far: one addition a tree, from wherever this worker had come to."""
        key, trees = (self.token, int(uid[0])), self.model.trees
        done, kept = _KEPT.pop(key, (self.held, margin))
        if not self.held <= done <= self.held + len(trees):
            done, kept = self.held, margin
        for tree in trees[done - self.held:]:
            kept = kept + tree.value[tree.leaves(bins)]
        _KEPT[key] = self.held + len(trees), kept
        while len(_KEPT) > KEPT_BLOCKS:
            _KEPT.popitem(last=False)
        return kept

    def _blocks(self, blocks_) -> Iterator[tuple]:
        """(uid, bins, label, val, margin after the trees so far) of every block."""
        for uid, bins, label, val, margin in blocks_:
            yield uid, bins, label, val, self._margins(uid, bins, margin)

    def _drawn(self, block: tuple, tree: Tree, number: int) -> tuple:
        """Drawn train rows of a block with gradients and the node of the growing tree that each is in."""
        uid, bins, label, val, margin = block
        use = ~val & drawn_rows(uid, number, self.cfg)
        bins = bins[use]
        return bins, *gradients(margin[use], label[use]), tree.leaves(bins)

    def _slim(self) -> Fit:
        """What tasks need of this object: of the trees those that the written margins don't hold."""
        out = object.__new__(Fit)
        out.cfg, out.features, out.kind, out.held, out.token = self.cfg, self.features, self.kind, self.held, self.token
        out.model = Boosted([], self.model.trees[self.held:])
        return out

    def _round(self) -> None:
        """One more tree, unless the loss of the last one, which the first job sums up, ends the fit."""
        cfg, number = self.cfg, len(self.model.trees)
        tree, columns = Tree.empty(cfg.depth), drawn_columns(number, self.features, cfg)
        large, small = [(0, self.train)], []
        while large:
            depth = depth_of(large[0][0])
            nodes = [n for n, _ in large]
            found, loss = self._split(tree, nodes, columns, number)
            if depth == 0 and self.val and number:
                self.model.losses.append(loss / _ONE / self.val)
                if stopped(self.model.losses, cfg.patience):
                    return
            children = put(tree, nodes, found, columns, cfg, depth)
            large = [c for c in children if c[1] > cfg.rows_in_task]
            small += [c for c in children if c[1] <= cfg.rows_in_task]
        if small:
            self._subtrees(tree, small, columns, number)
        self.model.trees.append(tree)

    def _split(self, tree: Tree, nodes: list[int], columns: np.ndarray, number: int) -> tuple[np.ndarray, int]:
        """Best split of each node by each column, histograms of blocks summed by column; at the root also the loss on val rows."""
        fit, width, cfg, slots = self._slim(), self.width, self.cfg, len(nodes)
        slot_of = np.full(len(tree.feature), -1)
        slot_of[nodes] = np.arange(slots)
        root = nodes == [0]

        def partial(blocks_):
            total, loss = None, 0
            for block in fit._blocks(blocks_):
                if root:
                    loss += _loss(block)
                bins, g, h, node = fit._drawn(block, tree, number)
                slot = slot_of[node]
                here = slot >= 0
                if not here.all():
                    bins, g, h, slot = bins[here], g[here], h[here], slot[here]
                own = histograms(bins[:, columns], g, h, slot, slots, width)
                if total is None:
                    total = own
                else:
                    total += own
            if total is not None:
                yield from ((i, total[:, i]) for i in range(len(columns)))
                yield -1, loss

        def whole(rows):
            total: dict = {}
            for column, own in rows:
                total[column] = total[column] + own if column in total else own
            return [(c, a if c < 0 else best_splits(a.reshape(3, slots, width), cfg)) for c, a in total.items()]

        tasks = self.tasks
        found = dict(self._loaded().mapPartitions(partial).partitionBy(tasks, lambda c: c % tasks).mapPartitions(whole).collect())
        return np.stack([found[i] for i in range(len(columns))]).reshape(len(columns), slots, 8), found[-1]

    def _subtrees(self, tree: Tree, nodes: list[tuple[int, int]], columns: np.ndarray, number: int) -> None:
        """Rows of each small node (node, rows) go to one task, which grows its subtree; a task has the whole nodes it is dealt."""
        fit, width, cfg = self._slim(), self.width, self.cfg
        # The largest nodes first, each to the task with the fewest rows: a task holds two times rows_in_task at most.
        cores, size = self.table.sparkSession.sparkContext.defaultParallelism, sum(n for _, n in nodes)
        task_of, load = np.full(len(tree.feature), -1), [0] * min(len(nodes), max(cores, -(-size // max(1, cfg.rows_in_task))))
        for node, rows in sorted(nodes, key=lambda n: (-n[1], n[0])):
            task_of[node] = load.index(min(load))
            load[task_of[node]] += rows

        def dealt(blocks_):
            for block in fit._blocks(blocks_):
                bins, g, h, node = fit._drawn(block, tree, number)
                for root in np.unique(node[task_of[node] >= 0]).tolist():
                    own = node == root
                    yield int(task_of[root]), (root, bins[own], g[own].astype(np.int32), h[own].astype(np.int32))

        def grown(rows):
            parts: dict = {}
            for _, (root, *part) in rows:
                parts.setdefault(root, []).append(part)
            for root in list(parts):
                bins, g, h = (np.concatenate(x) for x in zip(*parts.pop(root)))
                own = Tree.empty(cfg.depth)
                grow(own, root, bins, g.astype(float), h.astype(float), columns, width, cfg)
                yield _packed(own.listed())

        for found in self._loaded().mapPartitions(dealt).partitionBy(len(load), int).mapPartitions(grown).collect():
            own = _unpacked(found, len(tree.feature))
            below = (own.feature >= 0) | (own.value != 0)
            for name in ("feature", "bin", "value", "gain"):
                getattr(tree, name)[below] = getattr(own, name)[below]

    def _val_loss(self) -> float:
        fit = self._slim()
        return self._loaded().mapPartitions(lambda blocks_: [sum(_loss(block) for block in fit._blocks(blocks_))]).sum() / _ONE / self.val

    def _rewrite(self) -> None:
        fit = self._slim()

        def work(batches):
            for uid, bins, label, val, margin in fit._blocks(opened(batches, fit.features, fit.kind)):
                yield block(uid, bins, label, val.astype(np.uint8), margin)

        self._unload()
        self.table = materialise(self.table.mapInArrow(work, _BLOCK), "boosting-blocks")
        self.held = len(self.model.trees)


def _loss(block: tuple) -> int:
    """Loss of a block's val rows, in units."""
    _, _, label, val, margin = block
    return loss_units(margin[val], label[val])


_TREES = pa.schema([("number", pa.int64()), ("tree", pa.binary()), ("loss", pa.float64())])


def _packed(listed: list) -> bytes:
    return np.array(listed, np.float64).tobytes()


def _unpacked(data: bytes, n: int) -> Tree:
    at, feature, bin_, value, gain = np.frombuffer(data).reshape(5, -1)
    tree, at = Tree(np.full(n, -1, np.int16), np.zeros(n, np.int16), np.zeros(n), np.zeros(n)), at.astype(np.int64)
    tree.feature[at], tree.bin[at], tree.value[at], tree.gain[at] = feature, bin_, value, gain
    return tree


def best_round(losses: list[float]) -> int:
    """The number of rounds with the least loss, the first of equal ones."""
    return int(np.argmin(losses)) + 1 if losses else 0


def stopped(losses: list[float], patience: int) -> bool:
    return bool(losses) and len(losses) - best_round(losses) >= patience


def fit(rows: DataFrame, names: list[str], label: str, cfg: StyloConfig) -> Boosted:
    """Trees on the rows of split ``train``, stopped by the loss on those of split ``val``."""
    return Fit(rows, names, label, cfg).run()
