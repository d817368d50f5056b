"""The fusion head: a small perceptron fitted by mini-batch Adam over summed gradients.

Layers of rectified units with dropout end in one sigmoid. An epoch deals the train rows
into mini-batches by a hash of (row, epoch); a step sums the gradients of its rows
and moves the weights; after an epoch the loss on the val rows is taken, the
best weights are kept, and ``patience`` epochs without a better loss end the fit.

Batches have ``batch_rows`` rows, or as many as make ``max_steps`` steps an epoch, so the
number of jobs doesn't grow with the rows. Blocks' gradients are rounded to whole multiples
of 2^-40 before they are added: sums are exact, and a fit is the same however its blocks
were dealt. If all rows are at most ``rows_in_task``, one task does all epochs. Else a job
brings the batches of as many steps as make that many rows to one task, which takes those
steps one after the other; a batch that is larger than that is summed over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.config import FusionConfig
from inkprint.operators.boosting import mixed
from inkprint.session import materialise

BLOCK_ROWS = 1 << 13
_UNIT = float(1 << 40)
_BLOCK = "rows long, train long, uid binary, x binary, label binary, val binary"


def shapes(inputs: int, hidden: tuple[int, ...]) -> list[tuple[int, int]]:
    wide = [inputs, *hidden, 1]
    return [(a + 1, b) for a, b in zip(wide, wide[1:])]  # the last row of a layer is its bias


def unpacked(flat: np.ndarray, layers: list[tuple[int, int]]) -> list[np.ndarray]:
    ends = np.cumsum([a * b for a, b in layers])[:-1]
    return [w.reshape(s) for w, s in zip(np.split(flat, ends), layers)]


def first_weights(layers: list[tuple[int, int]], seed: int) -> np.ndarray:
    """Weights and biases uniform within one over the root of a unit's inputs."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-1, 1, a * b) / np.sqrt(a - 1) for a, b in layers])


def kept_units(uid: np.ndarray, epoch: int, layer: int, units: int, drop: float, seed: int) -> np.ndarray:
    """Dropout of a layer: each (row, epoch, unit) draws for itself; kept units are scaled up."""
    if not drop:
        return np.ones((len(uid), units))
    row = mixed(uid, seed * 7_919 + epoch * 64 + layer + 1)
    draw = mixed(row[:, None] + np.arange(units, dtype=np.uint64), 17)
    return (draw >= np.uint64(int(drop * 2.0**64))) / (1 - drop)


def forward(weights: list[np.ndarray], x: np.ndarray, masks: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Outputs of every layer, the margin last."""
    out = [x]
    for i, w in enumerate(weights):
        z = out[-1] @ w[:-1] + w[-1]
        if i < len(weights) - 1:
            z = np.maximum(z, 0)
            z = z * masks[i] if masks is not None else z
        out.append(z)
    return out


def gradient(flat: np.ndarray, layers, x: np.ndarray, label: np.ndarray, masks: list[np.ndarray]) -> np.ndarray:
    """Summed gradient of the log loss over the rows, in whole units."""
    weights = unpacked(flat, layers)
    out = forward(weights, x, masks)
    back = 1 / (1 + np.exp(-out[-1])) - label[:, None]
    found = []
    for i in range(len(weights) - 1, -1, -1):
        found.append(np.concatenate([out[i].T @ back, back.sum(0, keepdims=True)]).reshape(-1))
        if i:
            back = (back @ weights[i][:-1].T) * (out[i] > 0) * masks[i - 1]
    return np.rint(np.concatenate(found[::-1]) * _UNIT).astype(np.int64)


def loss_units(flat: np.ndarray, layers, x: np.ndarray, label: np.ndarray) -> int:
    margin = forward(unpacked(flat, layers), x)[-1][:, 0]
    return int(np.rint(np.logaddexp(0, np.where(label > 0, -margin, margin)) * (1 << 24)).sum())


def pieces(block, epoch: int, first: int, last: int, steps: int, cfg: FusionConfig) -> Iterator[tuple]:
    """(step, uid, x, label) of a block's train rows in the mini-batches ``first`` up to ``last`` of an epoch."""
    uid, x, label, val = block
    rows = np.flatnonzero(~val)
    step_of = (mixed(uid[rows], cfg.seed * 104_729 + epoch + 1) % np.uint64(steps)).astype(np.int64)
    order = np.argsort(step_of, kind="stable")
    ends = np.searchsorted(step_of[order], np.arange(first, last + 1))
    for step, at, end in zip(range(first, last), ends, ends[1:]):
        if at < end:
            own = rows[order[at:end]]
            yield step, uid[own], x[own], label[own]


def batch_gradient(flat, layers, parts: list[tuple], epoch: int, cfg: FusionConfig) -> tuple[np.ndarray, int]:
    """Gradient and rows of the pieces (uid, x, label) of one mini-batch, each piece's rounded for itself."""
    if not parts:
        return np.zeros(len(flat), np.int64), 0
    uid = np.concatenate([part[0] for part in parts])
    masks = [kept_units(uid, epoch, i, units, drop, cfg.seed) for i, (units, drop) in enumerate(zip(cfg.hidden, cfg.dropout))]
    total, at = np.zeros(len(flat), np.int64), 0
    for own, x, label in parts:
        total += gradient(flat, layers, x, label, [m[at:at + len(own)] for m in masks])
        at += len(own)
    return total, len(uid)


def by_step(found: Iterator[tuple]) -> dict[int, list[tuple]]:
    """Pieces of each mini-batch."""
    out: dict[int, list[tuple]] = {}
    for step, *part in found:
        out.setdefault(step, []).append(part)
    return out


class Adam:
    """Weights with their running moments."""

    def __init__(self, flat: np.ndarray, rate: float):
        self.flat, self.rate, self.time = flat, rate, 0
        self.mean, self.square = np.zeros_like(flat), np.zeros_like(flat)

    def step(self, units: np.ndarray, rows: int) -> None:
        if not rows:
            return
        g = units / _UNIT / rows
        self.time += 1
        self.mean = 0.9 * self.mean + 0.1 * g
        self.square = 0.999 * self.square + 0.001 * g * g
        m, s = self.mean / (1 - 0.9**self.time), self.square / (1 - 0.999**self.time)
        self.flat = self.flat - self.rate * m / (np.sqrt(s) + 1e-8)


def epochs(start: np.ndarray, val_rows: int, cfg: FusionConfig, stepped, val_loss) -> tuple[np.ndarray, list[float]]:
    """The loop: ``stepped(adam, epoch)`` gives the state after an epoch's steps, ``val_loss(flat)`` the units of loss."""
    adam, best, losses = Adam(start, cfg.rate), start, []
    for epoch in range(cfg.max_iter):
        adam = stepped(adam, epoch)
        if not val_rows:
            best = adam.flat
            continue
        losses.append(val_loss(adam.flat) / (1 << 24) / val_rows)
        if losses[-1] == min(losses) and losses.index(losses[-1]) == epoch:
            best = adam.flat
        elif epoch - int(np.argmin(losses)) >= cfg.patience:
            break
    return best, losses


@dataclass
class Head:
    """A fitted head; ``losses`` are those on the val rows by epoch."""

    inputs: int
    hidden: tuple[int, ...]
    flat: np.ndarray
    losses: list[float]

    def margins(self, x: np.ndarray) -> np.ndarray:
        return forward(unpacked(self.flat, shapes(self.inputs, self.hidden)), x)[-1][:, 0]

    def probability(self, columns: list[Column]) -> Column:
        model = self

        @F.pandas_udf("double")
        def score(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-model.margins(rows.to_numpy(np.float64)))))

        return score(F.struct(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)]))

    def to_dict(self) -> dict:
        return {"inputs": self.inputs, "hidden": list(self.hidden), "flat": self.flat.tolist(), "losses": self.losses}

    @classmethod
    def from_dict(cls, d: dict) -> Head:
        return cls(d["inputs"], tuple(d["hidden"]), np.array(d["flat"]), d["losses"])


def _opened(batches: Iterator[pa.RecordBatch], inputs: int) -> Iterator[tuple]:
    for batch in batches:
        for row in batch.to_pylist():
            uid = np.frombuffer(row["uid"], np.int64)
            yield (uid, np.frombuffer(row["x"]).reshape(len(uid), inputs), np.frombuffer(row["label"]),
                   np.frombuffer(row["val"], np.uint8) > 0)


def _blocks(rows: DataFrame, names: list[str], label: str) -> DataFrame:
    def work(batches):
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            for at in range(0, len(batch), BLOCK_ROWS):
                x = np.stack([c[at:at + BLOCK_ROWS] for c in cols[:-3]], 1).astype(float)
                label_, val, uid = (c[at:at + BLOCK_ROWS] for c in cols[-3:])
                yield pa.RecordBatch.from_pylist([{
                    "rows": len(uid), "train": int((val == 0).sum()), "uid": uid.astype(np.int64).tobytes(), "x": x.tobytes(),
                    "label": label_.astype(float).tobytes(), "val": val.astype(np.uint8).tobytes()}],
                    pa.schema([("rows", pa.int64()), ("train", pa.int64()), *[(n, pa.binary()) for n in ("uid", "x", "label", "val")]]))

    d = rows.where(F.col("split").isin("train", "val")).select(
        *[F.col(n).cast("double").alias(f"_x{i}") for i, n in enumerate(names)], F.col(label).cast("double").alias("_label"),
        (F.col("split") == "val").cast("int").alias("_val"), F.monotonically_increasing_id().alias("_uid"))
    return materialise(d.mapInArrow(work, _BLOCK), "fusion-blocks")


def fit(rows: DataFrame, names: list[str], label: str, cfg: FusionConfig) -> Head:
    """A head on the rows of split ``train``, stopped by the loss on those of split ``val``."""
    table, inputs, layers = _blocks(rows, names, label), len(names), shapes(len(names), cfg.hidden)
    size = table.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "train")]).first()
    val_rows, steps = size["rows"] - size["train"], min(cfg.max_steps, max(1, -(-size["train"] // cfg.batch_rows)))
    start = first_weights(layers, cfg.seed)
    if not size["train"]:
        return Head(inputs, cfg.hidden, start, [])
    if size["rows"] <= cfg.rows_in_task:
        def work(batches):
            held = list(_opened(batches, inputs))
            if not held:
                return

            def stepped(adam, epoch):
                batches_ = by_step(p for b in held for p in pieces(b, epoch, 0, steps, steps, cfg))
                for step in range(steps):
                    adam.step(*batch_gradient(adam.flat, layers, batches_.get(step, []), epoch, cfg))
                return adam

            flat, losses = epochs(start, val_rows, cfg, stepped,
                                  lambda flat: sum(loss_units(flat, layers, x[v], y[v]) for _, x, y, v in held))
            yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()]), pa.array([losses], pa.list_(pa.float64()))], ["flat", "losses"])

        done = table.repartition(1).mapInArrow(work, "flat array<double>, losses array<double>").first()
        return Head(inputs, cfg.hidden, np.array(done["flat"]), done["losses"])

    def decoded(rows_):
        for uid, x, y, v in rows_:
            uid = np.frombuffer(uid, np.int64)
            yield uid, np.frombuffer(x).reshape(len(uid), inputs), np.frombuffer(y), np.frombuffer(v, np.uint8) > 0

    blocks = table.select("uid", "x", "label", "val").rdd.mapPartitions(decoded).persist(StorageLevel.MEMORY_AND_DISK)
    together = cfg.rows_in_task // -(-size["train"] // steps)  # steps whose rows one task may hold

    def summed(flat, epoch, step):
        """A batch's (gradient, rows), summed over all tasks."""
        def partial(blocks_):
            total, rows_ = np.zeros(len(flat), np.int64), 0
            for b in blocks_:
                g, n = batch_gradient(flat, layers, [p[1:] for p in pieces(b, epoch, step, step + 1, steps, cfg)], epoch, cfg)
                total, rows_ = total + g, rows_ + n
            yield total, rows_

        return blocks.mapPartitions(partial).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))

    def taken(adam, epoch, first, last):
        """The state after the steps of some batches, whose rows go to one task."""
        def own(blocks_):
            return ((0, p) for b in blocks_ for p in pieces(b, epoch, first, last, steps, cfg))

        def work(rows_):
            batches_ = by_step(p for _, p in rows_)
            for step in range(first, last):
                adam.step(*batch_gradient(adam.flat, layers, batches_.get(step, []), epoch, cfg))
            yield adam

        return blocks.mapPartitions(own).partitionBy(1, int).mapPartitions(work).collect()[0]

    def stepped(adam, epoch):
        if together:
            for first in range(0, steps, together):
                adam = taken(adam, epoch, first, min(first + together, steps))
        else:
            for step in range(steps):
                adam.step(*summed(adam.flat, epoch, step))
        return adam

    def val_loss(flat):
        return blocks.map(lambda b: loss_units(flat, layers, b[1][b[3]], b[2][b[3]])).sum()

    try:
        return Head(inputs, cfg.hidden, *epochs(start, val_rows, cfg, stepped, val_loss))
    finally:
        blocks.unpersist()
