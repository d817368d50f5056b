"""Quality scores: a Gaussian kernel on document statistics by random Fourier features.

Every whole text is reduced to a few statistics. They are standardised, clipped and
mapped to cosines of fixed random projections, whose inner products approach a Gaussian
kernel. Tasks sum the normal equations of their labelled rows; the sums are added in
two steps by row of the matrix, and the driver solves one system whose size is a
parameter. A fold of its own among the labelled rows then calibrates: scores fall into
fixed bins, and pooling adjacent violators over the bins makes shares that never fall.

Defined cases: a null or empty text has statistics of zero and gets a score; rows with
equal ids are scored one by one; of several labels of an id the largest counts; null
labels and labels of missing ids are left out; with labels of no or one class the score
is the smoothed share of that class; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm.common import rows_by_python, stage, table
from inkprint.llm.words import bounds, hashes, shingle_hashes, slices

FEATURES = 256
WIDTH = 4.0
RIDGE = 1e-2
SEED = 7
CLIP = 4.0
BINS = 512
THRESHOLD = 0.3

# Classes of bytes whose shares are statistics.
_CLASSES = {"letter": [*range(65, 91), *range(97, 123)], "upper": [*range(65, 91)], "digit": [*range(48, 58)],
            "space": [9, 10, 11, 12, 13, 32], "stop": [ord(c) for c in ".,;:"], "shout": [ord(c) for c in "!?"],
            "symbol": [ord(c) for c in "#*$%&|<>"], "other": [ord(c) for c in "\"'()[]{}/\\@^_`~+=-"],
            "wide": [*range(128, 256)], "line": [10], "bar": [ord("|")]}
_LOOKUP = np.zeros((len(_CLASSES), 256), np.uint8)
for _i, _codes in enumerate(_CLASSES.values()):
    _LOOKUP[_i, _codes] = 1
STATISTICS = [*_CLASSES, "words", "length", "spread", "longest", "distinct", "top", "again", "lines_again",
              "line_words", "sentence", "marked"]


def _shares(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (run[offsets[1:]] - run[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics per text."""
    parts = [np.zeros((0, len(STATISTICS)))]
    for _, _, data, offsets in slices(texts):
        n, cols = len(offsets) - 1, []
        cols += [_shares(row[data], offsets) for row in _LOOKUP]
        starts, ends = bounds(data, offsets)
        at = np.searchsorted(starts, offsets)
        sizes, counts = (ends - starts).astype(np.float64), np.diff(at)
        some = np.maximum(counts, 1)
        run = lambda x: (lambda c: c[at[1:]] - c[at[:-1]])(np.concatenate([[0], np.cumsum(x)]))
        mean = run(sizes) / some
        marks = _LOOKUP[list(_CLASSES).index("symbol")] | _LOOKUP[list(_CLASSES).index("shout")]
        tail = marks[data[np.maximum(ends - 1, 0)]] if len(ends) else np.zeros(0)
        words = hashes(data, starts, ends, True)
        grams, gat = shingle_hashes(words, at, 4)
        rows = np.zeros((n, 5))
        edges = np.concatenate([[-1], np.flatnonzero(data == 10)])
        for i in range(n):
            own = words[at[i]:at[i + 1]]
            if len(own):
                _, times = np.unique(own, return_counts=True)
                g = grams[gat[i]:gat[i + 1]]
                rows[i, 0], rows[i, 1] = len(times) / len(own), times.max() / len(own)
                rows[i, 2] = 1 - len(np.unique(g)) / len(g)
                rows[i, 4] = sizes[at[i]:at[i + 1]].max()
        breaks = np.unique(np.concatenate([edges[1:] + 1, offsets[:-1], offsets[1:]]))
        lines = hashes(data, breaks[:-1], breaks[1:], False) if len(breaks) > 1 else np.zeros(0, np.uint64)
        lat = np.searchsorted(breaks, offsets)
        for i in range(n):
            own = lines[lat[i]:lat[i + 1]]
            rows[i, 3] = 1 - len(np.unique(own)) / len(own) if len(own) else 0
        ended = _shares(_LOOKUP[list(_CLASSES).index("stop")][data], offsets) * np.diff(offsets)
        square = run(sizes * sizes) / some - mean * mean
        cols += [np.log1p(counts), mean, np.sqrt(np.maximum(square, 0)), np.log1p(rows[:, 4]), rows[:, 0], rows[:, 1],
                 rows[:, 2], rows[:, 3], np.log1p(counts / np.maximum(np.diff(lat), 1)),
                 np.log1p(counts / (ended + 1)), run(tail) / some]
        parts.append(np.stack(cols, 1))
    return np.concatenate(parts)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every document, as a written table."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column("text"))
            flat = pa.array(x.astype(np.float64).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)), flat)], ["doc_id", "x"])

    return stage(rows_by_python(docs.select("doc_id", "text"), work, "doc_id long, x array<double>"), "quality-x")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), len(STATISTICS))


def fourier(x: np.ndarray, model: dict) -> np.ndarray:
    """The random features of statistics, and a constant."""
    z = np.clip((x - model["mean"]) / model["scale"], -CLIP, CLIP)
    return np.concatenate([np.sqrt(2 / model["b"].size) * np.cos(z @ model["w"] + model["b"]), z,
                           np.ones((len(x), 1))], 1)


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    each = [F.struct(F.avg(F.col("x")[i]).alias("m"), F.stddev_pop(F.col("x")[i]).alias("s"))
            for i in range(len(STATISTICS))]
    got = rows.agg(F.array(*each).alias("a")).first()["a"]
    mean, scale = np.array([g["m"] or 0.0 for g in got]), np.array([g["s"] or 0.0 for g in got])
    return mean, np.where(scale > 1e-9, scale, 1.0)


def _normal(rows: DataFrame, model: dict) -> np.ndarray:
    """Sum of z z' over rows, z being features and label: by task, then in two steps by matrix row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z = np.concatenate([fourier(_matrix(batch.column("x")), model),
                                np.asarray(batch.column("y"), np.float64)[:, None]], 1)
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(total), TaskContext.get().partitionId() % 64, np.int32)),
                pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total))], ["part", "row", "v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for part, row, v in zip(batch.column("part").to_pylist(), batch.column("row").to_pylist(), batch.column("v")):
                v = np.asarray(v.values, np.float64)
                if (part, row) != now and now is not None:
                    yield one(now, total)
                total = total + v if (part, row) == now else v
                now = (part, row)
        if now is not None:
            yield one(now, total)

    def one(key, v) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()),
                                           pa.array([v])], ["part", "row", "v"])

    kind = "part int, row int, v array<double>"
    sums = rows_by_python(rows, work, kind)
    for key in (["part", "row"], ["row"]):
        sums = sums if len(key) == 2 else sums.withColumn("part", F.lit(0))
        sums = rows_by_python(sums.repartition(*key).sortWithinPartitions("part", "row"), added, kind)
    return np.array([r["v"] for r in sums.orderBy("row").collect()])


def pooled(good: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Shares of good rows by bin, pooled until they never fall; each with one pseudo-row."""
    prior = (good.sum() + 1) / (all_.sum() + 2)
    blocks: list[list[float]] = []
    for g, n in zip(good.tolist(), all_.tolist()):
        blocks.append([g, n, 1])
        while len(blocks) > 1 and (blocks[-1][1] == 0 or blocks[-2][1] == 0 or
                                   blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            g1, n1, w1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g1, blocks[-1][1] + n1, blocks[-1][2] + w1]
    out = np.concatenate([np.full(w, (g + prior) / (n + 1)) for g, n, w in blocks])
    return np.maximum.accumulate(out)


def fit(rows: DataFrame, *, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE,
        seed: int = SEED) -> dict:
    """A model from (x, y, calibrate): kernel weights from rows with calibrate false, bins from the others."""
    training, held = rows.where("NOT calibrate"), rows.where("calibrate")
    mean, scale = _moments(training)
    rng = np.random.default_rng(seed)
    d = len(STATISTICS)
    model = {"mean": mean, "scale": scale, "w": rng.normal(size=(d, features)) / width,
             "b": rng.uniform(0, 2 * np.pi, features), "beta": np.zeros(features + d + 1)}
    total = _normal(training.select("x", "y"), model)
    if len(total):
        n = max(total[-2, -2], 1.0)  # the constant's square sums to the rows
        penalty = np.eye(len(total) - 1) * ridge * n / features
        penalty[-1, -1] = 1e-9
        model["beta"] = np.linalg.solve(total[:-1, :-1] + penalty, total[:-1, -1])
    bins = _raw(held.select("x", "y"), model, ["y"]).groupBy(_bin("raw").alias("bin")).agg(
        F.sum("y").alias("good"), F.count("*").alias("n")).collect()
    good, all_ = np.zeros(BINS), np.zeros(BINS)
    for r in bins:
        good[r["bin"]], all_[r["bin"]] = r["good"], r["n"]
    model["curve"] = pooled(good, all_)
    return model


def _bin(raw: str):
    return F.least(F.greatest(F.floor((F.col(raw) + 0.5) / 2 * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")


def _raw(rows: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The ridge scores; labels lie at 0 and 1, bins reach from -0.5 to 1.5."""
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = fourier(_matrix(batch.column("x")), model) @ model["beta"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(raw)], [*keep, "raw"])

    return rows_by_python(rows, work, f"{schema}, raw double")


def scored(rows: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Calibrated scores of (x, ...): the curve, drawn straight between the middles of bins."""
    curve = F.array(*[F.lit(float(v)) for v in model["curve"]])
    at = F.least(F.greatest((F.col("raw") + 0.5) / 2 * BINS - 0.5, F.lit(0.0)), F.lit(BINS - 1.0))
    low = F.least(F.floor("_at"), F.lit(BINS - 2)).cast("int")
    return _raw(rows, model, keep).withColumn("_at", at).withColumn("_low", low).withColumn("_curve", curve).select(
        *keep, "raw", (F.get("_curve", F.col("_low")) + (F.get("_curve", F.col("_low") + 1) - F.get(
            "_curve", F.col("_low"))) * (F.col("_at") - F.col("_low"))).alias("score"))


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all documents, learnt from labels outside the held-out fold."""
    x = described(table(spark, sf, "documents"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    labels = table(spark, sf, "labels").where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("quality").cast("double").alias("y"))
    rows = stage(x.join(labels, "doc_id").where(fold != 0).select("x", "y", (fold == 1).alias("calibrate")), "quality-rows")
    return scored(x, fit(rows), ["doc_id"]).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
SQL = {}
