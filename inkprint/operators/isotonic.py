"""Monotone calibration by pooling adjacent violators in bounded groups.

Equal scores are one point of (sum of labels, rows). Points are numbered in order and cut
into groups of at most ``GROUP`` neighbours, each pooled by one task; the pools are written
and cut again half a group further, so that every seam lies inside a group, until two
rounds in a row pool nothing. The result is the least-squares fit, whatever the groups.

With labels 0 and 1 the pools' means are different fractions, and fractions with
denominators up to m need about m^3 / 5 rows: a billion rows leave a million pools at
most, and in practice a few thousand. Only those reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.session import materialise

GROUP = 100_000
_POOL = "lo double, hi double, y long, n long"


@dataclass
class Isotonic:
    """Ends of the pools and their values; straight lines between pools, end values outside."""

    x: np.ndarray
    y: np.ndarray

    def apply(self, score: Column) -> Column:
        x, y = self.x, self.y

        @F.pandas_udf("double")
        def calibrated(s: pd.Series) -> pd.Series:
            return pd.Series(np.interp(s.to_numpy(float), x, y) if len(x) else np.full(len(s), np.nan)).where(s.notna().to_numpy())

        return calibrated(score.cast("double"))

    def to_dict(self) -> dict:
        return {"x": self.x.tolist(), "y": self.y.tolist()}

    @classmethod
    def from_dict(cls, d: dict) -> Isotonic:
        return cls(np.array(d["x"]), np.array(d["y"]))


def pooled(rows: list[tuple]) -> list[tuple]:
    """Neighbours (lo, hi, y, n) pooled until the means rise strictly."""
    out: list[tuple] = []
    for lo, hi, y, n in rows:
        while out and out[-1][2] * n >= y * out[-1][3]:
            first, _, more, weight = out.pop()
            lo, y, n = first, y + more, n + weight
        out.append((lo, hi, y, n))
    return out


def _round(points: DataFrame, shift: int, group: int) -> DataFrame:
    """Points numbered by score, dealt into groups of neighbours, each group pooled."""
    spread = materialise(points.repartitionByRange("lo").sortWithinPartitions("lo").withColumn(
        "_part", F.spark_partition_id()).withColumn(
        "_row", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)), "isotonic-order")
    parts = spread.groupBy("_part").agg(F.count("*").alias("_rows"))  # a row per task
    parts = parts.select("_part", F.coalesce(F.sum("_rows").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    dealt = spread.join(F.broadcast(parts), "_part").select(
        "lo", "hi", "y", "n", F.floor((F.col("_before") + F.col("_row") + shift) / group).alias("group"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("group", "lo", "hi", "y", "n"))):
                if held and row[0] != now:
                    yield _batch(pooled(held))
                    held = []
                now = row[0]
                held.append(row[1:])
        if held:
            yield _batch(pooled(held))

    return materialise(dealt.repartition("group").sortWithinPartitions("group", "lo").mapInArrow(work, _POOL), "isotonic-pools")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["lo", "hi", "y", "n"])


def fit(rows: DataFrame, score: str, label: str, group: int | None = None) -> Isotonic:
    """The least-squares rising fit of labels 0 and 1 on a score; rows without either are left out."""
    group = group or GROUP
    points = rows.select(F.col(score).cast("double").alias("lo"), F.col(label).cast("long").alias("y")).where(
        F.col("lo").isNotNull() & F.col("y").isNotNull()).groupBy("lo").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    points = materialise(points.select("lo", F.col("lo").alias("hi"), "y", "n"), "isotonic-points")
    size, quiet, shift = points.count(), 0, 0
    while quiet < 2:
        whole = size <= group and not shift  # then this round's one group has no seam
        points = _round(points, shift, group)
        before, size = size, points.count()
        quiet = quiet + 1 if size == before else 0
        shift = 0 if shift else group // 2
        if whole:
            break
    found = sorted(tuple(r) for r in points.collect())
    x = np.array([v for lo, hi, _, _ in found for v in ((lo,) if lo == hi else (lo, hi))], float)
    y = np.array([y / n for lo, hi, y, n in found for _ in ((lo,) if lo == hi else (lo, hi))], float)
    return Isotonic(x, y)
