"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are summed over cells of source, language and topic. Raking scales the
cells so that each margin in turn meets its target share of the token budget, with no
cell above the tokens it has, until nothing moves. Raked over own tokens is a cell's
inclusion probability; a hash of the id decides on each document, so a document's fate
is the same on every run and any number of executors.

Cells use the categories that the targets name; all others share the name ``*``. The
targets bound the number of cells, whatever the data, and only cells reach the driver.
Each margin's targets are scaled to add up to one over the categories that have tokens.

A topic is a bucket of the longest-run content: the most frequent word of five or more
letters, by hash. Any other column can take its place.

Defined cases: a null source or language is the category ``*``; a null or empty text has
no tokens, joins the cell of its topic ``none`` and is kept with its cell's
probability; rows with equal ids share their fate; null ids are one id; a margin without
any token leaves the cells as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm.common import rows_by_python, stage, table

REST = "*"
TOPICS = 8
SEED = 17
BUDGET = 0.5
SWEEPS = 500
TOLERANCE = 1e-9
TARGETS = {
    "source": {f"src{i}": 1.0 for i in range(20)} | {REST: 1.0},
    "lang": {"en": 4.0, "fr": 2.0, "de": 2.0, "es": 2.0, REST: 1.0},
    "topic": {f"topic{i}": 1.0 for i in range(TOPICS)} | {"none": 1.0, REST: 1.0},
}


def measured(docs: DataFrame, topics: int = TOPICS) -> DataFrame:
    """(doc_id, source, lang, n_tokens, topic) of every whole text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names = [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").split()
                sizes.append(len(words))
                counts = Counter(w for w in words if len(w) > 4 and w.isalpha())
                most = max(counts.values(), default=0)
                top = min((w for w, n in counts.items() if n == most), default=None)
                names.append("none" if top is None else f"topic{xxhash.xxh64_intdigest(top.lower()) % topics}")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), batch.column("lang"),
                 pa.array(sizes, pa.int64()), pa.array(names, pa.string())],
                ["doc_id", "source", "lang", "n_tokens", "topic"])

    return rows_by_python(docs.select("doc_id", "text", "source", "lang"), work,
                          "doc_id long, source string, lang string, n_tokens long, topic string")


def rake(tokens: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], total: float,
         sweeps: int = SWEEPS) -> np.ndarray:
    """Cell weights that add up to ``total``, meet the margins (category, shares), and stay below ``tokens``.

    Where a cell is exhausted the margins can't all be met; the others take up what they can.
    """
    mass = tokens.astype(np.float64) * (total / max(tokens.sum(), 1))
    for _ in range(sweeps):
        before = mass.copy()
        for category, shares in margins:
            have = np.bincount(category, mass, len(shares))
            goal = np.where(have > 0, shares, 0)
            goal = goal / goal.sum() * total if goal.sum() > 0 else have
            mass = mass * np.divide(goal, have, out=np.ones_like(have), where=have > 0)[category]
            mass = np.minimum(mass, tokens)
        if np.abs(mass - before).max(initial=0) <= TOLERANCE * max(total, 1):
            break
    return mass


def calibrated(rows: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS,
               budget: float = BUDGET) -> tuple[list[str], list[tuple]]:
    """The cells' categories and probabilities; ``budget`` is the share of all tokens to keep."""
    names = list(targets)
    cells = _named(rows, targets).groupBy(*[f"_{c}" for c in names]).agg(
        F.sum("n_tokens").alias("n")).orderBy(*[f"_{c}" for c in names]).collect()
    tokens = np.array([r["n"] for r in cells], np.float64)
    margins = []
    for c in names:
        kinds = sorted(targets[c])
        margins.append((np.array([kinds.index(r[f"_{c}"]) for r in cells], np.int64),
                        np.array([targets[c][k] for k in kinds], np.float64)))
    mass = rake(tokens, margins, budget * tokens.sum()) if len(cells) else tokens
    chance = np.divide(mass, tokens, out=np.full(len(tokens), float(budget)), where=tokens > 0)
    return names, [(*[r[f"_{c}"] for c in names], float(min(p, 1.0))) for r, p in zip(cells, chance)]


def residuals(rows: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """(margin, category, target, reached): shares of the kept tokens that were asked for and that the mix expects.

    They differ where a category has too few tokens for its share, or where two margins
    contradict each other; categories without a row are listed with 0.
    """
    names, cells = calibrated(rows, targets, budget)
    fields = ", ".join(f"_{c} string" for c in names)
    chances = rows.sparkSession.createDataFrame(cells, f"{fields}, probability double")
    mass = _named(rows, targets).groupBy(*[f"_{c}" for c in names]).agg(F.sum("n_tokens").alias("n")).join(
        F.broadcast(chances), [f"_{c}" for c in names]).withColumn("mass", F.col("n") * F.col("probability"))
    whole = mass.agg(F.sum("mass")).first()[0] or 0.0
    wanted = [(c, k, float(v) / sum(targets[c].values())) for c in names for k, v in sorted(targets[c].items())]
    reached = mass.select(F.explode(F.array(*[F.struct(F.lit(c).alias("margin"), F.col(f"_{c}").alias("category"), "mass")
                                              for c in names])).alias("x")).select("x.*").groupBy("margin", "category").agg(
        F.sum("mass").alias("mass"))
    share = F.coalesce(F.col("mass") / F.lit(whole), F.lit(0.0)) if whole else F.lit(0.0)
    return rows.sparkSession.createDataFrame(wanted, "margin string, category string, target double").join(
        reached, ["margin", "category"], "left").select("margin", "category", "target", share.alias("reached"))


def _named(rows: DataFrame, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    for c, shares in targets.items():
        rows = rows.withColumn(f"_{c}", F.when(F.col(c).isin([k for k in shares if k != REST]), F.col(c)).otherwise(REST))
    return rows


def mixed(rows: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, budget: float = BUDGET,
          seed: int = SEED) -> DataFrame:
    """``rows`` (doc_id, n_tokens, target columns) with ``probability`` and ``kept``."""
    if missing := [c for c, shares in targets.items() if REST not in shares]:
        raise ValueError(f"targets without {REST!r}: {missing}")
    names, cells = calibrated(rows, targets, budget)
    fields = ", ".join(f"_{c} string" for c in names)
    chances = rows.sparkSession.createDataFrame(cells, f"{fields}, probability double")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return _named(rows, targets).join(F.broadcast(chances), [f"_{c}" for c in names]).drop(
        *[f"_{c}" for c in names]).withColumn("kept", draw < F.col("probability"))


def sampled(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, budget: float = BUDGET,
            seed: int = SEED) -> DataFrame:
    """The documents of ``docs`` that the mix keeps, columns as they were."""
    rows = stage(measured(docs), "mix-rows")
    # Equal ids share their fate unless their cells differ; the largest probability then counts.
    kept = mixed(rows, targets, budget, seed).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")


def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's cell, probability and fate."""
    rows = stage(measured(table(spark, sf, "documents")), "mix-rows")
    return mixed(rows).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "kept")


QUERIES = {"op4_mixing": op4_mixing}
SQL = {}
