"""A training corpus in five stages; each works on all that the one before kept."""

from __future__ import annotations

import time
from contextvars import ContextVar
from functools import wraps

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm import op3_repair, op4_mixing, op5_line_frequency, op6_ngram_join, op7_tiling
from inkprint.llm.common import owned, owning, release, table
from inkprint.session import scratch_path

# What the stages that this thread called one by one have written: folders, and when the last one returned.
_before: ContextVar[tuple[list[str], float]] = ContextVar("before", default=([], 0.0))


def tidy(work):
    """A stage that frees what earlier stages wrote, once their results are surely saved.

    Inside ``run`` the folders are run's. A stage called alone deletes the folders of those
    called before it in this thread only if its input is a file written after they
    returned, as a saved result is; a result that is still held unsaved can be read.
    """
    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if owned():
            return work(spark, docs, sf_dir)
        left, returned = _before.get()
        if left and _newer(docs, returned, left):
            release(spark, left)
            left = []
        with owning() as paths:
            out = work(spark, docs, sf_dir)
        _before.set((left + paths, time.time()))
        return out

    return stage


def _newer(docs: DataFrame, moment: float, paths: list[str]) -> bool:
    """Whether the rows come from a file that is younger than ``moment`` and not in ``paths``."""
    try:
        row = docs.select("_metadata.file_path", "_metadata.file_modification_time").first()
    except AnalysisException:  # no files behind these rows
        return False
    return (row is not None and row["file_modification_time"].timestamp() > moment
            and not any(p.rpartition("/")[2] in row["file_path"] for p in paths))


# The mix trims what is over-represented and keeps most of the rest.
MIX_BUDGET = 0.9
MIX = {
    "source": {"src0": 6.0} | {f"src{i}": 1.0 for i in range(1, 20)} | {op4_mixing.REST: 1.0},
    "lang": {"en": 5.0, "fr": 1.5, "de": 1.5, "es": 1.2, op4_mixing.REST: 1.0},
    "topic": {f"topic{i}": 1.0 for i in range(op4_mixing.TOPICS)} | {"none": 0.5, op4_mixing.REST: 1.0},
}


@tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go, and documents that fail the rules or have too little left."""
    return op5_line_frequency.cleaned(docs).withColumn("n_chars", F.length("text").cast("long"))


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, similarity 0.8."""
    return op6_ngram_join.representatives(docs, k=5, num=80, den=100)


@tidy
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    return op7_tiling.clean(docs, table(spark, sf_dir, "benchmark"))


@tidy
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the targets by source, language and topic."""
    return op4_mixing.sampled(docs, MIX, MIX_BUDGET)


@tidy
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in grammar shards, and where each document's lie."""
    home = scratch_path(spark, "pipeline-shards")  # a result: nobody deletes it
    return op3_repair.read(op3_repair.write(docs, home, public_tokenizers.path("byte_bpe_50k.json")), home)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminated),
          ("mixing", mixed), ("tokens", tokens)]

# Components, tiling and a tokenizer have no SQL form; tests compare every stage and run() with
# plain versions of them, rows kept and rows removed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written and read again.

    What a stage wrote on its way, and its input if that was another stage's result, goes
    once its own result is written.
    """
    docs, behind = table(spark, sf_dir, "documents"), []
    for name, work in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with owning() as paths:
            work(spark, docs, sf_dir).write.parquet(path)
        release(spark, paths + behind)
        docs, behind = spark.read.parquet(path), [path]
    return docs
