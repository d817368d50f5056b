"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprint.session import scratch_path

BATCH_ROWS = 512
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def batched(spark: SparkSession) -> None:
    """Whole texts go to Python some hundred at a time, so a batch stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stage(df: DataFrame, name: str) -> DataFrame:
    """A written table in the shared folder: short lineage, survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


@contextmanager
def owning() -> Iterator[list[str]]:
    """The scratch folders that this thread names inside the block, for whoever deletes them."""
    paths: list[str] = []
    token = _owned.set(paths)
    try:
        yield paths
    finally:
        _owned.reset(token)


def owned() -> bool:
    """Whether a caller collects this thread's scratch folders."""
    return _owned.get() is not None


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def folder(spark: SparkSession, name: str) -> str:
    path = scratch_path(spark, f"llm-{name}")
    if owned():
        _owned.get().append(path)
    return path


def filled(text: Column | str = "text") -> Column:
    """A text with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is.

    The join then shuffles both sides; its rows are the same either way. Give it
    narrow written tables only: the count reads them.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """A written copy (_at, _doc): a number per row, and the row itself whatever its columns are called."""
    return stage(docs.select(F.monotonically_increasing_id().alias("_at"),
                             F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")), name)


def running_start(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows that sort before each row.

    A range shuffle sorts the rows; sums of whole partitions (as many rows as
    partitions) are added up first, so that no window holds the table. Whole
    numbers only: the result doesn't depend on where the partitions end. Give it
    narrow tables.
    """
    spread = stage(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    parts = spread.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = parts.select("_part", F.coalesce(
        F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(value).over(
        Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))
    return spread.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(
        "start", F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside")


def connected(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every end of ``edges`` (a, b): root is the smallest node reachable.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its smallest one, then its smaller neighbours to the smallest.
    Each step is a group and a join by node; the sizes of neighbourhoods are never
    held in memory, and rounds grow with the logarithm of the longest chain.
    """
    pairs = edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stage(pairs, f"{name}-links")
    last = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), f"{name}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))).distinct()
        pairs = stage(small, f"{name}-small")
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select("node", F.col("node").alias("root")))


def rows_by_python(df: DataFrame, work: Callable, schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow(work)`` with batches of bounded rows."""
    batched(df.sparkSession)
    return df.mapInArrow(work, schema)


def tag() -> str:
    return uuid.uuid4().hex
