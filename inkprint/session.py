"""Session helpers: a tuned local session, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


SPREAD = "spark.inkprint.spread"


def local_session(cores: str = "8", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("inkprint")
        .config("spark.sql.shuffle.partitions", str(cores if cores.isdigit() else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config(SPREAD, "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, whose
    executors share this machine's disk, may fall back to a temporary folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    named = named or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    fallback = os.path.join(tempfile.gettempdir(), "inkprint-shared")
    spark.sparkContext.setCheckpointDir(fallback)
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, grouped by application for clean-up."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/inkprint/{app}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and lets later passes read only
    the columns they need.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def written(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """A stage in the shared folder for the jobs inside the block; deleted at its end."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    try:
        df.write.mode("overwrite").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        dropped(spark, path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread rows over all cores by a unique key, in sessions that ask for it.

    Local sessions do: their test tables are one unsplittable file each. It is a
    setting of the session, so the plan doesn't change with the size of the input.
    """
    if df.sparkSession.conf.get(SPREAD, "false") != "true":
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def together(*jobs: Callable) -> list:
    """Results of independent jobs, run at the same time.

    A fit in one task, or one that waits for the driver, leaves its cores to the others.
    """
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(job)) for job in jobs]]
