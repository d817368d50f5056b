"""Exact rank cuts without sending a class to one task.

Rows are ordered by a uniform string key. Counting keys per prefix bucket says
which bucket each cut falls into; only that bucket is ranked, which yields one
cut key per group. Applying the cuts is then a map-side comparison: the rows,
and their text, are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_HEX = 4  # 65,536 buckets


def sample_key(seed: str | int, id_col: str = "doc_id") -> Column:
    """Uniform order key: the digest of seed and id, then the id itself."""
    text_id = F.col(id_col).cast("string")
    padded = F.when(F.length(text_id) < 20, F.lpad(text_id, 20, "0")).otherwise(text_id)
    return F.concat(F.md5(F.concat(F.lit(f"{seed}|"), text_id)), F.lit("|"), padded)


def cut_keys(keyed: DataFrame, group: str, key: str, cuts: DataFrame,
             prefix: int = PREFIX_HEX) -> DataFrame:
    """The key at each wanted rank.

    ``cuts`` holds (group, cut, rank). Returns (group, cut, cut_key); a rank of
    zero has no row, a rank past the end gives the largest key.
    """
    slim = keyed.select(group, F.col(key).alias("_key"),
                        F.substring(F.col(key), 1, prefix).alias("_bucket"))
    buckets = slim.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(group).orderBy("_bucket")
    whole = Window.partitionBy(group)
    buckets = buckets.withColumn("_end", F.sum("_n").over(upto)).withColumn(
        "_all", F.sum("_n").over(whole))
    # cuts has one row per group and cut; groups are classes, a handful.
    hit = (
        buckets.join(F.broadcast(cuts), group)
        .withColumn("_rank", F.least("rank", "_all"))
        .where((F.col("_rank") > F.col("_end") - F.col("_n"))
               & (F.col("_rank") <= F.col("_end")))
        .select(group, "_bucket", "cut",
                (F.col("_rank") - (F.col("_end") - F.col("_n"))).alias("_within"))
    )
    inside = Window.partitionBy(group, "_bucket", "cut").orderBy("_key")
    return (
        slim.join(F.broadcast(hit), [group, "_bucket"])
        .withColumn("_pos", F.row_number().over(inside))
        .where(F.col("_pos") == F.col("_within"))
        .select(group, "cut", F.col("_key").alias("cut_key"))
    )


def keep_lowest(df: DataFrame, group: str, key: Column, quotas: DataFrame,
                prefix: int = PREFIX_HEX) -> DataFrame:
    """Per group, the rows with the lowest keys; ``quotas`` holds (group, rank)."""
    keyed = df.withColumn("_order", key)
    cuts = cut_keys(keyed, group, "_order",
                    quotas.withColumn("cut", F.lit("keep")), prefix)
    return (
        keyed.join(F.broadcast(cuts.select(group, "cut_key")), group)
        .where(F.col("_order") <= F.col("cut_key"))
        .select(df.columns)
    )
