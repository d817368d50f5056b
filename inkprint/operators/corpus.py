"""Corpus assembly: union, first-wins dedup, balanced sample, exact splits."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.config import CorpusConfig, GenreConfig
from inkprint.functions import text
from inkprint.operators import langid
from inkprint.operators.ranking import cut_keys, keep_lowest, sample_key
from inkprint.session import materialise

ID_SPAN = 1 << 63  # every BIGINT id has room below each source rank in an order key


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Union in load order; the position becomes ``source_rank``."""
    ranked = [f.withColumn("source_rank", F.lit(i).cast("bigint"))
              for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def load_order(rank_col: str = "source_rank", id_col: str = "doc_id") -> Column:
    """One whole number that sorts by source rank, then id; no two pairs meet.

    A decimal of fixed width, so aggregates of it stay hash aggregates.
    """
    wide = F.col(rank_col).cast("decimal(18,0)") * F.lit(Decimal(ID_SPAN)).cast("decimal(19,0)")
    return (wide + F.col(id_col).cast("decimal(19,0)")).cast("decimal(38,0)")


def with_fingerprint(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn("fp", text.fingerprint(F.col(col)))


def keep_first(df: DataFrame, order_key: Column, fp: str = "fp") -> DataFrame:
    """Of rows sharing a fingerprint keep the one loaded first.

    The aggregate moves digests and one number, combined before the shuffle, so
    a digest shared by a third of all rows is one row per task. Joining back on
    the unique order key, not the digest, keeps that join even.
    """
    keyed = df.withColumn("_order", order_key)
    first = keyed.groupBy(fp).agg(F.min("_order").alias("_order")).select("_order")
    return keyed.join(first, "_order", "left_semi").drop("_order")


def first_values(df: DataFrame, order_key: Column, columns: list[str], fp: str = "fp") -> DataFrame:
    """(fp, columns...) of the row loaded first, for a few narrow columns.

    One pass and one shuffle of the narrow columns, combined before it; the
    costly text expressions below are evaluated once.
    """
    keyed = df.select(fp, *columns, order_key.alias("_order"))
    return keyed.groupBy(fp).agg(*[F.min_by(c, "_order").alias(c) for c in columns])


def class_quota(df: DataFrame, n_total: int, label: str = "label") -> DataFrame:
    """(label, rank): the size both classes can fill, at most half of n_total."""
    counts = df.agg(F.count_if(F.col(label) == 0).alias("h"),
                    F.count_if(F.col(label) == 1).alias("a"))
    each = F.least(F.lit(n_total // 2).cast("bigint"), "h", "a")
    return counts.select(F.explode(F.array(F.lit(0), F.lit(1))).alias(label),
                         each.alias("rank"))


def balanced_sample(df: DataFrame, n_total: int, seed: int = 42,
                    label: str = "label", id_col: str = "doc_id") -> DataFrame:
    """Equal numbers of both classes, drawn by digest order."""
    return keep_lowest(df, label, sample_key(f"sample{seed}", id_col),
                       class_quota(df, n_total, label))


def soft_cap(df: DataFrame, limit: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """At most ``limit`` rows of a source, the same ones every time."""
    spark = df.sparkSession
    whole = df.withColumn("_one", F.lit(0))
    quota = spark.range(1).select(F.lit(0).alias("_one"), F.lit(limit).alias("rank"))
    return keep_lowest(whole, "_one", sample_key(f"cap{seed}", id_col), quota).drop("_one")


def shuffle_key(seed: int = 42, id_col: str = "doc_id") -> Column:
    """Order key of the seeded shuffle; sort by it only where order is consumed."""
    return sample_key(f"shuffle{seed}", id_col)


def fill_quota(df: DataFrame, quota: int, group: str = "label",
               rank_col: str = "source_rank", seed: int = 42,
               id_col: str = "doc_id", groups: list | None = None) -> DataFrame:
    """Up to ``quota`` rows per group, earlier sources first."""
    key = F.concat(F.lpad(F.col(rank_col).cast("string"), 19, "0"),
                   sample_key(f"quota{seed}", id_col))
    # One row per class: the class list is fixed by the caller or counted.
    if groups is None:
        quotas = df.groupBy(group).agg(F.lit(quota).cast("bigint").alias("rank"))
    else:
        quotas = df.sparkSession.createDataFrame(
            [(g, quota) for g in groups], f"{group} {df.schema[group].dataType.simpleString()}, rank bigint")
    return keep_lowest(df, group, key, quotas, prefix=23)


def _shares(classes: DataFrame, count: str, part: Column, out: str,
            label: str) -> DataFrame:
    """Largest-remainder shares of ``part`` rows; a handful of class rows."""
    everything = Window.partitionBy(F.lit(1))
    d = classes.withColumn("_tot", F.sum(count).over(everything)).withColumn("_part", part)
    product = F.col(count).cast("decimal(20,0)") * F.col("_part").cast("decimal(18,0)")
    d = d.withColumn("_rem", product % F.col("_tot").cast("decimal(20,0)"))
    d = d.withColumn("_floor", ((product - F.col("_rem"))
                                / F.col("_tot").cast("decimal(20,0)")).cast("bigint"))
    d = d.withColumn("_left", F.col("_part") - F.sum("_floor").over(everything))
    d = d.withColumn("_turn", F.row_number().over(
        everything.orderBy(F.desc("_rem"), F.asc(label))))
    d = d.withColumn(out, F.col("_floor") + F.when(
        F.col("_turn") <= F.col("_left"), 1).otherwise(0))
    return d.drop("_tot", "_part", "_rem", "_floor", "_left", "_turn")


def split_sizes(df: DataFrame, val_ratio: float, test_ratio: float,
                label: str = "label") -> DataFrame:
    """Rows per class and split: (label, n, n_train, n_val, n_test).

    Held-out rows are ceil((val+test)*n), test is ceil of its share of those.
    """
    held = val_ratio + test_ratio
    classes = df.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(1))
    n_all = F.sum("n").over(everything)
    d = classes.withColumn("_held_all", F.ceil(F.lit(held) * n_all))
    d = _shares(d, "n", F.col("_held_all"), "n_held", label)
    test_all = F.ceil(F.lit(test_ratio / held) * F.sum("n_held").over(everything))
    d = d.withColumn("_test_all", test_all)
    d = _shares(d, "n_held", F.col("_test_all"), "n_test", label)
    return d.select(
        label, "n", (F.col("n") - F.col("n_held")).alias("n_train"),
        (F.col("n_held") - F.col("n_test")).alias("n_val"), "n_test")


def stratified_split(df: DataFrame, val_ratio: float, test_ratio: float,
                     seed: int = 42, label: str = "label",
                     id_col: str = "doc_id") -> DataFrame:
    """Add ``split`` (train/val/test) with exact stratified sizes."""
    keyed = df.withColumn("_order", sample_key(f"split{seed}", id_col))
    sizes = split_sizes(df, val_ratio, test_ratio, label)
    cuts = sizes.select(label, F.explode(F.array(
        F.struct(F.lit("train").alias("cut"), F.col("n_train").alias("rank")),
        F.struct(F.lit("val").alias("cut"), (F.col("n_train") + F.col("n_val")).alias("rank")),
    )).alias("c")).select(label, "c.cut", "c.rank")
    keys = cut_keys(keyed, label, "_order", cuts)
    wide = keys.groupBy(label).agg(
        F.max(F.when(F.col("cut") == "train", F.col("cut_key"))).alias("_train_to"),
        F.max(F.when(F.col("cut") == "val", F.col("cut_key"))).alias("_val_to"))
    return (
        keyed.join(F.broadcast(wide), label, "left")
        .withColumn("split", F.when(F.col("_order") <= F.col("_train_to"), "train")
                    .when(F.col("_order") <= F.col("_val_to"), "val").otherwise("test"))
        .select(*df.columns, "split")
    )


def genre_corpus(classes: list[list[DataFrame]], cfg: GenreConfig = GenreConfig()) -> DataFrame:
    """Labelled genre rows with their split; ``classes`` holds each label's sources in order.

    A class takes its quota from its first source as far as that goes, then from
    the next. Ids must be unique over all frames.
    """
    rows = [union_sources(frames).withColumn("label", F.lit(i)) for i, frames in enumerate(classes)]
    picked = fill_quota(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows),
                        cfg.samples_per_class, seed=cfg.seed, groups=list(range(len(classes))))
    return stratified_split(picked, cfg.val_ratio, cfg.test_ratio, cfg.seed)


def speaking(staged: DataFrame, profile: langid.Profile, wanted: tuple[str, ...],
             key: str = "load_order") -> DataFrame:
    """Rows in a wanted language; text without a known trigram passes, as where a detector gives up."""
    found = langid.detect(staged.select(key, "text"), profile, key=key)
    other = found.where(~F.col("detected").isin(*wanted)).select(key)
    return staged.join(other, key, "left_anti")


def build_corpus(sources: list[DataFrame], cfg: CorpusConfig = CorpusConfig(),
                 profile: langid.Profile | None = None, languages: tuple[str, ...] = ("en",)) -> DataFrame:
    """Union, filter by language, dedup, balance and split cleaned source frames.

    With a language profile, rows the detector finds in another language go.

    Cleaned text is written once, which also freezes the load order. Dedup,
    sampling and splitting then work on (order, digest, label) alone, keyed on
    the digest so that they do not depend on how files were cut into tasks. The
    text moves in one final join.
    """
    staged = materialise(
        with_fingerprint(union_sources(sources)).withColumn("load_order", load_order()), "clean")
    if profile is not None:
        staged = materialise(speaking(staged, profile, languages), "spoken")
    first = staged.groupBy("fp").agg(F.min("load_order").alias("load_order")).select("load_order")
    unique = materialise(
        staged.select("fp", "load_order", "label").join(first, "load_order", "left_semi"), "unique")
    sample = materialise(
        balanced_sample(unique, cfg.total_samples, cfg.seed, id_col="fp"), "sample")
    chosen = stratified_split(sample, cfg.val_ratio, cfg.test_ratio, cfg.seed, id_col="fp")
    return staged.join(chosen.select("load_order", "split"), "load_order").drop(
        "load_order", "source_rank")
