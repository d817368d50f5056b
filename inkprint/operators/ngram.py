"""Cross-perplexity ratio of two counted n-gram models.

The observer is an interpolated bigram model, the scorer an interpolated trigram
model. With c() the counts, N tokens and V distinct tokens in the fitting text:

  P1(w)      = (c(w) + 1) / (N + V + 1)
  P2(w|v)    = l2 * c(v,w) / c(v,.)   + (1 - l2) * P1(w)     if c(v,.) > 0, else P1(w)
  P3(w|u,v)  = l3 * c(u,v,w) / c(u,v,.) + (1 - l3) * P2(w|v) if c(u,v,.) > 0, else P2(w|v)

The trigram table may be pruned (``RatioConfig.max_loss``). A pruned w gets b(u,v) P2(w|v) like
a w that never followed u, v; with K the words kept after u, v

  b(u,v) = (1 - sum over K of P3) / (1 - sum over K of P2)     (1 - l3 if none is pruned)

so that probabilities still add up to 1. Pruning can only raise b above 1 - l3, so an entry
costs the fitting text at most c(u,v,w) (ln P3 - ln (1 - l3) P2), and these bounds add up:
entries go by ascending bound as long as their sum stays within ``max_loss`` per token.

A document's ratio is its mean -ln P2 over its mean -ln P3, on all tokens but
the first. Scoring joins distinct n-grams, not tokens, with the count tables, so
a text copied a million times is looked up once; adaptive skew handling splits
what stays hot.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.config import RatioConfig
from inkprint.functions import text
from inkprint.session import materialise, scratch_path

START = ""  # stands before a text; never equals a token


def grams(df: DataFrame, max_tokens: int | None, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """(keep..., u, v, w): each token with the two before it."""
    t = text.ws_tokens(F.lower(F.coalesce(text_col, F.lit(""))))
    t = t if max_tokens is None else F.slice(t, 1, max_tokens)
    d = df.select(*keep, t.alias("_t"))
    rest = F.greatest(F.size("_t") - 1, F.lit(0))
    d = d.withColumn("_v", F.concat(F.array(F.lit(START)), F.slice("_t", F.lit(1), rest)))
    two = F.concat(F.array(F.lit(START)), F.slice("_v", F.lit(1), rest))
    # The outer form: the inner one makes the optimizer infer a filter that
    # tokenises every text a second time.
    return d.select(*keep, F.inline_outer(F.arrays_zip(
        two.alias("u"), F.col("_v").alias("v"), F.col("_t").alias("w")))).where(F.col("w").isNotNull())


@dataclass
class NgramModel:
    """Count tables under one folder, plus two totals."""

    path: str
    tokens: int
    vocabulary: int
    cfg: RatioConfig

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def fit(df: DataFrame, cfg: RatioConfig = RatioConfig(), path: str | None = None,
        text_col: str = "text") -> NgramModel:
    """Count trigrams in one pass over the text; everything else sums them up."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "ngrams")

    def stored(frame, name):
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    total = lambda c: F.sum(c).alias(c)
    tri = stored(grams(df, cfg.max_tokens, text_col, keep=()).groupBy("u", "v", "w")
                 .agg(F.count("*").alias("c")), "trigrams")
    bi = stored(tri.groupBy("v", "w").agg(total("c")), "bigrams")
    uni = stored(bi.groupBy("w").agg(total("c")), "unigrams")
    stored(bi.where(F.col("v") != START).groupBy("v").agg(F.sum("c").alias("n")), "after_one")
    stored(tri.where(F.col("u") != START).groupBy("u", "v").agg(F.sum("c").alias("n")).withColumn(
        "b", F.lit(1 - cfg.trigram_weight)), "after_two")
    size = uni.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    model = NgramModel(path, size["n"], size["v"], cfg)
    return pruned(spark, model, cfg.max_loss) if cfg.max_loss > 0 else model


def _mix(weight: float, below: str) -> Column:
    """Relative frequency mixed with the probability of the shorter context."""
    return F.when(F.col("n").isNotNull(), F.lit(weight) * F.coalesce("c", F.lit(0)) / F.col("n")
                  + F.lit(1 - weight) * F.col(below)).otherwise(F.col(below))


def _pairs(spark: SparkSession, model: NgramModel, wanted: DataFrame) -> DataFrame:
    """(v, w, p2) of distinct pairs."""
    p1 = (F.coalesce("c", F.lit(0)) + 1.0) / F.lit(float(model.tokens + model.vocabulary + 1))
    return (
        wanted.join(model.table(spark, "unigrams"), "w", "left").withColumn("p1", p1).drop("c")
        .join(model.table(spark, "bigrams").hint("merge"), ["v", "w"], "left")
        .join(model.table(spark, "after_one"), "v", "left")
        .select("v", "w", _mix(model.cfg.bigram_weight, "p1").alias("p2")))


def pruned(spark: SparkSession, model: NgramModel, max_loss: float, path: str | None = None) -> NgramModel:
    """The model without trigrams that hardly help; the fitting text loses at most ``max_loss`` nats a token."""
    path, weight = path or scratch_path(spark, "ngrams"), model.cfg.trigram_weight
    whole = model.table(spark, "trigrams")
    inner = whole.where(F.col("u") != START)
    p2 = _pairs(spark, model, inner.select("v", "w").distinct())
    priced = inner.join(p2, ["v", "w"]).join(model.table(spark, "after_two").select("u", "v", "n"), ["u", "v"]).withColumn(
        "p3", _mix(weight, "p2")).withColumn("loss", F.col("c") * (F.log("p3") - F.log(F.lit(1 - weight) * F.col("p2"))))
    priced = materialise(priced.select("u", "v", "w", "c", "n", "p2", "p3", "loss"), "priced")
    cut = loss_cut(priced, max_loss * model.tokens)
    kept, gone = priced.where(F.col("loss") > cut), priced.where(F.col("loss") <= cut)
    mass = kept.groupBy("u", "v").agg(F.sum("p3").alias("s3"), F.sum("p2").alias("s2"))
    # Only histories that lose an entry get another weight; one that loses all keeps none: b = 1.
    touched = gone.select("u", "v").distinct().join(mass, ["u", "v"], "left").select(
        "u", "v", ((1 - F.coalesce("s3", F.lit(0.0))) / (1 - F.coalesce("s2", F.lit(0.0)))).alias("_b"))
    after = model.table(spark, "after_two").join(touched, ["u", "v"], "left").withColumn(
        "b", F.coalesce("_b", "b")).drop("_b")
    after.write.mode("overwrite").parquet(f"{path}/after_two")
    whole.where(F.col("u") == START).unionByName(kept.select("u", "v", "w", "c")).write.mode("overwrite").parquet(f"{path}/trigrams")
    for name in ("bigrams", "unigrams", "after_one"):
        model.table(spark, name).write.mode("overwrite").parquet(f"{path}/{name}")
    return replace(model, path=path)


def loss_cut(priced: DataFrame, budget: float, slots: int = 4_096, passes: int = 3) -> float:
    """A value such that all losses up to it add up to at most ``budget``; 0 if there is none.

    Each pass sums the losses by slot of a logarithmic scale and goes on inside the first slot
    that doesn't fit, so a few thousand numbers reach the driver, however many entries there are.
    """
    ends = priced.where("loss > 0").agg(F.min("loss").alias("lo"), F.max("loss").alias("hi")).first()
    if ends["lo"] is None or budget <= 0:
        return 0.0
    low, high, spent, cut = math.log(ends["lo"]), math.log(ends["hi"]) + 1e-9, 0.0, 0.0
    for _ in range(passes):
        width = max((high - low) / slots, 1e-12)
        at = F.floor((F.log("loss") - F.lit(low)) / F.lit(width))
        inside = priced.where(F.col("loss") > 0).withColumn("_at", at).where(F.col("_at").between(0, slots - 1))
        sums = {r["_at"]: (r["s"], r["m"]) for r in inside.groupBy("_at").agg(F.sum("loss").alias("s"), F.max("loss").alias("m")).collect()}
        for slot in sorted(sums):
            if spent + sums[slot][0] > budget:
                low, high = low + slot * width, low + (slot + 1) * width
                break
            spent, cut = spent + sums[slot][0], max(cut, sums[slot][1])
        else:
            return cut
    return cut


def ratios(df: DataFrame, model: NgramModel, text_col: str = "text",
           key: str = "doc_id", out: str = "ratio") -> DataFrame:
    """(key, out) for every row; texts under two tokens get the neutral value."""
    spark, cfg = df.sparkSession, model.cfg
    g = grams(df, cfg.max_tokens, text_col, keep=(key,)).where(F.col("v") != START)
    # Tables of pairs and triples are merged, never broadcast: their files pack strings many times smaller than
    # the hash tables that the driver would build of them, one for each join of each model.
    # Read twice below; written once so that the text is not tokenised again.
    distinct = materialise(g.select("u", "v", "w").distinct(), "grams")

    pairs = _pairs(spark, model, distinct.select("v", "w").distinct())
    known = model.table(spark, "trigrams").where(F.col("u") != START)
    p3 = F.when(F.col("n").isNull(), F.col("p2")).when(F.col("c").isNull(), F.col("b") * F.col("p2")).otherwise(
        _mix(cfg.trigram_weight, "p2"))
    triples = (
        distinct.join(pairs.hint("merge"), ["v", "w"])
        .join(known.hint("merge"), ["u", "v", "w"], "left")
        .join(model.table(spark, "after_two").hint("merge"), ["u", "v"], "left")
        .select("u", "v", "w", (-F.log("p2")).alias("h2"), (-F.log(p3)).alias("h3"))
    )
    # Tokens go to their n-gram in one shuffle. Counting them per document first would take another one
    # of almost as many rows, since few n-grams come twice in a text.
    sums = (g.join(triples.hint("merge"), ["u", "v", "w"]).groupBy(key).agg(
        F.count("*").alias("n"), F.sum("h2").alias("h2"), F.sum("h3").alias("h3")))
    value = (F.col("h2") / F.col("n")) / F.greatest(F.col("h3") / F.col("n"), F.lit(cfg.floor))
    return (df.select(key).join(sums.select(key, value.alias(out)), key, "left")
            .withColumn(out, F.coalesce(out, F.lit(cfg.neutral))))
