"""Language identification from character trigrams, in the role of a detector.

The profile is a table of all trigrams of the fitting text with, per language that
has it, the add-one log count. Languages are rows; only their totals, one number
each, reach the driver. The table is joined like any other: the planner broadcasts
it where it is small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.session import materialise

HEAD_CHARS = 500  # fixed value: the detector reads the first 500 characters


def trigrams(c: Column, head: int = HEAD_CHARS) -> Column:
    """Overlapping character triples of the lower-cased first characters."""
    return F.regexp_extract_all(
        F.lower(F.substring(F.coalesce(c, F.lit("")), 1, head)),
        F.lit("(?s)(?=(...))."), F.lit(1))


@dataclass
class Profile:
    """``grams``: (gram, seen), seen holding (lang, w) with w = ln(count + 1).

    ``floors`` gives per language the log probability of a gram it never had.
    """

    grams: DataFrame
    floors: list[tuple[str, float]]


def fit(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Profile:
    """Add-one log probabilities over the joint vocabulary of all languages."""
    counts = materialise(
        df.where(F.col(lang_col).isNotNull()).select(
            F.col(lang_col).alias("lang"), F.explode_outer(trigrams(F.col(text_col))).alias("gram"))
        .where(F.col("gram").isNotNull()).groupBy("lang", "gram").agg(F.count("*").alias("c")), "grams")
    grams = materialise(counts.groupBy("gram").agg(F.collect_list(
        F.struct("lang", F.log(F.col("c") + 1.0).alias("w"))).alias("seen")), "profile")
    size = grams.count()
    floors = counts.groupBy("lang").agg((-F.log(F.sum("c") + F.lit(float(size)))).alias("floor"))
    return Profile(grams, sorted((r["lang"], r["floor"]) for r in floors.collect()))


def detect(df: DataFrame, profile: Profile, text_col: str = "text",
           key: str = "doc_id") -> DataFrame:
    """(key, detected): most likely language, null when no trigram is known.

    A document's distinct triples with their counts are joined with the profile;
    what comes back is summed per document and language.
    """
    if not profile.floors:
        return df.select(key, F.lit(None).cast("string").alias("detected"))
    # Outer explode: the inner one would compute the triples twice, once to filter.
    own = df.select(key, F.explode_outer(trigrams(F.col(text_col))).alias("gram")).where(
        F.col("gram").isNotNull()).groupBy(key, "gram").agg(F.count("*").alias("k"))
    hits = own.join(profile.grams, "gram")
    total = hits.groupBy(key).agg(F.sum("k").alias("n"))
    sums = hits.select(key, "k", F.inline("seen")).groupBy(key, "lang").agg(
        F.sum(F.col("k") * F.col("w")).alias("s")).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("lang", "s"))).alias("sums"))
    floors = F.array(*[F.struct(F.lit(x).alias("lang"), F.lit(f).alias("floor")) for x, f in profile.floors])
    best = F.array_max(F.transform(floors, lambda x: F.struct(F.round(
        F.coalesce(F.col("sums")[x["lang"]], F.lit(0.0)) + F.col("n") * x["floor"], 6).alias("score"),
        x["lang"].alias("lang"))))
    scored = total.join(sums, key).select(key, best["lang"].alias("detected"))
    return df.select(key).join(scored, key, "left")
