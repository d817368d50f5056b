"""Trained signals: semantic classifier, boosted trees on style, genre classifier.

Each model scores a DataFrame by ``transform`` alone and saves to any Hadoop
path. Only coefficients, importances and a few statistics reach the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.config import GenreConfig, SemanticConfig, StyloConfig
from inkprint.functions import text
from inkprint.functions.lexicons import FEATURE_NAMES, FORMAL_GENRES, GENRES
from inkprint.operators import boosting
from inkprint.session import written


def tokens_and_pairs(df: DataFrame, text_col: str, max_tokens: int | None) -> DataFrame:
    """Add ``_terms``: the tokens, all or the first ones, and their bigrams."""
    t = text.ws_tokens(F.lower(F.coalesce(text_col, F.lit(""))))
    t = t if max_tokens is None else F.slice(t, 1, max_tokens)
    d = df.withColumn("_tokens", t)
    return d.withColumn("_terms", F.concat("_tokens", text.word_bigrams(F.col("_tokens")))).drop("_tokens")


def _hashed(cfg_features: int) -> list:
    return [HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=cfg_features),
            IDF(inputCol="_tf", outputCol="_x")]


_WORK = ("_terms", "_tf", "_x", "_raw", "_prob", "_pred")


@dataclass
class TextModel:
    """Hashed unigrams and bigrams, inverse document frequency, logistic regression."""

    pipeline: PipelineModel
    max_tokens: int | None

    def probabilities(self, df: DataFrame, out: str, text_col: str = "text") -> DataFrame:
        d = self.pipeline.transform(tokens_and_pairs(df, text_col, self.max_tokens))
        return d.withColumn(out, vector_to_array("_prob")).drop(*_WORK)

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, max_tokens: int | None) -> TextModel:
        return cls(PipelineModel.load(path), max_tokens)


def fit_text_model(df: DataFrame, max_tokens: int | None, features: int, max_iter: int,
                   reg: float, text_col: str = "text", label: str = "label") -> TextModel:
    d = tokens_and_pairs(df.select(text_col, label), text_col, max_tokens)
    learner = LogisticRegression(
        featuresCol="_x", labelCol=label, rawPredictionCol="_raw", probabilityCol="_prob",
        predictionCol="_pred", maxIter=max_iter, regParam=reg)
    hashing, idf = _hashed(features)
    # Three passes read the hashed terms: document frequencies, feature statistics, and the blocks of rows
    # that the iterations work on. They are written, so text is tokenised once and the executors' memory,
    # which a cache fills by ten thousand texts at a time, is left to those blocks.
    with written(hashing.transform(d).select(label, "_tf"), "terms") as terms:
        weights = idf.fit(terms)
        return TextModel(PipelineModel([hashing, weights, learner.fit(weights.transform(terms))]), max_tokens)


def fit_semantic(train: DataFrame, cfg: SemanticConfig = SemanticConfig()) -> TextModel:
    return fit_text_model(train, cfg.max_tokens, cfg.hash_features, cfg.max_iter, cfg.reg)


def semantic_probability(df: DataFrame, model: TextModel, out: str = "semantic",
                         text_col: str = "text") -> DataFrame:
    return model.probabilities(df, out, text_col).withColumn(out, F.col(out)[1])


def external_probability(df: DataFrame, scores: DataFrame, out: str = "semantic",
                         key: str = "fp", neutral: float = 0.5) -> DataFrame:
    """Take the semantic score from a (key, prob) table instead of the model."""
    return df.join(scores.select(key, F.col("prob").alias(out)), key, "left").withColumn(
        out, F.coalesce(out, F.lit(neutral)))


def fit_genre(train: DataFrame, cfg: GenreConfig = GenreConfig(),
              sem: SemanticConfig = SemanticConfig()) -> TextModel:
    return fit_text_model(train, cfg.max_tokens, cfg.hash_features, sem.max_iter, sem.reg)


def formality(probs: Column) -> Column:
    """Probability mass on the formal genres."""
    return sum((probs[GENRES.index(g)] for g in FORMAL_GENRES[1:]), probs[GENRES.index(FORMAL_GENRES[0])])


def best_genre(probs: Column) -> Column:
    at = F.array_position(probs, F.array_max(probs)).cast("int")
    return F.element_at(F.array(*[F.lit(g) for g in GENRES]), at)


def genre_signals(df: DataFrame, model: TextModel, text_col: str = "text") -> DataFrame:
    """Add ``genre_info`` (name, four probabilities, formality) and ``formality``."""
    d = model.probabilities(df, "_genre", text_col)
    p = F.col("_genre")
    info = F.struct(
        best_genre(p).alias("genre"), *[p[i].alias(f"p_{g}") for i, g in enumerate(GENRES)],
        formality(p).alias("formality"))
    return d.withColumn("genre_info", info).withColumn(
        "formality", F.col("genre_info.formality")).drop("_genre")


# --- stylometric trees ---------------------------------------------------------


def fit_scaler(train: DataFrame, names) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature; a constant feature scales by 1."""
    row = train.agg(*[F.avg(n).alias(f"{n}_m") for n in names],
                    *[F.stddev_pop(n).alias(f"{n}_s") for n in names]).first()
    return {n: (row[f"{n}_m"] or 0.0, row[f"{n}_s"] or 1.0) for n in names}


def scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({n: (F.col(n) - F.lit(m)) / F.lit(s) for n, (m, s) in stats.items()})


@dataclass
class StyloModel:
    trees: boosting.Boosted
    stats: dict[str, tuple[float, float]]
    names: list[str] = field(default_factory=list)

    def probability(self, df: DataFrame, out: str = "stylometric") -> DataFrame:
        """Score rows that carry the feature columns; those stay unscaled."""
        scaled = [(F.col(n) - F.lit(m)) / F.lit(s) for n, (m, s) in ((n, self.stats[n]) for n in self.names)]
        return df.withColumn(out, self.trees.probability(scaled))

    def importances(self, spark: SparkSession) -> DataFrame:
        """(feature, importance), one row per feature, largest first."""
        rows = [(n, float(v)) for n, v in zip(self.names, self.trees.importances())]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(
            F.desc("importance"), "feature")

    def save(self, path: str) -> None:
        meta = json.dumps({"stats": self.stats, "names": self.names, "trees": self.trees.to_dict()})
        SparkSession.active().createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str) -> StyloModel:
        meta = json.loads(SparkSession.active().read.text(path, wholetext=True).first()["value"])
        return cls(boosting.Boosted.from_dict(meta["trees"]), {k: tuple(v) for k, v in meta["stats"].items()}, meta["names"])


def fit_stylometric(features: DataFrame, names=FEATURE_NAMES, cfg: StyloConfig = StyloConfig(),
                    label: str = "label") -> StyloModel:
    """Boosted trees on train rows, stopped by the loss on val rows (``split``)."""
    names = list(names)
    stats = fit_scaler(features.where(F.col("split") == "train"), names)
    d = scale(features.where(F.col("split").isin("train", "val")).select(label, "split", *names), stats)
    return StyloModel(boosting.fit(d, names, label, cfg), stats, names)


def pruned_names(model: StyloModel, threshold: float) -> list[str]:
    """Features at or above the importance threshold, most important first."""
    pairs = zip(model.names, model.trees.importances().tolist())
    kept = sorted(((n, v) for n, v in pairs if v >= threshold), key=lambda p: (-p[1], p[0]))
    return [n for n, _ in kept]


def fit_pruned(features: DataFrame, cfg: StyloConfig = StyloConfig(),
               first: StyloModel | None = None) -> tuple[StyloModel, StyloModel]:
    """Fit on all features, drop the weak ones, fit again: (first, pruned)."""
    first = first or fit_stylometric(features, FEATURE_NAMES, cfg)
    kept = pruned_names(first, cfg.importance_threshold)
    return first, fit_stylometric(features, kept or first.names, cfg)
