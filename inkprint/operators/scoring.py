"""Scoring new documents: four signals, fusion, sentences, bands and conflicts."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from functools import cached_property, partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.config import (
    FusionConfig, GenreConfig, RatioConfig, ScoringConfig, SemanticConfig, StyloConfig,
)
from inkprint.functions import text
from inkprint.functions.lexicons import EXPLAINED_FEATURES, FEATURE_NAMES
from inkprint.functions.stylometry import with_stylometry
from inkprint.operators import fusion, metrics, models, ngram
from inkprint.operators.isotonic import Isotonic
from inkprint.operators.perceptron import Head
from inkprint.operators.cleaning import scorable_text
from inkprint.session import materialise, scratch_path, together

SCORING = ScoringConfig()


# --- verdicts on scores ----------------------------------------------------------


def verdict(prob: Column, threshold: float = SCORING.threshold) -> Column:
    return F.when(prob >= threshold, "AI").otherwise("Human")


def confidence(prob: Column, threshold: float = SCORING.threshold) -> Column:
    return F.when(prob >= threshold, prob).otherwise(1 - prob)


def sentence_rows(df: DataFrame, text_col: str = "shown_text", key: str = "doc_id") -> DataFrame:
    """One row per display sentence: (key, sent_idx, sentence)."""
    # Outer explode: the inner one would split every text twice, once to filter.
    return df.select(key, F.posexplode_outer(text.display_sentences(F.col(text_col))).alias(
        "sent_idx", "sentence")).where(F.col("sentence").isNotNull())


def sentence_band(prob: Column, cfg: ScoringConfig = SCORING) -> Column:
    return (F.when(prob >= cfg.threshold, "AI").when(prob <= cfg.sentence_human, "Human")
            .otherwise("Uncertain"))


def sentence_stats(sentences: DataFrame, key: str = "doc_id", prob: str = "prob",
                   cfg: ScoringConfig = SCORING) -> DataFrame:
    """Counts per band and the machine share of each document."""
    p = F.col(prob)
    ai, human = F.count_if(p >= cfg.threshold), F.count_if(p <= cfg.sentence_human)
    total = F.count("*")
    return sentences.groupBy(key).agg(
        total.alias("n_total"), ai.alias("n_ai"), human.alias("n_hum"),
        (total - ai - human).alias("n_unc"), (ai / total).alias("ai_frac"))


def long_document(n_total: Column, cfg: ScoringConfig = SCORING) -> Column:
    return n_total >= cfg.long_document_sentences


def score_conflict(prob: Column, ai_frac: Column, cfg: ScoringConfig = SCORING) -> Column:
    """Where the document score and its sentences disagree, and in which way."""
    return (
        F.when((prob >= cfg.conflict_high) & (ai_frac < cfg.conflict_high_share),
               "document_ai_sentences_human")
        .when((prob <= cfg.conflict_low) & (ai_frac > cfg.conflict_low_share),
              "document_human_sentences_ai")
        .otherwise("none"))


def explain_signals(df: DataFrame, columns: list[str], key: str = "doc_id",
                    cfg: ScoringConfig = SCORING) -> DataFrame:
    """A row per signal with its percentage and verdict band."""
    s = F.col("score")
    band = (F.when(s >= cfg.verdict_ai, "AI").when(s <= cfg.verdict_human, "Human")
            .otherwise("Uncertain"))
    return df.unpivot([key], columns, "signal", "score").withColumn("verdict", band)


def explain_features(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.unpivot([key], list(EXPLAINED_FEATURES), "feature", "value")


def score_sentences(df: DataFrame, semantic: models.TextModel, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Semantic score of each sentence, uncalibrated, structure kept."""
    ready = scorable_text(df.select(key, text_col), col=text_col)
    rows = sentence_rows(ready.where(~F.col("too_short")), key=key)
    d = models.semantic_probability(rows, semantic, "prob", "sentence")
    p = F.col("prob")
    return d.withColumns({"label": verdict(p), "confidence": confidence(p), "band": sentence_band(p)})


# What an explanation shows, in order.
EXPLAINED_SIGNALS = ("semantic", "stylometric", "ratio_signal", "formality", "final_prob")

# --- the detector -----------------------------------------------------------------


@dataclass
class Detector:
    """Everything fitted; scores any (key, text) frame."""

    semantic: models.TextModel
    stylo: models.StyloModel
    ngrams: ngram.NgramModel
    genre: models.TextModel
    semantic_cal: Isotonic
    stylometric_cal: Isotonic
    head: Head | None
    meta: fusion.FusionMeta

    def raw_signals(self, df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Features and raw signals. Three signals are row-local; the ratio joins in.

        The text stays behind: only numbers go through the join.
        """
        d = with_stylometry(df, text_col, FEATURE_NAMES)
        d = self.stylo.probability(d)
        d = models.semantic_probability(d, self.semantic, "semantic", text_col)
        d = models.genre_signals(d, self.genre, text_col).drop(text_col)
        return d.join(ngram.ratios(df, self.ngrams, text_col, key), key)

    def matrix(self, raw: DataFrame) -> DataFrame:
        """Add the fusion columns: neutral values, calibration, normalisation."""
        d = fusion.with_neutral(raw).withColumn("_s", fusion.unsaturated(F.col("semantic")))
        d = fusion.calibrated(d, self.semantic_cal, "_s", "semantic_cal").drop("_s")
        d = fusion.calibrated(d, self.stylometric_cal, "stylometric", "stylometric_cal")
        return d.withColumn("ratio_signal", fusion.ratio_signal(
            F.col("ratio"), self.meta.p_low, self.meta.p_high))

    def fuse(self, raw: DataFrame) -> DataFrame:
        """Fused probability, label and confidence of rows with the raw signals."""
        d = fusion.fused(self.matrix(raw), self.head, self.meta.names)
        return d.withColumns({"label": verdict(F.col("final_prob")),
                              "confidence": confidence(F.col("final_prob"))})

    def score(self, df: DataFrame, key: str = "doc_id", text_col: str = "text",
              cfg: ScoringConfig = SCORING) -> DataFrame:
        """One row per document, short ones with a status and no score."""
        ready = scorable_text(df.select(key, text_col), cfg, text_col)
        scored = self.fuse(self.raw_signals(
            ready.where(~F.col("too_short")).select(key, "prose"), key, "prose"))
        status = F.when(F.col("too_short"), "too_short").otherwise("scored")
        return ready.select(
            key, status.alias("status"),
            text.preview(F.col("shown_text"), cfg.preview_chars).alias("preview"),
        ).join(scored, key, "left")

    def explain(self, df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Five rows a document: two raw signals, normalised ratio, formality, fused score."""
        return explain_signals(self.score(df, key, text_col), list(EXPLAINED_SIGNALS), key)

    def evaluate(self, rows: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The comparison table of labelled rows: the fused score, then its signals."""
        scored = self.fuse(self.raw_signals(rows.select(key, text_col), key, text_col)).drop("label")
        order = ["final_prob", *EXPLAINED_SIGNALS[:-1]]
        signals = rows.select(key, F.col("label")).join(scored, key).unpivot(
            [key, "label"], order, "signal", "score")
        return metrics.comparison_table(signals, order)

    def score_sentences(self, df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
        return score_sentences(df, self.semantic, key, text_col)

    def report(self, df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Document score with sentence statistics, length flag and conflict."""
        stats = sentence_stats(self.score_sentences(df, key, text_col), key)
        return self.score(df, key, text_col).join(stats, key, "left").withColumns({
            "long_document": F.coalesce(long_document(F.col("n_total")), F.lit(False)),
            # Without sentences the share is null, which is no conflict.
            "conflict": score_conflict(F.col("final_prob"), F.col("ai_frac"))})

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.semantic.save(f"{path}/semantic")
        self.genre.save(f"{path}/genre")
        self.stylo.save(f"{path}/stylo")
        for name in ("trigrams", "bigrams", "unigrams", "after_one", "after_two"):
            self.ngrams.table(spark, name).write.mode("overwrite").parquet(f"{path}/ngrams/{name}")
        meta = {"fusion": asdict(self.meta), "head": self.head.to_dict(), "semantic_cal": self.semantic_cal.to_dict(),
                "stylometric_cal": self.stylometric_cal.to_dict(), "tokens": self.ngrams.tokens,
                "vocabulary": self.ngrams.vocabulary, "ratio": asdict(self.ngrams.cfg),
                "semantic_tokens": self.semantic.max_tokens, "genre_tokens": self.genre.max_tokens}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(
            "overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> Detector:
        meta = json.loads(SparkSession.active().read.text(f"{path}/meta", wholetext=True).first()["value"])
        fm = meta["fusion"]
        return cls(
            models.TextModel.load(f"{path}/semantic", meta["semantic_tokens"]),
            models.StyloModel.load(f"{path}/stylo"),
            ngram.NgramModel(f"{path}/ngrams", meta["tokens"], meta["vocabulary"],
                             RatioConfig(**meta["ratio"])),
            models.TextModel.load(f"{path}/genre", meta["genre_tokens"]),
            Isotonic.from_dict(meta["semantic_cal"]), Isotonic.from_dict(meta["stylometric_cal"]), Head.from_dict(meta["head"]),
            fusion.FusionMeta(fm["p_low"], fm["p_high"], tuple(fm["names"])))


class Training:
    """The parts of a detector, each fitted when it is first used.

    ``corpus`` holds (key, text, label, split), ``genres`` (text, label, split). Base models,
    counts and percentiles see train rows only; calibration and the stopping rules see
    val rows. ``names`` picks the columns that are fused: the first two or three make
    the smaller detectors.

    The head is fitted on train rows whose semantic, stylometric and ratio signals come from
    models of the other ``folds``: a model scores the rows it was fitted on too well, and a
    head that sees such scores trusts them too much. Rows are dealt into folds by a hash of
    their key; val, test and new rows are scored by the models of all train rows.
    """

    def __init__(self, corpus: DataFrame, genres: DataFrame, key: str = "doc_id", stylo: StyloConfig = StyloConfig(),
                 semantic: SemanticConfig = SemanticConfig(), genre: GenreConfig = GenreConfig(),
                 ratio: RatioConfig = RatioConfig(), fuse: FusionConfig = FusionConfig(),
                 names: tuple[str, ...] = fusion.MATRIX):
        self.corpus, self.genres, self.key, self.names = corpus, genres, key, names
        self.stylo_cfg, self.semantic_cfg, self.genre_cfg, self.ratio_cfg, self.fuse_cfg = stylo, semantic, genre, ratio, fuse

    def _train(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("split") == "train")

    @cached_property
    def semantic(self) -> models.TextModel:
        return models.fit_semantic(self._train(self.corpus), self.semantic_cfg)

    @cached_property
    def genre(self) -> models.TextModel:
        return models.fit_genre(self._train(self.genres), self.genre_cfg, self.semantic_cfg)

    @cached_property
    def ngrams(self) -> ngram.NgramModel:
        return ngram.fit(self._train(self.corpus), self.ratio_cfg, scratch_path(self.corpus.sparkSession, "ngrams"))

    @cached_property
    def features(self) -> DataFrame:
        """Features of every row, written once; the text stays behind."""
        slim = self.corpus.select(self.key, "text", "label", "split")
        return materialise(with_stylometry(slim).drop("text"), "features")

    @cached_property
    def first_trees(self) -> models.StyloModel:
        """Trees on all features: their importances decide which are kept."""
        return models.fit_stylometric(self.features, FEATURE_NAMES, self.stylo_cfg)

    @cached_property
    def trees(self) -> models.StyloModel:
        return models.fit_pruned(self.features, self.stylo_cfg, self.first_trees)[1]

    def _scored(self, rows: DataFrame, semantic: models.TextModel, trees: models.StyloModel,
                counts: ngram.NgramModel) -> DataFrame:
        """(key, label, split, four raw signals) of corpus rows by the models given."""
        key = self.key
        slim = rows.select(key, "text", "label", "split")
        by_text = models.genre_signals(models.semantic_probability(slim, semantic), self.genre).drop("text", "genre_info")
        styled = trees.probability(self.features.join(rows.select(key), key, "left_semi")).select(key, "stylometric")
        return by_text.join(styled, key).join(ngram.ratios(slim, counts, key=key), key)

    @cached_property
    def signals(self) -> DataFrame:
        """Raw signals of every row by the detector's own models."""
        together(lambda: self.trees, lambda: self.semantic, lambda: self.genre, lambda: self.ngrams)
        return materialise(self._scored(self.corpus, self.semantic, self.trees, self.ngrams), "signals")

    def fold(self) -> Column:
        """The fold of a row, by its key alone."""
        return F.pmod(F.xxhash64(F.col(self.key), F.lit("fold")), F.lit(self.fuse_cfg.folds))

    @cached_property
    def head_signals(self) -> DataFrame:
        """Raw signals to fit the head on: those of train rows come from models that never saw the row."""
        folds = self.fuse_cfg.folds
        if folds < 2:
            return self.signals
        # The rounds are those of the detector's trees: a fold has no val rows of its own.
        rounds = replace(self.stylo_cfg, trees=max(1, len(self.trees.trees.trees)))

        def part(k: int) -> DataFrame:
            mine = (F.col("split") == "train") & (self.fold() == k)
            others = self._train(self.corpus).where(self.fold() != k)
            trees = models.fit_stylometric(self._train(self.features).where(self.fold() != k), self.trees.names, rounds)
            counts = ngram.fit(others, self.ratio_cfg, scratch_path(self.corpus.sparkSession, "ngrams"))
            return self._scored(self.corpus.where(mine), models.fit_semantic(others, self.semantic_cfg), trees, counts)

        rest = self.signals.where(F.col("split") != "train")
        parts = together(*[partial(part, k) for k in range(folds)])
        return materialise(reduce(DataFrame.unionByName, [rest, *parts]), "head-signals")

    @cached_property
    def unfused(self) -> Detector:
        """The detector without its head: models, calibrators and percentiles."""
        cfg, val = self.fuse_cfg, self.signals.where(F.col("split") == "val")
        clipped = val.withColumn("semantic", fusion.unsaturated(F.col("semantic"), cfg.saturation))
        low, high = fusion.exact_percentiles(
            self._train(self.signals), "ratio", [cfg.low_percentile, cfg.high_percentile])
        return Detector(self.semantic, self.trees, self.ngrams, self.genre, fusion.fit_isotonic(clipped, "semantic"),
                        fusion.fit_isotonic(val, "stylometric"), None, fusion.FusionMeta(low, high, self.names))

    @cached_property
    def head_rows(self) -> DataFrame:
        return self.unfused.matrix(self.head_signals)

    @cached_property
    def detector(self) -> Detector:
        return replace(self.unfused, head=fusion.fit_fusion(self.head_rows, self.names, self.fuse_cfg))


def train_detector(corpus: DataFrame, genres: DataFrame, **settings) -> tuple[Detector, DataFrame]:
    """Fit everything from split, labelled text; returns the detector and the signals of its rows."""
    training = Training(corpus, genres, **settings)
    return training.detector, training.signals
