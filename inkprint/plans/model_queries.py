"""Signal queries (M, X) and the model sinks (K04, K05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprint.config import RatioConfig, StyloConfig
from inkprint.functions.lexicons import FEATURE_NAMES, GENRES
from inkprint.functions.stats import round6
from inkprint.functions.stylometry import with_stylometry
from inkprint.operators import corpus, fusion, langid, models, ngram
from inkprint.operators.scoring import Training
from inkprint.plans.corpus_queries import genre_rows
from inkprint.plans.sql import (
    SIGNALS, STYLED, clean_sql, documents, h01, h01_col, r6, scored, scored_sql, table, tokens_sql, turns,
)
from inkprint.plans.text_queries import features_sql
from inkprint.session import materialise, scratch_path
from inkprint.sources import sinks

QUERIES: dict = {}
SQL: dict = {}


def _add(name, build, sql=None):
    QUERIES[name] = build
    if sql is not None:
        SQL[name] = sql


_FITTED: dict = {}

STYLO = StyloConfig()  # the published boosting, whatever the size of the tables


def fitted(s, sf):
    """The training for a data folder, one per application; each part is fitted when a query first needs it.

    Human and machine text are the user and assistant turns; the four genre
    classes are the document languages.
    """
    key = (s.sparkContext.applicationId, sf)
    if key not in _FITTED:
        rows = materialise(corpus.stratified_split(turns(s, sf), 0.15, 0.15), "rows")
        genres = materialise(corpus.stratified_split(genre_rows(s, sf).select(
            "doc_id", "text", "label"), 0.1, 0.1), "genres")
        _FITTED[key] = Training(rows, genres, stylo=STYLO)
    return _FITTED[key]


def _rounded(df, *cols):
    return df.withColumns({c: round6(F.col(c)) for c in cols})


# --- trained models: no SQL equivalent ---------------------------------------------
_add("m01_semantic_probability",
     lambda s, sf: _rounded(models.semantic_probability(turns(s, sf), fitted(s, sf).semantic)
                            .select("doc_id", "semantic"), "semantic"))


def _style_scores(model):
    """All turns scored by the trees on all features, or by those on the kept ones."""
    def build(s, sf):
        d = with_stylometry(turns(s, sf).select("doc_id", "text"))
        return _rounded(getattr(fitted(s, sf), model).probability(d).select("doc_id", "stylometric"), "stylometric")
    return build


_add("m03_stylometric_trees", _style_scores("first_trees"))
_add("m04_stylometric_scoring", _style_scores("trees"))
_add("m05_pruned_features",
     lambda s, sf: s.createDataFrame(
         [(i, n) for i, n in enumerate(fitted(s, sf).trees.names)], "place int, feature string"))
_add("m06_feature_importance",
     lambda s, sf: _rounded(fitted(s, sf).trees.importances(s), "importance"))


def _genre_probs(s, sf):
    d = models.genre_signals(documents(s, sf), fitted(s, sf).genre)
    return d.select("doc_id", "genre_info.genre", *[
        round6(F.col(f"genre_info.p_{g}")).alias(f"p_{g}") for g in GENRES],
        round6(F.col("formality")).alias("formality"))


_add("m08_genre_probabilities", _genre_probs)
_add("m13_out_of_fold_signals",
     lambda s, sf: _rounded(fitted(s, sf).head_signals.select("doc_id", "label", "split", *SIGNALS), *SIGNALS))
_add("m14_fusion",
     lambda s, sf: _rounded(fitted(s, sf).detector.fuse(fitted(s, sf).signals.drop("label")).select(
         "doc_id", "final_prob"), "final_prob"))


def _linear(s, sf):
    training = fitted(s, sf)
    head = fusion.fit_linear_fusion(training.head_rows.where(F.col("split") == "train"))
    return _rounded(fusion.fused(training.unfused.matrix(training.signals), head, linear=True).select(
        "doc_id", "final_prob"), "final_prob")


_add("m14_linear_baseline", _linear)


def _importance_file(s, sf):
    path = scratch_path(s, "importance")
    sinks.write_importances(fitted(s, sf).trees.importances(s), path)
    return s.read.schema("feature string, importance double").option("header", True).csv(path)


def _feature_lists(s, sf):
    path = scratch_path(s, "active")
    sinks.write_feature_list(s, fitted(s, sf).trees.names, path)
    return s.createDataFrame([(n,) for n in sinks.read_feature_list(s, path)], "feature string")


_add("k04_importance_table", _importance_file)
_add("k05_feature_lists", _feature_lists)

# --- scaling --------------------------------------------------------------------------
_TRAIN = h01("train", "doc_id") + " < 0.7"


def _scaling(s, sf):
    # Read twice, for the statistics and to be scaled; written once so that no text is tokenised again.
    d = materialise(with_stylometry(documents(s, sf, STYLED).select("doc_id", "text"), names=FEATURE_NAMES).drop("text"), "features")
    stats = models.fit_scaler(d.where(h01_col("train", "doc_id") < 0.7), FEATURE_NAMES)
    return _rounded(models.scale(d, stats), *FEATURE_NAMES)


_RAW = features_sql(FEATURE_NAMES, finish=lambda e: f"({e})::DOUBLE")
_add("m02_feature_scaling", _scaling,
     f"WITH f AS MATERIALIZED ({_RAW}), m AS (SELECT " + ", ".join(
         f"avg({n}) AS m_{n}, coalesce(nullif(stddev_pop({n}), 0), 1) AS s_{n}" for n in FEATURE_NAMES)
     + f" FROM f WHERE {_TRAIN}) SELECT doc_id, "
     + ", ".join(f"{r6(f'({n} - m_{n}) / s_{n}')} AS {n}" for n in FEATURE_NAMES) + " FROM f, m")

# --- cross-perplexity ratio -------------------------------------------------------------


def _ratio(s, sf):
    d = documents(s, sf)
    model = ngram.fit(d.where(h01_col("train", "doc_id") < 0.7))
    return _rounded(ngram.ratios(d, model), "ratio")


_C = RatioConfig()
_RATIO_SQL = f"""
WITH tk AS (SELECT doc_id, {tokens_sql('lower(text)')} AS t FROM documents),
g AS (SELECT doc_id, {_TRAIN} AS fit, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS i, t FROM tk),
r AS (SELECT doc_id, fit, i, w, CASE WHEN i > 1 THEN t[i - 1] END AS v, CASE WHEN i > 2 THEN t[i - 2] END AS u FROM g),
f AS (SELECT * FROM r WHERE fit),
uni AS (SELECT w, count(*) AS c FROM f GROUP BY w),
z AS (SELECT sum(c)::DOUBLE + count(*) + 1 AS z FROM uni),
bi AS (SELECT v, w, count(*) AS c FROM f WHERE v IS NOT NULL GROUP BY v, w),
n1 AS (SELECT v, sum(c) AS n FROM bi GROUP BY v),
tri AS (SELECT u, v, w, count(*) AS c FROM f WHERE u IS NOT NULL GROUP BY u, v, w),
n2 AS (SELECT u, v, sum(c) AS n FROM tri GROUP BY u, v),
a AS (SELECT r.*, (coalesce(uni.c, 0) + 1) / z.z AS p1, coalesce(bi.c, 0)::DOUBLE AS c2, n1.n AS m1,
  coalesce(tri.c, 0)::DOUBLE AS c3, n2.n AS m2
  FROM r LEFT JOIN uni ON uni.w = r.w LEFT JOIN bi ON bi.v = r.v AND bi.w = r.w LEFT JOIN n1 ON n1.v = r.v
  LEFT JOIN tri ON tri.u = r.u AND tri.v = r.v AND tri.w = r.w LEFT JOIN n2 ON n2.u = r.u AND n2.v = r.v
  CROSS JOIN z WHERE r.v IS NOT NULL),
b AS (SELECT *, CASE WHEN m1 IS NOT NULL THEN {_C.bigram_weight}::DOUBLE * c2 / m1 + {1 - _C.bigram_weight!r}::DOUBLE * p1 ELSE p1 END AS p2 FROM a),
c AS (SELECT *, CASE WHEN m2 IS NOT NULL THEN {_C.trigram_weight}::DOUBLE * c3 / m2 + {1 - _C.trigram_weight!r}::DOUBLE * p2 ELSE p2 END AS p3 FROM b),
e AS (SELECT doc_id, avg(-ln(p2)) / greatest(avg(-ln(p3)), 1e-6) AS q FROM c GROUP BY doc_id)
SELECT documents.doc_id AS doc_id, {r6('coalesce(q, 1.0)')} AS ratio FROM documents LEFT JOIN e ON e.doc_id = documents.doc_id"""
_add("m07_cross_perplexity", _ratio, _RATIO_SQL)



def _pruned_ratio(s, sf):
    """The ratio with trigrams pruned at a hundredth of a nat a token."""
    d = documents(s, sf)
    model = ngram.fit(d.where(h01_col("train", "doc_id") < 0.7), RatioConfig(max_loss=0.01))
    return _rounded(ngram.ratios(d, model), "ratio")


_add("m07_pruned_ratio", _pruned_ratio)

# --- genre mass, calibration, normalisation, matrix ----------------------------------------


def _mass(s, sf):
    parts = [h01_col(f"p{i}", "doc_id") + F.lit(0.01) for i in range(4)]
    whole = parts[0] + parts[1] + parts[2] + parts[3]
    d = table(s, sf, "documents").select("doc_id", F.array(*[p / whole for p in parts]).alias("probs"))
    return d.select("doc_id", models.best_genre(F.col("probs")).alias("genre"),
                    round6(models.formality(F.col("probs"))).alias("formality"))


_P = [f"({h01(f'p{i}', 'doc_id')} + 0.01::DOUBLE)" for i in range(4)]
_add("m09_formality", _mass,
     f"SELECT doc_id, {list(GENRES)}[list_position(p, list_max(p))] AS genre, {r6('p[1] / t + p[2] / t')} AS formality "
     f"FROM (SELECT doc_id, [{', '.join(_P)}] AS p, {' + '.join(_P)} AS t FROM documents)")


def _isotonic(s, sf):
    """Both calibrators, fitted on val rows and applied to all."""
    d = scored(s, sf).withColumn("semantic", fusion.unsaturated(F.col("semantic")))
    val = d.where((h01_col("train", "doc_id") >= 0.7) & (h01_col("train", "doc_id") < 0.85))
    for score in ("semantic", "stylometric"):
        d = fusion.calibrated(d, fusion.fit_isotonic(val, score), score, f"{score}_cal")
    return _rounded(d.select("doc_id", "semantic_cal", "stylometric_cal"), "semantic_cal", "stylometric_cal")


def _pools_sql(score, n):
    """CTEs of one calibrator: v{n} is the fitted value of each val score."""
    return (f"g{n} AS (SELECT {score} AS x, sum(label)::DOUBLE AS y, count(*)::DOUBLE AS n, row_number() OVER (ORDER BY {score}) AS i "
            f"FROM val GROUP BY {score}), "
            f"s{n} AS (SELECT *, sum(y) OVER (ORDER BY i) AS cy, sum(n) OVER (ORDER BY i) AS cn FROM g{n}), "
            f"m{n} AS (SELECT a.i AS a, b.i AS b, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS mean FROM s{n} a JOIN s{n} b ON a.i <= b.i), "
            f"lo{n} AS (SELECT s{n}.i, a, min(mean) AS v FROM s{n} JOIN m{n} ON a <= s{n}.i AND b >= s{n}.i GROUP BY 1, 2), "
            f"v{n} AS (SELECT any_value(x) AS x, max(v) AS v FROM lo{n} JOIN s{n} USING (i) GROUP BY i)")


# Straight lines between val scores, end values outside.
def _line_sql(score, n):
    x = f"d.{score}"
    return (f"CASE WHEN b{n}.x IS NULL THEN a{n}.v WHEN a{n}.x IS NULL OR a{n}.x = b{n}.x THEN b{n}.v "
            f"ELSE b{n}.v + (a{n}.v - b{n}.v) * ({x} - b{n}.x) / (a{n}.x - b{n}.x) END")


_add("m10_isotonic", _isotonic,
     f"WITH d AS (SELECT * REPLACE (least(semantic, 0.99::DOUBLE) AS semantic) FROM ({scored_sql()})), "
     f"val AS (SELECT * FROM d WHERE {h01('train', 'doc_id')} >= 0.7 AND {h01('train', 'doc_id')} < 0.85), "
     + _pools_sql("semantic", 1) + ", " + _pools_sql("stylometric", 2)
     + f" SELECT d.doc_id AS doc_id, {r6(_line_sql('semantic', 1))} AS semantic_cal, {r6(_line_sql('stylometric', 2))} AS stylometric_cal FROM d "
     + " ".join(f"ASOF LEFT JOIN v{n} b{n} ON d.{c} >= b{n}.x ASOF LEFT JOIN v{n} a{n} ON d.{c} <= a{n}.x"
                for n, c in ((1, "semantic"), (2, "stylometric"))))
_add("m11_saturation_clip",
     lambda s, sf: scored(s, sf).select(
         "doc_id", round6(fusion.unsaturated(F.col("semantic"))).alias("semantic")),
     f"SELECT doc_id, {r6('least(semantic, 0.99::DOUBLE)')} AS semantic FROM ({scored_sql()})")


def _normalised(s, sf):
    d = scored(s, sf)
    low, high = fusion.exact_percentiles(d.where(h01_col("train", "doc_id") < 0.7), "ratio", [0.05, 0.95])
    return d.select("doc_id", round6(fusion.ratio_signal(F.col("ratio"), low, high)).alias("ratio_signal"))


_SIGNAL = "1 - greatest(0::DOUBLE, least(1::DOUBLE, (ratio - lo) / (hi - lo + 1e-6)))"
_add("m12_percentile_normalise", _normalised,
     f"WITH d AS ({scored_sql()}), q AS (SELECT quantile_cont(ratio, 0.05) AS lo, quantile_cont(ratio, 0.95) AS hi FROM d WHERE {_TRAIN}) "
     f"SELECT doc_id, {r6(_SIGNAL)} AS ratio_signal FROM d, q")


def _matrix(names):
    def build(s, sf):
        d = scored(s, sf)
        tables = [d.where(h01_col(n, "doc_id") >= 0.1).select("doc_id", n) for n in names]
        joined = fusion.signal_matrix(d.select("doc_id", "label"), tables, "doc_id")
        missing = [n for n in ("semantic", "stylometric", "ratio", "formality") if n not in names]
        whole = fusion.with_neutral(joined.withColumns({n: F.lit(None).cast("double") for n in missing}))
        return _rounded(whole.select("doc_id", "label", *names), *names)
    neutral = {"semantic": 0.5, "stylometric": 0.5, "ratio": 1.0, "formality": 0.5}
    sql = (f"SELECT doc_id, label, " + ", ".join(
        r6(f"CASE WHEN {h01(n, 'doc_id')} >= 0.1 THEN {n} ELSE {neutral[n]} END") + f" AS {n}" for n in names)
        + f" FROM ({scored_sql()})")
    return build, sql


_add("m13_signal_matrix", *_matrix(["semantic", "stylometric", "ratio", "formality"]))
_add("m13_three_signals", *_matrix(["semantic", "stylometric", "ratio"]))
_add("m13_two_signals", *_matrix(["semantic", "stylometric"]))


def _neutral(s, sf):
    d = scored(s, sf)
    holes = {n: F.when(h01_col(n, "doc_id") >= 0.3, F.col(n)) for n in SIGNALS}
    return _rounded(fusion.with_neutral(d.withColumns(holes)).select(
        "doc_id", *SIGNALS), *SIGNALS)


_HOLE = lambda n, v: r6(f"coalesce(CASE WHEN {h01(n, 'doc_id')} >= 0.3 THEN {n} END, {v})") + f" AS {n}"
_add("m15_neutral_values", _neutral,
     f"SELECT doc_id, {_HOLE('semantic', 0.5)}, {_HOLE('stylometric', 0.5)}, {_HOLE('ratio', 1.0)}, {_HOLE('formality', 0.5)} FROM ({scored_sql()})")

# --- language identification ----------------------------------------------------------------


def _language(s, sf):
    d = documents(s, sf)
    return langid.detect(d, langid.fit(d.where(h01_col("train", "doc_id") < 0.7)))


_GRAMS = ("SELECT doc_id, lang, unnest(CASE WHEN len(ch) > 2 THEN list_transform(list_zip(ch[:-3], ch[2:-2], ch[3:]), "
          "lambda z: z[1] || z[2] || z[3]) ELSE [] END) AS gram FROM (SELECT doc_id, lang, "
          f"string_split(lower(substr(text, 1, {langid.HEAD_CHARS})), '') AS ch FROM documents)")
_LANGUAGE_SQL = (
     f"WITH g AS ({_GRAMS}), c AS (SELECT lang, gram, count(*) AS c FROM g WHERE {_TRAIN} GROUP BY 1, 2), "
     "vocab AS (SELECT DISTINCT gram FROM c), "
     "langs AS (SELECT DISTINCT lang FROM c), "
     "dense AS (SELECT v.gram, l.lang, coalesce(c.c, 0) AS c FROM vocab v CROSS JOIN langs l LEFT JOIN c ON c.gram = v.gram AND c.lang = l.lang), "
     "p AS (SELECT gram, lang, ln((c + 1)::DOUBLE / (sum(c) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))) AS logp FROM dense), "
     "s AS (SELECT g.doc_id, p.lang, round(sum(logp), 6) AS score FROM g JOIN p ON p.gram = g.gram GROUP BY 1, 2), "
     "b AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang DESC) AS rn FROM s) "
     "SELECT documents.doc_id AS doc_id, b.lang AS detected FROM documents LEFT JOIN b ON b.doc_id = documents.doc_id AND rn = 1")
_add("x01_language_id", _language, _LANGUAGE_SQL)


def _spoken(s, sf):
    """The corpus rule on detected languages: English, or no verdict."""
    d = documents(s, sf)
    profile = langid.fit(d.where(h01_col("train", "doc_id") < 0.7))
    return corpus.speaking(d, profile, ("en",), key="doc_id").select("doc_id", "lang")


_add("c06_language", _spoken,
     f"SELECT d.doc_id AS doc_id, d.lang AS lang FROM documents d JOIN ({_LANGUAGE_SQL}) x ON x.doc_id = d.doc_id "
     "WHERE coalesce(x.detected = 'en', true)")
