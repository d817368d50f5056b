"""Evaluation queries (E): all signals of every document at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprint.functions.stats import round6
from inkprint.operators import metrics
from inkprint.plans.corpus_queries import _GENRE_ROWS, genre_rows
from inkprint.plans.sql import LONG_SQL, SIGNALS, h01, h01_col, r6, ratio, scored

QUERIES: dict = {}
SQL: dict = {}


def _add(name, build, sql=None):
    QUERIES[name] = build
    if sql is not None:
        SQL[name] = sql


def long_rows(s, sf):
    return metrics.long_signals(scored(s, sf), list(SIGNALS), ["doc_id", "label"])


def rounded(df, *cols):
    return df.withColumns({c: round6(F.col(c)) for c in cols})


_L = f"WITH l AS ({LONG_SQL}) "
_CELLS = (
    "(SELECT signal, count(*) FILTER (label = 0 AND score < 0.5) AS tn, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, "
    "count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 1 AND score >= 0.5) AS tp FROM l GROUP BY signal)")
_ACC, _PREC, _REC, _F1 = (ratio("tp + tn", "tp + tn + fp + fn"), ratio("tp", "tp + fp"),
                          ratio("tp", "tp + fn"), ratio("2 * tp", "2 * tp + fp + fn"))

_add("e01_threshold",
     lambda s, sf: long_rows(s, sf).select(
         "doc_id", "signal", metrics.predicted(F.col("score")).alias("pred")),
     _L + "SELECT doc_id, signal, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM l")
_add("e02_confusion", lambda s, sf: metrics.confusion(long_rows(s, sf)),
     _L + f"SELECT * FROM {_CELLS}")
_add("e03_threshold_metrics",
     lambda s, sf: rounded(metrics.threshold_metrics(metrics.confusion(long_rows(s, sf))),
                           "accuracy", "precision", "recall", "f1"),
     _L + f"SELECT *, {r6(_ACC)} AS accuracy, {r6(_PREC)} AS precision, {r6(_REC)} AS recall, {r6(_F1)} AS f1 FROM {_CELLS}")

# Mann-Whitney from ranks with ties; average precision from cumulative counts.
_COUNTS = ("(SELECT signal, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg "
           "FROM l GROUP BY signal, score)")
_CUM = (f"(SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY signal) AS tp_all, "
        f"sum(neg) OVER (PARTITION BY signal) AS tn_all FROM {_COUNTS} WINDOW w AS (PARTITION BY signal ORDER BY score DESC))")
_AUC = "sum(pos::DOUBLE * (tn_all - cn + neg / 2.0::DOUBLE)) / (any_value(tp_all)::DOUBLE * any_value(tn_all))"
_AP = "sum(pos::DOUBLE * cp / (cp + cn)) / any_value(tp_all)"
_AREAS = f"(SELECT signal, {_AUC} AS auc_roc, {_AP} AS auc_pr FROM {_CUM} GROUP BY signal)"
_add("e04_auc_roc",
     lambda s, sf: rounded(metrics.areas(long_rows(s, sf)).select("signal", "auc_roc"), "auc_roc"),
     _L + f"SELECT signal, {r6('auc_roc')} AS auc_roc FROM {_AREAS}")
_add("e05_average_precision",
     lambda s, sf: rounded(metrics.areas(long_rows(s, sf)).select("signal", "auc_pr"), "auc_pr"),
     _L + f"SELECT signal, {r6('auc_pr')} AS auc_pr FROM {_AREAS}")
_add("e06_roc_points",
     lambda s, sf: rounded(metrics.roc_points(long_rows(s, sf)), "threshold", "fpr", "tpr"),
     _L + f"SELECT signal, {r6('score')} AS threshold, {r6('cn::DOUBLE / tn_all')} AS fpr, {r6('cp::DOUBLE / tp_all')} AS tpr FROM {_CUM}")
_add("e07_pr_points",
     lambda s, sf: rounded(metrics.pr_points(long_rows(s, sf)), "threshold", "precision", "recall"),
     _L + f"SELECT signal, {r6('score')} AS threshold, {r6('cp::DOUBLE / (cp + cn)')} AS precision, {r6('cp::DOUBLE / tp_all')} AS recall FROM {_CUM}")


def _hist_sql(lo, hi):
    place = "floor((score - lo) / ((hi - lo) / 60))"
    return (_L + f", e AS (SELECT *, {lo} AS lo, {hi} AS hi FROM l), "
            f"b AS (SELECT signal, label, greatest(0, least(59, {place}))::BIGINT AS bin, count(*) AS n, "
            "any_value((hi - lo) / 60) AS w FROM e GROUP BY 1, 2, 3) "
            f"SELECT signal, label, bin, n, {r6('n / (sum(n) OVER (PARTITION BY signal, label) * w)')} AS density FROM b")


_ENDS = "OVER (PARTITION BY signal, label)"
_add("e08_score_histogram",
     lambda s, sf: rounded(metrics.score_histogram(long_rows(s, sf)), "density"),
     _hist_sql(f"min(score) {_ENDS}", f"max(score) {_ENDS}"))
_add("e08_unit_histogram",
     lambda s, sf: rounded(metrics.score_histogram(long_rows(s, sf), fixed_range=True), "density"),
     _hist_sql("0.0::DOUBLE", "1.0::DOUBLE"))
_add("e09_normalised_confusion",
     lambda s, sf: rounded(metrics.normalised_confusion(metrics.confusion(long_rows(s, sf))),
                           "tn_share", "fp_share", "fn_share", "tp_share"),
     _L + f"SELECT signal, {r6(ratio('tn', 'tn + fp'))} AS tn_share, {r6(ratio('fp', 'tn + fp'))} AS fp_share, "
     f"{r6(ratio('fn', 'fn + tp'))} AS fn_share, {r6(ratio('tp', 'fn + tp'))} AS tp_share FROM {_CELLS}")
_add("e10_error_rates",
     lambda s, sf: rounded(metrics.error_rates(metrics.confusion(long_rows(s, sf))), "fp_rate", "fn_rate"),
     _L + f"SELECT signal, {r6(ratio('fp', 'fp + tn'))} AS fp_rate, {r6(ratio('fn', 'fn + tp'))} AS fn_rate FROM {_CELLS}")


def _pairs(s, sf):
    wrong = F.floor(h01_col("g", "doc_id") * 7).cast("int")
    return genre_rows(s, sf).select("label", F.when(wrong > 3, F.col("label")).otherwise(wrong).alias("pred"))


_G = f"floor({h01('g', 'doc_id')} * 7)::INTEGER"
_PAIRS = (f"WITH p AS (SELECT label, CASE WHEN {_G} > 3 THEN label ELSE {_G} END AS pred FROM {_GENRE_ROWS}), "
          "cl AS (SELECT label AS c FROM p UNION SELECT pred FROM p), "
          "per AS (SELECT c, (SELECT count(*) FROM p WHERE label = c) AS support, (SELECT count(*) FROM p WHERE pred = c) AS said, "
          "(SELECT count(*) FROM p WHERE label = c AND pred = c) AS hit FROM cl), "
          f"m AS (SELECT CAST(c AS VARCHAR) AS cls, support, {ratio('hit', 'said')} AS precision, {ratio('hit', 'support')} AS recall, "
          f"{ratio('2 * hit', 'said + support')} AS f1 FROM per) ")
_add("e11_macro_f1",
     lambda s, sf: rounded(metrics.multiclass_summary(_pairs(s, sf)), "accuracy", "f1_macro"),
     _PAIRS + f"SELECT {r6('(SELECT avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0 END) FROM p)')} AS accuracy, "
     f"{r6('avg(f1)')} AS f1_macro FROM m")
_W = lambda k: f"sum({k} * support) / sum(support)"
_add("e12_class_report",
     lambda s, sf: rounded(metrics.class_report(_pairs(s, sf)), "precision", "recall", "f1"),
     _PAIRS + ", u AS (SELECT * FROM m UNION ALL SELECT 'macro avg', sum(support), avg(precision), avg(recall), avg(f1) FROM m "
     f"UNION ALL SELECT 'weighted avg', sum(support), {_W('precision')}, {_W('recall')}, {_W('f1')} FROM m) "
     f"SELECT cls, support::BIGINT AS support, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1 FROM u")
_add("e13_comparison",
     lambda s, sf: rounded(metrics.comparison_table(long_rows(s, sf), list(SIGNALS)),
                           "f1", "auc_roc", "precision", "recall"),
     _L + f"SELECT list_position([{', '.join(repr(x) for x in SIGNALS)}], signal)::BIGINT AS place, signal, {r6(_F1)} AS f1, "
     f"{r6('auc_roc')} AS auc_roc, {r6(_PREC)} AS precision, {r6(_REC)} AS recall FROM {_CELLS} JOIN {_AREAS} USING (signal)")
_add("e14_class_prior", lambda s, sf: rounded(metrics.class_prior(long_rows(s, sf)), "prior"),
     _L + f"SELECT signal, {r6('avg(label::DOUBLE)')} AS prior FROM l GROUP BY signal")
