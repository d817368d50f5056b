"""Set operations, sampling and splitting (P) and corpus reports (A)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.config import CorpusConfig, GenreConfig
from inkprint.functions.stats import round6
from inkprint.functions.text import word_count
from inkprint.operators import corpus, reports
from inkprint.plans.sql import (
    SIGNALS, TURNS_SQL, documents, r6, scored, scored_sql, table, tokens_sql, turns,
)

QUERIES: dict = {}
SQL: dict = {}

CORPUS, GENRE = CorpusConfig(), GenreConfig()


def _add(name, build, sql=None):
    QUERIES[name] = build
    if sql is not None:
        SQL[name] = sql


def _key_sql(tag, key="doc_id"):
    digits = f"CAST({key} AS VARCHAR)"
    return f"(md5('{tag}|' || {digits}) || '|' || lpad({digits}, 20, '0'))"


_GENRE_OF = "CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END"


def genre_rows(s, sf):
    """Documents with their four-class label."""
    return documents(s, sf).withColumn("label", F.expr(_GENRE_OF))


_GENRE_ROWS = f"(SELECT doc_id, text, lang, source, {_GENRE_OF} AS label FROM documents)"

# --- set operations, sampling, splitting -------------------------------------


def _union(s, sf):
    d = table(s, sf, "documents").select("doc_id", "source")
    t = turns(s, sf).select("doc_id", "source")
    b = table(s, sf, "benchmark").select(F.col("item_id").alias("doc_id"),
                                         F.lit("benchmark").alias("source"))
    return corpus.union_sources([d, t, b])


_add("p01_union_all", _union,
     f"SELECT doc_id, source, 0::BIGINT AS source_rank FROM documents UNION ALL "
     f"SELECT doc_id, source, 1 FROM ({TURNS_SQL}) UNION ALL "
     "SELECT item_id, 'benchmark', 2 FROM benchmark")

_EACH = "(SELECT least(150, count(*) FILTER (label = 0), count(*) FILTER (label = 1)) FROM t)"
_add("p02_balanced_sample",
     lambda s, sf: corpus.balanced_sample(turns(s, sf), 300).select("doc_id", "label"),
     f"WITH t AS ({TURNS_SQL}) SELECT doc_id, label FROM (SELECT *, row_number() OVER ("
     f"PARTITION BY label ORDER BY {_key_sql('sample42')}) AS rn FROM t) WHERE rn <= {_EACH}")
_add("p03_seeded_shuffle",
     lambda s, sf: turns(s, sf).select("doc_id", corpus.shuffle_key().alias("order_key"))
     .orderBy("order_key"),
     f"SELECT doc_id, {_key_sql('shuffle42')} AS order_key FROM ({TURNS_SQL}) ORDER BY order_key")


def split_sql(rows, held, test, seed=42):
    """Largest-remainder sizes, then plain ranks within each class."""
    def shares(src, n, part, out):
        return (f"SELECT *, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, label) <= part - sum(fl) OVER () "
                f"THEN 1 ELSE 0 END AS {out} FROM (SELECT *, ({n} * part) // tot AS fl, ({n} * part) % tot AS rem "
                f"FROM (SELECT *, CAST({part} AS BIGINT) AS part, CAST(sum({n}) OVER () AS BIGINT) AS tot FROM {src}))")
    first = shares("cls", "n", f"ceil({held}::DOUBLE * sum(n) OVER ())", "n_held")
    drop = "SELECT label, n, n_held FROM h"
    second = shares(f"({drop})", "n_held", f"ceil({test}::DOUBLE * sum(n_held) OVER ())", "n_test")
    return (
        f"WITH t AS ({rows}), cls AS (SELECT label, count(*) AS n FROM t GROUP BY label), "
        f"h AS ({first}), z AS ({second}), "
        "sized AS (SELECT label, n - n_held AS n_train, n - n_test AS n_keep FROM z), "
        "split_rows AS (SELECT r.*, CASE WHEN rn <= n_train THEN 'train' WHEN rn <= n_keep THEN 'val' ELSE 'test' END AS split "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_key_sql(f'split{seed}')}) AS rn FROM t) r "
        "JOIN sized USING (label)) ")


_HELD, _TEST = repr(0.15 + 0.15), repr(0.15 / (0.15 + 0.15))
_SPLIT = split_sql(TURNS_SQL, _HELD, _TEST)


def split_turns(s, sf):
    return corpus.stratified_split(turns(s, sf), CORPUS.val_ratio, CORPUS.test_ratio)


_add("p04_stratified_split",
     lambda s, sf: split_turns(s, sf).select("doc_id", "label", "split"),
     _SPLIT + "SELECT doc_id, label, split FROM split_rows")
_add("p05_genre_split",
     lambda s, sf: corpus.stratified_split(
         genre_rows(s, sf), GENRE.val_ratio, GENRE.test_ratio).select("doc_id", "label", "split"),
     split_sql(f"SELECT * FROM {_GENRE_ROWS}", repr(0.1 + 0.1), repr(0.1 / (0.1 + 0.1)))
     + "SELECT doc_id, label, split FROM split_rows")

_RANK3 = "CAST(regexp_replace(source, '[^0-9]', '', 'g') AS BIGINT) % 3"
_add("p06_quota_fill",
     lambda s, sf: corpus.fill_quota(
         genre_rows(s, sf).withColumn(
             "source_rank", F.regexp_replace("source", "[^0-9]", "").cast("bigint") % 3), 90
     ).select("doc_id", "label", "source_rank"),
     "SELECT doc_id, label, source_rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY "
     f"lpad(CAST(source_rank AS VARCHAR), 4, '0') || {_key_sql('quota42')}) AS rn FROM "
     f"(SELECT *, {_RANK3} AS source_rank FROM {_GENRE_ROWS})) WHERE rn <= 90")
_add("p07_head",
     lambda s, sf: table(s, sf, "documents").orderBy("doc_id").limit(150).select("doc_id", "source"),
     "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 150")
_add("s04_soft_cap",
     lambda s, sf: corpus.soft_cap(documents(s, sf), 150).select("doc_id"),
     f"SELECT doc_id FROM documents ORDER BY {_key_sql('cap42')} LIMIT 150")


def _weights(s, sf):
    return documents(s, sf).groupBy("lang", "source").agg(
        F.sum(word_count(F.col("text"))).alias("weight"))


_WEIGHTS = (f"(SELECT lang, source, sum(len({tokens_sql('text')}))::BIGINT AS weight FROM documents GROUP BY 1, 2)")
_add("p08_top_k",
     lambda s, sf: _weights(s, sf).orderBy(F.desc("weight"), "lang", "source").limit(20),
     f"SELECT * FROM {_WEIGHTS} ORDER BY weight DESC, lang, source LIMIT 20")
_add("p09_sort_by_weight",
     lambda s, sf: _weights(s, sf).orderBy(F.desc("weight"), "lang", "source"),
     f"SELECT * FROM {_WEIGHTS} ORDER BY weight DESC, lang, source")

# --- reports -------------------------------------------------------------------


def _rounded(df, *cols):
    return df.withColumns({c: round6(F.col(c)) for c in cols})


_add("a01_split_report",
     lambda s, sf: _rounded(reports.split_report(split_turns(s, sf)), "human_pct", "ai_pct"),
     _SPLIT + "SELECT split, count(*) AS total, count(*) FILTER (label = 0) AS human, "
     "count(*) FILTER (label = 1) AS ai, "
     + r6("100.0 * count(*) FILTER (label = 0)::DOUBLE / count(*)") + " AS human_pct, "
     + r6("100.0 * count(*) FILTER (label = 1)::DOUBLE / count(*)") + " AS ai_pct "
     "FROM split_rows GROUP BY split")
_add("a02_coverage", lambda s, sf: reports.coverage(turns(s, sf)),
     "SELECT CASE label WHEN 1 THEN 'model' ELSE 'source' END AS kind, "
     f"CASE label WHEN 1 THEN model ELSE source END AS name, count(*) AS n FROM ({TURNS_SQL}) GROUP BY 1, 2 ORDER BY 1, 3 DESC, 2")
_add("a03_source_counts", lambda s, sf: reports.source_counts(turns(s, sf)),
     "SELECT coalesce(source, 'all') AS source, coalesce(CAST(label AS VARCHAR), 'all') AS label, "
     f"count(*) AS n FROM ({TURNS_SQL}) GROUP BY ROLLUP (source, label)")
_add("a04_class_counts", lambda s, sf: reports.class_counts(genre_rows(s, sf)),
     f"SELECT label, count(*) AS n FROM {_GENRE_ROWS} GROUP BY label")
_add("a05_token_lengths",
     lambda s, sf: _rounded(reports.length_stats(documents(s, sf), 448, "lang"),
                            "mean_tokens", "truncated_pct"),
     f"SELECT lang, {r6('avg(n)')} AS mean_tokens, max(n) AS max_tokens, "
     f"{r6('avg(CASE WHEN n >= 448 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS truncated_pct "
     f"FROM (SELECT lang, len({tokens_sql('text')})::BIGINT AS n FROM documents) GROUP BY lang")
_add("a06_signal_distribution",
     lambda s, sf: reduce(DataFrame.unionByName, [_rounded(reports.signal_distribution(scored(s, sf), x).withColumn(
         "signal", F.lit(x)), "mean", "std", "min", "max") for x in SIGNALS]),
     " UNION ALL ".join(f"SELECT '{x}' AS signal, {r6(f'avg({x})')} AS mean, {r6(f'stddev_pop({x})')} AS std, "
                        f"{r6(f'min({x})')} AS min, {r6(f'max({x})')} AS max FROM ({scored_sql()})" for x in SIGNALS))
_add("a07_dataset_statistics", lambda s, sf: reports.dataset_statistics(split_turns(s, sf)),
     _SPLIT + ", c AS (SELECT coalesce(split, 'total') AS part, count(*) AS n FROM split_rows GROUP BY ROLLUP (split)) "
     "SELECT part, n, round(100.0::DOUBLE * n / (SELECT count(*) FROM split_rows)) AS pct FROM c")
