"""Source (S) and sink (K) queries.

Readers of files run on files that Spark first derives from the whole tables,
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprint.config import CorpusConfig
from inkprint.functions.lexicons import FEATURE_NAMES
from inkprint.functions.stats import round6
from inkprint.operators import cleaning, metrics
from inkprint.operators.corpus import build_corpus, with_fingerprint
from inkprint.plans.corpus_queries import _SPLIT, _key_sql, split_turns
from inkprint.plans.metric_queries import _AREAS, _CELLS, _F1, _L, _PREC, _REC, long_rows
from inkprint.plans.sql import (
    NON_WS, STYLED, TURNS_SQL, WS, clean_sql, documents, h01, h01_col, r6,
    strip_sql, table, tokens_sql, turns,
)
from inkprint.plans.text_queries import features_sql
from inkprint.session import scratch_path
from inkprint.sources import readers, sinks

QUERIES: dict = {}
SQL: dict = {}


def _add(name, build, sql=None):
    QUERIES[name] = build
    if sql is not None:
        SQL[name] = sql


def _written(spark, df, name, write):
    path = scratch_path(spark, name)
    write(df.write, path)
    return path


_TOKS = tokens_sql("text")
_KEEP = (f"len({_TOKS}) BETWEEN 50 AND 512 AND "
         f"len(list_distinct({tokens_sql('lower(text)')}))::DOUBLE / len({_TOKS}) >= 0.20")


def _kept(rows):
    """Turn rows after the corpus rules, text as a digest."""
    return f"(SELECT * FROM (SELECT doc_id, label, source, model, {clean_sql('text')} AS text FROM ({rows})) WHERE {_KEEP})"


def _digest(df):
    return df.withColumn("text", F.md5("text"))


# --- sources ------------------------------------------------------------------


def _qa(s, sf):
    only = lambda y: F.when(F.col("label") == y, F.array("text"))
    record = F.to_json(F.struct(only(0).alias("human_answers"), only(1).alias("chatgpt_answers")))
    lines = turns(s, sf).select(F.explode(F.array(
        record, F.lit("{}"))).alias("value"))
    lines = lines.select(F.from_json("value", "human_answers array<string>, chatgpt_answers array<string>").alias("r"))
    path = _written(s, lines.select("r.*"), "qa", lambda w, p: w.json(p))
    return _digest(cleaning.cleaned(readers.qa_pairs(s, path))).select("text", "label", "model")


_add("s01_qa_pairs", _qa,
     "SELECT md5(text) AS text, label, CASE label WHEN 0 THEN 'human' ELSE 'chatgpt' END AS model FROM "
     + _kept(TURNS_SQL))


def _detect(s, sf):
    d = turns(s, sf).select("label", F.col("doc_id").alias("Id"), F.col("text").alias("Content"),
                            F.col("source").alias("generation"), F.col("model").alias("MODEL"))
    body, model = readers.detect_columns(d.columns)
    return d.select(F.md5(F.col(body)).alias("body"), F.col(model).alias("model"))


_add("s02_detect_columns", _detect, f"SELECT md5(text) AS body, model FROM ({TURNS_SQL})")

_MODEL = "CASE label WHEN 0 THEN CASE doc_id % 2 WHEN 0 THEN ' Human ' ELSE 'human' END ELSE model END"


def _raid(s, sf):
    d = turns(s, sf).select(F.expr(_MODEL).alias("Model"), F.col("text").alias("GENERATION"))
    pq = _written(s, d, "gen-parquet", lambda w, p: w.parquet(p))
    csv = _written(s, d, "gen", lambda w, p: w.option("header", True).option("escape", '"')
                   .option("quoteAll", True).csv(p + "-csv")) + "-csv"
    bare = _written(s, d.select("GENERATION"), "bare", lambda w, p: w.parquet(p))
    rows = readers.multi_generator(s, [csv, pq, bare, pq + "-missing"])
    return _digest(cleaning.cleaned(rows)).select("text", "label", "model")


_add("s03_multi_generator", _raid,
     "SELECT md5(text) AS text, CASE WHEN lower(model) = 'human' THEN 0 ELSE 1 END AS label, model FROM "
     f"(SELECT text, unnest([trim({_MODEL}), trim({_MODEL}), 'unknown']) AS model FROM {_kept(TURNS_SQL)})")


def _chat(as_json):
    def build(s, sf):
        chat = F.array(F.struct(F.lit("user").alias("role"), F.lit("hello").alias("content")),
                       F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")))
        d = turns(s, sf).select(
            F.when(F.col("label") == 1, "gpt-4").otherwise("other").alias("model"),
            (F.to_json(chat) if as_json else chat).alias("conversation"))
        path = _written(s, d, "chat", lambda w, p: w.parquet(p))
        return _digest(cleaning.cleaned(readers.chat_log(s, path))).select("text", "label", "model")
    return build


_CHAT = f"SELECT md5(text) AS text, 1 AS label, 'gpt-4' AS model FROM {_kept(TURNS_SQL)} WHERE label = 1"
_add("s05_chat_log", _chat(False), _CHAT)
_add("s05_chat_log_json", _chat(True), _CHAT)


def _transcripts(s, sf):
    said = F.when(F.col("label") == 1, F.concat(
        F.lit("\n\nHuman: hi\n\nAssistant: well\n\nHuman: and?\n\nAssistant: "), "text", F.lit(" \n"))
    ).otherwise(F.concat(F.lit("\n\nHuman: "), "text"))
    d = turns(s, sf).select(said.alias("chosen"))
    path = _written(s, d, "transcripts", lambda w, p: w.option("compression", "gzip").json(p))
    return _digest(cleaning.cleaned(readers.transcripts(s, path))).select("text", "label", "model")


_add("s06_transcripts", _transcripts,
     f"SELECT md5(text) AS text, 1 AS label, 'claude' AS model FROM {_kept(TURNS_SQL)} WHERE label = 1")

_PARA = (f"list_filter(string_split(text, chr(10) || chr(10)), lambda x: len({tokens_sql('x')}) >= 50)[1]")


def _encyclopedia(s, sf):
    rows = readers.human_source(documents(s, sf, STYLED), readers.first_paragraph(F.col("text"), 50),
                                "encyclopedia", CorpusConfig().human_source_target)
    return _digest(cleaning.cleaned(rows)).select("doc_id", "text", "label", "source")


_add("s07_encyclopedia", _encyclopedia,
     f"SELECT doc_id, md5(text) AS text, 0 AS label, 'encyclopedia' AS source FROM (SELECT doc_id, {clean_sql(strip_sql('text'))} AS text FROM "
     f"(SELECT doc_id, {_PARA} AS text FROM (SELECT doc_id, {STYLED} AS text FROM documents)) WHERE text IS NOT NULL) WHERE {_KEEP}")


def _abstracts(s, sf):
    d = cleaning.cleaned(documents(s, sf)).withColumn("label", F.lit(0))
    first, second = d.where(F.col("lang") == "fr"), d.where(F.col("lang") != "fr")
    return readers.with_fallbacks([first, second], 200, groups=[0]).select("doc_id", "lang", "source_rank")


_add("s08_abstracts", _abstracts,
     "SELECT doc_id, lang, source_rank FROM (SELECT *, CASE lang WHEN 'fr' THEN 0 ELSE 1 END::BIGINT AS source_rank FROM "
     f"(SELECT * FROM (SELECT doc_id, lang, {clean_sql('text')} AS text FROM documents) WHERE {_KEEP})) "
     f"ORDER BY lpad(CAST(source_rank AS VARCHAR), 4, '0') || {_key_sql('quota42')} LIMIT 200")


def _genre(bounds, label, quota):
    """One genre source over ordered frames, one per language."""
    def build(s, sf):
        d = documents(s, sf)
        frames = [readers.genre_rows(d.where(F.col("lang") == lang), F.col("text"), label, low, high)
                  for lang, low, high in bounds]
        return _digest(readers.with_fallbacks(frames, quota, groups=[label])).select(
            "doc_id", "text", "label", "source_rank")
    branches = " UNION ALL ".join(
        f"SELECT doc_id, substr({strip_sql('text')}, 1, 1500) AS text, {i}::BIGINT AS source_rank FROM documents "
        f"WHERE lang = '{lang}' AND len({_TOKS}) BETWEEN {low} AND {high or 10**9}"
        for i, (lang, low, high) in enumerate(bounds))
    sql = (f"SELECT doc_id, md5(text) AS text, {label} AS label, source_rank FROM ({branches}) "
           f"ORDER BY lpad(CAST(source_rank AS VARCHAR), 4, '0') || {_key_sql('quota42')} LIMIT {quota}")
    return build, sql


_add("s09_informal", *_genre([("de", 40, None), ("es", 40, None), ("en", 40, 300), ("fr", 40, None)], 2, 250))
_add("s10_news", *_genre([("fr", 20, None), ("de", 40, None), ("es", 40, None), ("en", 40, None)], 3, 250))


def _files(s, sf):
    d = table(s, sf, "benchmark").select("item_id", F.col("text").alias("value"))
    path = _written(s, d, "files", lambda w, p: w.partitionBy("item_id").text(p))
    rows = readers.text_files(s, path)
    return rows.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("bigint").alias("item_id"),
                       F.md5("text").alias("text"), "status")


_add("s11_text_files", _files,
     "SELECT item_id, md5(text || chr(10)) AS text, 'ok' AS status FROM benchmark")

_HTML = ("replace(html, '<body>', concat('<body><header class=\"x\">top <b>bar</b></header><!-- <nav> gone -->', "
         "'<HEADER>in<nav>menu</nav>after nav</HEADER> 1 < 2 &lt;kept&gt; a&nbsp;b <p title=\"1 > 0\">quoted</p><nav-bar>own</nav-bar>',"
         " '<style>a > b { } </nav> </style><a href=x>bare</a>'))")
# The same scan: comments, raw elements, tags with their attributes, text; then what stands between marks goes.
_ATTR = r"""([^>=]|=\s*"[^"]*"|=\s*''[^'']*''|=)*"""
_TOKEN = (r"<!--(?s:.*?)-->|" + "|".join(rf"(?is:<{t}([\s/]{_ATTR})?>.*?(</{t}\s*>|\z))" for t in ("script", "style"))
          + rf"|<[a-zA-Z]{_ATTR}>|<[/!?][^>]*>|[^<]+|<")
_NAMED = r"(script|style|nav|footer|header)"
_PAGE = (f"array_to_string(list_transform(regexp_extract_all(html, '{_TOKEN}'), lambda t: CASE "
         r"WHEN regexp_matches(t, '(?i)^<(script|style)[\s/>]') THEN chr(1) || chr(2) "
         rf"WHEN regexp_matches(t, '(?i)^<{_NAMED}[\s/>]') THEN chr(1) WHEN regexp_matches(t, '(?i)^</{_NAMED}\s*>') THEN chr(2) "
         r"WHEN regexp_matches(t, '^<[a-zA-Z/!?]') THEN ' ' ELSE t END), '')")
_PAGE = rf"regexp_replace({_PAGE}, '\x01[^\x02]*(\x02|\z)|\x02', ' ', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _PAGE = f"replace({_PAGE}, '{_a}', '{_b}')"
_add("s12_page_text",
     lambda s, sf: table(s, sf, "pages").select("page_id", F.expr(_HTML).alias("html")).select(
         "page_id", readers.page_text(F.col("html")).alias("text")),
     f"SELECT page_id, trim(regexp_replace({_PAGE}, '{WS}+', ' ', 'g'), ' ') AS text FROM (SELECT page_id, {_HTML} AS html FROM pages)")


def _split_files(s, sf):
    path = scratch_path(s, "splits")
    sinks.write_splits(split_turns(s, sf), path)
    return path


_add("s13_read_split",
     lambda s, sf: readers.read_split(s, _split_files(s, sf), "val").select("doc_id", "label", "split"),
     _SPLIT + "SELECT doc_id, label, split FROM split_rows WHERE split = 'val'")

# --- sinks --------------------------------------------------------------------


def _csv_splits(s, sf):
    path = scratch_path(s, "splits-csv")
    sinks.write_splits(split_turns(s, sf), path, "csv")
    back = (s.read.option("header", True).option("multiLine", True).option("escape", '"')
            .schema("doc_id bigint, text string, label int, source string, model string, split string").csv(path))
    return back.select("doc_id", F.md5("text").alias("text"), "label", "split")


_add("k01_write_splits", _csv_splits,
     _SPLIT + "SELECT doc_id, md5(text) AS text, label, split FROM split_rows")

_CACHE_NAMES = FEATURE_NAMES


def _feature_cache(s, sf):
    path = scratch_path(s, "features")
    d = with_fingerprint(documents(s, sf, STYLED))
    sinks.cached_features(d.where(F.col("lang") == "en"), path, _CACHE_NAMES)
    return sinks.cached_features(d, path, _CACHE_NAMES).select(
        "fp", *[round6(F.col(n)).alias(n) for n in _CACHE_NAMES])


_FP_SQL = f"md5(lower({strip_sql(STYLED)}))"
_add("k02_feature_cache", _feature_cache,
     f"SELECT DISTINCT fp, {', '.join(_CACHE_NAMES)} FROM ({features_sql(_CACHE_NAMES)}) f JOIN "
     f"(SELECT doc_id, {_FP_SQL} AS fp FROM documents) d ON d.doc_id = f.doc_id")


def _signal_cache(s, sf):
    path = scratch_path(s, "signals")
    d = table(s, sf, "documents").select("doc_id", "lang", F.md5("text").alias("fp"))
    compute = lambda x: x.withColumn("semantic", h01_col("s0", "fp"))
    sinks.cached_signal(d.where(F.col("lang") == "fr"), path, "semantic", compute)
    stored = sinks.cached_signal(d.where(F.col("lang") != "de"), path, "semantic", compute)
    return sinks.with_signal(d, stored, "semantic", 0.5).select(
        "doc_id", round6(F.col("semantic")).alias("semantic"))


_SIG = h01("s0", "md5(text)")
_add("k03_signal_cache", _signal_cache,
     f"SELECT doc_id, {r6(f'CASE WHEN text IN (SELECT text FROM documents WHERE lang <> {chr(39)}de{chr(39)}) THEN {_SIG} ELSE 0.5 END')}"
     " AS semantic FROM documents")
_add("k06_summary",
     lambda s, sf: sinks.summary_lines(metrics.binary_metrics(long_rows(s, sf))),
     _L + "SELECT signal, printf('%-14s %8.4f %10.4f %12.4f %10.4f', signal, "
     f"{_F1}, auc_roc, {_PREC}, {_REC}) AS line FROM {_CELLS} JOIN {_AREAS} USING (signal)")

# --- the whole corpus job -------------------------------------------------------


def _corpus(s, sf):
    d = cleaning.cleaned(turns(s, sf))
    return build_corpus([d.where(F.col("label") == 1), d.where(F.col("label") == 0)]).select(
        "fp", "label", "split")


_FIRST = (f"SELECT fp AS doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY label DESC, doc_id) AS rn "
          f"FROM (SELECT *, md5(lower({strip_sql('text')})) AS fp FROM {_kept(TURNS_SQL)})) WHERE rn = 1")
_SAMPLED = (f"SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY "
            f"md5('sample42|' || doc_id) || '|' || doc_id) AS rn, least(120000, (SELECT min(c) FROM "
            f"(SELECT count(*) AS c FROM ({_FIRST}) GROUP BY label))) AS each FROM ({_FIRST})) WHERE rn <= each")
from inkprint.plans.corpus_queries import _HELD, _TEST, split_sql  # noqa: E402

_add("corpus_build", _corpus,
     split_sql(_SAMPLED, _HELD, _TEST).replace("lpad(CAST(doc_id AS VARCHAR), 20, '0')", "doc_id")
     + "SELECT doc_id AS fp, label, split FROM split_rows")
