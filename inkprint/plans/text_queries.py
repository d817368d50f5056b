"""Cleaning (C), tokenisation (T) and stylometry (F) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprint.config import CorpusConfig
from inkprint.functions import lexicons, text
from inkprint.functions.stats import clogc, entropy_bits, round6
from inkprint.functions.stylometry import with_stylometry
from inkprint.operators import cleaning
from inkprint.operators.corpus import first_values, keep_first, load_order, with_fingerprint
from inkprint.plans.sql import (
    DIRTY, LINED, NON_WS, STYLED, WS, clean_sql, documents, h01, h01_col, r6,
    strip_sql, table, tokens_sql, words_sql,
)

QUERIES: dict = {}
SQL: dict = {}


def _add(name, build, sql=None):
    QUERIES[name] = build
    if sql is not None:
        SQL[name] = sql


def _text_op(name, source, column, expr_sql):
    """One expression over every document: (doc_id, out)."""
    _add(name,
         lambda s, sf: documents(s, sf, source).select("doc_id", column().alias("out")),
         f"SELECT doc_id, {expr_sql} AS out FROM (SELECT doc_id, {source} AS text FROM documents)")


T = lambda: F.col("text")

# --- cleaning ---------------------------------------------------------------
BLANKED = f"CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN concat(' ', chr(9), ' ') ELSE {DIRTY} END"
_add("c01_blank_guard",
     lambda s, sf: documents(s, sf, BLANKED).where(~text.is_blank(T())).select("doc_id", "text"),
     f"SELECT doc_id, text FROM (SELECT doc_id, {BLANKED} AS text FROM documents) "
     f"WHERE text IS NOT NULL AND regexp_matches(text, '{NON_WS}')")
_add("c02_nfkc",
     lambda s, sf: documents(s, sf, "concat(text, ' ﬁne ＡＢＣ x² ①')").select(
         "doc_id", text.nfkc(T()).alias("out")),
     "SELECT doc_id, concat(text, ' fine ABC x2 1') AS out FROM documents")
_text_op("c03_url_removal", DIRTY, lambda: text.remove_urls(T()),
         rf"regexp_replace(text, 'https?://{NON_WS}+|www\.{NON_WS}+', ' ', 'g')")
_text_op("c04_whitespace", DIRTY, lambda: text.collapse_whitespace(T()),
         f"trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ')")
_text_op("c05_controls", DIRTY, lambda: text.remove_controls(T()),
         r"regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f]', ' ', 'g')")

_CLEANED = f"(SELECT doc_id, lang, source, {clean_sql(DIRTY)} AS text FROM documents)"
_add("c07_word_bounds",
     lambda s, sf: documents(s, sf, DIRTY).select(
         "doc_id", text.clean_word_count(text.clean_characters(T())).alias("n_words")
     ).where(F.col("n_words").between(50, 512)),
     f"SELECT * FROM (SELECT doc_id, len({tokens_sql('text')})::BIGINT AS n_words FROM {_CLEANED}) "
     "WHERE n_words BETWEEN 50 AND 512")
_UNIQUE = f"(len(list_distinct({tokens_sql('lower(text)')}))::DOUBLE / len({tokens_sql('text')}))"
_add("c08_unique_ratio",
     lambda s, sf: documents(s, sf, DIRTY).where(~text.is_blank(T())).select(
         "doc_id", text.clean_unique_ratio(text.clean_characters(T())).alias("r")
     ).where(F.col("r") >= 0.20).select("doc_id", round6(F.col("r")).alias("unique_ratio")),
     f"SELECT doc_id, {r6('r')} AS unique_ratio FROM (SELECT doc_id, {_UNIQUE} AS r FROM {_CLEANED}) WHERE r >= 0.20")
_text_op("c09_fingerprint", DIRTY, lambda: text.fingerprint(T()),
         f"md5(lower({strip_sql('text')}))")


def _dedup_input(s, sf):
    d = table(s, sf, "documents")
    rank = F.regexp_replace("source", "[^0-9]", "").cast("bigint")
    return with_fingerprint(d.withColumn("source_rank", rank))


_add("c10_keep_first",
     lambda s, sf: keep_first(_dedup_input(s, sf), load_order()).select("doc_id", "source", "fp"),
     "SELECT doc_id, source, fp FROM (SELECT *, row_number() OVER (PARTITION BY fp "
     "ORDER BY source_rank, doc_id) AS rn FROM (SELECT doc_id, source, "
     "CAST(regexp_replace(source, '[^0-9]', '', 'g') AS BIGINT) AS source_rank, "
     f"md5(lower({strip_sql('text')})) AS fp FROM documents)) WHERE rn = 1")

_INNER = WS.replace(r"\t-\r", r"\t\x0b-\r")
_EXTRACT = strip_sql(
    rf"regexp_replace(regexp_replace(text, '{_INNER}+', ' ', 'g'), '[^\x20-\x7E\n]', ' ', 'g')")
_text_op("c11_extracted_text", DIRTY, lambda: cleaning.extracted_text(T()), _EXTRACT)

_LINE_RULES = "|".join((
    r"^[0-9]{1,2}(\.[0-9]{1,2}){0,3}\.?\s+[A-Z]", r"^(\[?[0-9]+\]\.?|\([0-9]+\))\s+[A-Z]",
    r"^((?i)(Figure|Fig\.|Table|Tbl\.|Appendix|Exhibit))\s", r"\.{3,}", "…{2,}",
    "^[IVXivx0-9\\s\\-–—]+$", r"^[A-Z][A-Z\s\-]{4,}$"))


def _stripped(expr):
    lines = f"list_transform(string_split({expr}, chr(10)), lambda x: {strip_sql('x')})"
    return (f"array_to_string(list_filter({lines}, lambda x: length(x) >= 20 "
            f"AND NOT regexp_matches(x, '{_LINE_RULES}')), ' ')")


_text_op("c12_strip_structure", LINED, lambda: cleaning.without_structure(T()), _stripped("text"))

_NEWLINES = "(length(text) - length(replace(text, chr(10), '')))"
_GATED = (
    "CASE WHEN nl > 30 AND len(" + tokens_sql("stripped") + ") >= 100 THEN stripped ELSE text END")
_SHOWN = f"(SELECT doc_id, {_EXTRACT} AS text FROM (SELECT doc_id, {LINED} AS text FROM documents))"
_add("c13_long_document_gate",
     lambda s, sf: cleaning.scorable_text(documents(s, sf, LINED)).select("doc_id", "prose"),
     f"SELECT doc_id, {_GATED} AS prose FROM (SELECT doc_id, text, {_NEWLINES} AS nl, "
     f"{_stripped('text')} AS stripped FROM {_SHOWN})")
_add("c14_minimum_words",
     lambda s, sf: cleaning.scorable_text(documents(s, sf)).select(
         "doc_id", F.when(F.col("too_short"), "too_short").otherwise("scored").alias("status")),
     f"SELECT doc_id, CASE WHEN len({tokens_sql(_EXTRACT)}) < 20 THEN 'too_short' ELSE 'scored' END AS status FROM documents")
_text_op("c15_char_cap", "text", lambda: F.substring(T(), 1, 1500), "substr(text, 1, 1500)")

_GENRE_RULE = "CASE lang WHEN 'fr' THEN n >= 40 WHEN 'de' THEN n >= 20 ELSE n BETWEEN 40 AND 300 END"
_add("c16_genre_bounds",
     lambda s, sf: documents(s, sf).select("doc_id", "lang", text.word_count(T()).alias("n"))
     .where(F.expr(_GENRE_RULE)),
     f"SELECT * FROM (SELECT doc_id, lang, len({tokens_sql('text')})::BIGINT AS n FROM documents) WHERE {_GENRE_RULE}")

_MAYBE = f"CASE doc_id % 11 WHEN 0 THEN NULL ELSE {DIRTY} END"
_add("c17_rejection_funnel",
     lambda s, sf: cleaning.rejection_funnel(
         documents(s, sf, _MAYBE), speaks_english=F.col("lang") == "en"),
     "SELECT CASE WHEN text IS NULL OR NOT regexp_matches(text, '" + NON_WS + "') THEN 'blank' "
     "WHEN lang <> 'en' THEN 'language' "
     f"WHEN len({tokens_sql('text')}) NOT BETWEEN 50 AND 512 THEN 'word_count' "
     f"WHEN {_UNIQUE} < 0.20 THEN 'repetition' ELSE 'kept' END AS reason, count(*) AS n "
     f"FROM (SELECT lang, {clean_sql(_MAYBE)} AS text FROM documents) GROUP BY 1")


def minimum_slice(s, sf, source="text"):
    """Clean, fingerprint, keep first, count by language: the flagship query."""
    d = cleaning.cleaned(documents(s, sf, source), speaks_english=None)
    d = with_fingerprint(d.withColumn("n_words", text.clean_word_count(T())))
    return first_values(d, F.col("doc_id"), ["lang", "n_words"]).groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum("n_words").alias("words"))


_KEPT = (
    f"SELECT *, len({tokens_sql('text')}) AS n FROM (SELECT doc_id, lang, {clean_sql('text')} AS text FROM documents)")
_add("corpus_clean_dedup", minimum_slice,
     "SELECT lang, count(*) AS docs, sum(n)::BIGINT AS words FROM (SELECT *, row_number() OVER ("
     "PARTITION BY md5(lower(trim(text))) ORDER BY doc_id) AS rn FROM (SELECT * FROM (" + _KEPT +
     f") WHERE n BETWEEN 50 AND 512 AND {_UNIQUE} >= 0.20)) WHERE rn = 1 GROUP BY lang")

# --- tokenisation -----------------------------------------------------------
_text_op("t01_words", STYLED, lambda: F.array_join(text.words(F.lower(T())), " "),
         f"array_to_string({words_sql('text')}, ' ')")
_SENTS = f"list_filter(string_split_regex(text, '[.!?]+'), lambda x: regexp_matches(x, '{NON_WS}'))"
_PARAS = f"list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_matches(x, '{NON_WS}'))"
_text_op("t02_sentences", STYLED,
         lambda: F.array_join(F.transform(text.sentences(T()), text.strip), "|"),
         f"array_to_string(list_transform({_SENTS}, lambda x: {strip_sql('x')}), '|')")
_text_op("t03_paragraphs", STYLED,
         lambda: F.array_join(F.transform(text.paragraphs(T()), text.strip), "|"),
         f"array_to_string(list_transform({_PARAS}, lambda x: {strip_sql('x')}), '|')")
_DISPLAY = (
    f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), "
    f"lambda x: {strip_sql('x')}), lambda x: length(x) > 10)")
_text_op("t04_display_sentences", STYLED,
         lambda: F.array_join(text.display_sentences(T()), "|"), f"array_to_string({_DISPLAY}, '|')")
_PAIRS = ("CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), "
          "lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END")
_CHARS = ("CASE WHEN len(ch) > 1 THEN list_transform(list_zip(ch[:-2], ch[2:]), "
          "lambda z: z[1] || z[2]) ELSE [] END")
_add("t05_bigrams",
     lambda s, sf: documents(s, sf, STYLED).select(
         "doc_id",
         F.md5(F.array_join(text.word_bigrams(text.words(F.lower(T()))), "|")).alias("word_pairs"),
         F.md5(F.array_join(text.char_bigrams(F.lower(T())), "|")).alias("char_pairs")),
     f"SELECT doc_id, md5(array_to_string({_PAIRS}, '|')) AS word_pairs, "
     f"md5(array_to_string({_CHARS}, '|')) AS char_pairs FROM (SELECT doc_id, {words_sql('text')} AS w, "
     f"string_split(replace(lower(text), '  ', ' '), '') AS ch FROM (SELECT doc_id, {STYLED} AS text FROM documents))")

# --- stylometry -------------------------------------------------------------


def _lexicon_sql(words):
    return "(len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in words) + ")))::DOUBLE / nw)"


def _quote(phrase):
    return "'" + phrase.replace("'", "''") + "'"


def _mark_sql(ch):
    return f"((length(t) - length(replace(t, '{ch}', '')))::DOUBLE / nw)"


def _entropy_sql(items, total):
    """Entropy per document of a list column, as a correlated lookup table."""
    return (f"(SELECT doc_id, log2(any_value(tot)::DOUBLE) - sum(c * log2(c)) / any_value(tot) AS h, "
            "count(*) AS types, count(*) FILTER (c = 1) AS singles FROM "
            f"(SELECT doc_id, item, any_value(tot) AS tot, count(*)::DOUBLE AS c FROM "
            f"(SELECT doc_id, {total} AS tot, unnest({items}) AS item FROM tok) GROUP BY 1, 2) GROUP BY 1)")


_TOK = (
    "WITH base AS (SELECT doc_id, {src} AS t FROM documents), "
    "cut AS (SELECT doc_id, t, lower(t) AS lo, " + _SENTS.replace("text", "lower(t)") + " AS s, "
    + words_sql("t") + " AS w, " + _PARAS.replace("text", "t") + " AS p, "
    + tokens_sql("t") + " AS raw, string_split(replace(lower(t), '  ', ' '), '') AS ch FROM base), "
    "tok AS MATERIALIZED (SELECT *, greatest(len(w), 1) AS nw, greatest(len(s), 1) AS ns, greatest(len(p), 1) AS np, "
    "list_transform(s, lambda y: len(" + words_sql("y") + ")) AS lens, array_to_string(w, ' ') AS joined FROM cut) "
)
_JOINS = {
    "u": _entropy_sql("w", "nw"),
    "b": _entropy_sql(_PAIRS, "(len(w) - 1)"),
    "c": _entropy_sql(_CHARS, "(len(ch) - 1)"),
    "l": _entropy_sql("lens", "ns"),
}
_POP = lambda xs: f"coalesce(list_stddev_pop({xs}), 0)"
_SYLL = ("(len(regexp_extract_all(joined, '[aeiouy]+')) + len(list_filter(w, lambda x: "
         "NOT regexp_matches(x, '[aeiouy]'))))::DOUBLE")
_COMPLEX = ("len(list_filter(w, lambda x: len(regexp_extract_all(x, '[aeiouy]+')) >= 3))::DOUBLE")
_WPS, _SPW = "(len(w)::DOUBLE / ns)", f"({_SYLL} / nw)"
_FILLER = "(" + " + ".join(
    f"((length(lo) - length(replace(lo, {_quote(p)}, '')))::DOUBLE / {len(p)})"
    for p in lexicons.FILLER_PHRASES) + ")"
_AVG = "coalesce(list_avg(lens), 0)"
_STARTS = "^" + WS + "*(" + "|".join(lexicons.LIST_STARTERS) + ")"
_DIGITS = text.DIGIT

FEATURE_SQL = {
    "sent_count": "ns", "avg_sent_len_words": _AVG, "std_sent_len_words": _POP("lens"),
    "burstiness": f"{_POP('lens')} / greatest({_AVG}, 1)",
    "max_sent_len": "list_max(lens)", "min_sent_len": "list_min(lens)",
    "word_count": "nw",
    "avg_word_len_chars": "coalesce(list_avg(list_transform(w, lambda x: length(x))), 0)",
    "std_word_len_chars": _POP("list_transform(w, lambda x: length(x))"),
    "unique_word_ratio": "coalesce(u.types, 0)::DOUBLE / nw",
    "hapax_ratio": "coalesce(u.singles, 0)::DOUBLE / nw",
    "long_word_ratio": "len(list_filter(w, lambda x: length(x) > 6))::DOUBLE / nw",
    "vocab_size": "coalesce(u.types, 0)",
    "function_word_ratio": _lexicon_sql(lexicons.FUNCTION_WORDS),
    "hedge_word_ratio": _lexicon_sql(lexicons.HEDGE_WORDS),
    "comma_per_word": _mark_sql(","), "period_per_word": _mark_sql("."),
    "exclamation_per_word": _mark_sql("!"), "question_per_word": _mark_sql("?"),
    "semicolon_per_word": _mark_sql(";"), "colon_per_word": _mark_sql(":"),
    "flesch_reading_ease":
        f"greatest(-100.0, least(120.0, 206.835::DOUBLE - 1.015::DOUBLE * {_WPS} - 84.6::DOUBLE * {_SPW}))",
    "flesch_kincaid_grade":
        f"greatest(0.0, least(20.0, 0.39::DOUBLE * {_WPS} + 11.8::DOUBLE * {_SPW} - 15.59::DOUBLE))",
    "gunning_fog":
        f"greatest(0.0, least(30.0, 0.4::DOUBLE * ({_WPS} + 100.0 * {_COMPLEX} / nw)))",
    "unigram_entropy": "coalesce(u.h, 0)", "bigram_entropy": "coalesce(b.h, 0)",
    "char_bigram_entropy": "coalesce(c.h, 0)",
    "ai_filler_count": _FILLER, "ai_filler_density": f"{_FILLER} / ns",
    "list_starter_ratio": f"len(list_filter(s, lambda x: regexp_matches(x, '{_STARTS}')))::DOUBLE / ns",
    "uppercase_ratio":
        "len(list_filter(raw, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x)))::DOUBLE / nw",
    "digit_ratio": f"len(list_filter(raw, lambda x: regexp_matches(x, '{_DIGITS}')))::DOUBLE / nw",
    "avg_paragraph_len":
        f"coalesce(list_avg(list_transform(p, lambda y: len({words_sql('y')}))), 0)",
    "paragraph_count": "np", "sent_len_entropy": "coalesce(l.h, 0)",
    "stopword_ratio": _lexicon_sql(lexicons.STOP_WORDS),
    "personal_pronoun_ratio": _lexicon_sql(lexicons.PERSONAL_PRONOUNS),
    "transition_word_density": _lexicon_sql(lexicons.TRANSITION_WORDS),
    "repeat_phrase_ratio":
        "coalesce(b.types - b.singles, 0)::DOUBLE / greatest(len(w) - 1, 1)",
}


def features_sql(names, src=STYLED, finish=r6):
    body = ", ".join(
        f"{finish(f'CASE WHEN len(s) = 0 THEN 0 ELSE {FEATURE_SQL[n]} END')} AS {n}" for n in names)
    joined = " ".join(
        f"LEFT JOIN {sub} {a} ON {a}.doc_id = tok.doc_id" for a, sub in _JOINS.items()
        if any(f"{a}." in FEATURE_SQL[n].replace("x.", "") for n in names))
    return _TOK.replace("{src}", src) + f"SELECT tok.doc_id AS doc_id, {body} FROM tok {joined}"


def _features(names, src=STYLED):
    def build(s, sf):
        d = documents(s, sf, src).select("doc_id", "text")
        return with_stylometry(d, names=names).select(
            "doc_id", *[round6(F.col(n)).alias(n) for n in names])
    return build


for _i, _n in enumerate(lexicons.FEATURE_NAMES, 1):
    _add(f"f{_i:02d}_{_n}", _features([_n]), features_sql([_n]))

_EDGES = ("CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ... !? ' "
          "WHEN 3 THEN '123.' WHEN 4 THEN concat(' ', chr(10)) ELSE text END")
_add("f00_zero_rule", _features(lexicons.FEATURE_NAMES, _EDGES),
     features_sql(lexicons.FEATURE_NAMES, f"coalesce({_EDGES}, '')"))
_add("features_all", _features(lexicons.FEATURE_NAMES), features_sql(lexicons.FEATURE_NAMES))
_add("t06_entropy",
     lambda s, sf: documents(s, sf, STYLED).select(
         "doc_id", text.words(F.lower(T())).alias("w")).select(
         "doc_id", round6(entropy_bits(clogc(text.run_lengths(F.col("w"))), F.size("w"))).alias("h")),
     _TOK.replace("{src}", STYLED) + f"SELECT tok.doc_id AS doc_id, {r6('coalesce(u.h, 0)')} AS h "
     f"FROM tok LEFT JOIN {_JOINS['u']} u ON u.doc_id = tok.doc_id")
