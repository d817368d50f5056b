"""Cleaning: the corpus rules, the rejection funnel, and document preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.config import CorpusConfig, ScoringConfig
from inkprint.functions import text

# Fixed patterns: lines that are structure rather than prose. Digits, captions,
# contents leaders, numerals and headings as the published rules name them.
STRUCTURE_LINES = {
    "numbered_heading": r"\A[0-9]{1,2}(?:\.[0-9]{1,2}){0,3}\.?\s+[A-Z]",
    "reference": r"\A(?:\[?[0-9]+\]\.?|\([0-9]+\))\s+[A-Z]",
    "caption": r"\A(?i:Figure|Fig\.|Table|Tbl\.|Appendix|Exhibit)\s",
    "leader": r"\.{3,}|…{2,}",
    "numeral": r"\A[IVXivx0-9\s\-–—]+\z",
    "capitals": r"\A[A-Z][A-Z\s\-]{4,}\z",
}
MIN_LINE_CHARS = 20
# The same rules as tests of a whole line: a pattern that starts at \A is tried once, not at every character.
_AT_START = r"\A(?:" + "|".join(p.removeprefix(r"\A") for p in STRUCTURE_LINES.values() if p.startswith(r"\A")) + ")"
_ANYWHERE = ("...", "……")  # "leader", as plain text


def corpus_rules(cfg: CorpusConfig, speaks_english: Column | None,
                 col: str = "text") -> list[tuple[str, Column]]:
    """Pass conditions on cleaned text in reporting order; a null language verdict passes."""
    c = F.col(col)
    n = text.clean_word_count(c)
    rules = [("blank", ~text.is_blank(c))]
    if speaks_english is not None:
        rules.append(("language", F.coalesce(speaks_english, F.lit(True))))
    return rules + [
        ("word_count", n.between(cfg.min_words, cfg.max_words)),
        ("repetition", text.clean_unique_ratio(c) >= cfg.min_unique_ratio),
    ]


def cleaned(df: DataFrame, cfg: CorpusConfig = CorpusConfig(),
            speaks_english: Column | None = None, col: str = "text") -> DataFrame:
    """Cleaned text, failing rows dropped.

    The cheap word-count test runs before the language verdict and the token-set
    test; all are pure predicates on the same text, so the order is free.
    """
    d = df.where(~text.is_blank(F.col(col))).withColumn(
        col, text.clean_characters(F.col(col)))
    rules = dict(corpus_rules(cfg, speaks_english, col))
    d = d.where(rules["word_count"]).where(rules["repetition"])
    return d.where(rules["language"]) if "language" in rules else d


def with_rejection(df: DataFrame, cfg: CorpusConfig = CorpusConfig(),
                   speaks_english: Column | None = None, col: str = "text") -> DataFrame:
    """Every row with the first rule it fails, or ``kept``."""
    d = df.withColumn(col, text.clean_characters(F.coalesce(F.col(col), F.lit(""))))
    reason = F.lit("kept")
    for name, passes in reversed(corpus_rules(cfg, speaks_english, col)):
        reason = F.when(~passes, F.lit(name)).otherwise(reason)
    return d.withColumn("reason", reason)


def rejection_funnel(df: DataFrame, **kwargs) -> DataFrame:
    return with_rejection(df, **kwargs).groupBy("reason").agg(F.count("*").alias("n"))


def extracted_text(c: Column) -> Column:
    """Spaces collapsed, non-ASCII blanked, line breaks kept."""
    other = r"\t\x0b\f\r\x1c-\x1f[\x{85}-\x{3000}&&" + text.WS + "]"
    # A lone plain space, the usual case, is no match: it would only be replaced by itself.
    runs = rf"\x20[\x20{other}]+|[{other}][\x20{other}]*+"
    # Of all whitespace only spaces and line breaks are left at the end.
    return F.btrim(F.regexp_replace(F.regexp_replace(c, runs, " "), r"[^\x20-\x7E\n]", " "), F.lit(" \n"))


def is_structure(line: Column) -> Column:
    leader = F.contains(line, F.lit(_ANYWHERE[0])) | F.contains(line, F.lit(_ANYWHERE[1]))
    return (F.length(line) < MIN_LINE_CHARS) | leader | line.rlike(_AT_START)


def without_structure(c: Column) -> Column:
    """Prose lines of a document, joined by a space."""
    lines = F.transform(F.split(c, "\n"), text.strip)
    return F.array_join(F.filter(lines, lambda s: ~is_structure(s)), " ")


def newline_count(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n"), F.lit("")))


def scorable_text(df: DataFrame, cfg: ScoringConfig = ScoringConfig(),
                  col: str = "text") -> DataFrame:
    """Add ``shown_text``, ``prose`` (what gets scored) and ``too_short``.

    Structure is stripped only from documents with many line breaks, and only
    when enough words survive.
    """
    d = df.withColumn("shown_text", extracted_text(F.coalesce(F.col(col), F.lit(""))))
    shown = F.col("shown_text")
    d = d.withColumn("_stripped", F.when(
        newline_count(shown) > cfg.long_newlines, without_structure(shown)))
    enough = text.word_count(F.col("_stripped")) >= cfg.min_words_after_strip
    return (
        d.withColumn("prose", F.when(enough, F.col("_stripped")).otherwise(shown))
        .withColumn("too_short", text.word_count(shown) < cfg.min_words)
        .drop("_stripped")
    )
