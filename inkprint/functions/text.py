"""Text expressions: Column in, Column out, no Python per row.

Java's ``\\s`` and ``trim`` know ASCII only, so whitespace is spelled out as the
Unicode class everywhere. The exotic members sit behind one range test, so plain
characters cost a single comparison. Tokenisers return arrays; nothing here
shuffles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WS_BODY = (
    r"\t-\r\x1c-\x20[\x{85}-\x{3000}&&[\x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)
WS = f"[{_WS_BODY}]"
NON_WS = f"[^{_WS_BODY}]"
TOKEN = rf"[!-~]++{NON_WS}*+|{NON_WS}++"

URL = rf"https?://{NON_WS}++|www\.{NON_WS}++"
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f]"
# A run of a-z with no other letter, digit or underscore touching it.
# The look ahead comes first: where no a-z follows, nothing behind is looked at.
WORD = r"(?=[a-z])(?<![\p{L}\p{N}_])[a-z]++(?![\p{L}\p{N}_])"
SENTENCE_END = r"[.!?]+"
DIGIT = r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}-\x{2079}\x{2080}-\x{2089}]"


def strip(c: Column) -> Column:
    """Trim Unicode whitespace at both ends; texts without any there skip the search through the whole text."""
    return once(c, lambda t: F.when(
        F.substring(t, 1, 1).rlike(WS) | F.substring(t, -1, 1).rlike(WS), F.regexp_replace(t, rf"\A{WS}+|{WS}+\z", "")).otherwise(t))


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def nfkc(c: Column) -> Column:
    """Unicode NFKC on the JVM; pure-ASCII text, already in NFKC, skips the call.

    The method call counts as non-deterministic for the optimizer, which also
    keeps filters on the cleaned text from re-running the cleaning below them.
    """
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True)
    )).otherwise(c)


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, " ")


def remove_controls(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, " ")


def clean_characters(c: Column) -> Column:
    """NFKC, URLs out, whitespace collapsed, control characters blanked.

    Control characters go last, so they can leave double or edge spaces.
    """
    return remove_controls(collapse_whitespace(remove_urls(nfkc(c))))


def ws_tokens(c: Column) -> Column:
    """Whitespace-separated tokens."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TOKEN)).cast("bigint")


def single_spaced(c: Column) -> Column:
    """Cleaned text, whose only whitespace is the plain space, without runs of it."""
    return F.trim(F.when(F.contains(c, F.lit("  ")), F.regexp_replace(c, " {2,}", " ")).otherwise(c))


def once(c: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it.

    Cleaning counts as non-deterministic, so equal parts of an expression over it are not
    shared: a text named six times would be cleaned six times.
    """
    return F.element_at(F.transform(F.array(c), use), 1)


def clean_word_count(c: Column) -> Column:
    """Words of cleaned text, by counting its spaces."""
    def count(flat: Column) -> Column:
        spaces = F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "), F.lit("")))
        return F.when(flat == "", 0).otherwise(spaces + 1).cast("bigint")
    return once(c, lambda t: once(single_spaced(t), count))


def clean_unique_ratio(c: Column) -> Column:
    """Share of distinct lower-cased words of cleaned text."""
    return once(c, lambda t: once(
        F.split(F.lower(single_spaced(t)), " "), lambda tokens: F.size(F.array_distinct(tokens)) / F.size(tokens)))


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(NON_WS)


def words(lowered: Column) -> Column:
    """Words of already lower-cased text."""
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, SENTENCE_END), lambda s: s.rlike(NON_WS))


def paragraphs(c: Column) -> Column:
    return F.filter(F.split(c, r"\n\n"), lambda p: p.rlike(NON_WS))


def display_sentences(c: Column) -> Column:
    """Sentences as shown to a reader: cut after .!? and whitespace, over 10 chars."""
    cut = F.split(c, rf"(?<=[.!?]){WS}+")
    return F.filter(F.transform(cut, strip), lambda s: F.length(s) > 10)


def word_bigrams(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(
        F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )


def char_bigrams(lowered: Column) -> Column:
    """Overlapping character pairs after one double-space pass; linear time."""
    return F.regexp_extract_all(
        F.replace(lowered, F.lit("  "), F.lit(" ")), F.lit("(?s)(?=(..))."), F.lit(1)
    )


def run_lengths(items: Column) -> Column:
    """Counts of the distinct items of an array whose items hold no newline.

    Equal items are brought together by a sort and each run is then one regex
    match: the counting stays inside the row, with no explode and no shuffle.
    """
    joined = F.concat(F.array_join(F.sort_array(items), "\n"), F.lit("\n"))
    runs = F.regexp_extract_all(joined, F.lit(r"([^\n]+\n)\1*+"), F.lit(0))
    return F.transform(runs, lambda r: count_literal(r, "\n"))


def char_bigram_counts(lowered: Column) -> Column:
    """Counts of the distinct character pairs; pairs may hold any character.

    Batches of texts go to numpy: a pair is one number there, an object in a row's array.
    The helper is a local function, so that workers need not find this package.
    """
    def one(t: str) -> np.ndarray:
        points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        pairs = np.sort(points[:-1] << np.uint64(32) | points[1:])
        ends = np.flatnonzero(np.append(pairs[1:] != pairs[:-1], len(pairs) > 0))
        return np.diff(ends, prepend=-1).astype(float)

    @F.pandas_udf("array<double>")
    def counts(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return counts(F.replace(lowered, F.lit("  "), F.lit(" ")))


def count_literal(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    gone = F.octet_length(c) - F.octet_length(F.replace(c, F.lit(needle), F.lit("")))
    return (gone / len(needle.encode())).cast("double")


def fingerprint(c: Column) -> Column:
    return F.md5(F.lower(strip(c)))


def preview(c: Column, limit: int) -> Column:
    return F.concat(
        F.substring(c, 1, limit),
        F.when(F.length(c) > limit, F.lit("...")).otherwise(F.lit("")),
    )
