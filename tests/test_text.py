import hashlib
import re
import unicodedata

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from inkprint.functions import lexicons, text

PUBLISHED = {
    "FILLER_PHRASES": "34331d2772f56426", "HEDGE_WORDS": "d26a76ff20c511b4",
    "FUNCTION_WORDS": "43cd5cf65beea3c1", "PERSONAL_PRONOUNS": "cf19d9daedc92411",
    "TRANSITION_WORDS": "f4c7ad078415fb5e", "LIST_STARTERS": "5a1205c1014a8123",
}
TEXTS = [
    "plain words here", "  lead\ttab nbsp ls \x1cfs end \n", "", " 　\t ",
    "ﬁne ＡＢＣ x² ①", "café x_y a1b naïve it's ét d'été ²abc abc²", "U+1F600 😀😃 ab😀",
    "see https://a.b/c?d=e. and www.x.y", "a\x00b\x0ec\x7fd", "Straße ΣΑΣ İstanbul \u0085nel",
]


def column(spark, expr):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    return [r["o"] for r in d.select("i", expr(F.col("t")).alias("o")).orderBy("i").collect()]


def test_tokens_equal_python_split(spark):
    assert column(spark, text.ws_tokens) == [t.split() for t in TEXTS]
    assert column(spark, text.word_count) == [len(t.split()) for t in TEXTS]


def test_strip_and_blank(spark):
    assert column(spark, text.strip) == [t.strip() for t in TEXTS]
    assert column(spark, text.is_blank) == [not t.strip() for t in TEXTS]


def test_words_equal_python_regex(spark):
    got = column(spark, lambda c: text.words(F.lower(c)))
    assert got == [re.findall(r"\b[a-z]+\b", t.lower()) for t in TEXTS]


def test_nfkc(spark):
    assert column(spark, text.nfkc) == [unicodedata.normalize("NFKC", t) for t in TEXTS]


def test_controls_go_after_whitespace(spark):
    d = spark.createDataFrame([("a \x0e b\x7f",)], "t string")
    assert d.select(text.clean_characters(F.col("t"))).first()[0] == "a   b "


def test_fingerprint(spark):
    want = [hashlib.md5(t.lower().strip().encode()).hexdigest() for t in TEXTS]
    # Lower-casing differs between runtimes only for the dotted capital I.
    got = column(spark, text.fingerprint)
    assert [g for g, t in zip(got, TEXTS) if "İ" not in t] == [w for w, t in zip(want, TEXTS) if "İ" not in t]


def test_char_pairs_respect_code_points(spark):
    got = column(spark, text.char_bigrams)
    assert got == [[a + b for a, b in zip(s, s[1:])] for s in (t.replace("  ", " ") for t in TEXTS)]


def test_run_lengths(spark):
    d = spark.createDataFrame([(["b", "a", "b", "ab", "a", "b"],), ([],)], "x array<string>")
    got = [sorted(r[0]) for r in d.select(text.run_lengths(F.col("x"))).collect()]
    assert got == [[1.0, 2.0, 3.0], []]


def test_long_run_of_one_word(spark):
    d = spark.createDataFrame([(["w"] * 200_000,)], "x array<string>")
    assert d.select(text.run_lengths(F.col("x"))).first()[0] == [200_000.0]


def test_display_sentences(spark):
    d = spark.createDataFrame([("0123456789. 01234567890! Short. Is it? A longer one here...",)], "t string")
    assert d.select(text.display_sentences(F.col("t"))).first()[0] == [
        "0123456789.", "01234567890!", "A longer one here..."]


def test_stop_words_are_the_spark_list(spark):
    listed = [w for w in StopWordsRemover.loadDefaultStopWords("english") if re.fullmatch("[a-z]+", w)]
    assert sorted(lexicons.STOP_WORDS) == sorted(listed)


def test_lexicon_sizes():
    sizes = [len(x) for x in (lexicons.FEATURE_NAMES, lexicons.FILLER_PHRASES, lexicons.HEDGE_WORDS,
                              lexicons.FUNCTION_WORDS, lexicons.PERSONAL_PRONOUNS,
                              lexicons.TRANSITION_WORDS, lexicons.LIST_STARTERS)]
    assert sizes == [39, 25, 20, 53, 15, 19, 12]


def test_lists_are_as_published():
    """Digests of the lists in published order: a changed, lost or moved entry shows."""
    digest = lambda words: hashlib.sha256("\n".join(words).encode()).hexdigest()[:16]
    assert {n: digest(getattr(lexicons, n)) for n in PUBLISHED} == PUBLISHED


def test_texts_are_cleaned_once_per_figure(spark):
    d = spark.createDataFrame([(" Two  two\x01 three",), ("",), (None,)], "text string")
    got = d.select(text.clean_word_count(text.clean_characters(F.col("text"))).alias("n"),
                   text.clean_unique_ratio(text.clean_characters(F.col("text"))).alias("r"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ibm.icu.text.Normalizer") == 2  # once a column
    assert [tuple(r) for r in got.collect()] == [(3, 2 / 3), (0, 1.0), (None, None)]


def test_character_pairs_are_counted_by_code_point(spark):
    rows = ["", "a", "abab", "a  b a", "\U0001f600\U0001f600\U0001f600x", "e\u0301\nE"]
    d = spark.createDataFrame([(t,) for t in rows], "text string").select(
        "text", text.char_bigram_counts(F.col("text")).alias("n"), F.size(text.char_bigrams(F.col("text"))).alias("pairs"))
    assert "SortArray" not in (plan := d._jdf.queryExecution().optimizedPlan().toString()) and "sort_array" not in plan
    for r in d.collect():
        flat = r["text"].replace("  ", " ")
        want = {}
        for a, b in zip(flat, flat[1:]):
            want[a + b] = want.get(a + b, 0) + 1
        assert sorted(r["n"]) == sorted(want.values()) and sum(r["n"]) == r["pairs"]


def test_strip_searches_only_texts_with_whitespace_at_an_end(spark):
    rows = [(" a b ",), ("a b",), ("\u3000a\n",), ("",), (" ",), (None,), ("\u200ba",)]
    d = spark.createDataFrame(rows, "t string").select("t", text.strip(F.col("t")).alias("s"))
    assert [r["s"] for r in d.collect()] == ["a b", "a b", "a", "", "", None, "\u200ba"]
    assert "CASE WHEN" in d._jdf.queryExecution().optimizedPlan().toString()
