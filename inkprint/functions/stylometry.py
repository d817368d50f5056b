"""The 39 stylometric features as row-local expressions.

Each document is tokenised once. Frequencies (hapax, entropies, repeated
phrases) come from the row's own sorted arrays, so the whole job is one
narrow stage: scan, project, no exchange. Select fewer features and Catalyst
prunes the arrays they alone need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.functions import lexicons, text
from inkprint.functions.stats import clogc, entropy_bits, population_std, singles

VOWELS = "[aeiouy]+"
NO_VOWEL_WORD = "(?<![a-z])[^aeiouy ]++(?![a-z])"
LONG_SYLLABLE_WORD = (
    "[^aeiouy ]*+[aeiouy]++[^aeiouy ]++[aeiouy]++[^aeiouy ]++[aeiouy]++[a-z]*+"
)
LIST_START = rf"\A{text.WS}*(?:" + "|".join(lexicons.LIST_STARTERS) + ")"

# Which character, or which words, each plain ratio counts.
MARKS = {
    "comma_per_word": ",", "period_per_word": ".", "exclamation_per_word": "!",
    "question_per_word": "?", "semicolon_per_word": ";", "colon_per_word": ":",
}
LEXICON_RATIOS = {
    "function_word_ratio": lexicons.FUNCTION_WORDS, "hedge_word_ratio": lexicons.HEDGE_WORDS,
    "stopword_ratio": lexicons.STOP_WORDS,
    "personal_pronoun_ratio": lexicons.PERSONAL_PRONOUNS,
    "transition_word_density": lexicons.TRANSITION_WORDS,
}


def _hits(w: Column, lexicon) -> Column:
    return F.size(F.filter(w, lambda x: x.isin(list(lexicon))))


def _int_sum(values: Column, power: int = 1) -> Column:
    return F.aggregate(
        values, F.lit(0).cast("bigint"),
        lambda acc, x: acc + (x * x if power == 2 else x).cast("bigint"),
    )


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def with_stylometry(df: DataFrame, text_col: str = "text",
                    names=lexicons.FEATURE_NAMES) -> DataFrame:
    """Append the named feature columns (doubles) to ``df``.

    Text without a sentence (blank, or only .!?) gets zero in every feature.
    """
    kept = [F.col(c) for c in df.columns]
    c = F.col
    wanted = set(names)

    # Every layer turns arrays into numbers as early as it can: what later layers
    # do not use is pruned, so long arrays are not copied from layer to layer.
    body = F.coalesce(c(text_col), F.lit(""))
    d = df.withColumns({"_raw": body, "_low": F.lower(body)})
    d = d.withColumn("_sents", text.sentences(c("_low")))

    layer = {
        "_sent_words": F.transform("_sents", text.words),
        "_ns0": F.size("_sents"),
        "_starters": F.size(F.filter("_sents", lambda s: s.rlike(LIST_START))),
        "_raw_tokens": text.ws_tokens(c("_raw")),
        "_paras": F.size(text.paragraphs(c("_raw"))),
        "_char": text.char_bigram_counts(c("_low")),
    }
    layer |= {f"_{n}": text.count_literal(c("_raw"), ch) for n, ch in MARKS.items() if n in wanted}
    if wanted & {"ai_filler_count", "ai_filler_density"}:
        layer["_filler"] = sum(
            (text.count_literal(c("_low"), p) for p in lexicons.FILLER_PHRASES), F.lit(0.0))
    d = d.withColumns(layer)

    d = d.withColumns({
        "_w": F.flatten("_sent_words"),
        "_lens": F.transform("_sent_words", F.size),
        "_upper": F.size(F.filter("_raw_tokens", lambda x: (F.length(x) > 1)
                                  & (x == F.upper(x)) & (x != F.lower(x)))),
        "_digits": F.size(F.filter("_raw_tokens", lambda x: x.rlike(text.DIGIT))),
        "_nchar": F.aggregate("_char", F.lit(0.0), lambda acc, n: acc + n),
        "_char_clogc": clogc(c("_char")),
    })

    layer = {
        "_wlens": F.transform("_w", F.length),
        "_joined": F.array_join("_w", " "),
        "_uni": text.run_lengths(c("_w")),
        "_bi": text.run_lengths(text.word_bigrams(c("_w"))),
        "_lenruns": text.run_lengths(F.transform("_lens", lambda n: n.cast("string"))),
        "_nw0": F.size("_w"),
        "_ns": F.greatest(c("_ns0"), F.lit(1)),
        "_np": F.greatest(c("_paras"), F.lit(1)),
        "_len_max": F.array_max("_lens"),
        "_len_min": F.array_min("_lens"),
        "_len_sum": _int_sum(c("_lens")),
        "_len_sq": _int_sum(c("_lens"), 2),
    }
    layer |= {f"_{n}": _hits(c("_w"), words) for n, words in LEXICON_RATIOS.items() if n in wanted}
    d = d.withColumns(layer)

    d = d.withColumns({
        "_nw": F.greatest(c("_nw0"), F.lit(1)),
        "_nbi": F.greatest(c("_nw0") - 1, F.lit(0)),
        "_ch_sum": _int_sum(c("_wlens")),
        "_ch_sq": _int_sum(c("_wlens"), 2),
        "_long": F.size(F.filter("_wlens", lambda n: n > 6)),
        "_syll": F.regexp_count("_joined", F.lit(VOWELS))
        + F.regexp_count("_joined", F.lit(NO_VOWEL_WORD)),
        "_complex": F.regexp_count("_joined", F.lit(LONG_SYLLABLE_WORD)),
        "_avg_sent": c("_len_sum") / c("_ns"),
        "_std_sent": population_std(c("_ns0").cast("bigint"), c("_len_sum"), c("_len_sq")),
    })

    def per_word(name: str) -> Column:
        return c(name) / c("_nw")

    def words_per_sentence() -> Column:
        return c("_nw0") / c("_ns")

    values = {
        "sent_count": lambda: c("_ns"),
        "avg_sent_len_words": lambda: c("_avg_sent"),
        "std_sent_len_words": lambda: c("_std_sent"),
        "burstiness": lambda: c("_std_sent") / F.greatest(c("_avg_sent"), F.lit(1.0)),
        "max_sent_len": lambda: c("_len_max"),
        "min_sent_len": lambda: c("_len_min"),
        "word_count": lambda: c("_nw"),
        "avg_word_len_chars": lambda: per_word("_ch_sum"),
        "std_word_len_chars": lambda: population_std(
            c("_nw0").cast("bigint"), c("_ch_sum"), c("_ch_sq")),
        "unique_word_ratio": lambda: F.size("_uni") / c("_nw"),
        "hapax_ratio": lambda: singles(c("_uni")) / c("_nw"),
        "long_word_ratio": lambda: per_word("_long"),
        "vocab_size": lambda: F.size("_uni"),
        "flesch_reading_ease": lambda: _clamp(
            F.lit(206.835) - F.lit(1.015) * words_per_sentence() - F.lit(84.6) * per_word("_syll"),
            -100.0, 120.0),
        "flesch_kincaid_grade": lambda: _clamp(
            F.lit(0.39) * words_per_sentence() + F.lit(11.8) * per_word("_syll") - F.lit(15.59),
            0.0, 20.0),
        "gunning_fog": lambda: _clamp(
            F.lit(0.4) * (words_per_sentence() + F.lit(100.0) * c("_complex") / c("_nw")), 0.0, 30.0),
        "unigram_entropy": lambda: entropy_bits(clogc(c("_uni")), c("_nw0")),
        "bigram_entropy": lambda: entropy_bits(clogc(c("_bi")), c("_nbi")),
        "char_bigram_entropy": lambda: entropy_bits(c("_char_clogc"), c("_nchar")),
        "ai_filler_count": lambda: c("_filler"),
        "ai_filler_density": lambda: c("_filler") / c("_ns"),
        "list_starter_ratio": lambda: c("_starters") / c("_ns"),
        "uppercase_ratio": lambda: per_word("_upper"),
        "digit_ratio": lambda: per_word("_digits"),
        # Blank lines never split a word, so the words of all paragraphs are
        # the words of the text.
        "avg_paragraph_len": lambda: c("_nw0") / c("_np"),
        "paragraph_count": lambda: c("_np"),
        "sent_len_entropy": lambda: entropy_bits(clogc(c("_lenruns")), c("_ns")),
        "repeat_phrase_ratio": lambda: (F.size("_bi") - singles(c("_bi")))
        / F.greatest(c("_nbi"), F.lit(1)),
    }
    values |= {n: (lambda n=n: per_word(f"_{n}")) for n in (*MARKS, *LEXICON_RATIOS)}
    return d.select(*kept, *[
        F.when(c("_ns0") > 0, values[n]().cast("double")).otherwise(F.lit(0.0)).alias(n)
        for n in names
    ])
