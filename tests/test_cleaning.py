from pyspark.sql import functions as F

from inkprint.operators import cleaning


def words(n, distinct=None):
    return " ".join(f"w{i % (distinct or n)}" for i in range(n))


def kept(spark, texts, **kw):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r["doc_id"] for r in cleaning.cleaned(d, **kw).orderBy("doc_id").collect()]


def test_word_bounds_are_inclusive(spark):
    assert kept(spark, [words(n) for n in (49, 50, 512, 513)]) == [1, 2]


def test_unique_ratio_edge(spark):
    assert kept(spark, [words(100, 20), words(100, 19)]) == [0]


def test_unknown_language_is_kept(spark):
    d = [(0, words(60), "en"), (1, words(60), "fr"), (2, words(60), None)]
    df = spark.createDataFrame(d, "doc_id int, text string, lang string")
    got = cleaning.cleaned(df, speaks_english=F.col("lang") == "en")
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 2]


def test_funnel_names_the_first_failure(spark):
    rows = [(None, "en"), (" ", "en"), (words(3), "fr"), (words(3), "en"), (words(100, 5), "en"), (words(60), "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = cleaning.with_rejection(df, speaks_english=F.col("lang") == "en").select("reason").collect()
    assert [r[0] for r in got] == ["blank", "blank", "language", "word_count", "repetition", "kept"]


def test_cleaning_runs_once_in_the_plan(spark):
    df = spark.createDataFrame([(words(60),)], "text string")
    plan = cleaning.cleaned(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("compose") == 1 and "Exchange" not in plan


LINES = {
    "1.2  Introduction to the matter": False, "12. Results of the experiment": False,
    "123. Results of the experiment": True, "[14] Author, A. Title of it": False,
    "(3) Author, A. Title of the text": False, "Figure 3: what is shown here": False,
    "FIG. 3 what is shown in here": False, "Tablecloths are not captions.": True,
    "Introduction ........... 4": False, "Wait.. what is this about?": True,
    "Ellipsis …… is a leader as well": False, "123 456 789 012 345 678": False,
    "XIV – XV — XVI ii iii iv vx": False, "A HEADING IN CAPITALS-ONLY": False,
    "A HEADING With one small word": True, "nineteen chars line": False,
    "twenty characters li": True, "1.2.3.4.5 Too deep to be one": True, "": False,
}


def test_structure_lines(spark):
    d = spark.createDataFrame([("\n".join(f"  {s} " for s in LINES),)], "t string")
    got = d.select(cleaning.without_structure(F.col("t"))).first()[0]
    assert got == " ".join(s for s, keep in LINES.items() if keep)


def gate(spark, text):
    d = spark.createDataFrame([(text,)], "text string")
    return cleaning.scorable_text(d).first()


def test_long_document_gate(spark):
    prose = "\n".join(words(10).replace("w", "word") for _ in range(10))
    for extra, stripped in ((21, False), (22, True)):
        got = gate(spark, prose + "\n" + "\n".join(["xy"] * extra))
        assert (got["prose"] != got["shown_text"]) == stripped
    short = "\n".join([words(99).replace("w", "word")] + ["xy"] * 40)
    got = gate(spark, short)
    assert got["prose"] == got["shown_text"]


def test_minimum_words(spark):
    assert [gate(spark, words(n))["too_short"] for n in (19, 20)] == [True, False]


def test_extracted_text_keeps_line_breaks(spark):
    d = spark.createDataFrame([("  a \t  b\né\x07c\r\nd  ",)], "t string")
    assert d.select(cleaning.extracted_text(F.col("t"))).first()[0] == "a b\n  c \nd"


def test_extraction_touches_only_runs_that_change(spark):
    """Lone spaces are no match of the collapse; ends are trimmed without a search through the text."""
    texts = ["a b", " a  b ", "a\tb", "a \t b", "\n a\n\nb \n", "a　 b", "é a", "", "​"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    column = cleaning.extracted_text(F.col("t"))
    got = [r[0] for r in d.orderBy("i").select(column).collect()]
    assert got == ["a b", "a b", "a b", "a b", "a\n\nb", "a b", "a", "", ""]
    assert r"\x20[" in d.select(column)._jdf.queryExecution().optimizedPlan().toString()


def test_structure_rules_are_those_of_the_table(spark):
    rows = [("1.2  A heading of the document",), ("see 1.2 A heading, not at the start",), ("Some words ... and a leader",),
            ("Some words …… and a leader",), ("Some words .. and no leader",), ("A HEADING IN CAPITALS ONLY",), ("Figure 3 is a long caption",)]
    d = spark.createDataFrame(rows, "t string")
    one = F.col("t").rlike("|".join(cleaning.STRUCTURE_LINES.values()))
    assert d.where(cleaning.is_structure(F.col("t")) != one).count() == 0 and d.where(one).count() == 5
    assert cleaning._AT_START.startswith(r"\A(?:")  # tried once a line
