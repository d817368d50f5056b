"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, runs of space as one blank, digits as 0) and
hashed. Per host, a line's distinct documents are counted; exact copies of a text
count as one document, so a copied page doesn't turn its own lines into boilerplate.
Lines of more documents than ``min_docs`` and than ``max_share`` of the host's documents,
or than ``max_docs`` where the host is large, are removed: the number of documents that
make a line boilerplate doesn't grow with the host. A document left with too few words
is rejected.

Text is read once. What goes on from there is narrow: digests and counts. Counting
combines before each shuffle, and the join of lines with frequent lines can be split
where a line is hot.

Defined cases: a null or empty text has no words and fails the base rules; a null
host is the host with the empty name; repeated rows and equal or null ids are rows
of their own; an empty table gives no rows; columns that aren't needed are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm.common import filled, numbered, stage, table

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_DOCS = 20
MAX_SHARE = 0.10
MAX_DOCS = 200
MIN_WORDS = 20
MIN_LEFT = 0.3


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def repeated_words(tokens: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that the array holds twice or more.

    Windows are compared by 64-bit hashes. Only if two are equal are they sorted with
    their places; the places of equal neighbours then cover their words.
    """
    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, start, lambda a, p: F.struct(
            (a["n"] + p + F.lit(width) - F.greatest(a["end"], p)).cast("bigint").alias("n"),
            (p + F.lit(width)).alias("end")))["n"]

    def places(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bind(ranked, lambda s: F.sort_array(F.transform(F.filter(
            s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False))
            | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))), lambda e: e["i"])))

    def count(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - width),
                              lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(width)]))
        return bind(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(places(w)))
                    .otherwise(F.lit(0).cast("bigint")))

    return F.when(F.size(tokens) > width, bind(F.transform(tokens, lambda t: F.xxhash64(t)), count)).otherwise(
        F.lit(0).cast("bigint"))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), SPACES, " "), "[0-9]", "0"))


def measured(docs: DataFrame, host: str = "source", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: base counts, and place, digest and words of its lines."""
    body = docs.select(*keep, F.coalesce(F.col(host), F.lit("")).alias("_host"), filled(text).alias("_text"))
    body = body.withColumn("_row", F.monotonically_increasing_id())
    body = body.withColumn("_words", words(F.col("_text"))).withColumn("_lines", F.filter(
        F.transform(F.split("_text", "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line"))),
        lambda x: F.rlike(x["line"], F.lit(WORD))))
    return body.select(
        *keep, "_host", "_row",
        F.xxhash64("_text").alias("_same"),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct(F.col("_lines.line")))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.transform("_lines", lambda x: F.struct(
            x["at"].alias("at"), F.unhex(F.md5(normalised(x["line"]))).alias("digest"),
            F.regexp_count(x["line"], F.lit(WORD)).alias("words"))).alias("_lines"))


def frequent_lines(rows: DataFrame, min_docs: int, max_share: float, max_docs: int) -> DataFrame:
    """(_host, digest, docs) of lines in too many distinct documents of their host."""
    hosts = rows.select("_host", "_same").distinct().groupBy("_host").agg(F.count("*").alias("_all"))
    seen = rows.select("_host", "_same", F.explode("_lines.digest").alias("digest")).distinct()
    return seen.groupBy("_host", "digest").agg(F.count("*").alias("docs")).where(
        F.col("docs") > min_docs).join(hosts, "_host").where(
        F.col("docs") > F.least(F.col("_all") * max_share, F.lit(float(max_docs)))).select("_host", "digest", "docs")


def line_frequency(docs: DataFrame, *, host: str = "source", text: str = "text",
                   keep: tuple[str, ...] = ("doc_id",), min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS,
                   min_words: int = MIN_WORDS, min_left: float = MIN_LEFT) -> DataFrame:
    """Base counts, places of removed lines, and the verdict, a row per document.

    ``removed`` lists the 0-based places of removed lines among the \\n-split lines.
    """
    rows = stage(measured(docs, host, text, keep), "line-counts")
    hot = frequent_lines(rows, min_docs, max_share, max_docs)
    lines = rows.select("_row", "_host", F.explode("_lines").alias("line")).select(
        "_row", "_host", F.col("line.at").alias("at"), F.col("line.digest").alias("digest"),
        F.col("line.words").alias("words"))
    gone = lines.join(hot, ["_host", "digest"]).groupBy("_row").agg(
        F.sum("words").alias("_gone"), F.sort_array(F.collect_list("at")).alias("removed"))
    n = F.col("n_words")
    return rows.drop("_same", "_lines").join(gone, "_row", "left").withColumn(
        "n_removed_words", F.coalesce("_gone", F.lit(0)).cast("long")).withColumn(
        "removed", F.coalesce("removed", F.array().cast("array<int>"))).withColumn(
        "base_failed", (n < min_words) | (F.col("n_repeat_words") * 100 > n * 30)).withColumn(
        "kept", ~F.col("base_failed") & (n - F.col("n_removed_words") >= min_words)
        & (n - F.col("n_removed_words") >= n * min_left)).drop("_gone", "_host", "_row")


def cleaned(docs: DataFrame, *, host: str = "source", text: str = "text", **limits) -> DataFrame:
    """``docs`` without rejected documents and without frequent lines, columns as they were.

    Rows get a number in a written copy, so that equal ids stay apart.
    """
    rows = numbered(docs, "line-texts")
    verdict = line_frequency(rows.select("_at", F.col(f"_doc.{host}").alias("host"), F.col(f"_doc.{text}").alias("text")),
                             host="host", text="text", keep=("_at",), **limits).where("kept").select("_at", "removed")
    lines = F.transform(F.split(F.col(f"_doc.{text}"), "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("i")))
    left = F.array_join(F.transform(F.filter(lines, lambda x: ~F.array_contains(F.col("removed"), x["i"])),
                                    lambda x: x["line"]), "\n")
    return rows.join(verdict, "_at").select(*[
        F.when(F.size("removed") > 0, left).otherwise(F.col(f"_doc.{c}")).alias(c) if c == text
        else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def op5_line_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return line_frequency(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "n_removed_words", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


QUERIES = {"op5_line_frequency": op5_line_frequency}
SQL = {"op5_line_frequency": r"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10))))),
            lambda l: regexp_matches(l[1], '[^\x20\x09-\x0D]')) AS lines FROM d),
    win AS (SELECT doc_id, i, list_slice(words, i, i + 7) AS g FROM (
        SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1),
    l AS (SELECT doc_id, host, text, l[1] AS line, l[2] AS place, regexp_replace(trim(
        regexp_replace(lower(l[1]), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[0-9]', '0', 'g') AS norm
        FROM (SELECT doc_id, host, text, unnest(lines) AS l FROM w)),
    hot AS (SELECT f.host, norm FROM (SELECT host, norm, count(DISTINCT text) AS n FROM l GROUP BY 1, 2) f
        JOIN (SELECT host, count(DISTINCT text) AS n FROM d GROUP BY 1) h ON f.host = h.host
        WHERE f.n > 20 AND f.n > least(0.1 * h.n, 200)),
    gone AS (SELECT doc_id, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS n,
        string_agg(place::VARCHAR, ',' ORDER BY place) AS removed
        FROM l JOIN hot USING (host, norm) GROUP BY 1),
    b AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(list_transform(lines, lambda x: x[1]))))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words,
        coalesce(removed, '') AS removed_lines
        FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed_words >= 20
        AND n_words - n_removed_words >= 0.3 * n_words AS kept FROM b"""}
