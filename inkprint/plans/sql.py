"""Inputs shared by the registered queries, and their DuckDB twins.

Operators that never fire on the plain tables (URLs, control characters, filler
phrases...) run on the whole table with a snippet appended to each text; the
same expression, valid in both engines, appends it on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.session import spread

WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NON_WS = WS.replace("[", "[^", 1)

DIRTY = (
    "concat(text, CASE doc_id % 6"
    " WHEN 0 THEN ' see https://a.example/b?c=d and www.site.example/x'"
    " WHEN 1 THEN concat('  two', chr(9), chr(9), 'tabs nb sp ls sep ', chr(28), ' ')"
    " WHEN 2 THEN concat(chr(14), ' ctl', chr(14), 'x', chr(127))"
    " WHEN 3 THEN ' http:// www. wwwx httpsx://y'"
    " WHEN 4 THEN concat(chr(10), 'Last line ', chr(1), ' end')"
    " ELSE '' END)"
)

STYLED = (
    "concat(text, CASE doc_id % 8"
    " WHEN 0 THEN ' Moreover, you often see this; is it crucial? It is important to note: IN CONCLUSION, NASA and U.S. agree.'"
    " WHEN 1 THEN concat(chr(10), chr(10), 'Firstly I think we can. Secondary points: perhaps not!', chr(10), chr(10), 'However, my own view is of course! different; A1 B2.')"
    " WHEN 2 THEN ' As an AI, as a language model I cannot delve into it. i''m unable to; that''s a great question? Certainly! Absolutely!'"
    " WHEN 3 THEN concat(chr(10), chr(10), '  On the other hand our key, relevant and various results... therefore thus hence.', chr(10), chr(10), chr(10), chr(10), 'Yours: 12 3x ²')"
    " WHEN 4 THEN ' In today''s world, in summary, overall, furthermore, additionally, it is worth noting it plays a crucial role.  Meanwhile the the the end'"
    " WHEN 5 THEN ' It is essential. it is crucial. Dive into, to summarize, in the modern world. Third lastly finally subsequently.'"
    " WHEN 6 THEN ' café naïve x_y snake_case a1b ABC DEF ÉTÉ'"
    " ELSE '' END)"
)

LINED = (
    "concat(text, CASE WHEN doc_id % 2 = 0 THEN concat("
    "repeat(concat(chr(10), 'Plain prose line number that is long enough to be kept in the text.'), 16),"
    " chr(10), '1.2  Introduction to the whole matter at hand', chr(10), '12. Results of the second big experiment',"
    " chr(10), '[14] Author and Other. A title of a paper', chr(10), '(3) Author and Other. A title of a paper',"
    " chr(10), 'Figure 3: a caption that says something', chr(10), 'table 4 shows a caption in lower case',"
    " chr(10), 'Appendix B holds the remaining proofs', chr(10), 'Introduction ........... 4',"
    " chr(10), 'Ellipsis runs …… are leaders as well', chr(10), '123 456 789 012 345 678 901',"
    " chr(10), 'XIV  XV  XVI  IX  III  II  I', chr(10), 'A HEADING IN CAPITALS ONLY',"
    " chr(10), 'Figures of speech are kept as prose lines.', chr(10), '  1.2.3.4.5 Too deep to be a heading here',"
    " chr(10), 'nineteen chars line', chr(10), 'twenty characters li', chr(10), chr(10),"
    " repeat(concat(chr(10), 'short'), 20)) ELSE '' END)"
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, text: str = "text") -> DataFrame:
    """The documents table with its text replaced by an expression over it."""
    plain = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return spread(plain, "doc_id").withColumn("text", F.expr(text))


def h01(tag: str, key: str) -> str:
    """DuckDB: a uniform number in [0, 1) from a tag and a key."""
    return f"(CAST('0x' || substr(md5('{tag}|' || CAST({key} AS VARCHAR)), 1, 6) AS BIGINT) / 16777216.0::DOUBLE)"


def h01_col(tag: str, key: str) -> Column:
    digest = F.md5(F.concat(F.lit(f"{tag}|"), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 6), 16, 10).cast("bigint") / F.lit(16777216.0)


def r6(expr: str) -> str:
    return f"(floor(({expr})::DOUBLE * 1e6 + 0.5) / 1e6)"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN ({a})::DOUBLE / ({b})::DOUBLE ELSE 0.0 END)"


# DuckDB twin of clean_characters for text that NFKC leaves alone.
def clean_sql(expr: str) -> str:
    no_url = rf"regexp_replace({expr}, 'https?://{NON_WS}+|www\.{NON_WS}+', ' ', 'g')"
    one_space = f"trim(regexp_replace({no_url}, '{WS}+', ' ', 'g'), ' ')"
    return rf"regexp_replace({one_space}, '[\x00-\x08\x0b-\x1f\x7f]', ' ', 'g')"


def tokens_sql(expr: str) -> str:
    return f"regexp_extract_all({expr}, '{NON_WS}+')"


def words_sql(expr: str) -> str:
    return (rf"list_filter(string_split_regex(lower({expr}), '[^\p{{L}}\p{{N}}_]+'), "
            "lambda x: regexp_full_match(x, '[a-z]+'))")


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


# Conversation turns as labelled corpus rows: user 0, assistant 1.
TURNS_SQL = (
    "SELECT conv_id * 1000 + turn AS doc_id, text,"
    " CASE role WHEN 'user' THEN 0 ELSE 1 END AS label,"
    " 'part' || CAST(conv_id % 5 AS VARCHAR) AS source,"
    " CASE role WHEN 'user' THEN 'human' ELSE 'gen' || CAST(turn % 3 AS VARCHAR) END AS model"
    " FROM conversations WHERE role <> 'system'"
)


def turns(spark: SparkSession, sf: str) -> DataFrame:
    human = F.col("role") == "user"
    return table(spark, sf, "conversations").where(F.col("role") != "system").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text",
        F.when(human, 0).otherwise(1).alias("label"),
        F.concat(F.lit("part"), (F.col("conv_id") % 5).cast("string")).alias("source"),
        F.when(human, "human").otherwise(
            F.concat(F.lit("gen"), (F.col("turn") % 3).cast("string"))).alias("model"))


# A label and four scores per document, from digests of its id; two of the
# scores sit on a coarse grid so that ties occur.
SIGNALS = ("semantic", "stylometric", "ratio", "formality")


def scored_sql() -> str:
    y = f"CAST(floor({h01('y', 'doc_id')} * 2) AS INTEGER)"
    return (
        f"SELECT doc_id, label, (label + 2 * {h01('s0', 'doc_id')}) / 3 AS semantic,"
        f" floor((label + 3 * {h01('s1', 'doc_id')}) / 4 * 100) / 100 AS stylometric,"
        f" {h01('s2', 'doc_id')} AS ratio,"
        f" floor((0.5 * label + {h01('s3', 'doc_id')}) / 1.5 * 20) / 20 AS formality"
        f" FROM (SELECT doc_id, {y} AS label FROM documents)"
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id").withColumn(
        "label", F.floor(h01_col("y", "doc_id") * 2).cast("int"))
    y = F.col("label")
    return d.select(
        "doc_id", "label",
        ((y + 2 * h01_col("s0", "doc_id")) / 3).alias("semantic"),
        (F.floor((y + 3 * h01_col("s1", "doc_id")) / 4 * 100) / 100).alias("stylometric"),
        h01_col("s2", "doc_id").alias("ratio"),
        (F.floor((0.5 * y + h01_col("s3", "doc_id")) / 1.5 * 20) / 20).alias("formality"))


LONG_SQL = (
    f"SELECT doc_id, label, signal, score FROM (UNPIVOT ({scored_sql()}) "
    f"ON {', '.join(SIGNALS)} INTO NAME signal VALUE score)"
)
