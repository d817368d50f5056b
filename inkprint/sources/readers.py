"""Readers: each turns one kind of source into (doc_id, text, label, source, model).

``doc_id`` follows file and row order within a source. Text arrives uncleaned
unless said otherwise; ``operators.cleaning.cleaned`` finishes the job.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprint.functions import text
from inkprint.operators.corpus import fill_quota, union_sources
from inkprint.sources import probe
from inkprint.session import materialise

log = logging.getLogger(__name__)

CORPUS_SCHEMA = "doc_id bigint, text string, label int, source string, model string"
# Accepted names of the text column, compared in lower case.
TEXT_COLUMNS = ("generation", "text", "content")


def _corpus_rows(df: DataFrame, body: Column, label: Column, source: str,
                 model: Column) -> DataFrame:
    return df.select(
        F.monotonically_increasing_id().alias("doc_id"), body.alias("text"),
        label.cast("int").alias("label"), F.lit(source).alias("source"),
        model.alias("model"))


def empty_corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CORPUS_SCHEMA)


def or_empty(read, spark: SparkSession, what: str) -> DataFrame:
    """The frame, or an empty corpus where the source is not there."""
    try:
        return read()
    except AnalysisException as e:
        log.warning("%s skipped: %s", what, str(e).split("\n")[0])
        return empty_corpus(spark)


def qa_pairs(spark: SparkSession, path, source: str = "qa_pairs",
             machine: str = "chatgpt") -> DataFrame:
    """JSON lines with human and machine answer lists; undecodable lines drop.

    Both lists leave the record in one pass over it.
    """
    files = probe.sound_paths(spark, path, source, "*.{json,jsonl,json.gz,jsonl.gz}")
    if not files:
        return empty_corpus(spark)
    raw = (spark.read.schema("human_answers array<string>, chatgpt_answers array<string>")
           .option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).json(files))

    def side(col, label, model):
        answers = F.coalesce(F.col(col), F.array().cast("array<string>"))
        return F.transform(answers, lambda a: F.struct(
            a.alias("text"), F.lit(label).alias("label"), F.lit(model).alias("model")))

    rows = raw.select(F.inline(F.concat(
        side("human_answers", 0, "human"), side("chatgpt_answers", 1, machine))))
    return _corpus_rows(rows, F.col("text"), F.col("label"), source, F.col("model"))


def detect_columns(columns) -> tuple[str | None, str | None]:
    """First text-like column in file order, and the model column if any."""
    named = {c.lower(): c for c in reversed(columns)}
    body = next((c for c in columns if c.lower() in TEXT_COLUMNS), None)
    return body, named.get("model")


def label_of_model(model: Column) -> Column:
    return F.when(F.lower(F.trim(model)) == "human", 0).otherwise(1)


def multi_generator(spark: SparkSession, paths: list[str],
                    source: str = "multi_generator") -> DataFrame:
    """Parquet then CSV files whose text and model columns are found by name.

    Footers and headers are read in tasks. Files in which the same columns matter are one
    group and one scan, however many they are. A file that cannot be read, or has no text
    column, is logged and skipped; ``probe.probe`` gives the whole table of files.
    """
    files = probe.sound(probe.probe(spark, paths), source).where(F.col("kind").isin("parquet", "csv"))
    # A CSV scan needs all names of the header; a Parquet scan reads the two columns.
    groups = files.groupBy("kind", "columns", "types").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    scans: dict[tuple, list[str]] = {}
    for g in sorted(groups, key=lambda g: (g["kind"] == "csv", g["columns"], g["types"])):
        body, model = detect_columns(g["columns"])
        kinds = dict(zip(g["columns"], g["types"]))
        if body is None or "other" in (kinds[body], kinds.get(model)):
            log.warning("%d files skipped, %s the first: no column of text in %s", len(g["paths"]), g["paths"][0], g["columns"])
            continue
        header = tuple(g["columns"]) if g["kind"] == "csv" else ()
        wanted = tuple((c, kinds[c]) for c in (body, model) if c)
        scans.setdefault((g["kind"], body, model, wanted, header), []).extend(g["paths"])
    frames = []
    for (kind, body, model, wanted, _), named in scans.items():
        reader = spark.read.option("ignoreCorruptFiles", True)
        if kind == "csv":
            raw = reader.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(named)
        else:
            raw = reader.schema(", ".join(f"`{c}` {t}" for c, t in wanted)).parquet(*named)
        name = F.trim(F.coalesce(F.col(f"`{model}`").cast("string"), F.lit("None"))) if model else F.lit("unknown")
        frames.append(_corpus_rows(raw, F.col(f"`{body}`").cast("string"), label_of_model(name), source, name))
    if not frames:
        return empty_corpus(spark)
    ranked = union_sources(frames)
    # Ids of different scans must not meet: 2^23 partitions of each have room.
    if len(frames) > MAX_SCANS:
        raise ValueError(f"more than {MAX_SCANS} kinds of files; read them as several sources")
    span = F.col("source_rank") * F.lit(1 << 56)
    return ranked.withColumn("doc_id", F.col("doc_id") + span).drop("source_rank")


RUN_ROWS = 4_096
MAX_SCANS = 127


def first_rows_per_file(spark: SparkSession, path: str, keep: Column, limit: int) -> DataFrame:
    """The first ``limit`` matching rows of each Parquet file, in file order.

    Counts per run of rows say where each file's cut lies; only that run's row
    numbers are ranked. The cut is then a comparison, so no task gets a file.
    """
    raw = spark.read.parquet(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = raw.where(keep)
    places = rows.select("_file", "_row", F.floor(F.col("_row") / RUN_ROWS).alias("_run"))
    upto = Window.partitionBy("_file").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = places.groupBy("_file", "_run").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    cut = runs.where((F.col("_before") < limit) & (F.col("_before") + F.col("_n") >= limit))
    inside = Window.partitionBy("_file").orderBy("_row")
    last = places.join(cut.select("_file", "_run", "_before"), ["_file", "_run"]).withColumn(
        "_rank", F.row_number().over(inside)).where(F.col("_rank") + F.col("_before") == limit).select(
        "_file", F.col("_row").alias("_last"))
    return rows.join(last, "_file", "left").where(
        F.col("_last").isNull() | (F.col("_row") <= F.col("_last"))).drop("_file", "_row", "_last")


def conversation_text(df: DataFrame, col: str = "conversation", role: str | None = "assistant",
                      ) -> Column:
    """Text of the first turn by ``role``, or of the first turn for None.

    The column may hold structs, plain strings, or either encoded as JSON.
    """
    kind = df.schema[col].dataType
    struct = "array<struct<role:string,content:string>>"
    if isinstance(kind, T.StringType):
        turns = F.from_json(col, struct)
        plain = F.from_json(col, "array<string>")
    elif isinstance(kind.elementType, T.StructType):
        turns, plain = F.col(col), None
    else:
        turns, plain = None, F.col(col).cast("array<string>")
    first_plain = F.try_element_at(plain, F.lit(1)) if plain is not None else F.lit(None)
    if turns is None:
        return first_plain
    wanted = turns if role is None else F.filter(turns, lambda t: t["role"] == role)
    said = F.try_element_at(wanted, F.lit(1))["content"]
    return said if plain is None else F.coalesce(
        said, F.when(F.try_element_at(turns, F.lit(1)).isNull(), first_plain))


def chat_log(spark: SparkSession, path: str, model: str = "gpt-4", limit: int = 15_000,
             role: str | None = "assistant", source: str = "chat_log") -> DataFrame:
    """Replies of one model, from at most ``limit`` matching rows per file."""
    raw = first_rows_per_file(spark, path, F.col("model") == model, limit)
    return _corpus_rows(raw, conversation_text(raw, role=role), F.lit(1), source, F.lit(model))


def last_reply(chosen: Column, marker: str = "Assistant:") -> Column:
    """Text after the last marker; null when there is none."""
    return F.when(F.contains(chosen, F.lit(marker)),
                  text.strip(F.substring_index(chosen, marker, -1)))


def transcripts(spark: SparkSession, path, source: str = "transcripts",
                model: str = "claude") -> DataFrame:
    """Last assistant reply of each transcript; plain or gzipped JSON lines."""
    files = probe.sound_paths(spark, path, source)
    if not files:
        return empty_corpus(spark)
    raw = (spark.read.schema("chosen string").option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).json(files)
           .withColumn("reply", last_reply(F.col("chosen"))).where(F.col("reply").isNotNull()))
    return _corpus_rows(raw, F.col("reply"), F.lit(1), source, F.lit(model))


def first_paragraph(c: Column, min_words: int) -> Column:
    """First blank-line-separated paragraph with enough words, else null."""
    long = F.filter(F.split(c, r"\n\n"), lambda p: text.word_count(p) >= min_words)
    return text.strip(F.try_element_at(long, F.lit(1)))


def human_source(df: DataFrame, body: Column, source: str, target: int,
                 id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """Human rows from ``body`` up to a target, chosen by digest order."""
    rows = df.select(F.col(id_col).alias("doc_id"), body.alias("text"),
                     F.lit(0).alias("label"), F.lit(source).alias("source"),
                     F.lit("human").alias("model"), F.lit(0).cast("bigint").alias("source_rank"))
    # Written before the null test, which would otherwise evaluate the body twice.
    candidates = materialise(rows, source).where(F.col("text").isNotNull())
    return fill_quota(candidates, target, seed=seed, groups=[0]).drop("source_rank")


def genre_rows(df: DataFrame, body: Column, label: int, min_words: int,
               max_words: int | None = None, id_col: str = "doc_id",
               max_chars: int = 1_500) -> DataFrame:
    """Genre rows within word bounds, cut to the character cap."""
    n = text.word_count(F.col("text"))
    rows = df.select(F.col(id_col).alias("doc_id"), text.strip(body).alias("text"))
    rows = rows.where(n >= min_words) if max_words is None else rows.where(
        n.between(min_words, max_words))
    return rows.select("doc_id", F.substring("text", 1, max_chars).alias("text"),
                       F.lit(label).alias("label"))


def with_fallbacks(frames: list[DataFrame], quota: int, seed: int = 42,
                   groups: list | None = None) -> DataFrame:
    """Rows from the frames in order until each class has its quota.

    Rows of a later frame come in only as far as earlier ones fall short. The
    candidates are written once: ranking them reads ids, not text.
    """
    candidates = materialise(union_sources(frames), "candidates")
    return fill_quota(candidates, quota, seed=seed, groups=groups)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file; bytes that are not UTF-8 are dropped.

    ``status`` reports empty files instead of failing on them.
    """
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), "value")
    body = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(
        F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit("")))
    rows = raw.select("path", body.alias("text"))
    return rows.withColumn("status", F.when(text.is_blank(F.col("text")), "empty").otherwise("ok"))


# Fixed pattern: elements whose text is not content.
SKIPPED_TAGS = "script|style|nav|footer|header"
# Attributes of a tag: a quoted value may hold ``>``; quotes elsewhere are plain characters.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""
# Pieces of a page from left to right: comment, raw element, start tag, other markup, a tag that never ends, text.
_PIECE = (rf"<!--(?s:.*?)-->|(?is:<(script|style)(?:[\s/]{_ATTRIBUTES})?>.*?(?:</\1\s*>|\z))|<[a-zA-Z]{_ATTRIBUTES}>|<[/!?][^>]*+>"
          r"|<[a-zA-Z/!?][^>]*+\z|[^<]++|<")


def page_text(html: Column) -> Column:
    """Visible text of a stored page, whitespace collapsed.

    One scan cuts the page into pieces; a tag, with its quoted values, or a comment is one piece,
    and so is a script or style with its raw text. Tags that open a skipped element become
    one mark, tags that close any skipped element another, and the text after an opening mark
    goes up to the next closing one. Entities are read last.
    """
    opens = rf"(?i)^<(?:{SKIPPED_TAGS})[\s/>]"
    closes = rf"(?i)^</(?:{SKIPPED_TAGS})\s*>"
    plain = F.translate(html, "\x01\x02", "")
    pieces = F.transform(F.regexp_extract_all(plain, F.lit(_PIECE), F.lit(0)), lambda t: F.when(
        ~t.startswith("<"), t).when(t.rlike(r"(?i)^<(?:script|style)[\s/>]"), "\x01\x02").when(t.rlike(opens), "\x01")
        .when(t.rlike(closes), "\x02").when(t == "<", t).otherwise(" "))
    c = F.regexp_replace(F.array_join(pieces, ""), r"\x01[^\x02]*+(?:\x02|\z)|\x02", " ")
    c = F.when(F.contains(c, F.lit("&")), F.java_method(
        F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), c)).otherwise(c)
    return text.collapse_whitespace(c)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; partition pruning leaves the other folders unread."""
    return spark.read.parquet(path).where(F.col("split") == split)
