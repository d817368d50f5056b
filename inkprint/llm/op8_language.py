"""Language identification, word first with back-off to shorter character n-grams.

A known word scores by its log frequency per language. An unseen word falls back to
its known 4-grams; if there are none to its 3-grams, 2-grams and single letters. Scores
of all words of a whole text add up.

Learning counts words and n-grams with Spark over at most about ``fit_rows`` labelled
documents of each language, chosen by a hash of the id; of ``max_words`` words and
``max_grams`` n-grams in the model every language chooses an equal share, its own most
frequent ones. A rare language is thus learnt as well as a common one, and these three
numbers bound the model whatever the size of the corpus.

A batch of texts is cut into pieces at space in Arrow; distinct pieces are scored once,
through a bounded cache, and their scores are gathered by index and added up by text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no
labelled document every text is; letters of an unknown script leave all languages equal; ties go to the language first in the alphabet; rows
with equal ids are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkprint.llm.common import rows_by_python, stage, table, tag
from inkprint.llm.words import slices

FIT_ROWS = 4_000
MAX_WORDS = 200_000
MAX_GRAMS = 100_000
LONGEST = 4
CACHED = 200_000
EVIDENCE_WORDS = 20
LETTERS = r"\p{L}+"
UNKNOWN = "und"


def fold(key: str = "doc_id", parts: int = 4):
    """The fold of a row: crc32 of its id as text; null ids are fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts, F.lit(0))


def fit(labelled: DataFrame, *, fit_rows: int = FIT_ROWS, max_words: int = MAX_WORDS,
        max_grams: int = MAX_GRAMS) -> dict:
    """Languages, and log-frequency rows by word and by n-gram, of (doc_id, text, lang)."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count("*").alias("_rows"))  # a row per language
    share = F.least(F.lit(1.0), F.lit(float(fit_rows)) / F.col("_rows"))
    chosen = rows.join(F.broadcast(counts), "lang").where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    words = stage(chosen.select("lang", F.explode(F.regexp_extract_all(
        F.lower("text"), F.lit(LETTERS), F.lit(0))).alias("word")).groupBy("lang", "word").agg(
        F.count("*").alias("n")), "language-words")
    marked = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    grams = F.flatten(F.array(*[_cut(marked, size) for size in range(1, LONGEST + 1)]))
    pieces = words.select("lang", "n", F.explode(grams).alias("word")).groupBy("lang", "word").agg(
        F.sum("n").alias("n"))
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    return {"languages": languages, "words": _table(words, languages, max_words),
            "grams": _table(pieces, languages, max_grams)}


def _cut(marked, size: int):
    """The character n-grams of one size; a word that is too short has none."""
    found = F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - size + 1, F.lit(1))),
                        lambda i: F.substring(marked, i, F.lit(size)))
    return F.filter(found, lambda g: F.length(g) == size)


def _table(counts: DataFrame, languages: list[str], most: int) -> tuple[str, np.ndarray]:
    """Log frequencies by language of each language's most frequent words; unseen pairs count half.

    Words come as one string, a line each, next to a matrix with a row per word.
    """
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    own = counts.withColumn("_place", place).where(F.col("_place") <= most // max(len(languages), 1)).select("word").distinct()
    top = stage(counts.join(own, "word").groupBy("word").agg(F.map_from_entries(
        F.collect_list(F.struct("lang", "n"))).alias("by")).orderBy("word"), "language-top")
    by = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    got = top.select("word", F.array(*[F.coalesce(F.col("by")[F.lit(x)], F.lit(0)) for x in languages]).alias(
        "n")).toArrow() if languages else None
    if got is None or not got.num_rows:
        return "", np.zeros((0, len(languages)), np.float32)
    n = np.asarray(got.column("n").combine_chunks().flatten(), np.float64).reshape(-1, len(languages))
    row = np.log((n + 0.5) / (np.array([by.get(x, 0) for x in languages], np.float64) + 0.5 * most))
    return "\n".join(got.column("word").to_pylist()), (row - row.max(1, keepdims=True)).astype(np.float32)


class Scorer:
    """Adds up the scores of a text's words, through a bounded cache of its pieces."""

    def __init__(self, model: dict):
        self.languages = model["languages"]
        (words, self.by_word), (grams, self.by_gram) = model["words"], model["grams"]
        self.words = {w: i for i, w in enumerate(words.split("\n"))} if words else {}
        self.grams = {g: i for i, g in enumerate(grams.split("\n"))} if grams else {}
        self.letters = re.compile(r"[^\W\d_]+")
        self.rows = np.zeros((CACHED + 1, len(self.languages)), np.float32)
        self.heard = np.zeros(CACHED + 1, np.int64)  # words with a letter in the piece
        self.places = _Places(self)

    def word(self, word: str) -> np.ndarray | None:
        found = self.words.get(word)
        if found is not None:
            return self.by_word[found]
        marked = f"<{word}>"
        for size in range(LONGEST, 0, -1):
            cut = marked if size > 1 else word  # the marks alone say nothing
            known = [g for i in range(len(cut) - size + 1)
                     if (g := self.grams.get(cut[i:i + size])) is not None]
            if known:
                return self.by_gram[known].mean(0)
        return None

    def __call__(self, text: str | None) -> tuple[str, float]:
        names, scores = self.batch(pa.array([text], pa.string()))
        return names[0], float(scores[0])

    def batch(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        cut = pc.utf8_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        counts = cut.value_lengths().to_numpy().astype(np.int64)
        if not self.languages or not counts.sum():
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        pieces = cut.flatten().dictionary_encode()
        places = self.places.of(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())[pieces.indices.to_numpy(zero_copy_only=False)]
        some = np.flatnonzero(counts)
        begin = (np.cumsum(counts) - counts)[some]
        heard, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)))
        heard[some] = np.add.reduceat(self.heard[places], begin)
        total[some] = np.add.reduceat(self.rows[places].astype(np.float64), begin, 0)
        best, most = total.argmax(1), total.max(1, keepdims=True)
        odds = np.exp((total - most) / np.maximum(heard, 1)[:, None] * np.minimum(heard, EVIDENCE_WORDS)[:, None])
        return ([self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), heard.tolist())],
                np.where(heard > 0, 1 / odds.sum(1), 0.0))


class _Places(dict):
    """Where a piece's score lies among the scorer's rows."""

    def __init__(self, scorer: Scorer):
        super().__init__()
        self.scorer = scorer

    def of(self, pieces: list[str]) -> np.ndarray:
        if len(self) + len(pieces) > CACHED:
            self.clear()
        if len(pieces) > CACHED:  # a text of more pieces than the cache: its words are few enough by part
            return self._long(pieces)
        return np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))

    def _long(self, pieces: list[str]) -> np.ndarray:
        known = {p: None for p in pieces}
        self.scorer.rows = np.zeros((max(CACHED, len(known)) + 1, len(self.scorer.languages)), np.float32)
        self.scorer.heard = np.zeros(len(self.scorer.rows), np.int64)
        return np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))

    def __missing__(self, piece: str) -> int:
        at = self[piece] = len(self)
        words = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in self.scorer.letters.findall(piece.lower())]
        words = list(filter(None, words))
        scores = [s for w in words if (s := self.scorer.word(w)) is not None]
        self.scorer.rows[at] = scores[0] if len(scores) == 1 else np.sum(scores, 0) if scores else 0
        self.scorer.heard[at] = len(words)
        return at


_scorers: dict[str, Scorer] = {}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    held, name = docs.sparkSession.sparkContext.broadcast(model), tag()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _scorers:  # kept by the worker for its next tasks
            _scorers.clear()
            _scorers[name] = Scorer(held.value)
        scorer = _scorers[name]
        for batch in batches:
            for row, end, _, _ in slices(batch.column("text")):
                names, scores = scorer.batch(batch.column("text").slice(row, end - row))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), pa.array(names, pa.string()), pa.array(scores)],
                    ["doc_id", "lang_pred", "score"])

    return rows_by_python(docs.select("doc_id", "text"), work, "doc_id long, lang_pred string, score double")


def op8_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learnt from the folds other than the held-out one."""
    docs = table(spark, sf, "documents")
    model = fit(docs.where(fold() != 2).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language": op8_language}
SQL = {}
