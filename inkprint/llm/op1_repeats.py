"""Substring dedup by hashing lines and the sentences in them.

A unit is a sentence: it ends with a line, or with ``.``, ``!`` or ``?`` before space.
Units are normalised (words in lower case, space left out) and hashed. Digests are
grouped over the whole corpus; the earliest document, by id, keeps its occurrence. In
all others, and from the second occurrence in one text on, a unit is a repeat. A line
whose units are all repeats is cut whatever its length, and so is a run of neighbouring
repeats of at least ``min_words`` words; a shorter run in an otherwise new line, a
``The.`` or ``And.``, is no repeat of anything and stays. A passage is found wherever it
begins, also in the middle of a line or around an edited sentence, which stays.
Neighbouring cut units make one span. Cut spans keep their places in the original text.

Every task sends a document's distinct digests only, counts combine before the
shuffle, and the join on digests can be split where one is hot. Texts move once.

Defined cases: a null or empty text has no units and comes back as it is; rows with
equal ids are one document towards others, and each is searched for repeats in itself;
null ids come last; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm.common import rows_by_python, stage, table
from inkprint.llm.words import bounds, hashes, mix, slices

MIN_WORDS = 5
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
CLEANED = ("doc_id long, n_units long, n_removed long, removed_chars long, "
           "spans array<struct<start:int,end:int>>, text string")


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each unit: digest, words, byte start and end, line; and the units' offsets by row."""
    starts, ends = bounds(data, offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, none, np.zeros(len(offsets), np.int64)
    lines = np.cumsum(data == 10)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = _ENDS[data[ends[:-1] - 1]] | (lines[starts[1:]] != lines[starts[:-1]])
    at = np.searchsorted(starts, offsets)
    fresh[at[:-1][at[:-1] < len(starts)]] = True
    first = np.flatnonzero(fresh)
    count = np.diff(np.concatenate([first, [len(starts)]]))
    place = np.arange(len(starts)) - np.repeat(first, count)
    words = hashes(data, starts, ends, True)
    digest = mix(np.add.reduceat(mix(words + mix(place.astype(np.uint64) + np.uint64(1))), first))
    return digest, count, starts[first], ends[first + count - 1], lines[starts[first]], np.searchsorted(first, at)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row = 0
        for _, end, data, offsets in slices(batch.column("text")):
            digest, *_, at = units(data, offsets)
            own = [np.unique(digest[at[i]:at[i + 1]]) for i in range(len(at) - 1)]
            ids = batch.column("doc_id").slice(row, end - row)
            keys = ids.take(pa.array(np.repeat(np.arange(len(own)), [len(o) for o in own])))
            row = end
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(own).view(np.int64))], ["doc_id", "digest"])


def _runs(repeat: np.ndarray) -> list[tuple[int, int]]:
    """First and end unit of runs of repeats."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], repeat.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def cut(repeat: np.ndarray, words: np.ndarray, line: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs to be cut: repeats in lines of nothing else, and runs with enough words."""
    _, first, of = np.unique(line, return_index=True, return_inverse=True)
    gone = np.minimum.reduceat(repeat, first)[of]
    for a, b in _runs(repeat):
        if words[a:b].sum() >= least:
            gone[a:b] = True
    return _runs(gone)


def _cutter(min_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()),
                        ("removed_chars", pa.int64()),
                        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("text", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            known, row, out = batch.column("seen"), 0, []
            for _, end, data, offsets in slices(batch.column("text")):
                digest, count, first, last, line, at = units(data, offsets)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                for i in range(end - row):
                    lo, hi = at[i], at[i + 1]
                    own, seen = digest[lo:hi], known[row + i]
                    repeat = np.ones(hi - lo, bool)
                    repeat[np.unique(own, return_index=True)[1]] = False
                    if seen.is_valid:
                        repeat |= np.isin(own, np.asarray(seen.values).view(np.uint64))
                    cuts = cut(repeat, count[lo:hi], line[lo:hi], min_words) if repeat.any() else []
                    base = chars[offsets[i]]
                    spans = [(int(chars[first[lo + a]] - base), int(chars[last[lo + b - 1]] - base)) for a, b in cuts]
                    text = texts[row + i]
                    if spans:
                        edges = [0, *[x for s in spans for x in s], len(text)]
                        text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    out.append({"doc_id": keys[row + i], "n_units": int(hi - lo),
                                "n_removed": sum(b - a for a, b in cuts), "removed_chars": sum(b - a for a, b in spans),
                                "spans": [{"start": a, "end": b} for a, b in spans], "text": text})
                row = end
            yield pa.RecordBatch.from_pylist(out, schema)

    return work


def without_repeats(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, counts, cut spans in code points, remaining text) of every document."""
    rows = docs.select("doc_id", "text")
    # A null id is later than all others.
    late = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    seen = rows_by_python(rows, _digests, "doc_id long, digest long").withColumn("id", late).drop("doc_id")
    firsts = seen.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(
        "first <> last").select("digest", "first")
    repeats = stage(seen.join(firsts, "digest").where("id > first").groupBy("id").agg(
        F.collect_set("digest").alias("seen")), "repeats-seen")
    return rows_by_python(rows.withColumn("id", late).join(repeats, "id", "left").select("doc_id", "text", "seen"),
                          _cutter(min_words), CLEANED)


def op1_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """All documents without passages that an earlier document, or their own text, has."""
    return without_repeats(table(spark, sf, "documents")).select(
        "doc_id", "n_units", "n_removed", "removed_chars", F.array_join(F.transform("spans", lambda s: F.concat_ws(
            ":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"), "text")


QUERIES = {"op1_repeats": op1_repeats}
SQL = {}
