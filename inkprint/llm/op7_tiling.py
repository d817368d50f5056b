"""Benchmark decontamination by greedy string tiling.

Texts and test items are read as lower-case words without ASCII punctuation. Runs of
``seed_words`` words shared by a document and an item are found by comparing
Karp-Rabin hashes; equal hashes along a diagonal make maximal matches. The longest match
whose words are unmarked on both sides is marked, again and again; matches that a mark
cuts go on with what is left of them while it is long enough. The share of an item's
words under marks, its coverage, doesn't depend on the order of passages, so shuffled
copies are caught as well.

Items are the queries. They are written in blocks of bounded size, in the order of their
ids, and every document meets every block: tasks read their block from the shared
folder, documents are never shuffled, and a block's matches are written before the next
pass begins, so neither the driver nor the plan grows with the items.

An item shorter than a seed is looked up whole, in texts of any length, if it has
``short_words`` words; with fewer it is no evidence inside a longer text and matches
only texts that consist of just its words.

Defined cases: a null or empty text or item has no words and no match; a null item_id is
matched like any other and returned as null; rows with equal ids are matched one by one; ties between matches go to the earlier place in the item,
then in the text; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm.common import filled, folder, numbered, rows_by_python, running_start, stage, table
from inkprint.llm.files import place
from inkprint.llm.words import bounds, hashes, shingle_hashes, slices

SEED_WORDS = 5
COVERAGE = 0.5
BLOCK_WORDS = 500_000
SHORT_WORDS = 3
PAIRS = ("doc_id long, item_id long, matched_words long, item_words long, coverage double, tiles int, "
         "longest int, spans array<struct<start:int,end:int>>")

# Letters and digits stay; every other ASCII byte separates words.
_PLAIN = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]:
    _PLAIN[_b] = _b


def plain_words(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(word hashes, word offsets by row, bytes, starts, ends, byte offsets) for runs of texts."""
    for _, _, data, offsets in slices(texts):
        plain = _PLAIN[data]
        starts, ends = bounds(plain, offsets)
        yield hashes(plain, starts, ends, True), np.searchsorted(starts, offsets), data, starts, ends, offsets


def matches(doc: np.ndarray, item: np.ndarray, seeds: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, place in the item, place in the text), from equal seed hashes.

    ``seeds`` are the places in the text whose seeds some item holds.
    """
    own, _ = shingle_hashes(item, np.array([0, len(item)]), k)
    there, _ = shingle_hashes(doc, np.array([0, len(doc)]), k)
    order = np.argsort(own, kind="stable")
    low = np.searchsorted(own[order], there[seeds], "left")
    many = np.searchsorted(own[order], there[seeds], "right") - low
    i = np.repeat(seeds, many)
    j = order[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    sort = np.lexsort((i, i - j))
    i, j = i[sort], j[sort]
    if not len(i):
        return []
    fresh = np.concatenate([[True], (np.diff(i) != 1) | (np.diff(i - j) != 0)])
    first = np.flatnonzero(fresh)
    runs = np.diff(np.concatenate([first, [len(i)]])) + min(k, len(item)) - 1
    return list(zip(runs.tolist(), j[first].tolist(), i[first].tolist()))


def tile(found: list[tuple[int, int, int]], item_words: int, doc_words: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in the item, place in the text): the longest unmarked match first."""
    heap = [(-n, j, i) for n, j, i in found]
    heapq.heapify(heap)
    in_item, in_doc, tiles = np.zeros(item_words, bool), np.zeros(doc_words, bool), []
    while heap:
        n, j, i = heapq.heappop(heap)
        n = -n
        free = ~(in_item[j:j + n] | in_doc[i:i + n])
        if free.all():
            in_item[j:j + n] = True
            in_doc[i:i + n] = True
            tiles.append((n, j, i))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= least:
                heapq.heappush(heap, (-(b - a), j + a, i + a))
    return tiles


class Block:
    """Items with an index of their seeds."""

    def __init__(self, ids: list, texts: list | pa.Array, k: int, short: int | None = None):
        self.ids, self.k, self.items = ids, k, []
        short = k if short is None else short
        for words, at, *_ in plain_words(pa.array(texts, pa.string()) if isinstance(texts, list) else texts):
            self.items += [words[at[i]:at[i + 1]] for i in range(len(at) - 1)]
        brief: dict[int, dict[int, list[int]]] = {}  # by length, then by hash of the whole item
        for o, w in enumerate(self.items):
            if short <= len(w) < k:
                whole = int(shingle_hashes(w, np.array([0, len(w)]), len(w))[0][0])
                brief.setdefault(len(w), {}).setdefault(whole, []).append(o)
        self.brief = {n: (np.array(sorted(held), np.uint64), held) for n, held in brief.items()}
        seeds = [np.zeros(0, np.uint64) if short <= len(w) < k else shingle_hashes(w, np.array([0, len(w)]), k)[0]
                 for w in self.items]
        own = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        every = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.seeds, self.owner = every[order], own[order]
        self.maybe = np.zeros(1 << 20, bool)  # most places are settled by one look-up
        self.maybe[(self.seeds >> np.uint64(44)).astype(np.int64)] = True

    def places(self, shingles: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.maybe[(shingles >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.seeds):
            return at[:0]
        found = np.minimum(np.searchsorted(self.seeds, shingles[at]), len(self.seeds) - 1)
        return at[self.seeds[found] == shingles[at]]

    def whole(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, list]]:
        """(row, item, its one tile) of short items that a row of ``words`` holds, at their first place."""
        for n, (hashes_, held) in self.brief.items():
            shingles, sat = shingle_hashes(words, at, n)
            hits = np.flatnonzero(np.isin(shingles, hashes_))
            rows = np.searchsorted(sat, hits, "right") - 1
            seen = set()
            for hit, row in zip(hits.tolist(), rows.tolist()):
                if at[row + 1] - at[row] < n:
                    continue  # a text of fewer words is one hash of another length
                for o in held[int(shingles[hit])]:
                    if (row, o) not in seen:
                        seen.add((row, o))
                        yield row, o, [(n, 0, hit - int(sat[row]))]

    def pairs(self, doc: np.ndarray, shingles: np.ndarray, seeds: np.ndarray) -> Iterator[tuple[int, list]]:
        low = np.searchsorted(self.seeds, shingles[seeds], "left")
        high = np.searchsorted(self.seeds, shingles[seeds], "right")
        many = high - low
        owners = self.owner[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        for o in np.unique(owners).tolist():
            item = self.items[o]
            least = min(self.k, len(item))
            tiles = tile(matches(doc, item, seeds, self.k), len(item), len(doc), least)
            yield o, tiles


def tiled(docs: DataFrame, items: DataFrame, *, seed_words: int = SEED_WORDS, coverage: float = COVERAGE,
          block_words: int = BLOCK_WORDS, short_words: int = SHORT_WORDS) -> DataFrame:
    """A row per (document, item) whose coverage reaches the threshold, with spans in bytes of the text."""
    spark = docs.sparkSession
    rows = items.select("item_id", filled().alias("text"))
    sized = stage(running_start(rows.withColumn("words", F.size(F.split("text", r"\s+")).cast("long")),
                                ["item_id", "text"], "words", "tiling-items").withColumn(
        "block", F.floor(F.col("start") / block_words)), "tiling-blocks")
    found = folder(spark, "tiling-pairs")
    blocks = [r["block"] for r in sized.select("block").distinct().orderBy("block").toLocalIterator()]
    for number in blocks:
        path = folder(spark, "tiling-block")
        sized.where(F.col("block") == number).select("item_id", "text").orderBy("item_id", "text").write.parquet(path)
        _against(docs, path, seed_words, coverage, short_words).write.mode("append").parquet(found)
    return spark.read.schema(PAIRS).parquet(found) if blocks else spark.createDataFrame([], PAIRS)


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched_words", pa.int64()),
                    ("item_words", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32()),
                    ("longest", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
_blocks: dict[tuple, Block] = {}


def _opened(path: str, k: int, short: int) -> Block:
    """The block of a written table, kept by the worker for its next tasks."""
    if (path, k, short) not in _blocks:
        _blocks.clear()
        store, at = place(path)
        rows = pq.read_table(at, filesystem=store).combine_chunks()
        _blocks[path, k, short] = Block(rows.column("item_id").to_pylist(), rows.column("text").combine_chunks(), k, short)
    return _blocks[path, k, short]


def _against(docs: DataFrame, path: str, k: int, coverage: float, short: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _opened(path, k, short)
        for batch in batches:
            keys, row, out = batch.column("doc_id").to_pylist(), 0, []
            for words, at, _, starts, ends, offsets in plain_words(batch.column("text")):
                def put(d: int, o: int, tiles: list) -> None:
                    n, covered = len(block.items[o]), sum(t[0] for t in tiles)
                    if covered and covered >= coverage * n:
                        spans = sorted((int(starts[at[d] + i] - offsets[d]), int(ends[at[d] + i + m - 1] - offsets[d]))
                                       for m, _, i in tiles)
                        out.append({"doc_id": keys[row + d], "item_id": block.ids[o], "matched_words": covered,
                                    "item_words": n, "coverage": covered / n, "tiles": len(tiles),
                                    "longest": max(t[0] for t in tiles),
                                    "spans": [{"start": a, "end": b} for a, b in spans]})

                shingles, sat = shingle_hashes(words, at, k)
                hits = block.places(shingles)
                for d in np.unique(np.searchsorted(sat, hits, "right") - 1).tolist():
                    own = hits[(hits >= sat[d]) & (hits < sat[d + 1])] - sat[d]
                    for o, tiles in block.pairs(words[at[d]:at[d + 1]], shingles[sat[d]:sat[d + 1]], own):
                        put(d, o, tiles)
                for d, o, tiles in block.whole(words, at):
                    put(d, o, tiles)
                row += len(at) - 1
            if out:
                yield pa.RecordBatch.from_pylist(out, _FOUND)

    return rows_by_python(docs.select("doc_id", filled().alias("text")), work, PAIRS)


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without those that cover an item; columns and other rows as they were."""
    rows = numbered(docs, "tiling-texts")
    bad = tiled(rows.select(F.col("_at").alias("doc_id"), F.col("_doc.text").alias("text")), items, **options).select(
        F.col("doc_id").alias("_at")).distinct()
    return rows.join(stage(bad, "tiling-found"), "_at", "left_anti").select("_doc.*")


def op7_tiling(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold at least half of the words of a benchmark item."""
    return tiled(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select(
        "doc_id", "item_id", "matched_words", "item_words", "coverage", "tiles", "longest",
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))),
                     ",").alias("spans"))


QUERIES = {"op7_tiling": op7_tiling}
SQL = {}
