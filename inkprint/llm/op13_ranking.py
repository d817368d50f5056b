"""Ranked lexical search by presence masks.

Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Items are
dealt into blocks of a bounded number of terms, written as files; for each block one pass
cuts every whole document into terms and keeps, written, a row per document with its
length and the block's terms in it. Counts over all documents follow from that table.

The second pass takes those rows some thousand at a time. Each term has a bitmap over the
rows; an item's bitmaps, turned on their side, give every row's mask of matched terms,
and equal masks are one group. The most that a group can score is the sum over its terms
of the weight times the term's highest impact among the rows; groups are evaluated by
descending maximum, their documents exactly, until the next maximum is below the item's
tenth score so far. A task keeps the best of each item of the block and nothing else, so
memory is bounded by the block; the items' bests over all tasks are then ranked.

Equal terms are found by their 64-bit hashes (``words``); scores are 64-bit integers.

Defined cases: a null or empty document has no terms, isn't counted and is never ranked;
an item without text or terms has no rows; items are rows, so an item_id on two rows has
two rankings, and a null item_id is returned as null; of equal scores a null doc_id comes
first, then the smaller; repeated documents are ranked one by one; other columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkprint.llm.common import filled, folder, release, rows_by_python, running_start, stage, table
from inkprint.llm.files import place
from inkprint.llm.op11_bpe import gathered
from inkprint.llm.words import hashes, slices

TOP = 10
BLOCK_TERMS = 100_000
CHUNK_DOCS = 1 << 13
CHUNK_POSTINGS = 1 << 22
FIRST_DOCS = 32  # documents evaluated before the first look at the threshold; then four times as many
FLAT, PER_LENGTH = 25, 75  # parts of a hundred of a document's own length that count as one and by length
IMPACT, TF, LENGTH = 1_000_000_000, 1000, 8
NOBODY = -1

_TERM = np.ones(256, bool)
_TERM[:128] = [chr(b).isalnum() for b in range(128)]


def term_hashes(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of all terms, how many each row has) for runs of whole texts."""
    for row, _, data, offsets in slices(text):
        inside = _TERM[data]
        begins, ends = inside.copy(), inside.copy()
        inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        begins[1:] &= ~inside[:-1]
        begins[inner] = inside[inner]
        ends[:-1] &= ~inside[1:]
        ends[inner - 1] = inside[inner - 1]
        starts = np.flatnonzero(begins)
        found = hashes(data, starts, np.flatnonzero(ends) + 1, True)
        yield row, found.view(np.int64), np.diff(np.searchsorted(starts, offsets))


# --- items ---------------------------------------------------------------------------


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, times = [], []
        for _, found, counts in term_hashes(batch.column("text")):
            for own in np.split(found, np.cumsum(counts)[:-1]):
                t, n = np.unique(own, return_counts=True)
                terms.append(t)
                times.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("no"), batch.column("item_id"), pa.array(terms, pa.list_(pa.int64())),
             pa.array(times, pa.list_(pa.int64()))], ["no", "item_id", "terms", "times"])


def dealt(items: DataFrame) -> DataFrame:
    """(no, item_id, terms, times, block): items with terms, numbered and dealt into blocks."""
    numbered = stage(items.select("item_id", filled().alias("text")).withColumn(
        "no", F.monotonically_increasing_id()), "ranking-items")
    found = stage(rows_by_python(numbered, _queries, "no long, item_id long, terms array<long>, times array<long>")
                  .where(F.size("terms") > 0), "ranking-terms")
    starts = running_start(found.select("no", F.size("terms").alias("size")), ["no"], "size", "ranking-order")
    return stage(found.join(starts.select("no", F.floor(F.col("start") / BLOCK_TERMS).alias("block")), "no"), "ranking-blocks")


def _read(path: str) -> pa.Table:
    """A small written table of the shared folder, read by a task."""
    store, at = place(path)
    return pq.read_table(at, filesystem=store)


# --- the block's terms in every document -------------------------------------------------


def _postings(path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = np.unique(_read(path).column("terms").combine_chunks().flatten().to_numpy())
        for batch in batches:
            ids = batch.column("doc_id")
            for row, found, counts in term_hashes(batch.column("text")):
                at = np.minimum(np.searchsorted(vocabulary, found), len(vocabulary) - 1)
                known = vocabulary[at] == found
                owner = np.repeat(np.arange(len(counts)), counts)[known]
                pair, times = np.unique(owner * len(vocabulary) + at[known], return_counts=True)
                offsets = np.searchsorted(pair, np.arange(len(counts) + 1) * len(vocabulary)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(counts)), pa.array(counts, pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(pair % len(vocabulary), pa.int32())),
                     pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))], ["doc_id", "n", "terms", "times"])

    return work


# --- masks ------------------------------------------------------------------------------


class Best:
    """The best documents of every item so far: scores, whether ids are known, ids."""

    def __init__(self, items: int, top: int):
        self.score = np.zeros((items, top), np.int64)
        self.known = np.full((items, top), NOBODY, np.int64)
        self.doc = np.zeros((items, top), np.int64)

    def add(self, item: int, score: np.ndarray, known: np.ndarray, doc: np.ndarray) -> None:
        score, known, doc = (np.concatenate([a[item], b]) for a, b in
                             ((self.score, score), (self.known, known), (self.doc, doc)))
        first = np.lexsort((doc, known, -score))[:self.score.shape[1]]
        self.score[item], self.known[item], self.doc[item] = score[first], known[first], doc[first]


class Chunk:
    """Some thousand documents: postings by document, and a bitmap over the documents per term."""

    def __init__(self, known, doc, begin, terms, impact, size: int):
        self.known, self.doc, self.begin, self.terms, self.impact = known, doc, begin, terms, impact
        self.docs = len(doc)
        present = np.flatnonzero(np.bincount(terms, minlength=size)) if len(terms) else np.zeros(0, np.int64)
        self.row = np.full(size, -1)
        self.row[present] = np.arange(len(present))
        width = (self.docs + 7) // 8
        owner = np.repeat(np.arange(self.docs), np.diff(begin))
        bits = np.zeros(len(present) * width, np.uint8)
        np.bitwise_or.at(bits, self.row[terms] * width + (owner >> 3), (128 >> (owner & 7)).astype(np.uint8))
        self.bits = bits.reshape(len(present), width)
        self.most = np.zeros(len(present), np.int64)
        np.maximum.at(self.most, self.row[terms], impact)

    def groups(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(presence of terms by group, group of each document, -1 without any, size of groups)."""
        there = np.unpackbits(self.bits[rows], axis=1, count=self.docs)
        mask = np.ascontiguousarray(np.packbits(there, axis=0, bitorder="little").T)
        if mask.shape[1] <= 8:
            wide = np.zeros((self.docs, 8), np.uint8)
            wide[:, :mask.shape[1]] = mask
            key = wide.view("<u8")[:, 0]
        else:
            key = mask.view(np.dtype((np.void, mask.shape[1])))[:, 0]
        some = np.flatnonzero(mask.any(1))
        _, first, group = np.unique(key[some], return_index=True, return_inverse=True)
        of = np.full(self.docs, -1)
        of[some] = group.reshape(-1)
        return there[:, some[first]].T, of, np.bincount(group.reshape(-1), minlength=len(first))

    def evaluate(self, item: int, terms: np.ndarray, weight: np.ndarray, lookup: np.ndarray, best: Best) -> None:
        """Put the item's best documents of this chunk into ``best``; ``lookup`` is zero outside."""
        here = self.row[terms] >= 0
        terms, weight = terms[here], weight[here]
        if not len(terms):
            return
        rows = self.row[terms]
        there, of, sizes = self.groups(rows)
        # Room for rounding: a maximum is never too low.
        most = there @ (weight * self.most[rows]).astype(np.float64) * (1 + 1e-9) + 1
        order = np.argsort(-most, kind="stable")
        most, reach = most[order], np.cumsum(sizes[order])
        lookup[terms] = weight
        at, take = 0, FIRST_DOCS
        while at < len(order) and most[at] >= max(best.score[item, -1], 1):
            stop = int(np.searchsorted(reach, (reach[at - 1] if at else 0) + take)) + 1
            stop = min(stop, int(np.searchsorted(-most, -float(max(best.score[item, -1], 1)), "right")))
            chosen = np.zeros(len(order) + 1, bool)  # the last stands for documents without a group
            chosen[order[at:stop]] = True
            docs = np.flatnonzero(chosen[of])
            place, sizes_ = gathered(np.arange(len(self.terms)), self.begin, docs)
            score = np.add.reduceat(lookup[self.terms[place]] * self.impact[place], np.cumsum(sizes_) - sizes_)
            good = score >= max(best.score[item, -1], 1)
            best.add(item, score[good], self.known[docs[good]], self.doc[docs[good]])
            at, take = stop, take * 4
        lookup[terms] = 0


def _search(path: str, counts_path: str, n_docs: int, n_terms: int, top: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, counts = _read(path), _read(counts_path)
        flat = block.column("terms").combine_chunks()
        vocabulary, term = np.unique(flat.flatten().to_numpy(), return_inverse=True)
        held_by = np.zeros(len(vocabulary), np.int64)
        held_by[counts.column("term").to_numpy()] = counts.column("df").to_numpy()
        idf = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in held_by.tolist()], np.int64)
        ends = np.cumsum(flat.value_lengths().to_numpy())[:-1]
        item_terms = np.split(term.reshape(-1), ends)
        times = np.split(block.column("times").combine_chunks().flatten().to_numpy(), ends)
        numbers = block.column("no").to_numpy()
        best, lookup = Best(len(numbers), top), np.zeros(len(vocabulary), np.int64)

        def done(rows: list[pa.RecordBatch]) -> None:
            held = pa.Table.from_batches(rows).combine_chunks()
            doc_id, terms, tf = (held.column(c).combine_chunks() for c in ("doc_id", "terms", "times"))
            known = doc_id.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = doc_id.fill_null(0).to_numpy()
            length = FLAT + PER_LENGTH * held.column("n").to_numpy() * n_docs // n_terms
            sizes = terms.value_lengths().to_numpy().astype(np.int64)
            tf = tf.flatten().to_numpy().astype(np.int64)
            impact = IMPACT * tf // (TF * tf + LENGTH * np.repeat(length, sizes))
            chunk = Chunk(known, doc, np.concatenate([[0], np.cumsum(sizes)]), terms.flatten().to_numpy(), impact,
                          len(vocabulary))
            for item, (own, n) in enumerate(zip(item_terms, times)):
                chunk.evaluate(item, own, n * idf[own], lookup, best)

        rows, docs, postings = [], 0, 0
        for batch in batches:
            rows.append(batch)
            docs, postings = docs + len(batch), postings + len(batch.column("terms").flatten())
            if docs >= CHUNK_DOCS or postings >= CHUNK_POSTINGS:
                done(rows)
                rows, docs, postings = [], 0, 0
        if rows:
            done(rows)
        item, place_ = np.nonzero((best.known != NOBODY) & (best.score > 0))
        known = best.known[item, place_]
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers[item]), pa.array(best.doc[item, place_], mask=known == 0), pa.array(best.score[item, place_])],
            ["no", "doc_id", "score"])

    return work


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of (doc_id, text) for each of (item_id, text)."""
    spark = docs.sparkSession
    queries = dealt(items)
    texts = docs.select("doc_id", filled().alias("text"))
    parts = None
    # A pass over all documents per block of items; each is written before the next begins.
    for block in [r["block"] for r in queries.select("block").distinct().orderBy("block").toLocalIterator()]:
        own, _ = _written(queries.where(F.col("block") == block).orderBy("no"), "ranking-block")
        listed, postings = _written(rows_by_python(
            texts, _postings(own), "doc_id long, n long, terms array<int>, times array<int>").where("n > 0"), "ranking-postings")
        size = postings.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if not size["docs"]:
            continue
        held, _ = _written(postings.select(F.explode("terms").alias("term")).groupBy("term").agg(
            F.count("*").alias("df")), "ranking-df")
        found = stage(rows_by_python(postings.where(F.size("terms") > 0).select("doc_id", "n", "terms", "times"),
                                     _search(own, held, size["docs"], size["terms"], top),
                                     "no long, doc_id long, score long"), "ranking-found")
        release(spark, [listed])
        parts = found if parts is None else stage(_first(parts.unionByName(found), top).drop("rank"), "ranking-parts")
    if parts is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return _first(parts, top).join(queries.select("no", "item_id"), "no").select("item_id", "rank", "doc_id", "score")


def _first(found: DataFrame, top: int) -> DataFrame:
    """Ranks up to ``top`` per item. Spark cuts each task's rows to as many before the shuffle."""
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _written(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """A table in the shared folder, by its path for tasks and as a frame."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def op13_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """All documents ranked for every benchmark item."""
    return ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


_LIST = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
         r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
QUERIES = {"op13_ranking": op13_ranking}
SQL = {"op13_ranking": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LIST} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM
  (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term),
q AS (SELECT no, any_value(item_id) AS item_id, term, count(*) AS times FROM
  (SELECT row_number() OVER () AS no, item_id, unnest({_LIST}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY no, term),
s AS (SELECT q.no, any_value(q.item_id) AS item_id, p.r, any_value(p.doc_id) AS doc_id,
  sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.n * c.docs) // c.terms))))::BIGINT AS score
  FROM q JOIN p ON p.term = q.term JOIN w ON w.term = q.term, c GROUP BY q.no, p.r),
k AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {TOP}"""}
