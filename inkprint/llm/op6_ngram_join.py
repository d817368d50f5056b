"""N-gram Jaccard join with token-combination prefixes, up to connected components.

A document's set holds the hashes of its distinct word shingles; equal sets are one
node. Nodes link when the Jaccard similarity of their sets is at least ``num/den``.

Prefixes. Tokens have one global order: rare ones by hash, then frequent ones by
count. Of two linked sets the shorter lacks at most ``n - o`` tokens of the other, so
some leading part of each must share tokens. Rare tokens are signatures alone.
Frequent tokens fall into classes by hash, and two of the same class make one
signature; a class with c tokens in the prefix then stands for c - 1 of them, and
prefixes are extended until rare tokens and classes together exceed what may be
missing. The shorter set needs the shorter of two prefixes (it "indexes"), the longer
one the longer ("probes"). The number of classes grows with the size of a set, by
powers of two; a set near the next power also indexes there. Which tokens count as
frequent changes the cost only, never the result.

Candidates. Large groups of near copies share their signatures, so pairs inside a
bucket are not spelt out. First every member meets the bucket's most central member
(fewest rare tokens). Verified links are joined to components. Then only members
outside of the central member's component meet the rest of the bucket, in blocks of
bounded size, and only members of other components; sizes and counts of tokens in 512
hash ranges, an exact bound of the overlap, drop most pairs before any set is read.
A pair that is never compared lies in one component already.

Verification joins pairs with the sets of their two nodes. Texts are read again
only for nodes in such pairs. Links, components and sets stay in tables.

Defined cases: documents without words, empty or null, have no set, size 0 and their
own id as component; fewer words than a shingle give one token; rows with equal ids
are separate rows; a component of null ids only has a null id; other columns are
ignored; an empty table gives no rows. If two different sets ever had the same
64-bit number, a second one tells and the job stops; another ``seed`` settles it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm.common import connected, few, numbered, rows_by_python, stage, table
from inkprint.llm.words import mix, shingle_hashes, word_hashes

FREQUENT = 50
LOCAL = 3
COUNTED_TOKENS = 4_000_000
MAX_FREQUENT = 1_000_000
RANGES = 512
BLOCK = 2_000


def sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, words, offsets in word_hashes(texts):
        shingles, at = shingle_hashes(words, offsets, k)
        for i in range(len(at) - 1):
            yield np.unique(shingles[at[i]:at[i + 1]])


def node_of(tokens: np.ndarray, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed) - (1 << 63)


def ranges(tokens: np.ndarray) -> bytes:
    counts = np.bincount((tokens >> np.uint64(55)).astype(np.int64), minlength=RANGES)
    most = counts.max(initial=0)
    return counts.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _unranged(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    if all(len(x) == RANGES for x in rows):
        return np.frombuffer(b"".join(rows), "u1").reshape(-1, RANGES)
    return np.array([np.frombuffer(x, f"<u{len(x) // RANGES}") for x in rows], np.uint32).reshape(-1, RANGES)


def _room(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The overlap that counts by hash range leave possible."""
    return np.minimum(left, right).sum(1, dtype=np.int64)


def overlap_needed(total: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap of two linked sets whose sizes add up to ``total``."""
    return -(-total * num // (num + den))


# --- one pass: nodes of documents, and locally frequent tokens -------------------

DOCS = "kind int, doc_id long, n long, node long, check long, ranges binary, token long, hits long"


def _describe(k: int, seed: int):
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()),
                        ("check", pa.int64()), ("ranges", pa.binary()), ("token", pa.int64()), ("hits", pa.int64())])

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, hits = np.unique(np.concatenate(held), return_counts=True)
        tokens, hits = tokens[hits >= LOCAL], hits[hits >= LOCAL]
        n = len(tokens)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(n, np.int32)), *[pa.nulls(n, f.type) for f in list(schema)[1:6]],
             pa.array(tokens.view(np.int64)), pa.array(hits.astype(np.int64))], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            rows = []
            for tokens in sets(batch.column("text"), k):
                if not len(tokens):
                    rows.append((0, None, None, None))
                    continue
                rows.append((len(tokens), node_of(tokens, seed), node_of(tokens, seed + 1), ranges(tokens)))
                held.append(tokens)
                size += len(tokens)
            n = len(rows)
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), batch.column("doc_id"),
                 *[pa.array(c, t.type) for c, t in zip(cols, list(schema)[2:6])],
                 pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)
            if size >= COUNTED_TOKENS:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    return work


# --- signatures ------------------------------------------------------------------


def _band(n: int) -> int:
    return max(1, n).bit_length() - 1


def _classes(band: int) -> int:
    return max(1, (1 << band) // 4)


def signatures(rare: np.ndarray, frequent: np.ndarray, n: int, band: int, probes: bool,
               num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, index flags) of a set in a band; tokens come in the global order."""
    long = n - -(-n * num // den) + 1
    short = n - -(-2 * n * num // (num + den)) + 1
    need = long if probes else short
    salt = mix(np.array([band + 1], np.uint64))[0]
    alone = rare[:need]
    out, index = [mix(alone + salt)], [np.arange(len(alone)) < short]
    if need > len(rare):
        group = (mix(frequent) % np.uint64(_classes(band))).astype(np.int64)
        first = np.zeros(len(frequent), bool)
        first[np.unique(group, return_index=True)[1]] = True
        gained = len(rare) + np.cumsum(~first)
        ends = np.searchsorted(gained, [need, short]) + 1
        inside = min(int(ends[0]), len(frequent))
        cut = int(ends[1]) if short > len(rare) else 0
        order = np.argsort(group[:inside], kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(group[:inside][order])) + 1)
        for at in parts:
            if len(at) > 1:
                i, j = np.triu_indices(len(at), 1)
                a, b = frequent[at[i]], frequent[at[j]]
                low, high = np.minimum(a, b), np.maximum(a, b)
                out.append(mix(mix(low + salt) + high))
                index.append(np.maximum(at[i], at[j]) < cut)
    return np.concatenate(out), np.concatenate(index)


POSTED = "sig long, node long, n int, spread int, indexed boolean"


def _post(k: int, seed: int, num: int, den: int, frequent: np.ndarray, rank: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for tokens in sets(batch.column("text"), k):
                n = len(tokens)
                if n < 2:  # a single token links with its equal only, which is the same node
                    continue
                node = node_of(tokens, seed)
                if node in seen:
                    continue
                seen.add(node)
                at = np.minimum(np.searchsorted(frequent, tokens), max(0, len(frequent) - 1))
                often = frequent[at] == tokens if len(frequent) else np.zeros(n, bool)
                rare = tokens[~often]
                common = tokens[often][np.argsort(rank[at[often]], kind="stable")] if often.any() else tokens[:0]
                band = _band(n)
                found = [signatures(rare, common, n, band, True, num, den)]
                if n * den >= num << (band + 1):
                    sig, index = signatures(rare, common, n, band + 1, False, num, den)
                    found.append((sig[index], index[index]))
                sig, index = (np.concatenate(x) for x in zip(*found))
                cols[0].append(sig.view(np.int64))
                cols[1].append(np.full(len(sig), node, np.int64))
                cols[2].append(np.full(len(sig), n, np.int32))
                cols[3].append(np.full(len(sig), len(rare) * 1000 // n, np.int32))
                cols[4].append(index)
            if cols[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in cols], ["sig", "node", "n", "spread", "indexed"])

    return work


# --- pairs -----------------------------------------------------------------------


def _bounded(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose counts by hash range leave room for a link."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("ranges").alias(f"{c}_ranges"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _unranged(batch.column("a_ranges")), _unranged(batch.column("b_ranges"))
            total = left.sum(1, dtype=np.int64) + right.sum(1, dtype=np.int64)
            room = _room(left, right) >= overlap_needed(total, num, den)
            yield batch.select(["a", "b"]).filter(pa.array(room))

    return rows_by_python(pairs.join(side("a"), "a").join(side("b"), "b").select(
        "a", "b", "a_ranges", "b_ranges"), work, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, seed: int, num: int, den: int,
              name: str) -> DataFrame:
    """The linked ones of ``pairs``, by the intersection of whole sets."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    ids = stage(wanted.join(nodes, "node").select("node", F.col("doc_id").alias("_id")), f"{name}-wanted")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(node_of(t, seed), t.tobytes()) for t in sets(batch.column("text"), k) if len(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()),
                                              pa.array([x for _, x in found], pa.binary())], ["node", "tokens"])

    texts = docs.join(few(ids.select("_id").distinct()), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    held = rows_by_python(texts, read, "node long, tokens binary").dropDuplicates(["node"])
    side = lambda c: held.select(F.col("node").alias(c), F.col("tokens").alias(f"{c}_tokens"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("a_tokens"), batch.column("b_tokens")):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(den * both >= num * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return stage(rows_by_python(pairs.join(side("a"), "a").join(side("b"), "b").select(
        "a", "b", "a_tokens", "b_tokens"), check, "a long, b long"), name)


def _rest(bucket: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of a bucket across components, other than those with its central member.

    Members outside the central member's component are dealt to blocks; the other
    members of the bucket are sent to each block and stream past it.
    """
    at = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    held = bucket.where("apart").select("sig", at.alias("block"), F.lit(0).alias("side"), "node", "n", "indexed", "comp")
    passing = bucket.select("sig", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"),
                            F.lit(1).alias("side"), "node", "n", "indexed", "comp")
    rows = held.union(passing).join(nodes.select("node", "ranges"), "node")
    rows = rows.repartition("sig", "block").sortWithinPartitions("sig", "block", "side")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("sig", "block", "side")], 1)
            edges = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1, [len(keys)]])
            cols = [np.asarray(batch.column(c)) for c in ("node", "n", "indexed", "comp")]
            counts = _unranged(batch.column("ranges"))
            out = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo == hi:
                    continue
                part = [c[lo:hi] for c in cols] + [counts[lo:hi]]
                if keys[lo, 2] == 0:
                    same = now == (keys[lo, 0], keys[lo, 1])
                    block = [np.concatenate(x) for x in zip(block, part)] if same else part
                    now = (keys[lo, 0], keys[lo, 1])
                elif now == (keys[lo, 0], keys[lo, 1]):
                    out += _across(block, part, num, den)
            if out:
                a, b = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows_by_python(rows, work, "a long, b long").distinct()


def _across(block: list, part: list, num: int, den: int) -> list:
    node, n, indexed, comp, counts = block
    found = []
    for i in range(len(part[0])):
        other, size, index, place, own = (p[i] for p in part)
        fits = (comp != place) & (num * n <= den * size) & (num * size <= den * n)
        fits &= np.where(n < size, indexed, np.where(n > size, index, indexed | index))
        at = np.flatnonzero(fits)
        if len(at):
            room = _room(counts[at], own) >= overlap_needed(n[at].astype(np.int64) + size, num, den)
            at = at[room]
            if len(at):
                low, high = np.minimum(node[at], other), np.maximum(node[at], other)
                found.append((low, high))
    return found


# --- the operator ----------------------------------------------------------------


def components(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, seed: int = 0,
               name: str = "ngram") -> DataFrame:
    """(doc_id, n_shingles, node, component_id) per document; equal sets have equal nodes."""
    texts = docs.select("doc_id", "text")
    described = stage(rows_by_python(texts, _describe(k, seed), DOCS), f"{name}-docs")
    rows = described.where("kind = 0").select("doc_id", "n", "node", "check", "ranges")
    nodes = stage(rows.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("ranges").alias("ranges"),
        (F.min("check") != F.max("check")).alias("clash")), f"{name}-nodes")
    if not nodes.where("clash").isEmpty():
        raise ValueError("two different sets have one number; use another seed")
    top = described.where("kind = 1").groupBy("token").agg(F.sum("hits").alias("hits")).where(
        F.col("hits") >= FREQUENT).orderBy(F.desc("hits"), "token").limit(MAX_FREQUENT).collect()
    frequent = np.array([r[0] for r in top], np.int64).view(np.uint64)
    rank = -np.arange(len(frequent))
    order = np.argsort(frequent)
    posted = rows_by_python(texts, _post(k, seed, num, den, frequent[order], rank[order]), POSTED)
    shared = posted.groupBy("sig").agg(F.count("*").alias("members"), F.min("node").alias("_low"),
                                       F.max("node").alias("_high")).where("_low <> _high").select("sig", "members")
    shared = stage(posted.join(shared, "sig"), f"{name}-shared")
    central = shared.groupBy("sig").agg(F.min(F.struct("spread", "node", "n")).alias("c")).select(
        "sig", F.col("c.node").alias("center"), F.col("c.n").alias("center_n"))
    met = shared.join(central, "sig")
    star = met.where(F.col("node") != F.col("center")).where(
        (F.col("n") * den >= F.col("center_n") * num) & (F.col("center_n") * den >= F.col("n") * num))
    star = star.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct()
    near = stage(_bounded(star, nodes, num, den), f"{name}-star")
    links = _verified(near, texts, nodes, k, seed, num, den, f"{name}-links-1")
    first = connected(links, f"{name}-first")
    # Buckets of two nodes are settled; larger ones go on if they span components.
    wide = met.where("members > 2").select("sig", "node", "n", "indexed", "center").distinct()
    wide = wide.join(first.withColumnRenamed("root", "comp"), "node", "left").withColumn(
        "comp", F.coalesce("comp", "node"))
    centers = first.select(F.col("node").alias("center"), F.col("root").alias("center_comp"))
    wide = wide.join(centers, "center", "left").withColumn(
        "apart", F.col("comp") != F.coalesce("center_comp", "center"))
    wide = stage(wide.drop("center_comp", "center"), f"{name}-wide")
    split = wide.groupBy("sig").agg(F.sum(F.col("apart").cast("long")).alias("out")).where("out > 0").select(
        "sig", F.ceil(F.col("out") / BLOCK).alias("blocks"))
    rest = _rest(wide.join(split, "sig"), nodes, num, den)
    rest = stage(rest.join(near, ["a", "b"], "left_anti"), f"{name}-rest")
    more = _verified(rest, texts, nodes, k, seed, num, den, f"{name}-links-2")
    roots = connected(links.union(more), f"{name}-all")
    placed = rows.select("doc_id", "n", "node").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    least = nodes.select("node", "doc_id").join(roots, "node", "left").groupBy(
        F.coalesce("root", "node").alias("root")).agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "node",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Of rows with the same id and equal words one stays; documents without words stay.
    """
    rows = numbered(docs, "ngram-texts")
    found = components(rows.select(F.col("_at").alias("doc_id"), F.col("_doc.text").alias("text")), k=k, num=num, den=den)
    ids = rows.select("_at", F.col("_doc.doc_id").alias("_id"))
    kept = found.select(F.col("doc_id").alias("_at"), "component_id").join(ids, "_at").groupBy("component_id").agg(
        F.min(F.struct(F.col("_id").isNull().alias("unknown"), "_id", "_at"))["_at"].alias("_at")).select("_at")
    return rows.join(kept, "_at", "left_semi").select("_doc.*")


def op6_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents whose 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return components(table(spark, sf, "documents"), k=4, num=85, den=100).select(
        "doc_id", "n_shingles", "component_id")


QUERIES = {"op6_ngram_join": op6_ngram_join}
SQL = {"op6_ngram_join": r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
    s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4
        THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 2),
            lambda i: array_to_string(words[i:i + 3], ' ')) END) AS tokens FROM w),
    t AS MATERIALIZED (SELECT doc_id, unnest(tokens) AS token FROM s),
    o AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
        FROM t x JOIN t y ON x.token = y.token AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT a, b FROM o JOIN s p ON a = p.doc_id JOIN s q ON b = q.doc_id
        WHERE 100 * common >= 85 * (len(p.tokens) + len(q.tokens) - common)),
    r AS (SELECT doc_id, doc_id AS seen FROM s
        UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
    SELECT s.doc_id, len(tokens)::BIGINT AS n_shingles, min(seen) AS component_id
    FROM s JOIN r USING (doc_id) GROUP BY 1, 2"""}
