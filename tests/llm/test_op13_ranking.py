"""Ranking by presence masks against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import pytest

from inkprint.llm import op13_ranking as op

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=op.TOP):
    """Every document scored for every item, term by term."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for doc, bag, n in bags:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                        for t in terms(text) if t in bag)
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, "x", "x") for r in docs], "doc_id long, text string, n string, terms string").repartition(3)
    i = spark.createDataFrame([(*r, "x", "x") for r in items], "item_id long, text string, no string, block string")
    return sorted((tuple(r) for r in op.ranked(d, i, **more).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def prose(rng, n, size):
    """Frequent and rare words, so that masks repeat and scores tie."""
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), size)}" for _ in range(n))


@pytest.mark.parametrize("block, chunk", [(100_000, 8192), (60, 50), (1, 7)])
def test_every_item_against_every_document(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(op, "BLOCK_TERMS", block)
    monkeypatch.setattr(op, "CHUNK_DOCS", chunk)
    rng = random.Random(block)
    docs = [(i, prose(rng, rng.randrange(0, 60), 300)) for i in range(300)]
    docs += [(i, docs[i % 7][1]) for i in range(300, 340)]  # equal scores
    items = [(j, prose(rng, rng.choice([1, 5, 30, 30, 200]), 300)) for j in range(5 if block == 1 else 25)]
    assert got(spark, docs, items) == plain(docs, items)


def test_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, "..."), (None, "The cat"), (4, "the CAT"), (4, "the CAT"), (5, "ÉCOLE école"), (6, "x" * 70_000),
            (7, "cat " * 30_000), (8, "a1_b2-c3"), (9, "日本 the")]
    items = [(1, "the cat"), (1, "cat cat"), (None, "école É"), (2, None), (3, ""), (4, "!?"), (5, "x" * 70_000), (6, "b2"), (7, "absent"),
             (8, " ".join(f"t{i}" for i in range(90)) + " 日本")]
    assert got(spark, docs, items) == plain(docs, items)
    assert got(spark, docs, items, top=2) == plain(docs, items, 2)


def test_nothing_to_rank(spark):
    assert got(spark, [], [(1, "a")]) == got(spark, [(1, "a")], []) == got(spark, [(1, None)], [(1, "a")]) == []


def test_groups_are_masks():
    """Each document's group has exactly the terms that the document holds."""
    import numpy as np

    rng = np.random.default_rng(4)
    for size in (5, 70):
        held = rng.random((90, size)) < 0.3
        terms_, begin = np.nonzero(held)[1], np.concatenate([[0], np.cumsum(held.sum(1))])
        chunk = op.Chunk(np.ones(90), np.arange(90), begin, terms_, np.ones(len(terms_), np.int64), size)
        there, of, sizes = chunk.groups(chunk.row[np.arange(size)])
        assert len({tuple(r) for r in there.tolist()}) == len(there) and sizes.sum() == (held.any(1)).sum()
        for doc in range(90):
            assert (of[doc] < 0 and not held[doc].any()) or np.array_equal(there[of[doc]].astype(bool), held[doc])
