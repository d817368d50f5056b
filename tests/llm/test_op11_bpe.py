"""Segment-tree BPE against the tokenizers library: ids, counts, decoded texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from inkprint.llm import op11_bpe
from inkprint.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'re", "1", "23", "é", "\x1c", "\x85", "　", "漢字", "\U0001f600", ".", "!!",
         "<|endoftext|>", "<|endof", "text|>", "A", "ing", "\r\n", "​", "x" * 50, "and", "Straße", "é", "\x00", "²", "ª"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain_merges(piece, merges, vocab):
    """The textbook loop: find the lowest rank, leftmost, merge it, start again."""
    while True:
        ranked = [(merges[p], i) for i, p in enumerate(zip(piece, piece[1:])) if p in merges]
        if not ranked:
            return [vocab[s] for s in piece]
        _, i = min(ranked)
        piece = [*piece[:i], piece[i] + piece[i + 1], *piece[i + 2:]]


def test_ids_and_texts_equal_the_library(library):
    rng = random.Random(11)
    bpe = op11_bpe.Bpe(PATH)
    texts = ["", " ", "  ", " a", "a ", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "x" * 5_000, "ab" * 700 + " end"]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randrange(n))) for n in (3, 8, 40) for _ in range(800)]
    ids, counts = bpe.encode(pa.array(texts))
    own = np.split(ids, np.cumsum(counts)[:-1])
    data, sizes = bpe.decode(ids, counts)
    spelt = np.split(data, np.cumsum(sizes)[:-1])
    for text, mine, back in zip(texts, own, spelt):
        expected = library.encode(text, add_special_tokens=False).ids
        assert mine.tolist() == expected
        assert back.tobytes().decode() == library.decode(expected, skip_special_tokens=False)


def test_every_tree_takes_the_textbook_merges():
    """One by one and as a forest, on a small vocabulary where ranks meet and overlap."""
    rng = random.Random(5)
    pairs = [("a", "b"), ("b", "a"), ("a", "a"), ("ab", "ab"), ("aa", "a"), ("b", "b"), ("abab", "ab"), ("ba", "a")]
    vocab = {s: i for i, s in enumerate(dict.fromkeys(["a", "b", *(x + y for x, y in pairs)]))}
    merges = op11_bpe.Merges([(vocab[x], vocab[y]) for x, y in pairs], [vocab[x + y] for x, y in pairs])
    ranks = {p: i for i, p in enumerate(pairs)}
    for length in (2, 3, 7, 8, 9, 33):
        texts = ["".join(rng.choice("ab") for _ in range(length)) for _ in range(50)]
        wide = 1 << (length - 1).bit_length()
        grid = np.array([[vocab[c] for c in t] + [-1] * (wide - length) for t in texts])
        together = op11_bpe.Forest(grid, merges).merged()
        for text, row in zip(texts, together):
            expected = plain_merges(list(text), ranks, vocab)
            alone = merges.alone([vocab[c] for c in text])
            assert [s for s in row.tolist() if s >= 0] == expected == [s for s in alone.tolist() if s >= 0]


def test_cache_may_be_emptied(library, monkeypatch):
    monkeypatch.setattr(op11_bpe, "CACHED_CHUNKS", 3)
    bpe = op11_bpe.Bpe(PATH)
    for text in ("one two three four", "four five six", "one two"):
        ids, _ = bpe.encode(pa.array([text, text]))
        assert ids.tolist() == 2 * library.encode(text, add_special_tokens=False).ids


def expected(text, library):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("where", ["edge", "small"])
def test_query_on_whole_tables(spark, where, library, request):
    sf = request.getfixturevalue(where)
    want = sorted((str(r["doc_id"]), *expected(r["text"], library)) for r in table(spark, sf, "documents").collect())
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
                 for r in op11_bpe.op11_bpe(spark, sf).collect())
    assert got == want


def test_ids_and_texts_as_tables(spark, edge, library):
    docs = table(spark, edge, "documents")
    ids = op11_bpe.encoded(docs, PATH)
    assert {(r["doc_id"], tuple(r["ids"])) for r in ids.collect()} == {
        (r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect()}
    assert sorted((str(r["doc_id"]), r["text"]) for r in op11_bpe.decoded(ids, PATH).collect()) == sorted(
        (str(r["doc_id"]), r["text"] or "") for r in docs.collect())


def test_bytes_that_are_no_text(spark, library):
    """Ids that end inside a character decode with the replacement character, as the library's do."""
    half = library.encode("漢字", add_special_tokens=False).ids[:1]
    row = spark.createDataFrame([(1, half), (2, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in op11_bpe.decoded(row, PATH).collect()} == {1: library.decode(half), 2: ""}
