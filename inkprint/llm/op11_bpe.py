"""Byte-level BPE by segment trees over adjacent pair ranks, and decoding.

A piece of pre-tokenised text starts as one symbol a byte. A segment tree holds, per
symbol, the rank of the merge of it and its right neighbour; a node is the least of its
two halves, so the root names the lowest rank and its leftmost place. Merging there
changes three leaves (the removed neighbour's, the merged one's and the one before), and
each change walks up one path: a merge costs the logarithm of the piece's length. The
piece is done when the root is empty. All new pieces of a batch with as many leaves
are a forest: one array of trees, in which every tree takes its own next merge at the
same time.

Texts are cut into chunks first. In this pre-tokenisation a single blank between two
other characters always starts a new piece, so a text's ids are those of its chunks one
after another; a batch's distinct chunks are looked up in a bounded cache, unknown ones
are cut by the library's pre-tokeniser and merged by the forest, and all ids are then
gathered by index. Texts with other runs of space are cut by the same rule one by one;
texts with a control character that regex libraries read differently go as one chunk.

Defined cases: a null or empty text has no ids and decodes to the empty text; an added
token of the vocabulary in a text is that token's one id, as the library does by default;
a piece of any length is merged whole; repeated rows are rows of their own; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from inkprint.llm.common import filled, rows_by_python, table
from inkprint.llm.words import slices

CACHED_CHUNKS = 800_000
BATCH_BYTES = 1 << 23
FEW_TREES = 16  # a bucket of fewer trees is merged one by one
NONE = np.int64(1) << 62
ENCODED = "doc_id long, ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

_APART = re.compile(r"(?<=\S) (?=\S)")
_UNSURE = "[\x1c-\x1f]"  # space for one regex library, not for another
# Every character that \s stands for, spelt out for a library that knows ASCII alone.
_SPACE = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_MARKS = ".,!?;:%$#*&|<>"


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes are themselves."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


def gathered(flat: np.ndarray, begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``flat`` one after another, and their sizes; run i is begin[i] to begin[i + 1]."""
    first = begin[which]
    sizes = begin[which + 1] - first
    before = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    return flat[np.repeat(first - before, sizes) + np.arange(total)], sizes


def runs(items: list) -> tuple[bytes, np.ndarray]:
    """Byte strings as one, and where each begins."""
    return b"".join(items), np.concatenate([[0], np.cumsum(np.fromiter(map(len, items), np.int64, len(items)))])


class Merges:
    """Ranks and results of pairs, looked up for whole arrays of pairs."""

    def __init__(self, pairs: list[tuple[int, int]], results: list[int]):
        left, right = np.array(pairs, np.int64).reshape(-1, 2).T
        code = left << 32 | right
        order = np.argsort(code, kind="stable")
        self.code, self.rank = code[order], order.astype(np.int64)
        self.result = np.array(results, np.int64)
        self.by_pair: dict[int, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where the pair doesn't merge."""
        if not len(self.code):
            return np.full(len(left), NONE)
        code = left << 32 | right
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.rank[at], NONE)

    def alone(self, symbols: list[int]) -> np.ndarray:
        """One piece's symbols after the last merge, -1 where one is gone: one tree, plain numbers."""
        if not self.by_pair:
            self.by_pair = dict(zip(self.code.tolist(), self.rank.tolist()))
        get, result, none = self.by_pair.get, self.result, int(NONE)
        n = len(symbols)
        wide = 1 << (n - 1).bit_length() if n > 1 else 1
        tree = [none] * (2 * wide)
        for i in range(n - 1):
            rank = get(symbols[i] << 32 | symbols[i + 1])
            if rank is not None:
                tree[wide + i] = rank * wide + i
        for node in range(wide - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = [*range(1, n), -1], list(range(-1, n - 1))

        def put(at: int, key: int) -> None:
            node = at + wide
            tree[node] = key
            while node > 1:
                other, node = tree[node ^ 1], node >> 1
                key = key if key < other else other
                if tree[node] == key:
                    return
                tree[node] = key

        def key(at: int) -> int:
            rank = get(symbols[at] << 32 | symbols[after[at]]) if after[at] >= 0 else None
            return none if rank is None else rank * wide + at

        while tree[1] < none:
            rank, at = divmod(tree[1], wide)
            gone = after[at]
            symbols[at], symbols[gone], after[at] = int(result[rank]), -1, after[gone]
            if after[at] >= 0:
                before[after[at]] = at
            put(gone, none)
            put(at, key(at))
            if before[at] >= 0:
                put(before[at], key(before[at]))
        return np.array(symbols, np.int64)


class Forest:
    """Segment trees of pieces with the same number of leaves, one merge of each at a time.

    ``symbols`` is (pieces, leaves), padded with -1. Leaf i of a tree holds rank * leaves + i,
    so the least leaf is the leftmost one of the lowest rank.
    """

    def __init__(self, symbols: np.ndarray, merges: Merges):
        self.merges, (pieces, self.leaves) = merges, symbols.shape
        wide = self.leaves
        self.symbols = symbols.reshape(-1)
        place = np.arange(wide)
        inside = symbols >= 0
        self.after = np.where(np.roll(inside, -1, 1) & (place < wide - 1), place + 1, -1).reshape(-1)
        self.before = np.where(inside, place - 1, -1).reshape(-1)
        tree = np.full((pieces, 2 * wide), NONE)
        row, at = np.nonzero(inside[:, 1:])
        rank = merges.ranks(symbols[row, at], symbols[row, at + 1])
        tree[row, wide + at] = np.where(rank < NONE, rank * wide + at, NONE)
        level = wide
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        self.tree = tree.reshape(-1)

    def _set(self, row: np.ndarray, at: np.ndarray, keys: np.ndarray) -> None:
        """Point updates of leaves, at most a few in each tree, and of the paths above them."""
        base, node = row * 2 * self.leaves, at + self.leaves
        self.tree[base + node] = keys
        while len(node) and node[0] > 1:
            parent = node >> 1
            self.tree[base + parent] = np.minimum(self.tree[base + 2 * parent], self.tree[base + 2 * parent + 1])
            node = parent

    def merged(self) -> np.ndarray:
        """All symbols after the last merge, -1 where there is none."""
        wide = self.leaves
        open_rows = np.arange(len(self.symbols) // wide)
        while True:
            root = self.tree[open_rows * 2 * wide + 1]
            more = root < NONE
            open_rows, root = open_rows[more], root[more]
            if not len(open_rows):
                return self.symbols.reshape(-1, wide)
            rank, at = root // wide, root % wide
            base = open_rows * wide
            gone = self.after[base + at]
            after, before = self.after[base + gone], self.before[base + at]
            new = self.merges.result[rank]
            self.symbols[base + at] = new
            self.symbols[base + gone] = -1
            self.after[base + at] = after
            has = after >= 0
            self.before[(base + after)[has]] = at[has]
            right = np.full(len(at), NONE)
            found = self.merges.ranks(new[has], self.symbols[(base + after)[has]])
            right[has] = np.where(found < NONE, found * wide + at[has], NONE)
            had = before >= 0
            found = self.merges.ranks(self.symbols[(base + before)[had]], new[had])
            left = np.where(found < NONE, found * wide + before[had], NONE)
            self._set(np.concatenate([open_rows, open_rows, open_rows[had]]),
                      np.concatenate([gone, at, before[had]]),
                      np.concatenate([np.full(len(at), NONE), right, left]))


class Bpe:
    """A byte-level BPE vocabulary file: ids of texts, and texts of ids."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.merges = Merges([(vocab[a], vocab[b]) for a, b in pairs], [vocab[a + b] for a, b in pairs])
        self.letters = byte_letters()
        self.back = {ord(c): b for b, c in enumerate(self.letters)}
        self.byte_ids = np.array([vocab[c] for c in self.letters], np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_at = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        spelt = {i: t.translate(self.back).encode("latin-1") for t, i in vocab.items()}
        spelt |= {i: t.encode() for t, i in self.added.items()}
        size = max(spelt, default=-1) + 1
        data, self.token_begin = runs([spelt.get(i, b"") for i in range(size)])
        self.token_bytes = np.frombuffer(data, np.uint8)
        data, self.digit_begin = runs([f"{i},".encode() for i in range(size)])
        self.digits = np.frombuffer(data, np.uint8)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.begin, self.used = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)

    def forget(self) -> None:
        """Keep the chunks that came more than once in a batch since the last time; all go if that is most of them."""
        kept = np.flatnonzero(self.used)
        if 2 * len(kept) > len(self.known):
            self.clear()
            return
        names = list(self.known)
        self.ids, sizes = gathered(self.ids, self.begin, kept)
        self.known = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.begin, self.used = np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(kept), bool)

    # --- encoding -----------------------------------------------------------------

    def pieces(self, data: np.ndarray, begin: np.ndarray, fixed: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of bytes (piece i is begin[i] to begin[i + 1]) and how many each has.

        ``fixed`` names the pieces that are an added token, and its id.
        """
        sizes = np.diff(begin)
        symbols, counts = self.byte_ids[data], sizes.copy()
        kept = np.ones(len(symbols), bool)
        for piece, own in fixed.items():
            kept[begin[piece] + 1:begin[piece + 1]] = False
            symbols[begin[piece]], counts[piece], sizes[piece] = own, 1, 1
        wide = np.where(sizes > 1, 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64), 1)
        for leaves in np.unique(wide[wide > 1]).tolist():
            which = np.flatnonzero(wide == leaves)
            if len(which) < FEW_TREES:
                for piece in which.tolist():
                    at = slice(begin[piece], begin[piece + 1])
                    symbols[at] = done = self.merges.alone(symbols[at].tolist())
                    kept[at] = done >= 0
                    counts[piece] = kept[at].sum()
                continue
            place = np.arange(leaves)
            inside = place < sizes[which, None]
            at = (begin[which, None] + place)[inside]
            grid = np.full(inside.shape, -1, np.int64)
            grid[inside] = symbols[at]
            done = Forest(grid, self.merges).merged()
            symbols[at] = done[inside]
            kept[at] = done[inside] >= 0
            counts[which] = (done >= 0).sum(1)
        return symbols[kept].astype(np.int32), counts

    def learn(self, chunks: list[str]) -> None:
        """Put the ids of new chunks into the cache."""
        full = pa.array(chunks, pa.large_string())
        offsets = np.frombuffer(full.buffers()[1], np.int64)[:len(chunks) + 1]
        data = np.frombuffer(full.buffers()[2] or b"", np.uint8)[:offsets[-1]]
        # A word, with or without its blank, is one piece, and so are the marks after it.
        spaced = pc.starts_with(full, " ")
        stems = pc.utf8_rtrim(full, characters=_MARKS)
        words = pc.utf8_is_alpha(pc.utf8_slice_codeunits(pc.if_else(spaced, stems, pc.binary_join_element_wise(
            pa.scalar(" ", pa.large_string()), stems, pa.scalar("", pa.large_string()))), 1))
        words = words.to_numpy(zero_copy_only=False)
        ends = offsets[:-1] + pc.binary_length(stems).to_numpy(zero_copy_only=False)
        cuts, owners, fixed = [offsets[:-1], ends[words]], [np.arange(len(chunks)), np.flatnonzero(words)], {}
        more, whose, tokens = [], [], {}
        for i in np.flatnonzero(~words).tolist():
            at = int(offsets[i])
            for length, token in self._cut(chunks[i]):
                if token is not None:
                    tokens[at] = token
                more.append(at)
                whose.append(i)
                at += length
        # Every piece but a chunk's first begins inside the chunk.
        begin = np.concatenate([*cuts, np.array(more, np.int64)])
        owner = np.concatenate([*owners, np.array(whose, np.int64)])
        inside = begin < offsets[1:][owner]
        begin, first = np.unique(begin[inside], return_index=True)
        owner = owner[inside][first]
        fixed = dict(zip(np.searchsorted(begin, np.array(list(tokens), np.int64)).tolist(), tokens.values()))
        ids, counts = self.pieces(data, np.append(begin, offsets[-1]), fixed)
        sizes = np.bincount(owner, counts, len(chunks)).astype(np.int64)
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])

    def _cut(self, chunk: str) -> Iterator[tuple[int, int | None]]:
        """Bytes of each piece, and the id of those that are an added token."""
        at = 0
        for m in self.added_at.finditer(chunk):
            for piece, _ in self.cut(chunk[at:m.start()]):
                yield len(piece), None
            yield len(m.group().encode()), self.added[m.group()]
            at = m.end()
        for piece, _ in self.cut(chunk[at:] if at else chunk):
            yield len(piece), None

    def _slow(self, text: str, whole: bool) -> list[str]:
        if whole or self.added_at.search(text):
            return [text] if text else []
        parts = _APART.split(text)
        return [parts[0], *(f" {p}" for p in parts[1:])] if text else []

    def chunked(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct chunks, the chunk numbers of all texts, and how many each text has."""
        texts = texts.cast(pa.large_string())
        cut = pc.split_pattern(texts, " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        encoded = cut.flatten().dictionary_encode()
        words, code = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)
        matches = lambda of, pattern: pc.match_substring_regex(of, pattern).to_numpy(zero_copy_only=False)
        # A blank is a sure cut only between two characters that are no space.
        left, right = matches(words, f"^{_SPACE}|^$"), matches(words, f"{_SPACE}$|^$")
        slow = np.zeros(len(texts), bool)
        row = np.repeat(np.arange(len(texts)), np.diff(offsets))
        if left.any() or right.any():
            unsure = np.zeros(len(code), bool)
            unsure[1:] = right[code[:-1]] | left[code[1:]]
            unsure[offsets[:-1]] = False
            slow[row[unsure]] = True
        whole = matches(texts, _UNSURE)
        for token in self.added:
            slow |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        slow |= whole
        code = 2 * code.astype(np.int64) + 1
        code[offsets[:-1]] -= 1  # a text's first chunk has no blank before it
        used = np.zeros(2 * len(words), bool)
        used[code[~slow[row]]] = True
        used = np.flatnonzero(used)
        place = np.zeros(2 * len(words), np.int64)
        place[used] = np.arange(len(used))
        lead = pa.array(["", " "], pa.large_string()).take(pa.array(used & 1))
        chunks = pc.binary_join_element_wise(lead, words.take(pa.array(used >> 1)), pa.scalar("", pa.large_string())).to_numpy(
            zero_copy_only=False).tolist()
        if not slow.any():
            return chunks, place[code], np.diff(offsets)
        number = {c: i for i, c in enumerate(chunks)}
        codes, counts = np.split(place[code], offsets[1:-1]), np.diff(offsets)
        for i in np.flatnonzero(slow).tolist():
            own = [number.setdefault(c, len(number)) for c in self._slow(texts[i].as_py(), bool(whole[i]))]
            codes[i], counts[i] = np.array(own, np.int64), len(own)
        return list(number), np.concatenate(codes), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        chunks, code, counts = self.chunked(texts)
        if len(self.known) > CACHED_CHUNKS:
            self.forget()
        new = [c for c in chunks if c not in self.known]
        if new:
            self.learn(new)
        place = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        if len(self.used) < len(self.known):
            self.used = np.concatenate([self.used, np.zeros(len(self.known) - len(self.used), bool)])
        self.used[place[np.bincount(code, minlength=len(place)) > 1]] = True
        ids, sizes = gathered(self.ids, self.begin, place[code])
        reach = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(reach)

    # --- decoding -----------------------------------------------------------------

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all ids one after another, and how many each text has."""
        data, sizes = gathered(self.token_bytes, self.token_begin, ids)
        reach = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return data, np.diff(reach)

    def listed(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids, each with a comma after it, and how many bytes each text has."""
        data, sizes = gathered(self.digits, self.digit_begin, ids)
        reach = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return data, np.diff(reach)


_opened: dict[str, Bpe] = {}


def opened(path: str) -> Bpe:
    """The vocabulary of a file, kept by the worker for its next tasks."""
    if path not in _opened:
        _opened[path] = Bpe(path)
    return _opened[path]


def gathered_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches together, about ``BATCH_BYTES`` at a time: more of the chunks are the same."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BATCH_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) of every whole text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(vocabulary)
        for rows in gathered_batches(batches):
            keys, texts = (rows.column(c).combine_chunks() for c in ("doc_id", "text"))
            for row, end, _, _ in slices(texts):
                ids, counts = bpe.encode(texts.slice(row, end - row))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(row, end - row), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))],
                    ["doc_id", "ids"])

    return rows_by_python(docs.select("doc_id", filled().alias("text")), work, ENCODED)


def _lists(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, counts) of about a million ids at a time."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    ids = column.values.to_numpy(zero_copy_only=False)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + (1 << 20), "right")) - 1
        end = min(len(column), max(end, row + 1))
        yield row, end, ids[offsets[row]:offsets[end]], np.diff(offsets[row:end + 1])
        row = end


def decoded(ids: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); bytes that are no UTF-8 become the replacement character."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(vocabulary)
        for batch in batches:
            for row, end, flat, counts in _lists(batch.column("ids")):
                data, sizes = bpe.decode(flat, counts)
                data, ends = data.tobytes(), np.cumsum(sizes).tolist()
                texts = [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows_by_python(ids.select("doc_id", "ids"), work, "doc_id long, text string")


def digests(ids: DataFrame, vocabulary: str) -> DataFrame:
    """Count and SHA-256 of the ids, and SHA-256 of the text that they decode to."""
    def hashed(data: bytes, sizes: np.ndarray, less: int = 0) -> list[str]:
        ends = np.cumsum(sizes).tolist()
        return [hashlib.sha256(data[a:max(a, b - less)]).hexdigest() for a, b in zip([0, *ends], ends)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(vocabulary)
        for batch in batches:
            for row, end, flat, counts in _lists(batch.column("ids")):
                digits, sizes = bpe.listed(flat, counts)
                names = hashed(digits.tobytes(), sizes, 1)
                data, sizes = bpe.decode(flat, counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), pa.array(counts, pa.int64()), pa.array(names),
                     pa.array(_valid(data.tobytes(), sizes, hashed))],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows_by_python(ids.select("doc_id", "ids"), work, DIGESTS)


def _valid(data: bytes, sizes: np.ndarray, hashed) -> list[str]:
    """Hashes of decoded texts; only where bytes are no UTF-8 do they differ from the bytes' own."""
    try:
        data.decode()
        return hashed(data, sizes)
    except UnicodeDecodeError:
        ends = np.cumsum(sizes).tolist()
        return [hashlib.sha256(data[a:b].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip([0, *ends], ends)]


def op11_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's ids, decoded again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return digests(encoded(table(spark, sf, "documents"), path), path)


QUERIES = {"op11_bpe": op11_bpe}
SQL = {}
