"""Token ids in Re-Pair grammar shards with random access.

Documents are range-sorted by id. A task encodes its texts, cuts them into shards of
about ``SHARD_TOKENS`` ids and compresses each by Re-Pair: the frequent neighbouring
pairs of symbols become new symbols, again and again until no pair is left ``MIN_COUNT``
times. A round replaces as many pairs at once as cannot overlap (no symbol is the left
part of one and the right part of another). Rounds after the first count only where a
pair can be frequent: at pairs that were, and next to replaced places. Pairs never reach over
the end of a document, so a document is a slice of the compressed sequence and is
decoded alone, with the stored expansion lengths telling where an id lies.

Encoding works on pieces. In this vocabulary's pre-tokenisation a single blank
between two other characters always starts a new word, so a text's ids are those of
its pieces one after another, and pieces are kept in a bounded cache. As the library
does by default, an added token of the vocabulary in a text is that token's one id; a
text that holds one goes to the library whole.

Defined cases: a null or empty text has the end id only; equal ids keep an order of
their own by text; a null id sorts first; other columns are ignored; an empty table
gives no rows and no shards.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from inkprint.llm.common import filled, folder, rows_by_python, running_start, table, tag
from inkprint.llm.files import commit, make_folder, place, spread

SHARD_TOKENS = 2_000_000
MIN_COUNT = 32
BUCKET_BITS = 18
CACHED_PIECES = 600_000
END_ID = 0
MAGIC = b"RPG1"
MANIFEST = "part int, number int, temp string, file string, docs long, tokens long, symbols long, rules long, file_bytes long"
DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"

_APART = re.compile(r"(?<=\S) (?=\S)")
_UNSURE = re.compile("[\x1c-\x1f]")  # space for one regex library, not for another
_MARKS = ".,!?;:%$#*&|<>"


def _byte_letters() -> str:
    """The letter that byte-level BPE writes for each byte: printable bytes stay."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return "".join(chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256))


class _Awkward(Exception):
    """A piece with space at an edge: the text needs the slower way to cut it."""


class _Pieces(dict):
    """Ids of pieces by what stands after ``lead``; when full, those unused since the last time go."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead, self.old = encoder, lead, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece) or self.made(piece)
        if len(self) >= CACHED_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found

    def made(self, piece: str) -> bytes:
        word = piece.rstrip(_MARKS)
        if word.isalpha():
            if len(word) == len(piece):
                return self.encoder.word(self.lead + word)
            return self[word] + self.encoder.other[piece[len(word):]]
        if not piece or piece[0].isspace() or piece[-1].isspace() or _UNSURE.search(piece):
            raise _Awkward
        return self.encoder.mixed(piece, self.lead)


class _Others(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED_PIECES // 4:
            self.clear()
        found = self[piece] = self.encoder.whole(piece)
        return found


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, equal to the library's on the text.

    ``spelt`` sets the library's switch that reads the vocabulary's added tokens as plain text.
    """

    def __init__(self, path: str, spelt: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = spelt
        self.added = () if spelt else tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(_byte_letters()))
        self.first, self.rest, self.other = _Pieces(self, ""), _Pieces(self, " "), _Others(self)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """One word, with or without its blank, is one unit for the model."""
        spelt = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def mixed(self, piece: str, lead: str) -> bytes:
        """A piece of more than a word and marks; single line ends part it further."""
        parts = piece.split("\n")
        if len(parts) > 1 and all(p and not p[0].isspace() and not p[-1].isspace() for p in parts):
            head = self.rest[parts[0]] if lead else self.first[parts[0]]
            return self.other["\n"].join([head, *(self.first[p] for p in parts[1:])])
        return self.other[lead + piece]

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(token in text for token in self.added):
            return self.whole(text)
        pieces = text.split(" ")
        try:
            return self.first[pieces[0]] + b"".join(map(self.rest.__getitem__, pieces[1:]))
        except _Awkward:
            pass
        if _UNSURE.search(text):
            return self.whole(text)
        pieces = _APART.split(text)
        return self.other[pieces[0]] + b"".join([self.other[f" {p}"] for p in pieces[1:]])


def compress(ids: np.ndarray, last: np.ndarray, min_count: int = MIN_COUNT):
    """(terminals, rules, sequence, last): ``last`` marks symbols that end a document."""
    terminals = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
    place_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    place_of[terminals] = np.arange(len(terminals))
    seq, rules = place_of[ids], np.zeros((0, 2), np.int64)
    inside = np.flatnonzero(~last[:-1])
    while len(inside):
        total = len(terminals) + len(rules)
        # Pairs meet in hashed buckets; a bucket stands for the pair written to it last,
        # and other pairs in it wait for a later round, where buckets differ.
        kind, spin, shift = ((np.uint32, 2654435769, 32 - BUCKET_BITS) if total <= 1 << 16 else
                             (np.uint64, 0x9E3779B97F4A7C15, 64 - BUCKET_BITS))
        code = seq[inside].astype(kind) * kind(total) + seq[inside + 1]
        bucket = ((code * kind(spin)) >> kind(shift)).astype(np.uint32)
        often = (np.bincount(bucket, minlength=1 << BUCKET_BITS) >= min_count)[bucket]
        code, bucket, inside = code[often], bucket[often], inside[often]
        owner = np.zeros(1 << BUCKET_BITS, kind)
        owner[bucket] = code
        own = owner[bucket] == code
        counts = np.bincount(bucket[own], minlength=1 << BUCKET_BITS)
        full = np.flatnonzero(counts >= min_count)
        if not len(full):
            # What frequent pairs there are share their buckets with others: count pairs themselves.
            owner, bucket, counts = np.unique(code, return_inverse=True, return_counts=True)
            own = np.ones(len(code), bool)
            full = np.flatnonzero(counts >= min_count)
        bucket, at = bucket[own], inside[own]
        full = full[np.lexsort((owner[full], -counts[full]))]
        role = [0] * total  # 1 left, 2 right, 3 both parts of its own pair
        chosen, parts = [], []
        for place, p in zip(full.tolist(), owner[full].tolist()):
            a, b = divmod(p, total)
            if a == b and not role[a]:
                role[a] = 3
            elif a != b and role[a] in (0, 1) and role[b] in (0, 2):
                role[a], role[b] = 1, 2
            else:
                continue
            chosen.append(place)
            parts.append((a, b))
        if not chosen:
            break
        symbol = np.zeros(len(counts), np.uint32)
        symbol[chosen] = total + np.arange(len(chosen))
        new = symbol[bucket]
        at, new = at[new > 0], new[new > 0]
        # In a run of one symbol every second pair is taken, from the left.
        order = np.arange(len(at))
        fresh = np.concatenate([[True], np.diff(at) != 1])
        even = (order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0
        at, new = at[even], new[even]
        seq[at] = new
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        near = np.zeros(len(seq), bool)
        near[inside] = near[at] = near[at[at > 0] - 1] = True
        seq, last, near = seq[keep], last[keep], near[keep]
        inside = np.flatnonzero(near & ~last)
        rules = np.concatenate([rules, np.array(parts, np.int64)])
    return terminals, rules, seq, last


def expansions(terminals: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All symbols' ids in one array, and where each symbol's begin."""
    sizes = np.concatenate([np.ones(len(terminals), np.int64), lengths])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.empty(begin[-1], np.uint32)
    flat[:len(terminals)] = terminals
    for i, (a, b) in enumerate(rules.tolist(), len(terminals)):
        at, middle = begin[i], begin[i] + sizes[a]
        flat[at:middle] = flat[begin[a]:begin[a + 1]]
        flat[middle:begin[i + 1]] = flat[begin[b]:begin[b + 1]]
    return flat, begin


def pack(doc_ids: list, texts: list[bytes]) -> tuple[bytes, dict]:
    """One shard's bytes. Layout: magic, length and JSON of the sizes, then the arrays in that order."""
    ids = np.frombuffer(b"".join(texts), "<u4")
    tokens = np.array([len(t) // 4 for t in texts], np.int64)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(tokens) - 1] = True
    terminals, rules, seq, last = compress(ids, last)
    sizes = np.ones(len(terminals) + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist(), len(terminals)):
        sizes[i] = sizes[a] + sizes[b]
    wide = "<u2" if len(sizes) <= 1 << 16 else "<u4"
    arrays = [("terminals", terminals.astype("<u4")), ("rules", rules.astype("<u4").reshape(-1)),
              ("lengths", sizes[len(terminals):].astype("<u4")),
              ("known", np.array([d is not None for d in doc_ids], "u1")),
              ("doc_ids", np.array([d or 0 for d in doc_ids], "<i8")), ("tokens", tokens.astype("<u4")),
              ("ends", (np.flatnonzero(last) + 1).astype("<u4")), ("sequence", seq.astype(wide))]
    head = json.dumps([[n, a.dtype.str, len(a)] for n, a in arrays]).encode()
    data = b"".join([MAGIC, struct.pack("<I", len(head)), head, *(a.tobytes() for _, a in arrays)])
    return data, {"docs": len(texts), "tokens": len(ids), "symbols": len(seq), "rules": len(rules)}


class Shard:
    """A shard read back; documents are decoded alone or all together."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        size = struct.unpack_from("<I", data, 4)[0]
        at = 8 + size
        for name, kind, n in json.loads(data[8:at]):
            setattr(self, name, np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.rules = self.rules.reshape(-1, 2)
        self.flat, self.begin = expansions(self.terminals, self.rules, self.lengths.astype(np.int64))

    def decode(self, symbols: np.ndarray) -> np.ndarray:
        first = self.begin[symbols]
        sizes = self.begin[symbols.astype(np.int64) + 1] - first
        before = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(first - before, sizes) + np.arange(sizes.sum())]

    def document(self, i: int) -> np.ndarray:
        return self.decode(self.sequence[self.ends[i - 1] if i else 0:self.ends[i]])

    def token(self, i: int, place: int) -> int:
        """One id of a document: expansion lengths lead to the symbol that holds it."""
        symbols = self.sequence[self.ends[i - 1] if i else 0:self.ends[i]].astype(np.int64)
        reach = np.cumsum(self.begin[symbols + 1] - self.begin[symbols])
        s = int(np.searchsorted(reach, place, "right"))
        inside = place - (int(reach[s - 1]) if s else 0)
        return int(self.flat[self.begin[symbols[s]] + inside])

    def documents(self) -> Iterator[np.ndarray]:
        """All documents in order; whole runs are decoded at a time."""
        for i in range(0, len(self.ends), 256):
            stop = min(i + 256, len(self.ends))
            ids = self.decode(self.sequence[self.ends[i - 1] if i else 0:self.ends[stop - 1]])
            yield from np.split(ids, np.cumsum(self.tokens[i:stop].astype(np.int64))[:-1])


_encoders: dict[str, Encoder] = {}


def _writer(home: str, vocabulary: str, shard_tokens: int):
    names = [c.split()[0] for c in MANIFEST.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.setdefault(vocabulary, None) or Encoder(vocabulary, spelt=False)
        _encoders[vocabulary] = encode  # kept by the worker for its next tasks
        store, at = place(home)
        part, number, keys, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
        end = struct.pack("<I", END_ID)

        def close() -> pa.RecordBatch:
            data, sizes = pack(keys, texts)
            temp = f"tmp-{tag()}.rpg"
            with store.open_output_stream(f"{at}/{temp}") as out:
                out.write(data)
            row = {"part": part, "number": number, "temp": temp, "file": f"ids-{part:06d}-{number:06d}.rpg",
                   "file_bytes": len(data)} | sizes
            kinds = {"temp": pa.string(), "file": pa.string(), "part": pa.int32(), "number": pa.int32()}
            return pa.RecordBatch.from_pylist([row], pa.schema([(n, kinds.get(n, pa.int64())) for n in names]))

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text) + end
                keys.append(key)
                texts.append(ids)
                held += len(ids) // 4
                if held >= shard_tokens:
                    yield close()
                    number, keys, texts, held = number + 1, [], [], 0
        if keys:
            yield close()

    return work


def write(docs: DataFrame, home: str, vocabulary: str, *, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Shards of (doc_id, text) under ``home`` in ascending id order; the committed manifest."""
    make_folder(home)
    ordered = docs.select("doc_id", filled().alias("text")).repartitionByRange("doc_id").sortWithinPartitions(
        "doc_id", "text")
    return commit(rows_by_python(ordered, _writer(home, vocabulary, shard_tokens), MANIFEST), home, "repair")


def read(manifest: DataFrame, home: str) -> DataFrame:
    """A row per document of the committed shards: its first id's place among all ids, count and checksum."""
    starts = running_start(manifest, ["part", "number"], "tokens", "repair-order")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = place(home)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_stream(f"{at}/{file}") as stream:
                    shard = Shard(stream.read())
                sums = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in shard.documents()]
                tokens = shard.tokens.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, mask=shard.known == 0), pa.array(start + np.cumsum(tokens) - tokens),
                     pa.array(tokens), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows_by_python(spread(starts.select("file", "start")), work, DECODED)


def op3_repair(spark: SparkSession, sf: str) -> DataFrame:
    """All documents' ids, written and read back."""
    home = folder(spark, "repair-shards")
    return read(write(table(spark, sf, "documents"), home, public_tokenizers.path("byte_bpe_50k.json")), home)


QUERIES = {"op3_repair": op3_repair}
SQL = {}
