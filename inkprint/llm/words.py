"""Words and their 64-bit hashes for whole Arrow batches, in numpy.

A word is a longest run of bytes other than space and 0x09-0x0D; those bytes are
never part of another UTF-8 character, so the work can be done on bytes. A word's
hash is a polynomial over a random value per byte, finished by a bit mixer; equal
words have equal hashes everywhere, and two of a trillion different words meet
with a chance of about 3 in 100,000 (birthday bound of 64 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
CHUNK_BYTES = 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_EXACT = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        base = int(_BASE) | 1
        factor = base if which == "up" else pow(base, -1, 1 << 64)
        have = np.full(max(n, CHUNK_BYTES + 1), factor, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        _powers[which] = have
    return have[:n]


def slices(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about 4 MB."""
    text = text.cast(pa.large_string()).fill_null("")
    n = len(text)
    if not n:
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + n + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte start and end of every word; a word ends with its text at the latest."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[data]
    begin = np.empty(len(data), bool)
    begin[0] = True
    begin[1:] = space[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begin[inner] = True
    begin &= ~space
    starts = np.flatnonzero(begin)
    end = np.empty(len(data), bool)
    end[-1] = True
    end[:-1] = space[1:]
    end[inner[inner > 0] - 1] = True
    end &= ~space
    return starts, np.flatnonzero(end) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash per byte range; ``lower`` reads A-Z as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    run = np.empty(len(data) + 1, np.uint64)
    run[0] = 0
    np.cumsum((_LOWER if lower else _EXACT)[data] * _power("up", len(data)), out=run[1:])
    return mix((run[ends] - run[starts]) * _power("down", len(data))[starts]
               + (ends - starts).astype(np.uint64))


def word_hashes(text: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, word offsets of the rows) for runs of whole texts."""
    for row, end, data, offsets in slices(text):
        starts, ends = bounds(data, offsets)
        yield row, hashes(data, starts, ends, lower), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside a row, and their offsets by row.

    A row of fewer words, but at least one, has its whole sequence as one.
    """
    counts = np.diff(offsets)
    many = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(counts)), many)
    first = offsets[:-1][row] + np.arange(at[-1]) - at[:-1][row]
    length = np.minimum(counts, k)[row]
    total = mix(length.astype(np.uint64))
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        factor = np.uint64(pow(int(_BASE) | 1, j + 3, 1 << 64))
        total = total + np.where(length > j, padded[first + j], np.uint64(0)) * factor
    return mix(total), at
