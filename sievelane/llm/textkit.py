"""Vectorised text kernels on Arrow batches, shared by the operators of this subpackage.

All kernels treat an Arrow string column as one byte buffer plus offsets and work on whole
batches with numpy, so no Python code runs per character, word or document.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the
lower-cased text. A *shingle* is a run of ``n`` words of one document; a document with at least
one and fewer than ``n`` words has its whole word list as its only shingle; a document without
words (null, empty, punctuation only) has none. Shingles are 64-bit hashes that do not depend on
the machine, the batch or the partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD, _PRIME = 0x9E3779B97F4A7C15, 0x100000001B3
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over uint64 (wrapping); a bijection, so it adds no collisions."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _PRIME, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p, dtype=np.uint64)


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_hashes(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch in order, and for each text the index of its first word
    (length ``len(col) + 1``)."""
    if lower:
        col = pc.utf8_lower(pc.fill_null(col, ""))
    raw, off = buffers(col)
    n = len(off) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    is_word = _WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a text's first byte starts a new word
    edge[off] = True
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1] | edge[1:-1]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    at = np.flatnonzero(is_word)  # bytes of words only
    length = np.diff(np.append(np.flatnonzero(begins[at]), len(at)))
    first = np.cumsum(length) - length
    place = np.arange(len(at)) - np.repeat(first, length)
    value = (raw[at].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[place]
    words = mix64(np.add.reduceat(value, first) + np.uint64(_GOLD))
    return words, np.searchsorted(start, off)


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles in order, with the index of each text's first shingle."""
    count = np.diff(first)
    has = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out = np.concatenate(([0], np.cumsum(has)))
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    begin = np.repeat(first[:-1], has) + (np.arange(out[-1]) - np.repeat(out[:-1], has))
    span = np.repeat(np.minimum(count, n), has)
    h = np.full(int(out[-1]), 0, np.uint64)
    for k in range(n):
        live = span > k
        if live.all():
            h = mix64(h * np.uint64(_PRIME) + words[begin + k] + np.uint64(k + 1))
        else:
            h[live] = mix64(h[live] * np.uint64(_PRIME) + words[begin[live] + k] + np.uint64(k + 1))
    return h, out


def distinct_shingles(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles in ascending order, with the offsets of the texts."""
    h, first = shingle_hashes(*word_hashes(col), n)
    count = np.diff(first)
    parts, sizes = [], np.zeros(len(count), np.int64)
    for i in np.flatnonzero(count):
        s = np.sort(h[first[i] : first[i + 1]])
        if len(s) > 1:
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        parts.append(s)
        sizes[i] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def set_digest(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digest of each set of 64-bit values (two wrapping sums of differently mixed
    values), 0 for an empty set. Equal sets have equal digests whatever their order."""
    n = len(first) - 1
    out = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    live = np.flatnonzero(np.diff(first))
    if len(live):
        for o, salt in zip(out, (0x1234567, 0x89ABCDEF)):
            o[live] = np.add.reduceat(mix64(values + np.uint64(salt)), first[live])
    return out
