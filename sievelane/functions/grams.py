"""Distinct character n-grams of many texts at once, by numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHINGLE = 4
#: A place behind the end of a text that is shorter than a gram.
NONE = 0x110000
#: Characters of text that are cut into grams at a time.
AT_ONCE = 1 << 18


def groups(texts: list[str], limit: int) -> Iterator[list[str]]:
    """Runs of texts that hold about ``limit`` characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def distinct(texts: list[str]) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """(owner, code) of the distinct grams of each text, ascending; a shorter text is its own gram, an empty
    one has none. The function turns codes into rows of code points. Characters are numbered as they
    occur, so that the text's index and four characters mostly fit into one 64-bit number."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), lambda code: np.zeros((0, SHINGLE), "<u4")
    size = np.where(length >= SHINGLE, length - SHINGLE + 1, np.minimum(length, 1))
    owner = np.repeat(np.arange(len(texts)), size)
    at = np.repeat(np.cumsum(length) - length - np.cumsum(size) + size, size) + np.arange(len(owner))
    left = np.minimum(length, SHINGLE)[owner]
    alphabet = np.unique(flat)
    bits = int(len(alphabet)).bit_length()
    if SHINGLE * bits + int(len(texts)).bit_length() > 64:
        return _wide(flat, owner, at, left)
    table = np.zeros(int(alphabet[-1]) + 1, np.uint64)
    table[alphabet] = np.arange(1, len(alphabet) + 1)
    rank = np.concatenate((table[flat], np.zeros(SHINGLE, np.uint64)))
    code = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        code = code << np.uint64(bits) | rank[at + k]
    short = np.flatnonzero(left < SHINGLE)
    lost = ((SHINGLE - left[short]) * bits).astype(np.uint64)
    code[short] = code[short] >> lost << lost
    both = np.sort(owner.astype(np.uint64) << np.uint64(SHINGLE * bits) | code)
    both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    points = np.concatenate((np.array([NONE], "<u4"), alphabet))

    def cells(code: np.ndarray) -> np.ndarray:
        return np.stack([points[(code >> np.uint64(k * bits) & np.uint64((1 << bits) - 1)).astype(np.int64)] for k in range(SHINGLE - 1, -1, -1)], 1)

    return (both >> np.uint64(SHINGLE * bits)).astype(np.int64), both & np.uint64((1 << SHINGLE * bits) - 1), cells


def _wide(flat: np.ndarray, owner: np.ndarray, at: np.ndarray, left: np.ndarray):
    """The same for texts with very many different characters."""
    cells = np.concatenate((flat, np.zeros(SHINGLE, "<u4")))[at[:, None] + np.arange(SHINGLE)]
    cells[np.arange(SHINGLE) >= left[:, None]] = NONE
    wide = cells.astype(np.uint64)
    high, low = wide[:, 0] << np.uint64(21) | wide[:, 1], wide[:, 2] << np.uint64(21) | wide[:, 3]
    order = np.lexsort((low, high))
    new = np.concatenate(([True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])))
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    kinds = cells[order[new]]
    pairs = np.unique(owner * np.int64(len(kinds)) + code)
    return pairs // len(kinds), (pairs % len(kinds)).astype(np.uint64), lambda code: kinds[code.astype(np.int64)]


@F.pandas_udf(T.LongType())
def shingle_count(texts: pd.Series) -> pd.Series:
    """Number of distinct grams, null for null."""
    out = [np.bincount(distinct(some)[0], minlength=len(some)) for some in groups(["" if t is None else t for t in texts], AT_ONCE)]
    return pd.Series(np.concatenate(out) if out else np.zeros(0, np.int64), dtype="Int64").mask(texts.isna().to_numpy())
