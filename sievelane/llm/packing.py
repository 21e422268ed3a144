"""Operator 7: best-fit packing of documents into sequences by non-negative least squares.

Pieces of documents are packed into sequences of ``CAPACITY`` tokens without being split further
and without mixing order inside a piece. The plan is made on a histogram of fixed size, so its
cost doesn't depend on the number of documents:

1. A document longer than ``CAPACITY`` gives full pieces, each a sequence of its own, and a rest.
2. The other pieces are counted by length in ``BINS`` bins of equal width (rounded up).
3. *Patterns* are all multisets of up to ``DEPTH`` bins that fill a sequence exactly, and each bin
   alone. Non-negative least squares fits repeat counts of patterns to the histogram; a weight makes short
   lengths, which are easy to place, matter less. Counts are rounded, at most to what the histogram
   still offers, and the residual histogram is fitted again until a round places nothing.
4. What is left is packed best-fit decreasing on the histogram: patterns again, each with the
   number of times that it fits. Every piece now has a slot in some pattern.
5. Spark numbers the pieces of each bin and looks the number up in the slots of that bin, which
   gives the sequence and the offset. Nothing is gathered on the driver but the histogram.

Lengths are ``ceil(characters / 4)`` tokens, the convention of this library's size estimates;
``length`` takes any other column or expression.

``pack(docs)`` returns one row for each piece: ``doc_id, piece, start, n_tokens, pack_id, slot,
offset`` (start: first token of the piece in its document; offset: its first token in the sequence).

Edge cases: null and empty texts and documents of length 0 have no pieces; repeated rows and rows
with a null ``doc_id`` are packed each by itself; ties are broken by ``doc_id``; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

CAPACITY, BINS, DEPTH = 2048, 64, 3
#: Cells in which the pieces of a bin are numbered, at least, and documents for which there is one more.
CELLS, CELL_ROWS = 256, 100_000
TOKENS = "cast(ceil(length(text) / 4) as bigint)"


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Lawson-Hanson active-set solution of min |a x - b| with x >= 0."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    ata, atb = a.T @ a, a.T @ b
    tol = 1e-10 * max(1.0, float(np.abs(atb).max(initial=0)))
    for _ in range(rounds or 3 * n):
        w = atb - ata @ x
        w[passive] = -np.inf
        if not n or w.max() <= tol:
            break
        passive[int(w.argmax())] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.lstsq(ata[np.ix_(at, at)], atb[at], rcond=None)[0]
            if s.min(initial=1) > 0:
                x[:] = 0
                x[at] = s
                break
            bad = at[s <= 0]
            step = np.min(x[bad] / np.maximum(x[bad] - s[s <= 0], 1e-300))
            x[at] += step * (s - x[at])
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                break
    return x


def patterns(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of 1 to ``depth`` lengths 1..bins that sum to ``bins``, and each length alone."""
    exact = [c for k in range(1, depth + 1) for c in combinations_with_replacement(range(1, bins + 1), k) if sum(c) == bins]
    return exact + [(i,) for i in range(1, bins)]


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats): every unit of the histogram (counts of lengths 1..n) in one slot."""
    bins = len(histogram)
    left = histogram.astype(np.int64).copy()
    out: dict[tuple[int, ...], int] = {}
    pats = patterns(bins, depth)
    a = np.zeros((bins, len(pats)))
    for j, p in enumerate(pats):
        for i in p:
            a[i - 1, j] += 1
    full = a[:, : len(pats) - bins + 1]
    weight = np.where(np.arange(1, bins + 1) <= bins // 8, 0.1, 1.0)[:, None]
    while left.any():
        x = nnls(full * weight, left * weight[:, 0], rounds=4 * bins)
        placed = 0
        for j in np.argsort(-x):
            if x[j] < 0.5:
                break
            need = full[:, j]
            r = int(min(round(x[j]), (left[need > 0] // need[need > 0]).min()))
            if r > 0:
                out[pats[j]] = out.get(pats[j], 0) + r
                left -= (r * need).astype(np.int64)
                placed += r
        if placed == 0:
            break
    while left.any():  # best-fit decreasing on counts
        free, pat = bins, []
        take = np.zeros(bins, np.int64)
        while True:
            fits = np.flatnonzero((left - take > 0) & (np.arange(1, bins + 1) <= free))
            if not len(fits):
                break
            i = int(fits[-1])
            k = int(min(free // (i + 1), left[i] - take[i]))
            take[i] += k
            pat += [i + 1] * k
            free -= k * (i + 1)
        r = int((left[take > 0] // take[take > 0]).min())
        key = tuple(sorted(pat))
        out[key] = out.get(key, 0) + r
        left -= r * take
    return sorted(out.items())


def slots(chosen: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(bin, first rank, last rank + 1, first pack, slot) of each place of each pattern."""
    out, at, packs = [], {}, 0
    for p, r in chosen:
        for slot, b in enumerate(p):
            lo = at.get(b, 0)
            out.append((b, lo, lo + r, packs, slot))
            at[b] = lo + r
        packs += r
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, bins: int = BINS, depth: int = DEPTH, length: str | Column = TOKENS) -> DataFrame:
    if capacity % bins:
        raise ValueError("capacity must be a multiple of bins")
    width = capacity // bins
    length = F.expr(length) if isinstance(length, str) else length
    rows = docs.select(F.col("doc_id"), length.alias("n")).filter("n > 0")
    cells = max(CELLS, min(1 << 16, docs.count() // CELL_ROWS))
    rows = rows.withColumn("cell", F.expr(f"cast(pmod(xxhash64(doc_id, n), {cells}) as int)"))
    piece = F.explode(F.expr(f"sequence(0L, (n - 1) div {capacity})"))
    rows = rows.select("doc_id", "n", "cell", piece.alias("piece")).withColumn("n_tokens", F.expr(f"least(n - piece * {capacity}, {capacity})"))
    rows = rows.withColumn("bin", F.expr(f"cast(ceil(n_tokens / {width}) as int)"))
    rows = cut(rows.withColumn("local", F.expr("row_number() over (partition by cell, bin order by doc_id, n, piece)")))
    sizes = rows.groupBy("cell", "bin").count()
    histogram = np.zeros(bins, np.int64)
    for r in sizes.groupBy("bin").agg(F.sum("count").alias("n")).collect():  # a row for each bin
        histogram[r.bin - 1] = r.n
    chosen = plan(histogram, depth)
    spark = docs.sparkSession
    base_df = sizes.select("cell", "bin", F.expr("sum(count) over (partition by bin order by cell) - count").alias("base"))
    # a full sequence is a pattern with one slot of the largest bin, so it needs no case of its own
    slot_df = spark.createDataFrame(slots(chosen), T.StructType([T.StructField(c, T.LongType() if c in ("lo", "hi", "pack") else T.IntegerType()) for c in ("bin", "lo", "hi", "pack", "slot")]))
    placed = rows.join(base_df, ["cell", "bin"]).withColumn("rank", F.col("base") + F.col("local") - 1)
    placed = placed.join(F.broadcast(slot_df), "bin").filter("rank >= lo and rank < hi")
    placed = placed.withColumn("pack_id", F.col("pack") + F.col("rank") - F.col("lo"))
    offset = F.expr("coalesce(sum(n_tokens) over (partition by pack_id order by slot rows between unbounded preceding and 1 preceding), 0L)")
    return placed.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), "n_tokens", "pack_id", "slot", offset.alias("offset"))
