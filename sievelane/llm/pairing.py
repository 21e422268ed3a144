"""Candidate pairs of sets that share a hash, for the operators that join a table with itself.

A *set* has a 64-bit name, a size and a list of (hash, position). Rows are not shuffled one by one:
a task packs what it has for a partition of the hash space into one binary value, in which the name
and the size of a set stand once. A partition is one numpy sort by (hash, size); sets that share a
hash lie side by side and, since sizes ascend, a set's partners end where the size test fails.

Copies of one set have one name; they meet in a partition and count once there. A hash of which the
frequency table expects more than ``HOT`` sets is spread over a triangle of cells: the sets are
divided in g parts, cell (i, j) gets parts i and j and pairs one with the other, so no task holds
more than about 2 ``HOT`` sets of one hash, and no pair is lost.

Where only connected groups are asked for, pairs of sets that are known to be connected are passed over:
a run of them is one step, so a group of k sets costs about k steps at a hash and not k^2 / 2.

Within a partition a hash is compared by 32 of its bits. Partitions have a bounded number of rows,
so chance matches stay rare at any size; they cost a comparison and never a pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, flat
from .textkit import mix64

#: Rows that one partition should hold, rows that a task packs at a time, and sets a hash may have.
PART_ROWS, PACK_ROWS, HOT = 1 << 21, 1 << 19, 4096
#: Weight (in hashes) of either side of one block of pairs, about 8 bytes each; what a set weighs besides;
#: sets of either side of a block with more than BLOCK_SETS^2 pairs.
BLOCK_WEIGHT, SET_WEIGHT, BLOCK_SETS = 1 << 19, 128, 1 << 9
#: Names whose connected group is known beforehand, 12 bytes each.
KNOWN = 1 << 20
#: Candidate pairs that a task holds before it packs them.
HELD_PAIRS = 1 << 20
BITS = 54
#: Counters of the frequency table (4 bytes each), and how many of them one shuffled row holds.
COUNTERS, CHUNK = 1 << 20, 1 << 14
#: Names that two classes of the corpus may claim; 64 bits give about one at 5 billion classes.
CLASHES = 100_000
ROW = "part int, blob binary"
PROFILE = "doc_id long, n int, d1 long, d2 long, chunk int, lane int, counts binary"
#: Marks the size of a set that is a query.
ASKED = np.uint32(1 << 31)
_LOW = np.uint64(0xFFFFFFFF)


def profile_rows(ids: np.ndarray, size: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(ids), pa.int32())
    columns = [pa.array(ids, pa.int64()), pa.array(size, pa.int32()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), none, none, pa.nulls(len(ids), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "d1", "d2", "chunk", "lane", "counts"])


class Counter:
    """Counts of a task's hashes by their low bits, as extra rows of its profile."""

    def __init__(self):
        self.table = np.zeros(COUNTERS, np.uint64)

    def add(self, h: np.ndarray) -> None:
        self.table += np.bincount((h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint64)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.table.any():
            k, task = COUNTERS // CHUNK, TaskContext.get()
            blank, size, lane = pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), np.full(k, (task.partitionId() if task else 0) % 256)
            counts = [zlib.compress(c.tobytes(), 1) for c in np.minimum(self.table, 2**32 - 1).astype(np.uint32).reshape(k, CHUNK)]  # a few bits each
            yield pa.RecordBatch.from_arrays([blank, size, blank, blank, pa.array(range(k), pa.int32()), pa.array(lane, pa.int32()), pa.array(counts, pa.binary())], names=["doc_id", "n", "d1", "d2", "chunk", "lane", "counts"])


def _add_chunks(width: int):
    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, lane, c in zip(flat(batch, "chunk").to_pylist(), flat(batch, "lane").to_pylist(), flat(batch, "counts")):
                at = k, lane % width
                total[at] = total.get(at, 0) + np.frombuffer(zlib.decompress(c.as_buffer()), np.uint32).astype(np.uint64)
        if total:
            sums = [zlib.compress(np.minimum(c, 2**32 - 1).astype(np.uint32).tobytes(), 1) for c in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.int32()), pa.array([x for _, x in total], pa.int32()), pa.array(sums, pa.binary())], names=["chunk", "lane", "counts"])

    return run


def frequency_table(profile: DataFrame) -> np.ndarray:
    """Occurrences of hashes by their low bits, over all documents; added up in a tree."""
    chunks = profile.filter("chunk is not null").select("chunk", "lane", "counts")
    for width in (16, 1):
        chunks = chunks.repartition("chunk", F.expr(f"lane % {width}")).mapInArrow(_add_chunks(width), "chunk int, lane int, counts binary")
    out = np.zeros(COUNTERS, np.uint32)
    for r in chunks.collect():  # COUNTERS counters, whatever the corpus
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(r.counts), np.uint32)
    return out


def rank_of(counts: np.ndarray) -> np.ndarray:
    """The order of hashes, rare ones first, in 10 bits."""
    return np.minimum(32 * np.log2(1.0 + counts), 1023).astype(np.uint16)


def classes(profile: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Members (``doc_id, name``, once each), classes of equal digests (``name, rep, n, m``: smallest member,
    size, number of members) and the first halves of digests that don't name their class."""
    members = profile.filter("doc_id is not null").select("doc_id", "n", "d1", "d2").distinct()
    found = cut(members.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("m")))
    twice = found.groupBy("d1").count().filter("count > 1").limit(CLASHES + 1).toArrow()
    if len(twice) > CLASHES:
        raise ValueError("too many sets with equal 64-bit digests")
    clash = np.asarray(twice["d1"], np.int64)
    name = F.when(F.col("d1").isin(clash.tolist()), F.col("d2")).otherwise(F.col("d1")) if len(clash) else F.col("d1")
    return members.select("doc_id", name.alias("name")), found.select(name.alias("name"), "rep", "n", "m"), clash.view(np.uint64)


def parts_for(rows: int, least: int) -> int:
    return max(1, least, -(-rows // PART_ROWS))


def grid_of(counts: np.ndarray) -> np.ndarray:
    """Parts in which the sets of a cell's hashes are divided. What a cell holds by chance is taken
    off; the result only spreads work."""
    return np.clip(-(-(counts.astype(np.int64) - 2 * int(counts.mean())) // HOT), 1, 1 << 15).astype(np.uint16)


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, so that high zeros compress to nothing."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel()


class Packer:
    def __init__(self, parts: int, grid: np.ndarray | None = None):
        self.parts, self.grid, self.held, self.rows = parts, grid, [], 0

    def add(self, names: np.ndarray, sizes: np.ndarray, owner: np.ndarray, h: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``owner`` ascends and points into names and sizes; ``h`` has ``BITS`` bits."""
        self.held.append((names, sizes, owner, h, pos))
        self.rows += len(h)
        if self.rows >= PACK_ROWS:
            yield from self.flush()

    def _spread(self, names, owner, h, pos):
        g = self.grid[(h & np.uint64(len(self.grid) - 1)).astype(np.int64)].astype(np.int64)
        hot = g > 1
        if not hot.any():
            return owner, h, pos
        own, hh, pp, gg = owner[hot], h[hot], pos[hot], g[hot]
        mine = (mix64(names[own] + np.uint64(99)) % gg.astype(np.uint64)).astype(np.int64)
        at = np.repeat(np.arange(len(gg)), gg)
        other = np.arange(len(at)) - np.repeat(np.cumsum(gg) - gg, gg)
        lo, hi = np.minimum(mine[at], other), np.maximum(mine[at], other)
        side = np.where(lo == hi, 0, np.where(mine[at] == lo, 1, 2)).astype(np.uint32)
        cell = mix64(hh[at] + mix64((lo << 32 | hi).astype(np.uint64))) >> np.uint64(64 - BITS)
        owner, h, pos = np.concatenate((owner[~hot], own[at])), np.concatenate((h[~hot], cell)), np.concatenate((pos[~hot], pp[at] | side << np.uint32(30)))
        order = np.argsort(owner, kind="stable")
        return owner[order], h[order], pos[order]

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        base = np.cumsum([0] + [len(x[0]) for x in self.held])
        names, sizes = (np.concatenate([x[i] for x in self.held]) for i in (0, 1))
        owner = np.concatenate([x[2] + b for x, b in zip(self.held, base)])
        h, pos = (np.concatenate([x[i] for x in self.held]) for i in (3, 4))
        self.held, self.rows = [], 0
        if self.grid is not None:
            owner, h, pos = self._spread(names, owner, h, pos)
        part = ((h >> np.uint64(BITS - 32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.uint16 if self.parts <= 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        part, owner, h, pos = part[order], owner[order], (h & _LOW)[order].astype("<u4"), pos[order]
        begin = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1]))))
        count, who = np.diff(np.append(begin, len(part))), owner[begin]
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        ends, set_at = np.append(at[1:], len(part)), np.searchsorted(begin, at)
        set_end = np.append(set_at[1:], len(begin))
        blobs = [
            np.array([t - s, b - a], "<u4").tobytes() + names[who[s:t]].astype("<u8").tobytes() + _planes(sizes[who[s:t]]) + _planes(count[s:t]) + h[a:b].tobytes() + _planes(pos[a:b])
            for a, b, s, t in zip(at.tolist(), ends.tolist(), set_at.tolist(), set_end.tolist())
        ]
        yield pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])


def _unpack(batches: Iterator[pa.RecordBatch]):
    """names, sizes, owner, h, pos of all rows of a partition; owner points into names."""
    out, base = [], 0
    for batch in batches:
        for v in flat(batch, "blob"):
            raw = v.as_buffer().to_pybytes()
            k, r = np.frombuffer(raw, "<u4", 2).tolist()
            at = np.cumsum([8, 8 * k, 4 * k, 4 * k, 4 * r, 4 * r]).tolist()
            count = _numbers(raw[at[2] : at[3]], k)
            out.append((np.frombuffer(raw, "<u8", k, 8), _numbers(raw[at[1] : at[2]], k), np.repeat(np.arange(base, base + k), count), np.frombuffer(raw, "<u4", r, at[3]), _numbers(raw[at[4] : at[5]], r)))
            base += k
    return [np.concatenate(x) for x in zip(*out)] if out else None


def _pack_pairs(a: np.ndarray, b: np.ndarray, numbers: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """``numbers``: met, size of a, size of b; the smaller name goes first."""
    turn = a > b
    met, n, m = numbers
    a, b, n, m = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, m, n), np.where(turn, n, m)
    part = ((mix64(a ^ mix64(b)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((b, a, part))
    part, a, b = part[order], a[order], b[order]
    numbers = [x[order] for x in (met, n, m)]
    at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    blobs = [np.array([y - x], "<u8").tobytes() + a[x:y].tobytes() + b[x:y].tobytes() + b"".join(_planes(z[x:y]) for z in numbers) for x, y in zip(at.tolist(), [*at[1:].tolist(), len(part)])]
    return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])


Test = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def known_groups(linked: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Sorted names and small numbers of their groups, of (``node``, ``component``): those of the largest groups,
    at most ``KNOWN`` names. What is left out costs comparisons, never a pair."""
    sizes = linked.groupBy("component").count()
    least, names = None, 0
    for r in sizes.groupBy("count").agg(F.count("*").alias("groups")).orderBy(F.desc("count")).toLocalIterator():
        names += r["count"] * r.groups
        if least is not None and names > KNOWN:
            break
        least = r["count"]
    if least is None:
        return None
    got = linked.join(sizes.filter(F.col("count") >= least), "component").select("node", "component").limit(KNOWN).toArrow()
    names, label = np.asarray(got["node"]).view(np.uint64), np.unique(np.asarray(got["component"]), return_inverse=True)[1].ravel()
    order = np.argsort(names)
    return names[order], label[order].astype(np.uint32)


def _match(reach: Callable[[np.ndarray, np.ndarray], np.ndarray], test: Test, parts: int, search: bool, near: int | None = None, known=None):
    def run(batches: Iterator[pa.RecordBatch]):
        got = _unpack(batches)
        if got is None:
            return
        names, sizes, owner, h, pos = got
        order = np.lexsort((names, sizes & ~ASKED))
        again = np.concatenate(([False], (names[order][1:] == names[order][:-1]) & (sizes[order][1:] == sizes[order][:-1])))
        code = np.empty(len(order), np.int64)
        code[order] = np.cumsum(~again) - 1
        names, sizes = names[order][~again], sizes[order][~again]
        key = h.astype(np.uint64) << np.uint64(32) | code[owner].astype(np.uint64)
        order = np.argsort(key)
        key, pos = key[order], pos[order]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))  # copies of a set, from several tasks
        key, pos = key[fresh], pos[fresh]
        h, c = (key >> np.uint64(32)).astype(np.int64), (key & _LOW).astype(np.int64)
        side, pos, n, asked = pos >> np.uint32(30), (pos & np.uint32((1 << 30) - 1)).astype(np.int64), (sizes & ~ASKED).astype(np.int64)[c], (sizes >= ASKED)[c]
        if known is not None:
            table, label = known.value
            at = np.minimum(np.searchsorted(table, names), len(table) - 1)
            group = np.where(table[at] == names, label[at], len(table) + np.arange(len(names)))[c]
            ends = np.append(np.flatnonzero((h[1:] != h[:-1]) | (group[1:] != group[:-1])) + 1, len(h))
            after = np.repeat(ends, np.diff(ends, prepend=0))  # the first row behind a run of one group
        held, many = [], 0

        def out():
            p, met = np.unique(np.concatenate(held), return_counts=True)
            a, b = p >> 32, p & 0xFFFFFFFF
            return _pack_pairs(names[a], names[b], [met, sizes[a], sizes[b]], parts)

        i, step = np.flatnonzero(np.concatenate((h[1:] == h[:-1], [False]))), 0
        j = i + 1
        while len(i) and step != near:
            live = j < len(h)
            i, j = i[live], j[live]
            live = h[i] == h[j]
            i, j = i[live], j[live]
            live = reach(n[i], n[j])
            i, j = i[live], j[live]
            good = test(n[i], n[j], pos[i], pos[j]) & ((side[i] == 0) | (side[i] != side[j]))
            if search:
                good &= asked[i] != asked[j]
            if known is not None:
                apart = group[i] != group[j]
                good &= apart
            if good.any():
                held.append(c[i[good]] << 32 | c[j[good]])
                many += len(held[-1])
            if many > HELD_PAIRS:
                yield out()
                held, many = [], 0
            j = j + 1 if known is None else np.where(apart, j + 1, after[j])
            step += 1
        if held:
            yield out()

    return run


def _distinct(keep: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]):
        got = []
        for batch in batches:
            for v in flat(batch, "blob"):
                raw = v.as_buffer().to_pybytes()
                k = int(np.frombuffer(raw, "<u8", 1)[0])
                got.append((np.frombuffer(raw, "<u8", k, 8), np.frombuffer(raw, "<u8", k, 8 + 8 * k), *(_numbers(raw[8 + (16 + 4 * x) * k : 8 + (20 + 4 * x) * k], k) for x in range(3))))
        if got:
            a, b, met, n, m = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            met, n, m = np.add.reduceat(met[order].astype(np.int64), at), n[order][at], m[order][at]
            size = [(x & ~ASKED).astype(np.int64) for x in (n, m)]
            good = keep(met, *size)
            columns = [a[at].view(np.int64), b[at].view(np.int64), *size, n >= ASKED]
            yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in columns], names=["a", "b", "w_a", "w_b", "asked"])

    return run


def candidates(rows: DataFrame, parts: int, reach, test: Test, keep, search: bool = False, near: int | None = None, known=None) -> DataFrame:
    """Distinct pairs of names (a, b) and sizes (w_a, w_b) of sets that share hashes. ``test(n, m, pos, pos)``
    says which matches count, ``keep(met, n, m)`` which pairs stay, given the number of their matches;
    ``reach(n, m)`` for n <= m must stay false as m grows. With ``search``, one of the two is marked as a
    query (``ASKED`` in its size); ``asked`` says whether it is a. With ``near``, a set meets only so many of those
    behind it at each hash; ``known``, a broadcast of ``known_groups``, leaves out pairs inside a group."""
    met = rows.repartitionById(parts, F.col("part")).mapInArrow(_match(reach, test, parts, search, near, known), ROW)
    return met.repartitionById(parts, F.col("part")).mapInArrow(_distinct(keep), "a long, b long, w_a long, w_b long, asked boolean")


def payload(pairs: DataFrame, sides: dict[str, DataFrame], docs: DataFrame, column: str) -> DataFrame:
    """``column`` of the smallest member of each class that a block compares, with the block's ``key``, the
    ``name`` and the number ``m`` of members. ``sides`` has the classes of a and of b."""
    wanted = None
    for x, classes in sides.items():
        one = pairs.select(F.col(x).alias("name"), "key").distinct().join(classes.select("name", "rep", "m"), "name")
        one = one.select(F.col("rep").alias("doc_id"), F.struct("key", "name", "m", F.lit(x).alias("side")).alias("want"))
        wanted = one if wanted is None else wanted.unionByName(one)
    wanted = wanted.groupBy("doc_id").agg(F.collect_set("want").alias("wants"))
    return docs.join(wanted.hint("shuffle_hash"), "doc_id").select(column, F.explode("wants").alias("want")).select("want.*", column)


def blocks(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b, w_a, w_b) with a ``key``: pairs of a block are compared in one task, which
    gets each set once. A block is named by the smallest partner of b; blocks that are too heavy are
    cut into a grid by the weights of their two sides, those with too many pairs by the numbers of their sets."""
    low = pairs.groupBy("b").agg(F.min("a").alias("block"))
    pairs = pairs.join(low, "b")
    weight = pairs.groupBy("block").agg(F.count("*").alias("many"))
    for x in "ab":
        side = pairs.select("block", x, f"w_{x}").distinct().groupBy("block").agg(F.sum(F.col(f"w_{x}") + SET_WEIGHT).alias("w"), F.count("*").alias("sets"))
        cells = F.expr(f"cast(greatest(ceil(w / {float(BLOCK_WEIGHT)}), if(many > {BLOCK_SETS**2}, ceil(sets / {float(BLOCK_SETS)}), 1)) as int)")
        weight = weight.join(side, "block").withColumn(f"cut_{x}", cells).drop("w", "sets")
    heavy = weight.filter("cut_a > 1 or cut_b > 1").drop("many")
    pairs = pairs.join(heavy, "block", "left")
    return pairs.withColumn("key", F.expr("concat_ws(':', block, pmod(xxhash64(a), coalesce(cut_a, 1)), pmod(xxhash64(b), coalesce(cut_b, 1)))")).drop("block", "cut_a", "cut_b")


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of the connected group of each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
