"""Operator 1: n-gram Jaccard self-join (rare-first prefix filtering, PPJoin+ style).

Documents are similar if their sets of word ``n``-grams have a Jaccard similarity of at least
``threshold``. Candidate generation is exact, not approximate:

1. One pass over the texts makes the size and a 128-bit digest of each document's shingle set, and a
   table of shingle frequencies. Equal sets are one *class*. A class is named by 64 bits of its
   digest; where two classes would share a name, by the other 64.
2. *Prefix filter*: shingles are put in one global order, rare ones first; two sets that reach the
   threshold share one of the first ``size - ceil(t size) + 1``. Only these are shuffled, packed
   (see ``pairing``). Tasks send each class once, whatever the number of its copies.
3. *Length* and *positional filter*: sets a and b need an overlap o of ``t / (1 + t) (|a| + |b|)``, so at
   most ``o - DEEP`` of their common shingles lie after the first ``size - o + DEEP`` of either. Only matches
   before are counted, and a pair needs ``DEEP`` of them (o, if that is less). Prefixes are longer
   by ``DEEP - 1`` for it.
4. Each distinct pair is looked at once. Pairs are grouped in blocks by the smallest partner, so that
   a group of copies ships every text once rather than once per pair; heavy blocks are cut.
5. *Suffix filter*: histograms of ranges of the hash space bound the overlap that two sets can have
   outside their matches too, before the pair is verified on the whole sets.

The frequency table only orders shingles and spreads frequent ones. Its size is fixed, it is all
that is broadcast, and collisions in it can cost time but never a pair.

``groups(docs)`` returns one row for each document: ``doc_id``, ``class_id`` (smallest ``doc_id`` of its
connected group of similar documents, its own if there is none), ``links`` (number of other documents
that are similar to it, copies included) and ``best`` (the highest similarity to one of them, 6 digits,
null without). Links are counted where they are verified, so pairs of a group of copies are never
written. ``connected(docs)`` returns ``doc_id`` and ``class_id`` alone, without the work of a pair for each link: a first pass
links each set with the few next in size at each hash, a second one looks only at pairs of sets that the
first has not connected. ``similar_pairs(docs)`` returns pairs ``doc_a < doc_b, jaccard``: a class as a star of its
smallest member, and all pairs of the smallest members of two classes. ``all_pairs`` expands it.

Edge cases: null, empty and punctuation-only texts have no shingles and pair with nothing; texts
shorter than ``n`` words are one shingle; rows with a null ``doc_id`` are ignored; repeated rows count
once; a ``doc_id`` that repeats with several texts joins their groups, has the sum of their links,
and never pairs with itself, except that ``links`` counts its own similar texts; other
columns are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pairing
from .common import cut, flat, join_classes, release, slices, split_partitions
from .components import components
from .textkit import distinct_shingles, set_digest

NGRAM, THRESHOLD, DEEP = 3, 0.55, 8
#: Cells of the suffix filter's histogram, and pairs that are compared at a time.
CELLS, PAIRS_AT_ONCE = 128, 20_000
#: Sets behind it that a set meets at a hash in the first pass of ``connected``.
NEAR = 4
#: Members of a class that one row of the expansion holds; two such rows give at most PART^2 pairs.
PART = 256

_LINKS, _PAIRS = "name long, links long, best double, root long", "a long, b long, jaccard double"


def _profile(n: int):
    def run(batches):
        counter = pairing.Counter()
        for batch in batches:
            ids, text = flat(batch, "doc_id"), flat(batch, "text")
            for lo, hi in slices(text):
                values, first = distinct_shingles(text.slice(lo, hi - lo), n)
                size = np.diff(first)
                live = np.flatnonzero(size)
                if not len(live):
                    continue
                counter.add(values >> np.uint64(64 - pairing.BITS))
                d1, d2 = set_digest(values, first)
                yield pairing.profile_rows(np.asarray(ids.slice(lo, hi - lo))[live], size[live], d1[live], d2[live])
        yield from counter.rows()

    return run


def _named(text: pa.Array, n: int, clash: np.ndarray):
    """Names, values and offsets of the sets of a column."""
    values, first = distinct_shingles(text, n)
    d1, d2 = set_digest(values, first)
    return (np.where(np.isin(d1, clash), d2, d1) if len(clash) else d1), values, first


def _prefixes(n: int, threshold: float, table, parts: int, clash: np.ndarray):
    def run(batches):
        rank, grid = table.value
        seen, packer = set(), pairing.Packer(parts, grid)
        shift = np.uint64(64 - pairing.BITS)
        for batch in batches:
            text = flat(batch, "text")
            for lo, hi in slices(text):
                names, values, first = _named(text.slice(lo, hi - lo), n, clash)
                size, h, keep = np.diff(first), values >> shift, []
                key = rank[(h & np.uint64(pairing.COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(pairing.BITS) | h
                who = []
                for i, name in enumerate(names.tolist()):
                    if size[i] and name not in seen:
                        seen.add(name)
                        who.append(i)
                        own = np.sort(key[first[i] : first[i + 1]])
                        keep.append(own[: size[i] - max(1, int(np.ceil(threshold * size[i] - 1e-9))) + DEEP])
                if who:
                    long = np.array([len(k) for k in keep])
                    pos = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
                    yield from packer.add(names[who], size[who], np.repeat(np.arange(len(who)), long), np.concatenate(keep) & np.uint64((1 << pairing.BITS) - 1), pos.astype(np.uint32))
        yield from packer.flush()

    return run


def _overlap(values: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """|A and B| of pairs of sets, given as indexes; pairs are sorted by a."""
    if not len(a):
        return np.zeros(0, np.int64)
    code = np.unique(values, return_inverse=True)[1].ravel()
    mark, size = np.zeros(int(code.max(initial=0)) + 1, np.int8), np.diff(first)
    out = np.zeros(len(a), np.int64)
    at = np.append(np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))), len(a))
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        x = a[lo]
        mark[code[first[x] : first[x + 1]]] = 1
        for s in range(lo, hi, 1000):
            y = b[s : min(s + 1000, hi)]
            ends = np.cumsum(size[y])
            where = np.repeat(first[y] - ends + size[y], size[y]) + np.arange(ends[-1])
            out[s : s + len(y)] = np.add.reduceat(mark[code[where]], ends - size[y], dtype=np.int64)
        mark[code[first[x] : first[x + 1]]] = 0
    return out


def _verify(n: int, threshold: float, clash: np.ndarray, links: bool):
    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        names, values, sizes, members = [], [], [], []
        for batch in texts.combine_chunks().to_batches():
            text = flat(batch, "text")
            for lo, hi in slices(text):
                name, value, first = _named(text.slice(lo, hi - lo), n, clash)
                size = np.diff(first)
                own = name == np.asarray(flat(batch, "name").slice(lo, hi - lo)).view(np.uint64)  # not another text of that document
                names.append(name[own])
                values.append(value[np.repeat(own, size)])
                sizes.append(size[own])
                members.append(np.asarray(flat(batch, "m").slice(lo, hi - lo))[own])
        names, values, sizes, members = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (names, values, sizes, members))
        first = np.concatenate(([0], np.cumsum(sizes)))
        order = np.argsort(names, kind="stable")
        a, b = (order[np.searchsorted(names[order], np.asarray(pairs[x]).view(np.uint64))] for x in "ab")
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        where = np.repeat(np.arange(len(sizes)), sizes) * CELLS + (values >> np.uint64(57)).astype(np.int64)
        cells = np.bincount(where, minlength=len(sizes) * CELLS).astype(np.int32).reshape(-1, CELLS)
        need = np.ceil(threshold / (1 + threshold) * (sizes[a] + sizes[b]) - 1e-9)
        live = np.concatenate([np.minimum(cells[a[s : s + PAIRS_AT_ONCE]], cells[b[s : s + PAIRS_AT_ONCE]]).sum(1) for s in range(0, len(a), PAIRS_AT_ONCE)]) >= need if len(a) else np.zeros(0, bool)
        a, b, by = a[live], b[live], by[live]
        both = _overlap(values, first, a, b)
        jaccard = both / (sizes[a] + sizes[b] - both)
        good = jaccard >= threshold - 1e-12
        a, b, by, jaccard = a[good], b[good], by[good], jaccard[good].round(6)
        if not links:
            return pa.table({x: pairs[x].take(pa.array(by)) for x in "ab"} | {"jaccard": jaccard})
        k = len(names)
        count, best = np.zeros(k, np.int64), np.zeros(k)
        for x, y in ((a, b), (b, a)):
            np.add.at(count, x, members[y])
            np.maximum.at(best, x, jaccard)
        root, hit = pairing.roots(a, b, k), np.flatnonzero(count)
        return pa.table({"name": names[hit].view(np.int64), "links": count[hit], "best": best[hit], "root": names[root[hit]].view(np.int64)})

    return run


def _joined(docs: DataFrame, n: int, threshold: float, links: bool, whole: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (``doc_id, name``), classes (``name, rep, n, m``: smallest document, size, number of members)
    and what ``_verify`` found of pairs of classes; unless ``whole``, only what connects them, as (name, root)."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    profile = cut(docs.mapInArrow(_profile(n), pairing.PROFILE))
    counts = pairing.frequency_table(profile)
    table = spark.sparkContext.broadcast((pairing.rank_of(counts), pairing.grid_of(counts)))
    members, classes, clash = pairing.classes(profile)
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = pairing.parts_for(int(total * (1 - threshold)), split_partitions(spark))

    def need(na, nb):
        return np.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9)

    def test(na, nb, x, y):
        o = need(na, nb)
        return np.maximum(x - na, y - nb) < np.minimum(DEEP, o) - o

    def verified(**limits):
        rows = docs.select("text").mapInArrow(_prefixes(n, threshold, table, parts, clash), pairing.ROW)
        pairs = cut(pairing.candidates(rows, parts, lambda na, nb: na >= threshold * nb - 1e-9, test, lambda met, na, nb: met >= np.minimum(DEEP, need(na, nb)), **limits))
        del rows
        release(spark)

        pairs = cut(pairing.blocks(pairs).select("key", "a", "b"))
        release(spark)
        texts = pairing.payload(pairs, {"a": classes, "b": classes}, docs, "text")
        found = cut(pairs.groupBy("key").cogroup(texts.groupBy("key")).applyInArrow(_verify(n, threshold, clash, links), _LINKS if links else _PAIRS))
        del texts
        release(spark)
        return found

    if whole:
        return members, classes, verified()
    near = cut(components(verified(near=NEAR).select("name", "root"), "name", "root"))
    known = pairing.known_groups(near)
    found = verified(known=known and spark.sparkContext.broadcast(known)).select("name", "root")
    return members, classes, near.toDF("name", "root").unionByName(found)


def _linked(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(``name, group``) of the classes that ``edges`` (name, root) or a document with several texts connect."""
    several = members.groupBy("doc_id").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).filter("lo < hi")
    same = members.join(several, "doc_id").filter("name > lo").select("name", F.col("lo").alias("root"))
    return components(edges.unionByName(same), "name", "root").withColumnsRenamed({"node": "name", "component": "group"})


def connected(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id`` of documents with shingles, as ``groups`` gives them; see the module text."""
    members, classes, edges = _joined(docs, n, threshold, links=True, whole=False)
    whole = classes.select("name", "rep", "m").join(_linked(members, edges), "name", "left").withColumn("group", F.coalesce("group", "name"))
    whole = cut(whole.join(whole.groupBy("group").agg(F.min("rep").alias("class_id")), "group").select("name", "m", "class_id"))
    return join_classes(members, whole, "name").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def groups(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: its group, its links and its highest similarity; see the module text."""
    members, classes, found = _joined(docs, n, threshold, links=True)
    per = found.groupBy("name").agg(F.sum("links").alias("links"), F.max("best").alias("best"))
    linked = _linked(members, found.select("name", "root"))
    whole = classes.select("name", "rep", "m").join(per, "name", "left").join(linked, "name", "left").withColumn("group", F.coalesce("group", "name"))
    low = whole.groupBy("group").agg(F.min("rep").alias("class_id"))
    whole = cut(whole.join(low, "group").select("name", "m", "class_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), F.when(F.col("m") > 1, 1.0).otherwise(F.col("best")).alias("best")))
    each = join_classes(members, whole, "name").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"), F.max("best").alias("best"))
    alone = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    return alone.join(each, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), "best")


def similar_pairs(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """Stars of classes and pairs of their smallest members; see the module text."""
    members, classes, near = _joined(docs, n, threshold, links=False)
    stars = join_classes(members, classes, "name").filter("doc_id <> rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    for x in "ab":
        near = near.join(classes.select(F.col("name").alias(x), F.col("rep").alias(f"rep_{x}")), x)
    near = near.filter("rep_a <> rep_b").select(F.least("rep_a", "rep_b").alias("doc_a"), F.greatest("rep_a", "rep_b").alias("doc_b"), "jaccard")
    return stars.unionByName(near).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def all_pairs(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """Every pair of documents with n-gram Jaccard similarity >= ``threshold``, copies included:
    classes and verified pairs of classes are joined back to their members. Members travel in parts
    of bounded size, so that a large class is spread over tasks."""
    members, _, near = _joined(docs, n, threshold, links=False)
    parts = members.withColumn("part", F.expr(f"(row_number() over (partition by name order by doc_id) - 1) div {PART}"))
    parts = cut(parts.groupBy("name", "part").agg(F.collect_list("doc_id").alias("ids")))
    side = lambda x: parts.select(F.col("name").alias(x), F.col("part").alias(f"part_{x}"), F.col("ids").alias(f"ids_{x}"))
    inner = side("a").join(side("b").withColumnRenamed("b", "a"), "a").filter("part_a <= part_b").select("ids_a", "ids_b", F.lit(1.0).alias("jaccard"))
    outer = near.join(side("a"), "a").join(side("b"), "b").select("ids_a", "ids_b", "jaccard")
    both = inner.unionByName(outer).repartition(F.xxhash64("ids_a", "ids_b"))
    pairs = both.select(F.explode("ids_a").alias("a"), "ids_b", "jaccard").select("a", F.explode("ids_b").alias("b"), "jaccard").filter("a <> b")
    return pairs.groupBy(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).agg(F.max("jaccard").alias("jaccard"))
