"""Operator 10: document fingerprints, bottom-k sketches of shingle hashes.

The sketch of a set is its ``k`` smallest 64-bit shingle hashes (all, if there are fewer). It is a
function of the set alone, so sketches of parts merge into the sketch of the whole: the ``k``
smallest distinct values of their union. From sketches alone follow estimates of

* the number of distinct shingles: exact below ``k``, else ``(k - 1) / u``, with u the k-th value
  as a fraction of the hash range (relative standard error about ``1 / sqrt(k - 2)``);
* resemblance |A and B| / |A or B|: share of common values among the k smallest of the union;
* containment |A and B| / |A|: share of A's values, up to the smaller of the two largest values
  of full sketches, that B has.

``overlaps(docs, queries)`` gives one row for each document: its sketch, the estimated number of shingles,
``class_id`` (the smallest ``doc_id`` with an equal sketch) and ``copies`` (documents with that sketch). For the
documents that ``queries`` selects it also gives ``links``, the number of other documents that resemble it by
at least ``LEAST``, ``best``, the highest resemblance to one of them, and ``contained``, the highest share of it
that one of them has. A class is sent and compared once. Candidates come from a prefix join (see
``pairing``): values are put in one order, rare ones first; a pair has ``LEAST`` of the values of the longer
sketch in common, so it meets ``DEEP`` times among the first ``size - ceil(LEAST size) + DEEP``, and pairs that
meet less often are dropped.

``search(docs, queries)`` finds, for the documents that ``queries`` selects, all documents of the table with
a resemblance, or a containment either way, of at least ``LEAST``. One of the two must have a common
value in a prefix: if A is contained in B, at least ``LEAST`` of those values of A that lie below B's
end are shared, and these are A's j smallest for some j; so the values that come among the first
``j - ceil(LEAST j) + 1`` of A's j smallest, for any j, miss no pair. No value and no document is capped.
The fixed-size table of frequencies only orders values and spreads frequent ones.

Hashes are shifted by 2^63 into signed integers, which keeps their order in Spark.

Edge cases: null, empty and punctuation-only texts have an empty sketch and 0 shingles; both
ratios with an empty sketch are 0; texts shorter than ``n`` words have one shingle; the rows of a
repeated ``doc_id`` are merged into one sketch; rows with a null ``doc_id`` are sketched each and have
no class, no copies and no links; documents without shingles are classes of their own; null keys merge into one group; other columns
are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pairing
from .common import cut, flat, join_classes, release, slices, split_partitions
from .textkit import distinct_shingles, mix64, set_digest

NGRAM, K, LEAST, DEEP = 3, 128, 0.5, 16
#: Pairs of sketches that are compared at a time.
PAIRS_AT_ONCE = 10_000
#: Keys that a task merges in memory before it passes partial sketches on.
MERGE_KEYS = 50_000


def _sketches(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            text, docs = flat(batch, "text"), flat(batch, "doc_id")
            for lo, hi in slices(text):
                values, first = distinct_shingles(text.slice(lo, hi - lo), n)
                size = np.diff(first)
                take = np.minimum(size, k)
                off = np.concatenate(([0], np.cumsum(take)))
                at = np.repeat(first[:-1] - off[:-1], take) + np.arange(off[-1])
                signed = (values[at] ^ np.uint64(1 << 63)).view(np.int64)
                sketch = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(signed))
                yield pa.RecordBatch.from_arrays([docs.slice(lo, hi - lo).cast(pa.int64()), sketch], names=["doc_id", "sketch"])

    return run


def sketch(docs: DataFrame, n: int = NGRAM, k: int = K) -> DataFrame:
    """``doc_id, sketch`` of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketches(n, k), "doc_id long, sketch array<long>")


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[str | None, np.ndarray] = {}

        def out():
            keys = list(held)
            off = np.concatenate(([0], np.cumsum([len(held[x]) for x in keys])))
            values = np.concatenate([held[x] for x in keys]) if keys else np.zeros(0, np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values))], names=["key", "sketch"])

        for batch in batches:
            keys, lists = flat(batch, "key").dictionary_encode(), flat(batch, "sketch")
            names, code = keys.dictionary.to_pylist(), np.asarray(keys.indices.fill_null(-1))
            off = np.asarray(lists.offsets)
            owner, values = np.repeat(code, np.diff(off)), np.asarray(lists.values)[off[0] : off[-1]]
            order, codes = np.argsort(owner, kind="stable"), np.unique(code)
            lo, hi = (np.searchsorted(owner[order], codes, side) for side in ("left", "right"))
            for c, i, j in zip(codes.tolist(), lo.tolist(), hi.tolist()):
                name = None if c < 0 else names[c]
                held[name] = np.unique(np.concatenate((held.get(name, np.zeros(0, np.int64)), values[order[i:j]])))[:k]
            if len(held) > MERGE_KEYS:
                yield out()
        if held:
            yield out()

    return run


def merge(sketches: DataFrame, key: str, k: int = K) -> DataFrame:
    """``key, sketch``: the sketch of the union of all sketches that share a key (as a string).
    Each task merges what it has before anything is shuffled."""
    kind = "key string, sketch array<long>"
    part = sketches.select(F.col(key).cast("string").alias("key"), F.coalesce("sketch", F.array().cast("array<long>")).alias("sketch")).mapInArrow(_merge(k), kind)
    return part.repartition("key").mapInArrow(_merge(k), kind)


def distinct_estimate(s: Column, k: int = K) -> Column:
    u = (F.element_at(s, k).cast("double") + F.lit(2.0**63) + 1) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / u)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    low = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(F.array_intersect(low, a), b)) / F.size(low))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of the set of ``a`` that the set of ``b`` contains."""
    end = lambda s: F.when(F.size(s) >= k, F.element_at(s, k)).otherwise(F.lit(2**63 - 1))
    top = F.least(end(a), end(b))
    seen = F.filter(a, lambda x: x <= top)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(seen, b)) / F.greatest(F.size(seen), F.lit(1)))


def fingerprints(docs: DataFrame, n: int = NGRAM, k: int = K) -> DataFrame:
    """``doc_id, distinct_shingles`` (estimate) and ``sketch`` of each row."""
    return sketch(docs, n, k).select("doc_id", distinct_estimate(F.col("sketch"), k).alias("distinct_shingles"), "sketch")


def _leads(rank: np.ndarray, least: float) -> np.ndarray:
    """Which values of an ascending sketch are in a prefix, given their ranks; see the module text."""
    at = np.arange(len(rank))
    rarer = (rank[None, :] < rank[:, None]) | ((rank[None, :] == rank[:, None]) & (at[None, :] < at[:, None]))
    size = at + 2 - np.ceil(least * (at + 1) - 1e-9).astype(np.int64)
    return ((np.cumsum(rarer, 1, dtype=np.int16) < size) & (at[None, :] >= at[:, None])).any(1)


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Values (unsigned, ascending for each row) and offsets of the sketches of a batch."""
    lists = flat(batch, "sketch")
    off = np.asarray(lists.offsets).astype(np.int64)
    return np.asarray(lists.values)[off[0] : off[-1]].view(np.uint64) ^ np.uint64(1 << 63), off - off[0]


def _hashes(values: np.ndarray) -> np.ndarray:
    """Sketch values are the smallest hashes; these are spread evenly again."""
    return mix64(values + np.uint64(17)) >> np.uint64(64 - pairing.BITS)


def _profile(batches: Iterator[pa.RecordBatch]):
    counter = pairing.Counter()
    for batch in batches:
        values, off = _lists(batch)
        size = np.diff(off)
        live = np.flatnonzero(size)
        if len(live):
            counter.add(_hashes(values))
            d1, d2 = set_digest(values, off)
            yield pairing.profile_rows(np.asarray(flat(batch, "doc_id"))[live], size[live], d1[live], d2[live])
    yield from counter.rows()


def _named(batch: pa.RecordBatch, clash: np.ndarray):
    values, off = _lists(batch)
    d1, d2 = set_digest(values, off)
    return (np.where(np.isin(d1, clash), d2, d1) if len(clash) else d1), values, off


def _asked_name(names: np.ndarray) -> np.ndarray:
    return mix64(names + np.uint64(0x51A7))


def _prefixes(table, least: float, parts: int, clash: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]):
        rank, grid = table.value
        seen, packer = set(), pairing.Packer(parts, grid)
        for batch in batches:
            names, values, off = _named(batch, clash)
            h, size = _hashes(values), np.diff(off)
            key = rank[(h & np.uint64(pairing.COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(pairing.BITS) | h
            need, asked = _need(size, least), np.asarray(flat(batch, "asked").fill_null(False))
            for other, marks in ((names, np.zeros(len(size), bool)), (_asked_name(names), asked)):
                who, keep = [], []
                for i, name in enumerate(other.tolist()):
                    if size[i] and name not in seen and (asked[i] or other is names):
                        seen.add(name)
                        who.append(i)
                        keep.append(np.sort(key[off[i] : off[i + 1]])[: size[i] - need[i] + min(DEEP, need[i])])
                if who:
                    long = np.array([len(x) for x in keep])
                    pos = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
                    sizes = size[who].astype(np.uint32) | np.where(marks[who], pairing.ASKED, np.uint32(0))
                    yield from packer.add(other[who], sizes, np.repeat(np.arange(len(who)), long), np.concatenate(keep) & np.uint64((1 << pairing.BITS) - 1), pos.astype(np.uint32))
        yield from packer.flush()

    return run


def _need(size: np.ndarray, least: float) -> np.ndarray:
    return np.ceil(least * size - 1e-9).astype(np.int64)


def _compare(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, k: int):
    """Resemblance and both containments of rows of ascending sketches, padded with the largest number."""
    pad = np.uint64(2**64 - 1)
    both = np.sort(np.concatenate((x, y), 1), 1)
    same = (both[:, 1:] == both[:, :-1]) & (np.arange(both.shape[1] - 1) < (nx + ny)[:, None] - 1)
    common = same.sum(1)
    union = nx + ny - common
    low = np.minimum(union, k)
    # a value's place in the union is its place less the repeats before it; repeats lie right after
    place = np.arange(both.shape[1] - 1)[None, :] - np.cumsum(same, 1) + same
    resemblance = (same & (place < low[:, None])).sum(1) / low
    end = lambda s, n: np.where(n >= k, s[np.arange(len(s)), np.maximum(n, 1) - 1], pad)
    top = np.minimum(end(x, nx), end(y, ny))[:, None]
    seen = lambda s, n: np.maximum(((s <= top) & (np.arange(s.shape[1]) < n[:, None])).sum(1), 1)
    return resemblance, common / seen(x, nx), common / seen(y, ny)


_LINKS = "name long, links long, best double, contained double"


def _verify(k: int, least: float, clash: np.ndarray):
    def run(pairs: pa.Table, sketches: pa.Table) -> pa.Table:
        names, size, values = np.asarray(sketches["name"]).view(np.uint64), [], []
        for batch in sketches.combine_chunks().to_batches():
            v, off = _lists(batch)
            values.append(v)
            size.append(np.diff(off))
        size, members = np.concatenate(size), np.asarray(sketches["m"])
        table = np.full((len(names), k), 2**64 - 1, np.uint64)
        table[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.concatenate(values)
        order = np.argsort(names, kind="stable")
        a, b = (order[np.searchsorted(names[order], np.asarray(pairs[x]).view(np.uint64))] for x in "ab")
        count, best, held = np.zeros(len(names), np.int64), np.zeros(len(names)), np.zeros(len(names))
        for s in range(0, len(a), PAIRS_AT_ONCE):
            x, y = a[s : s + PAIRS_AT_ONCE], b[s : s + PAIRS_AT_ONCE]
            same, share, _ = _compare(table[x], size[x], table[y], size[y], k)
            good = same >= least - 1e-9
            np.add.at(count, x[good], members[y[good]])
            np.maximum.at(best, x[good], same[good])
            np.maximum.at(held, x[good], share[good])
        hit = np.flatnonzero(count)
        return pa.table({"name": names[hit].view(np.int64), "links": count[hit], "best": best[hit], "contained": held[hit]})

    return run


def _asked_column(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([flat(batch, "name"), pa.array(_asked_name(np.asarray(flat(batch, "name")).view(np.uint64)).view(np.int64))], names=["name", "asked_name"])


def by_document(docs: DataFrame, n: int = NGRAM, k: int = K) -> DataFrame:
    """``doc_id, sketch`` of each document; rows that share a ``doc_id`` are merged. Sketches are made again
    where they are needed, which is cheaper than to store them."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    again = docs.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return sketch(docs, n, k)
    again = cut(again)
    merged = merge(sketch(docs.join(again, "doc_id", "left_semi"), n, k), "doc_id", k).select(F.col("key").cast("long").alias("doc_id"), "sketch")
    return sketch(docs.join(again, "doc_id", "left_anti"), n, k).unionByName(cut(merged))


def _linked(each: DataFrame, queries: Column, k: int, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, classes (see ``pairing.classes``) and the links of classes of queries."""
    spark = each.sparkSession
    profile = cut(each.mapInArrow(_profile, pairing.PROFILE))
    counts = pairing.frequency_table(profile)
    table = spark.sparkContext.broadcast((pairing.rank_of(counts), pairing.grid_of(counts)))
    members, classes, clash = pairing.classes(profile)
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = pairing.parts_for(int(total * (1 - least)), split_partitions(spark))
    rows = each.select("sketch", queries.alias("asked")).mapInArrow(_prefixes(table, least, parts, clash), pairing.ROW)

    def test(n, m, x, y):
        return np.minimum(x, y) + np.minimum(n - x, m - y) >= _need(np.maximum(n, m), least)

    def keep(met, n, m):
        n, m, o = _need(n, least), _need(m, least), _need(np.maximum(n, m), least)
        return met + np.maximum(n - np.minimum(DEEP, n), m - np.minimum(DEEP, m)) >= o

    pairs = pairing.candidates(rows, parts, lambda n, m: n >= least * m - 1e-9, test, keep, search=True)
    turned = [F.when(F.col("asked"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("w_a", "w_b"), ("w_b", "w_a"))]
    pairs = cut(pairs.select(*turned))
    del rows
    release(spark)
    asked = members.filter(queries).groupBy("name").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"))
    both = cut(asked.join(asked.select("name").mapInArrow(_asked_column, "name long, asked_name long"), "name"))
    itself = both.select(F.col("asked_name").alias("a"), F.col("name").alias("b"))
    pairs = cut(pairing.blocks(pairs.join(itself, ["a", "b"], "left_anti")).select("key", "a", "b"))
    release(spark)
    sketches = pairing.payload(pairs, {"a": both.select(F.col("asked_name").alias("name"), "rep", "m"), "b": classes}, each, "sketch")
    found = pairs.groupBy("key").cogroup(sketches.groupBy("key")).applyInArrow(_verify(k, least, clash), _LINKS)
    per = found.groupBy("name").agg(F.sum("links").alias("links"), F.max("best").alias("best"), F.max("contained").alias("contained"))
    found = cut(both.join(per.withColumnRenamed("name", "asked_name"), "asked_name", "left").select("name", "links", "best", "contained"))
    del sketches, per
    release(spark)
    return members, classes, found


def overlaps(docs: DataFrame, queries: Column, n: int = NGRAM, k: int = K, least: float = LEAST) -> DataFrame:
    """One row for each document: ``doc_id, distinct_shingles, sketch, class_id, copies, links, best,
    contained``; see the module text. The last three are null for documents that ``queries`` (a condition
    on ``doc_id``) doesn't select, ``best`` and ``contained`` also for those without links."""
    each = by_document(docs, n, k)
    members, classes, found = _linked(each, queries, k, least)
    top = [F.when(F.col("m") > 1, 1.0).otherwise(F.col(c)).alias(c) for c in ("best", "contained")]
    whole = cut(classes.join(found, "name", "left").select("name", "m", F.col("rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), *top))
    narrow = cut(join_classes(members, whole, "name").select("doc_id", "class_id", F.col("m").alias("copies"), "links", "best", "contained"))
    release(docs.sparkSession)
    out = each.join(narrow.hint("shuffle_hash"), "doc_id", "left")
    out = out.select("doc_id", "sketch", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.when(queries, F.coalesce("links", F.lit(0))).alias("links"), *[F.when(queries, F.col(c)).alias(c) for c in ("best", "contained")])
    out = out.unionByName(sketch(docs.filter("doc_id is null"), n, k), allowMissingColumns=True)
    return out.select("doc_id", distinct_estimate(F.col("sketch"), k).alias("distinct_shingles"), "sketch", "class_id", "copies", "links", "best", "contained")


def _values(table, least: float):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            values, off = _lists(batch)
            rank = table.value[(_hashes(values) & np.uint64(pairing.COUNTERS - 1)).astype(np.int64)]
            lead = [_leads(rank[i:j], least) for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
            owner = np.repeat(np.asarray(flat(batch, "doc_id")), np.diff(off))
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(owner, pa.int64()), pa.array(np.concatenate(lead) if lead else np.zeros(0, bool))], names=["h", "doc_id", "lead"])

    return run


def search(docs: DataFrame, queries: Column, n: int = NGRAM, k: int = K, least: float = LEAST) -> DataFrame:
    """``query, doc_id, resemblance, containment`` (share of the query that the document has) and
    ``contained`` (share of the document that the query has) of all pairs of a document that
    ``queries`` (a condition on ``doc_id``) selects and another one, with one of the three at ``least`` or more."""
    each = by_document(docs, n, k).filter("size(sketch) > 0")
    counts = pairing.frequency_table(each.mapInArrow(_profile, pairing.PROFILE))
    table = docs.sparkSession.sparkContext.broadcast(pairing.rank_of(counts))
    values = each.mapInArrow(_values(table, least), "h long, doc_id long, lead boolean")
    asked = values.filter(queries).withColumnsRenamed({"doc_id": "query", "lead": "lead_q"})
    met = cut(asked.join(values, "h").filter("query <> doc_id and (lead or lead_q)").select("query", "doc_id").distinct())
    both = met.join(each, "doc_id").join(each.filter(queries).withColumnsRenamed({"doc_id": "query", "sketch": "asked"}), "query")
    a, b = F.col("asked"), F.col("sketch")
    out = both.select("query", "doc_id", resemblance(a, b, k).alias("resemblance"), containment(a, b, k).alias("containment"), containment(b, a, k).alias("contained"))
    return out.filter(F.greatest("resemblance", "containment", "contained") >= least - 1e-9)


def source_overlap(docs: DataFrame, n: int = NGRAM, k: int = K) -> DataFrame:
    """Merged sketches of the sources, compared pair by pair (as many rows as pairs of sources)."""
    rows = docs.select(F.xxhash64("doc_id", "source").alias("doc_id"), "text", "source")
    # the key travels with the text through one pass
    per = merge(_keyed(rows, n, k), "source", k)
    a, b = (per.select(F.col("key").alias(f"source_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")
    return a.join(b, F.col("source_a") < F.col("source_b")).select("source_a", "source_b", distinct_estimate(F.col("s_a"), k).alias("distinct_a"), distinct_estimate(F.col("s_b"), k).alias("distinct_b"), resemblance(F.col("s_a"), F.col("s_b"), k).alias("resemblance"), containment(F.col("s_a"), F.col("s_b"), k).alias("containment"))


def _keyed(rows: DataFrame, n: int, k: int) -> DataFrame:
    inner = _sketches(n, k)

    def run(batches):
        for batch in batches:
            names, at = flat(batch, "source"), 0
            for out in inner(iter([batch])):
                yield pa.RecordBatch.from_arrays([names.slice(at, len(out)), flat(out, "sketch")], names=["source", "sketch"])
                at += len(out)

    return rows.mapInArrow(run, "source string, sketch array<long>")
