"""Operator 5: mixing sources to target weights by pivotal dependent rounding.

Each document of source ``s`` gets the expected number of copies ``w_s * B / m_s`` (``w_s`` the
target weight, ``m_s`` the source's size in documents, or in ``size`` units, ``B`` the budget). Its integer part is
certain. The fractions are rounded dependently: two of them, a and b, trade mass at random until
one is 0 or 1 (a + b < 1: one becomes 0, the other a + b; else one becomes 1, the other
a + b - 1), with probabilities that keep both expectations. Expectations are exact, the number of
copies of every source is its target rounded up or down, and so is the total.

Distributed form: documents are spread by a hash over cells of about ``CELL_ROWS`` rows; each cell pairs the
fractions of each source as a tree in numpy and keeps at most one that isn't integral (a first
reduction of n fractions to cells x sources). These residuals are combined in a tree of groups of ``FAN`` cells until one cell is
left, where the residuals of the sources are paired with each other as well and the last one is
rounded by its own probability.

Random numbers come from a hash of (seed, smallest id of the pair), so the result depends on the
seed and the rows, not on partitions.

Rows that agree in ``doc_id``, ``source`` and size are interchangeable: they are counted, not ranked, and
numbered from their count, so a source whose ids are all null is no task of its own.

``copies(docs, weights)`` returns ``doc_id, source, expected, copies`` for every row (0 copies
included). ``mix(docs, weights)`` returns each row of ``docs`` ``copies`` times with its columns.

Edge cases: a null source is a source of its own; a source without a weight has weight 0; weights
are scaled to sum to 1 over the sources that are present, and None stands for equal weights; repeated rows are units of their own (they are
numbered); a null ``doc_id`` is a unit like any other; empty tables give empty results; other
columns are left alone. Texts aren't read by ``copies``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .textkit import mix64

#: Rows of one cell (their number grows with the table), cells that one reduction step combines, and the seed.
CELL_ROWS, FAN, SEED = 20_000, 16, 20240521
#: Interchangeable rows that are numbered at a time.
AT_ONCE = 100_000
#: Exponent that turns a source's size into its target weight: 1 keeps proportions, 0 makes all equal.
TEMPERATURE = 0.7
_EPS = 1e-9


def _uniform(key: np.ndarray, seed: int, level: int) -> np.ndarray:
    h = mix64(mix64(key.view(np.uint64) + np.uint64(seed)) + np.uint64(level * 7919 + 1))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivot(key: np.ndarray, p: np.ndarray, seed: int, level: int = 0) -> np.ndarray:
    """Pair fractions until at most one is neither 0 nor 1; the sum is kept. ``key`` (int64)
    orders the units and seeds the trades."""
    p = p.copy()
    live = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    live = live[np.argsort(key[live], kind="stable")]
    depth = 0
    while len(live) > 1:
        odd = live[len(live) // 2 * 2 :]
        i, j = live[: len(live) // 2 * 2 : 2], live[1 : len(live) // 2 * 2 : 2]
        a, b = p[i], p[j]
        u, low = _uniform(key[i] ^ (key[j] << 1), seed, level * 64 + depth), a + b < 1
        s = a + b
        win = np.where(low, u * s < a, u * (2 - s) < 1 - b)  # i gets the larger share
        p[i] = np.where(low, np.where(win, s, 0), np.where(win, 1, s - 1))
        p[j] = np.where(low, np.where(win, 0, s), np.where(win, s - 1, 1))
        live = np.concatenate((np.stack((i, j), 1).ravel(), odd))
        live = live[(p[live] > _EPS) & (p[live] < 1 - _EPS)]
        depth += 1
    return p


def _cell(seed: int, level: int, last: bool):
    """One cell of one level: within each source, then, in the last cell, across sources."""

    def run(t: pa.Table) -> pa.Table:
        key, p = np.asarray(t["unit"]), np.asarray(t["p"]).copy()
        source = t["source"].combine_chunks().dictionary_encode()
        code = np.asarray(source.indices.fill_null(-1))
        order = np.lexsort((key, code))
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) != 0, [True])))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            at = order[lo:hi]
            p[at] = pivot(key[at], p[at], seed, level)
        if last:
            p = pivot(key, p, seed, level + 1)
            left = (p > _EPS) & (p < 1 - _EPS)
            p[left] = (_uniform(key[left], seed, level + 2) < p[left]).astype(float)
        return pa.table({"unit": t["unit"], "source": t["source"], "p": pa.array(p)})

    return run


def expected(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: float | None = None, size: str | None = None, temperature: float | None = None) -> DataFrame:
    """``docs`` with the expected number of copies of each row, a function of its source."""
    amount = F.sum(F.coalesce(F.col(size), F.lit(0))).cast("double") if size else F.count("*").cast("double")
    per = docs.groupBy("source").agg(amount.alias("m"))
    if temperature is not None:
        per = per.withColumn("w", F.pow("m", F.lit(float(temperature))))
    elif weights is None:
        per = per.withColumn("w", F.lit(1.0))
    else:
        w = F.lit(0.0)
        for s, x in weights.items():
            w = F.when(F.col("source").isNull() if s is None else F.col("source") == s, F.lit(float(x))).otherwise(w)
        per = per.withColumn("w", w)
    total = per.agg(F.sum("w").alias("sw"), F.sum("m").alias("sm"))
    rate = per.crossJoin(total).withColumn("expected", F.when((F.col("m") > 0) & (F.col("sw") > 0), F.col("w") / F.col("sw") * (F.lit(float(budget)) if budget is not None else F.col("sm")) / F.col("m")).otherwise(F.lit(0.0)))
    rate = rate.select(F.col("source").alias("_s"), "expected")
    return docs.join(rate, docs["source"].eqNullSafe(rate["_s"])).drop("_s")


def copies(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: float | None = None, size: str | None = None, seed: int = SEED, temperature: float | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Copies of every row; see the module text. ``unit`` numbers the rows: it is the hash of
    (doc_id, source, size, the columns ``within``, number among rows with the same)."""
    keys = ["doc_id", "source", *([size] if size else []), *within]
    many = docs.groupBy(*keys).count().withColumn("_b", F.explode(F.expr(f"sequence(0L, (count - 1) div {AT_ONCE})")))
    narrow = many.repartition(*keys, "_b").withColumn("_r", F.explode(F.expr(f"sequence(_b * {AT_ONCE} + 1, least(count, (_b + 1) * {AT_ONCE}))"))).drop("count", "_b")
    units = expected(narrow, weights, budget, size, temperature)
    units = units.select("doc_id", "source", *within, "_r", "expected", F.xxhash64(*keys, "_r").alias("unit"))
    units = cut(units.withColumn("p", F.col("expected") - F.floor("expected")))
    cells = 1
    n = units.count()
    while cells * CELL_ROWS < n:
        cells *= FAN
    level, kind = 0, "unit long, source string, p double"
    live = units.select(F.pmod("unit", F.lit(cells)).cast("int").alias("cell"), "unit", F.col("source").cast("string").alias("source"), "p").filter(f"p > {_EPS} and p < 1 - {_EPS}")
    done: list[DataFrame] = []
    while True:
        last = cells == 1
        out = cut(live.groupBy("cell").applyInArrow(_with_cell(_cell(seed, level * 4, last)), f"{kind}, cell int"))
        whole = f"p <= {_EPS} or p >= 1 - {_EPS}"
        done.append(out.filter(whole).select("unit", "p"))
        if last:
            break
        live = out.filter(f"not ({whole})").withColumn("cell", F.expr(f"cast(cell div {FAN} as int)"))
        cells, level = cells // FAN, level + 1
    rounded = done[0]
    for d in done[1:]:
        rounded = rounded.unionByName(d)
    base = F.floor("expected") + F.when(F.col("expected") - F.floor("expected") >= 1 - _EPS, 1).otherwise(0)
    return units.join(rounded.select("unit", F.col("p").alias("q")), "unit", "left").select("doc_id", "source", *within, "expected", (base + F.round(F.coalesce("q", F.lit(0.0)))).cast("long").alias("copies"), "_r")


def _with_cell(f):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        out = f(t)
        return out.append_column("cell", pa.array([key[0].as_py()] * len(out), pa.int32()))

    return run


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: float | None = None, size: str | None = None, seed: int = SEED, temperature: float | None = None) -> DataFrame:
    """Each row of ``docs`` as often as ``copies`` says. Rows that share id and source are told apart by the
    hash of their text, so that a source of null ids is spread; texts move once, by the hash of the three."""
    text = F.col("text") if "text" in docs.columns else F.lit(None).cast("string")
    salted = docs.select("doc_id", "source", *([size] if size else []), F.xxhash64(text).alias("_t"))
    c = copies(salted, weights, budget, size, seed, temperature, ("_t",)).groupBy("doc_id", "source", "_t").agg(F.array_sort(F.collect_list("copies")).alias("_c"))
    c = cut(c.filter("exists(_c, x -> x > 0)").select(F.xxhash64("doc_id", "source", "_t").alias("_k"), F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("_t").alias("_x"), "_c"))
    row = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"), F.xxhash64(text).alias("_t")).withColumn("_h", F.xxhash64("row.doc_id", "row.source", "_t"))
    hit = row.join(c, (F.col("_h") == F.col("_k")) & F.col("row.doc_id").eqNullSafe(F.col("_d")) & F.col("row.source").eqNullSafe(F.col("_s")) & (F.col("_t") == F.col("_x")))
    if c.filter("size(_c) > 1").isEmpty():
        hit = hit.select("row", F.col("_c")[0].alias("_times"))
    else:
        hit = hit.withColumn("_n", F.expr("row_number() over (partition by _h, row.doc_id, row.source order by _h)")).select("row", F.expr("_c[_n - 1]").alias("_times"))
    return hit.filter("_times > 0").select("row", F.explode(F.expr("sequence(1, int(_times))")).alias("_i")).select("row.*")
