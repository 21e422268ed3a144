"""Classification by embeddings."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v)) + F.lit(EPS)
    return F.transform(v, lambda x: x.cast("double") / n)


def centroids(df: DataFrame, vec: str = "embedding", label: str = "label") -> DataFrame:
    """(label, centroid): normalised mean of normalised vectors. Means are taken by (label,
    dimension), so partial sums are combined before the shuffle."""
    parts = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.posexplode(unit(F.col(vec))).alias("i", "x"))
    mean = parts.groupBy("label", "i").agg(F.avg("x").alias("x"))
    whole = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    return whole.select("label", unit(F.col("c")).alias("centroid"))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    """Normalised vectors, zeros for null ones."""
    m = np.zeros((len(column), dim))
    at = np.flatnonzero(column.notna())
    if len(at):
        m[at] = np.stack(column.iloc[at].to_numpy())
    return m / (np.sqrt((m * m).sum(1, keepdims=True)) + EPS)


def nearest_centroid(df: DataFrame, cents: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """key, predicted, confidence (best minus second cosine). Centroids, one for each class, are gathered
    into one matrix that every task gets; rows are scored a batch at a time. Ties go to the later label;
    a null vector has no prediction."""
    rows = sorted(cents.select("label", "centroid").collect(), key=lambda r: r.label)
    labels = np.array([r.label for r in rows], object)
    table = np.array([r.centroid for r in rows], float)
    kinds = f"predicted {cents.schema['label'].dataType.simpleString()}, confidence double"

    @F.pandas_udf(kinds)
    def best(vectors: pd.Series) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"predicted": pd.Series([None] * len(vectors), dtype=object), "confidence": np.nan})
        sims = _matrix(vectors, table.shape[1]) @ table.T
        last = sims.shape[1] - 1 - np.argmax(sims[:, ::-1], 1)
        top = sims[np.arange(len(sims)), last]
        sims[np.arange(len(sims)), last] = -np.inf
        second = sims.max(1) if sims.shape[1] > 1 else np.zeros(len(sims))
        none = vectors.isna().to_numpy()
        return pd.DataFrame({"predicted": pd.Series(np.where(none, None, labels[last])), "confidence": np.where(none, np.nan, top - second)})

    return df.select(key, best(F.col(vec)).alias("_b")).select(key, "_b.predicted", "_b.confidence")


def _units(m: np.ndarray) -> np.ndarray:
    """Normalised rows; squares are added one after the other, as in ``_dots``."""
    total = np.zeros(len(m))
    for x in m.T:
        total += x * x
    return m / (np.sqrt(total) + EPS)[:, None]


def _dots(v: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Products of a vector with rows, added in the order of the dimensions: equal rows get equal numbers, which
    a matrix product doesn't promise, and they are those of SQL."""
    total = np.zeros(len(rows))
    for x, y in zip(v, rows.T):
        total += x * y
    return total


def _rounded(x: np.ndarray) -> np.ndarray:
    """12 digits, halves away from zero, as SQL rounds."""
    y = x * 1e12
    whole = np.trunc(y)
    return (whole + np.sign(y) * (np.abs(y - whole) >= 0.5)) / 1e12


def top_k(queries: DataFrame, index: DataFrame, key: str, vec: str = "embedding", k: int = 3, blocks: int = 8) -> DataFrame:
    """The k most similar rows of ``index`` of each row of ``queries`` (not itself; ties by key).
    Exact: each block of the index is scored in matrix products against all queries that reach
    it, and only its k best candidates of each query are shuffled."""
    n = blocks
    kind = queries.schema[key].dataType.simpleString()
    q = queries.select(F.col(key).alias("q"), F.col(vec).alias("v")).filter("v is not null").withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(n)))
    x = index.select(F.col(key).alias("x"), F.col(vec).alias("v")).filter("v is not null").withColumn("xb", F.pmod(F.xxhash64("x"), F.lit(n)))
    pair = F.sequence(F.lit(0), F.lit(n - 1))
    left = q.withColumn("xb", F.explode(pair))
    right = x.withColumn("qb", F.explode(pair))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": pd.Series(dtype=a["q"].dtype), "x": pd.Series(dtype=b["x"].dtype), "sim": pd.Series(dtype="float64"), "by": pd.Series(dtype="float64")})
        va, vb = (_units(np.stack(d["v"].to_numpy()).astype(np.float64)) for d in (a, b))
        ids, out = b["x"].to_numpy(), []
        for lo in range(0, len(a), 1024):
            s = va[lo : lo + 1024] @ vb.T
            for i, (qi, row) in enumerate(zip(a["q"].to_numpy()[lo : lo + 1024], s), lo):
                near = np.arange(len(row))
                if len(row) > k + 1:  # all that may tie with the last one count
                    near = np.flatnonzero(row >= np.partition(row, len(row) - k - 1)[len(row) - k - 1] - 1e-11)
                near = near[ids[near] != qi]
                sim = _dots(va[i], vb[near])
                best = _rounded(sim)
                take = np.lexsort((ids[near], -best))[:k]
                out += [(qi, ids[near[j]], float(sim[j]), float(best[j])) for j in take]
        return pd.DataFrame(out, columns=["q", "x", "sim", "by"])

    near = left.groupBy("qb", "xb").cogroup(right.groupBy("qb", "xb")).applyInPandas(best, f"q {kind}, x {kind}, sim double, by double")
    w = W.partitionBy("q").orderBy(F.desc("by"), "x")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select(F.col("q").alias(key), F.col("x").alias("neighbour"), "rank", "sim")


def blocks_for(rows: int, per_block: int = 20_000) -> int:
    """Blocks of an index so that one block pair fits in a task."""
    return max(1, math.ceil(rows / per_block))


def embed(df: DataFrame, text: str, fn: Callable[[list[str]], list[list[float]]], out: str = "embedding") -> DataFrame:
    """Adds what an embedder, a Python function over a batch of texts, gives for each text; a null text is
    embedded as an empty one."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = fn(["" if t is None else t for t in b[text]])
            yield b.assign(**{out: pd.Series([[float(x) for x in v] for v in got], index=b.index, dtype=object)})

    return df.mapInPandas(run, schema)


def hashed_embedding(df: DataFrame, text: str, dim: int = 256, n: int = 3) -> DataFrame:
    """Adds ``embedding``: counts of character n-grams by hash, for use without a model."""
    from ..functions.text import normalize_text

    t = normalize_text(F.col(text))
    grams = F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.pmod(F.xxhash64(F.substr(t, i, F.lit(n))), F.lit(dim)).cast("int"))).otherwise(F.array().cast("array<int>"))

    @F.pandas_udf("array<double>")
    def counted(lists: pd.Series) -> pd.Series:
        size = lists.map(len).to_numpy()
        flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if size.sum() else np.zeros(0, np.int64)
        return pd.Series(list(np.bincount(np.repeat(np.arange(len(size)), size) * dim + flat, minlength=len(size) * dim).astype(float).reshape(-1, dim)))

    return df.withColumn("embedding", counted(F.coalesce(grams, F.array().cast("array<int>"))))
