"""Cascade composition."""

from __future__ import annotations

import math
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def align(tiers: dict[str, DataFrame]) -> DataFrame:
    """Rows whose id every tier has: id, gold (of the first tier), then predicted_, conf_ and
    latency_ columns of each tier. A null prediction is an empty string."""
    out = None
    for name, t in tiers.items():
        cols = [F.coalesce("predicted", F.lit("")).alias(f"predicted_{name}"), F.col("confidence").alias(f"conf_{name}"), (F.col("latency_ms") if "latency_ms" in t.columns else F.lit(None)).cast("double").alias(f"latency_{name}")]
        t = t.select("id", *([F.col("gold")] if out is None else []), *cols)
        out = t if out is None else out.join(t, "id")
    return out


def dropped(tiers: dict[str, DataFrame]) -> int:
    """Rows of the largest tier that some other tier lacks."""
    return max(t.count() for t in tiers.values()) - align(tiers).count()


def calibrate(aligned: DataFrame, tier: str) -> tuple[list[float], list[float]]:
    """Isotonic map of a tier's confidence to the probability of a right answer, as knots; what
    is between them is linear, what is outside takes the end's value."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    rows = aligned.select((F.col("gold") == F.col(f"predicted_{tier}")).cast("double").alias("label"), array_to_vector(F.array(F.col(f"conf_{tier}").cast("double"))).alias("features"))
    m = IsotonicRegression().fit(rows)
    return [float(x) for x in m.boundaries.toArray()], [min(1.0, max(0.0, float(x))) for x in m.predictions.toArray()]


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction, in constant memory."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    total = d
    for m in range(1, 1_000_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def upper_bound(k: int, n: int, confidence: float = 0.95) -> float:
    """Exact (Clopper-Pearson) upper bound of a binomial share: the p with P(X <= k) = 1 - confidence."""
    if n <= 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if _beta_share(n - k, k + 1, 1 - mid) > 1 - confidence else (lo, mid)
    return hi


@F.pandas_udf(T.DoubleType())
def upper_bounds(k: pd.Series, n: pd.Series) -> pd.Series:
    """``upper_bound`` at 95 % of each row's (errors, trials)."""
    return pd.Series([upper_bound(int(a), int(b)) for a, b in zip(k, n)])


def architectures(tiers: list[str]) -> list[tuple[str, ...]]:
    """All subsequences of the tiers in order, longest first."""
    return [c for k in range(len(tiers), 0, -1) for c in combinations(tiers, k)]


def grid_cells(aligned: DataFrame, tiers: list[str], grid: int, knots: dict[str, tuple[list[float], list[float]]] | None = None) -> DataFrame:
    """Rows counted by (number of grid points that each tier's calibrated confidence reaches,
    right or wrong of each tier): (grid + 1)^tiers x 2^tiers cells at most, whatever the rows."""
    points = [float(x) for x in np.linspace(0, 1, grid)]
    cols = []
    # a lambda with a second parameter would be given the index, so the confidence is closed over
    reached = lambda c: F.size(F.filter(F.array(*[F.lit(p) for p in points]), lambda p: p <= c))
    for t in tiers:
        c = F.col(f"conf_{t}").cast("double")
        aligned = aligned.withColumn(f"conf_{t}", c if knots is None else _interpolate(c, *knots[t]))
        cols.append(reached(F.col(f"conf_{t}")).alias(f"k_{t}"))
    right = [(F.col("gold") == F.col(f"predicted_{t}")).cast("int").alias(f"ok_{t}") for t in tiers]
    return aligned.select(*cols, *right).groupBy(*[f"k_{t}" for t in tiers], *[f"ok_{t}" for t in tiers]).agg(F.count("*").alias("n"))


def _interpolate(c, xs: list[float], ys: list[float]):
    """The calibrated confidence. Knots travel with the function, not as literals of the plan."""
    x, y = np.array(xs), np.array(ys)

    @F.pandas_udf("double")
    def at(values: pd.Series) -> pd.Series:
        return pd.Series(np.interp(values.to_numpy(float), x, y))

    return at(c)


def simulate_grid(cells: DataFrame, arch: tuple[str, ...], grid: int) -> DataFrame:
    """n, right, terminal and answers by tier for each combination of thresholds (as grid
    indices) of one architecture, by a cross join of cells with the grid."""
    spark = cells.sparkSession
    combos = None
    for t in arch[:-1]:
        one = spark.range(grid).select(F.col("id").cast("int").alias(f"i_{t}"))
        combos = one if combos is None else combos.crossJoin(one)
    rows = cells if combos is None else cells.crossJoin(F.broadcast(combos))
    answered, right = [], F.lit(0)
    free = F.lit(True)
    for t in arch:
        here = free if t == arch[-1] else free & (F.col(f"k_{t}") > F.col(f"i_{t}"))
        answered.append(F.sum(F.when(here, F.col("n")).otherwise(0)).alias(f"by_{t}"))
        right = right + F.when(here, F.col("n") * F.col(f"ok_{t}")).otherwise(0)
        if t != arch[-1]:
            free = free & ~(F.col(f"k_{t}") > F.col(f"i_{t}"))
    keys = [f"i_{t}" for t in arch[:-1]]
    return (rows.groupBy(*keys) if keys else rows.groupBy()).agg(F.sum("n").alias("n"), F.sum(right).alias("right"), *answered)


def compose(tiers: dict[str, DataFrame], costs: dict[str, float], latency: dict[str, float] | None = None, grid: int = 41, max_terminal: float = 1.0, max_error: float | None = None, confidence: float = 0.95, calibrated: bool = True) -> list[dict]:
    """The best and the certified operating point of each architecture, ordered by accuracy
    (descending), cost, latency and enumeration. Best: highest accuracy, first in the order of thresholds, among
    points with a terminal share up to ``max_terminal`` (single tiers always pass). Certified, of several tiers:
    highest accuracy of the points at which the upper bound of the local risk (the share of errors among
    rows that are answered before the last tier) is at most ``max_error``. Latency charges a tier in
    full if it is first, else by the share answered at or before it."""
    names = list(tiers)
    aligned = align(tiers)
    med = aligned.agg(*[F.coalesce(F.median(f"latency_{t}"), F.lit(0.0)).alias(t) for t in names]).first()
    lat = {t: (latency or {}).get(t) or med[t] for t in names}
    knots = {t: calibrate(aligned, t) for t in names} if calibrated else None
    cells = grid_cells(aligned, names, grid, knots).toPandas()  # bounded by the grid, not the rows
    points = np.linspace(0, 1, grid)
    n, count = int(cells["n"].sum()), cells["n"].to_numpy()
    out = []
    for order, arch in enumerate(architectures(names)):
        best = cert = None
        for combo in product(range(grid), repeat=len(arch) - 1):
            free, right, kept, by = np.ones(len(cells), bool), 0, 0, {}
            for t, i in zip(arch, [*combo, -1]):
                here = free & (cells[f"k_{t}"].to_numpy() > i)
                by[t] = int(count[here].sum())
                kept = right  # right answers before the last tier
                right += int((count[here] * cells[f"ok_{t}"].to_numpy()[here]).sum())
                free &= ~here
            acc = right / n if n else 0.0
            share = {t: by[t] / n if n else 0.0 for t in arch}
            row = {"architecture": "->".join(arch), "thresholds": {t: float(points[i]) for t, i in zip(arch, combo)}, "accuracy": acc, "terminal_share": share[arch[-1]], "cost": sum(costs[t] * share[t] for t in arch)}
            seen, ms = 0.0, 0.0
            for j, t in enumerate(arch):
                seen += share[t]
                ms += lat[t] * (1 if j == 0 else seen)
            row |= {"latency_ms": ms, "order": order}
            if (len(arch) == 1 or share[arch[-1]] <= max_terminal) and (best is None or acc > best["accuracy"]):
                best = row
            local = n - by[arch[-1]]
            if max_error is not None and len(arch) > 1 and local and (cert is None or acc > cert["accuracy"]):
                bound = upper_bound(local - kept, local, confidence)
                if bound <= max_error:
                    cert = row | {"error_bound": bound}
        if best is not None:
            out.append(best | {"certified": cert})
    return sorted(out, key=lambda r: (-r["accuracy"], r["cost"], r["latency_ms"], r["order"]))


def synthetic(spark: SparkSession, rows: int = 4000) -> dict[str, DataFrame]:
    """Three tiers of rising strength with informative confidences, made from hashes of the id."""
    base = spark.range(rows).select(F.col("id"), F.concat(F.lit("c"), F.pmod("id", F.lit(7))).alias("gold"))
    out = {}
    for name, acc in (("a", 0.7), ("b", 0.85), ("c", 1.0)):
        u = F.pmod(F.xxhash64("id", F.lit(name)), F.lit(10_000)) / 10_000
        v = F.pmod(F.xxhash64("id", F.lit(name), F.lit(1)), F.lit(1000)) / 1000
        ok = u < acc
        out[name] = base.select("id", "gold", F.when(ok, F.col("gold")).otherwise("wrong").alias("predicted"), F.when(ok, 0.4 + 0.6 * v).otherwise(0.6 * v).alias("confidence"))
    return out
