"""Splits and samples (C4, D2, D9, D16, S10, A21). Orders are hashes of (seed, id), so splits
don't depend on the order of the input or its partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def seeded(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def split_dataset(df: DataFrame, key: str, label: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """Adds ``split``: in each class the first round(n r0) rows train, the next round(n r1) valid,
    the rest test; counts round half to even."""
    if any(r < 0 for r in ratios) or abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must be non-negative and sum to 1")
    # a row's rank in its class is the number of rows in the buckets of hashes before its own, and its
    # rank in the bucket, so that a class is never one task
    order = seeded(key, seed)
    row = df.withColumn("_h", order).withColumn("_b", F.substring("_h", 1, 4))
    sizes = row.groupBy(F.col(label).alias("_l"), "_b").agg(F.count("*").alias("_size"))
    per = W.partitionBy("_l")
    sizes = sizes.select(F.col("_l"), F.col("_b").alias("_bucket"), F.sum("_size").over(per).alias("_n"), (F.sum("_size").over(per.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_size")).alias("_before"))
    row = row.withColumn("_rank", F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", key)))
    row = row.join(sizes, row[label].eqNullSafe(sizes["_l"]) & (row["_b"] == sizes["_bucket"]))
    n, rank = F.col("_n"), F.col("_rank") + F.col("_before")
    train = F.least(F.rint(n * F.lit(ratios[0])), n)
    valid = F.least(F.rint(n * F.lit(ratios[1])), n - train)
    return row.withColumn("split", F.when(rank <= train, "train").when(rank <= train + valid, "valid").otherwise("test")).drop("_h", "_b", "_l", "_bucket", "_n", "_before", "_rank")


def split_gates(df: DataFrame, label: str, minimum: int = 10) -> None:
    """Refuses tables that can't be split: fewer rows than ``minimum``, or labels that are all different."""
    n = df.limit(minimum).count()
    if n < minimum:
        raise ValueError(f"{n} rows, at least {minimum} are needed")
    if df.filter(F.col(label).isNotNull()).groupBy(label).count().filter("count > 1").isEmpty():
        raise ValueError("each label occurs once; nothing can be stratified by them")


def split_summary(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy("split", label).agg(F.count("*").alias("n"))


def split_warnings(df: DataFrame, label: str, small: int = 5) -> DataFrame:
    """(rule, subject, n): splits without rows (``empty_split``), classes with fewer than ``small`` rows
    (``small_class``), and classes that a split lacks (``class_not_in_split``, subject ``label/split``)."""
    n = split_summary(df, label).withColumn("label", F.col(label).cast("string"))
    splits = df.sparkSession.createDataFrame([("train",), ("valid",), ("test",)], "split string")
    per = splits.join(n.groupBy("split").agg(F.sum("n").alias("n")), "split", "left").fillna(0, ["n"])
    empty = per.filter("n = 0").select(F.lit("empty_split").alias("rule"), F.col("split").alias("subject"), F.col("n").cast("long").alias("n"))
    sizes = n.groupBy("label").agg(F.sum("n").alias("n"))
    few = sizes.filter(F.col("n") < small).select(F.lit("small_class"), F.col("label"), "n")
    lack = sizes.crossJoin(F.broadcast(per.filter("n > 0").select("split"))).join(n.select("label", "split"), ["label", "split"], "left_anti")
    return empty.union(few).union(lack.select(F.lit("class_not_in_split"), F.concat_ws("/", "label", "split"), "n"))


def group_holdout(df: DataFrame, group: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split`` so that no group is in two splits."""
    u = F.conv(F.substring(seeded(group, seed), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return df.withColumn("split", F.when(u < share, "test").otherwise("train"))


def audit_slice(df: DataFrame, key: str, share: float = 0.05, seed: int = 42) -> DataFrame:
    """A uniform slice by hash, the same for the same ids."""
    u = F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return df.filter(u < share)


def stratified_sample(df: DataFrame, key: str, label: str, per_class: int, seed: int = 42) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(label).orderBy(seeded(key, seed), key))
    return df.withColumn("_r", rank).filter(F.col("_r") <= per_class).drop("_r")
