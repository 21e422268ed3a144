"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; its temporaries take about 40 times as much.
SLICE_BYTES = 1 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``. Only where the setting
    is absent and Spark runs on one machine (tests) is a temporary folder set as the checkpoint folder."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d
    if not spark.sparkContext.getCheckpointDir() and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievelane-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage there; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished, checkpointed phases. The first collection only
    finds plans that Python has just let go of; their shuffles are free in the one after. On one
    machine there is one collection and no wait."""
    for k in range(1 if spark.sparkContext.master.startswith("local[") else 3):
        time.sleep(0.3 * (k > 0))
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Row ranges of a string column that hold about ``limit`` bytes each, at least one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0).cast(pa.int64()))
    if not len(size):
        return []
    group = (np.cumsum(size) - size) // limit
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(size)]))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def flat(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def join_classes(members: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """``members`` joined with ``classes``, which has ``key`` once and the number ``m`` of its members. Classes
    with more than a thousandth of all members are at most a thousand rows and are broadcast, so a
    class that holds a third of all rows isn't shuffled."""
    total = classes.agg(F.sum("m")).first()[0] or 0
    hot = classes.filter(F.col("m") * 1000 > total)
    rest = members.join(F.broadcast(hot.select(key)), key, "left_anti").join(classes.filter(F.col("m") * 1000 <= total), key)
    return members.join(F.broadcast(hot), key).unionByName(rest)


def split_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


__all__ = ["F", "checkpoint_dir", "cut", "documents", "flat", "join_classes", "release", "slices", "split_partitions", "union_all"]
