"""What several operators share: the folder for intermediate tables and ranks over a whole table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def use_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to ``spark.checkpoint.dir``, which all executors share. Without it a temporary
    folder serves on one machine; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sievelane-")
    if folder and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def global_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Adds the rank (from 1) of each row of the whole table by ``order``; rows that tie in all of it are
    ranked in any order. The table is range-partitioned, ranked within partitions and shifted by
    the sizes of the partitions before, so no task holds more than a partition."""
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))  # a row for each partition
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_local", local).join(F.broadcast(sizes), "_part").withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")
