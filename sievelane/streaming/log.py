"""The prediction log as a stream (T-a to T-e, K2, K3)."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import use_checkpoints
from ..operators.loop import LOG, conform


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a temporary folder only
    where it is unset and Spark runs on one machine."""
    use_checkpoints(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()


def append_stream(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream of predictions to the log; restarts continue where they ended."""
    return conform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start()


def dual_append(stream: DataFrame, key: str, train_path: str, raw_path: str, checkpoint: str):
    """Each batch writes training rows, then the raw rows that mark them done. Batches have folders
    of their own and overwrite them, so a batch that is run again leaves nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        once = batch.dropDuplicates([key])
        once.select(key, "text", "generated").write.mode("overwrite").parquet(f"{train_path}/batch={number}")
        once.write.mode("overwrite").parquet(f"{raw_path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def event_windows(stream: DataFrame, time: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows and mean confidence by tier and event-time window, with a watermark for late rows."""
    t = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.window("_t", width), "tier").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence")).select(F.col("window.start").alias("start"), "tier", "n", "confidence")


def curate_stream(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Keeps the last feedback of each text (by ``pos``) while predictions arrive. The state has ``buckets``
    folders by the hash of the text; a batch rewrites those that it touches, in a new folder of its own
    number, so a batch that is run again leaves the same state. ``curated`` reads it."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fed = conform(batch).filter("feedback is not null").withColumn("bucket", F.expr(f"cast(pmod(xxhash64(input_hash), {buckets}) as int)"))
        touched = fed.select("bucket").distinct()
        old = _state(spark, path, number)
        both = fed if old is None else fed.unionByName(old.drop("batch").join(F.broadcast(touched), "bucket", "left_semi"))
        last = both.groupBy("bucket", "input_hash").agg(F.max_by(F.struct(*[c for c in LOG.fieldNames() if c != "input_hash"]), "pos").alias("r"))
        last.select("bucket", "input_hash", "r.*").select(*LOG.fieldNames(), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def _state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Each bucket as the last batch that touched it left it."""
    try:
        all_ = spark.read.parquet(path)
    except AnalysisException:
        return None
    all_ = all_ if before is None else all_.filter(F.col("batch") < before)
    newest = all_.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return all_.join(F.broadcast(newest), ["bucket", "batch"])


def curated(spark: SparkSession, path: str) -> DataFrame:
    """text, label, input_hash of the state of ``curate_stream``."""
    return _state(spark, path).select("text", F.col("feedback").alias("label"), "input_hash")


def run_through(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """The log that a finite stream leaves, read back."""
    base = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    append_stream(stream, f"{base}/log", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/log")
