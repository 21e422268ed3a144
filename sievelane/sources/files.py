"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..operators.common import global_rank
from ..operators.loop import conform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of each line. A file is one row of the scan, so that its lines
    can be numbered; use ``read_jsonl`` where numbers don't matter."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("i", "value"))
    last = F.max("i").over(W.partitionBy("file"))
    return lines.withColumn("_last", last).filter((F.col("i") < F.col("_last")) | (F.col("value") != "")).select("file", (F.col("i") + 1).cast("long").alias("line"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, blank: str = "skip") -> DataFrame:
    """Records of a JSONL file or folder under a declared schema. ``blank`` lines are skipped or
    an ``error``; malformed lines always fail the query, with the line in the message."""
    raw = spark.read.text(path)
    if blank == "skip":
        raw = raw.filter(F.trim("value") != "")
    bad = F.expr("try_parse_json(value) is null")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("malformed record: "), F.substring("value", 1, 80)))).otherwise(F.col("value"))
    return raw.select(F.from_json(checked, schema if isinstance(schema, str) else schema.simpleString()).alias("r")).select("r.*")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """gold, predicted of a predictions file: ``expected`` where a record has that key, else ``label``. The first
    bad line fails the query with file, line and kind of error; blank lines are skipped."""
    lines = read_lines(spark, path).filter(F.trim("value") != "")
    keys = F.json_object_keys("value")
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    kind = F.when(F.expr("try_parse_json(value) is null"), "JSONDecodeError").when(keys.isNull(), "TypeError: not an object").when(~has("expected") & ~has("label"), "KeyError: label").when(~has("predicted"), "KeyError: predicted")
    where = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(": bad prediction line ("), kind, F.lit(")"))
    value = F.when(kind.isNotNull(), F.raise_error(where)).otherwise(F.col("value"))
    get = lambda k: F.get_json_object(F.col("checked"), f"$.{k}")
    return lines.select(value.alias("checked"), has("expected").alias("first")).select(F.when(F.col("first"), get("expected")).otherwise(get("label")).alias("gold"), get("predicted").alias("predicted"))


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value of the lines that aren't JSON (blank ones aside)."""
    return read_lines(spark, path).filter((F.trim("value") != "") & F.expr("try_parse_json(value) is null"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """source, text of all .txt and .md files (any case) below a folder, or of the one file that ``path``
    names, whatever its extension; bytes that aren't UTF-8 are replaced."""
    named = F.col("path").endswith(path.rstrip("/"))  # only a file's own path ends with what was asked for
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(named | F.lower("path").rlike(r"\.(txt|md)$"))

    def run(batches):
        for b in batches:
            yield b.assign(text=[c.decode("utf-8", "replace") for c in b["content"]])[["path", "text"]].rename(columns={"path": "source"})

    return files.select("path", "content").mapInPandas(run, "source string, text string")


def head(df: DataFrame, pos: str, n: int = 1000) -> DataFrame:
    """The first ``n`` rows by ``pos``."""
    return df.orderBy(pos).limit(n)


def stride_sample(df: DataFrame, pos: str, k: int = 4) -> DataFrame:
    """``k`` rows at equal distances: those of rank 0, s, 2 s, ... by ``pos``, with s = max(1, n div k)."""
    ranked = global_rank(df, pos, name="_rank")
    n = ranked.count()
    return ranked.filter((F.col("_rank") - 1) % max(1, n // k) == 0).orderBy("_rank").limit(k).drop("_rank")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """Distinct, stripped, non-empty lines."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''").distinct()


def keyed_last(df: DataFrame, key: str, pos: str) -> DataFrame:
    """The last record of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct("*"), pos).alias("_r")).select("_r.*")


def done_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.select(key).distinct()


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder for each value of ``split``."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def init_log(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """An empty log; refuses a path that has rows."""
    try:
        old = spark.read.schema(schema).parquet(path).limit(1).count()
    except AnalysisException:
        old = 0
    if old:
        raise ValueError(f"{path} has rows")
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Appends predictions in the log's columns; absent ones are null, an absent input hash is computed."""
    conform(df).write.mode("append").parquet(path)


def write_flagged(gated: DataFrame, path: str) -> None:
    """The rows of a grounding gate that aren't clean or are over budget, as JSONL."""
    write_jsonl(gated.filter(~F.col("clean") | F.col("over_budget")), path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A one-row frame as one JSON document; refuses other frames."""
    if df.limit(2).count() != 1:
        raise ValueError("metrics are one row")
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def report(df: DataFrame, title: str, rows: int = 1000) -> str:
    """A Markdown table of a small frame; refuses one with more than ``rows`` rows."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"more than {rows} rows")
    show: Callable[[object], str] = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([f"# {title}", "", *head, *("| " + " | ".join(show(v) for v in r) + " |" for r in got)]) + "\n"
