"""A corpus pipeline of five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that its
predecessor kept. All stages but the last return the columns of ``documents``.

Edge cases: every stage keeps other columns, whatever their names, and gives an empty table for an empty
one. Null and empty texts go in the first stage. Rows that repeat a ``doc_id`` are one document from the second
stage on; rows with a null ``doc_id`` can't be paired and stay, those of equal text once. A null source is a
source of its own. Ties are settled by ``doc_id``. Each operator's module says more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sievelane.llm import dedup, mixing, packing, quality, queries, secret_scan
from sievelane.llm.common import checkpoint_dir, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return quality.accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, the one with the smallest doc_id."""
    return dedup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return secret_scan.redact(docs, queries.VOCABULARY)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that sources have their target weights."""
    return mixing.mix(docs, size="n_chars", temperature=mixing.TEMPERATURE)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: Mixing draws at random and packing fits by least squares; neither can be stated in SQL. The
#: stages are tested against brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
        release(spark)
        if k:
            delete(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def delete(spark: SparkSession, folder: str) -> None:
    """Drop what a later stage has read and written anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
