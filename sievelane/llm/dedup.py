"""Near-duplicate removal on top of the n-gram join: of each connected group of similar documents
the one with the smallest ``doc_id`` stays. What goes is decided on narrow rows; texts move once.

Edge cases: of rows that repeat a kept ``doc_id`` the one with the smallest text stays; rows with a
null ``doc_id`` can't be paired and stay, rows of them with equal texts once; texts without words are
in no group and stay; other columns are left alone whatever their names; an empty table gives an empty
result. Among rows that agree in id and text, the one with the smallest hash of all columns stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import NGRAM, THRESHOLD, connected


def keep_one(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    gone = connected(docs, n, threshold).filter("doc_id <> class_id").select(F.col("doc_id").alias("_gone"))
    again = docs.groupBy(F.col("doc_id").cast("long").alias("_again")).count().filter("_again is null or count > 1").select("_again")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("_id", F.col("row.doc_id").cast("long"))
    left = row.join(gone.hint("shuffle_hash"), F.col("_id") == F.col("_gone"), "left_anti")
    if again.isEmpty():
        return left.select("row.*")
    ids = again.filter("_again is not null")
    some = left.join(ids, F.col("_id") == F.col("_again"), "left_semi").unionByName(left.filter("_id is null"))
    one = some.groupBy("_id", F.expr("case when _id is null then xxhash64(row.text) end").alias("_t")).agg(F.min_by("row", F.struct("row.text", F.xxhash64(*[f"row.`{c}`" for c in docs.columns]))).alias("row"))
    return left.filter("_id is not null").join(ids, F.col("_id") == F.col("_again"), "left_anti").select("row.*").unionByName(one.select("row.*"))
