"""Queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, langid, lm_score, mixing, ngram_join, packing, pii, quality, secret_scan, url_filter
from .common import documents

#: Files of public tokenizers; they are read where they lie.
TOKENIZERS = os.environ.get("SIEVELANE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(documents(spark, sf_dir))


def ngram_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_pairs(documents(spark, sf_dir))


def ngram_jaccard_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.all_pairs(documents(spark, sf_dir))


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(documents(spark, sf_dir), size="n_chars", temperature=mixing.TEMPERATURE).drop("_r")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.match(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.rule_table(spark))


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir), VOCABULARY)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir), VOCABULARY)


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is sketched; the query set of the search is every id that 50 divides."""
    return fingerprint.overlaps(documents(spark, sf_dir), F.expr("doc_id % 50 = 0"))


def fingerprint_source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.source_overlap(documents(spark, sf_dir))


def fingerprint_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set is every document whose id is divisible by 50; it is searched in all documents."""
    return fingerprint.search(documents(spark, sf_dir), F.expr("doc_id % 50 = 0"))


ALL = (
    op1_ngram_jaccard_join,
    ngram_jaccard_pairs,
    ngram_jaccard_all_pairs,
    op2_pii_bootstrap,
    op3_quality_rules,
    op4_language_id,
    op5_source_mixing,
    op6_url_filter,
    op7_pattern_packing,
    op8_lm_score,
    op9_secret_scan,
    op10_document_fingerprints,
    fingerprint_source_overlap,
    fingerprint_search,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


NGRAM_JOIN_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3
        THEN list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))
        ELSE [array_to_string(w, ' ')] END AS s FROM w WHERE len(w) > 0),
c AS (SELECT min(doc_id) AS rep, list(DISTINCT doc_id) AS members, any_value(s) AS s, len(any_value(s)) AS n FROM s GROUP BY md5(array_to_string(s, chr(1)))),
e AS (SELECT rep, n, unnest(s) AS g FROM c),
k AS (SELECT a.rep AS doc_a, b.rep AS doc_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS joint
      FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep)
SELECT doc_a, doc_b, round(joint / (na + nb - joint), 6) AS jaccard FROM k WHERE joint / (na + nb - joint) >= 0.55
UNION ALL
SELECT rep AS doc_a, m AS doc_b, 1.0::DOUBLE AS jaccard FROM (SELECT rep, unnest(members) AS m FROM c) WHERE m <> rep
"""

#: Every pair, without the classes; sets of a document that repeats with several texts are apart.
NGRAM_ALL_PAIRS_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN len(w) >= 3
        THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
        ELSE [array_to_string(w, ' ')] END AS s FROM w WHERE len(w) > 0),
e AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS g FROM s),
k AS (SELECT any_value(a.doc_id) AS doc_a, any_value(b.doc_id) AS doc_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS joint
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.r, b.r)
SELECT doc_a, doc_b, round(max(joint / (na + nb - joint)), 6) AS jaccard FROM k WHERE joint / (na + nb - joint) >= 0.55 GROUP BY doc_a, doc_b
"""


#: One row for each document: the smallest document of its connected group, links and the best one.
NGRAM_GROUPS_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 3
        THEN list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))
        ELSE [array_to_string(w, ' ')] END AS s FROM w WHERE len(w) > 0),
r AS (SELECT row_number() OVER () AS r, doc_id, s FROM s),
e AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS g FROM r),
k AS (SELECT a.r AS x, b.r AS y, any_value(a.doc_id) AS a, any_value(b.doc_id) AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS joint
      FROM e a JOIN e b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
p AS (SELECT a, b, joint / (na + nb - joint) AS j FROM k WHERE joint / (na + nb - joint) >= 0.55),
g AS (SELECT DISTINCT a AS d, b AS c FROM p UNION SELECT g.d, p.b AS c FROM g JOIN p ON g.c = p.a),
m AS (SELECT d, min(c) AS c FROM g GROUP BY d),
l AS (SELECT a AS d, count(*) AS links, round(max(j), 6) AS best FROM p GROUP BY a)
SELECT t.doc_id, least(t.doc_id, coalesce(m.c, t.doc_id)) AS class_id, coalesce(l.links, 0)::BIGINT AS links, l.best
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) t LEFT JOIN m ON m.d = t.doc_id LEFT JOIN l ON l.d = t.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": NGRAM_GROUPS_SQL, "ngram_jaccard_pairs": NGRAM_JOIN_SQL, "ngram_jaccard_all_pairs": NGRAM_ALL_PAIRS_SQL, "op3_quality_rules": quality.sql(), "op6_url_filter": url_filter.sql()}
