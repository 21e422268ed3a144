"""Registry of the library's queries and of the DuckDB SQL that checks them.

Each query runs over its whole tables. ``LOG`` reads ``events`` as a prediction log, ``PREDS``
reads ``labels`` as predictions; their columns follow from ids, so SQL can state them too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import grams
from .functions import records as rec
from .functions import text as tx
from .operators import cascade, chunk, classify, dedup, generation, grounding, hparams, loop, metrics, split, validate, vectors
from .sources import files
from .sources.files import table
from .streaming import log as stream_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c, digits: int = 6):
    return F.round(c, digits)


def docs(s, d):
    return table(s, d, "documents")


def prediction_log(s, d):
    e, i = table(s, d, "events"), F.col("event_id")
    fed = F.when(i % 3 == 0, F.concat(F.lit("c"), (i + F.when(i % 7 == 0, 1).otherwise(0)) % 5))
    e = e.select(i.alias("pos"), F.col("event_type").alias("tier"), F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"), F.concat(F.lit("c"), i % 5).alias("prediction"), fed.alias("feedback"), F.when((i % 3 == 0) & (i % 4 == 0), "audit").when((i % 3 == 0) & (i % 4 == 1), "user").alias("feedback_source"), F.concat(F.lit("q"), F.col("user_id")).alias("text"))
    return loop.conform(e)


LOG = """log AS (SELECT event_id AS pos, event_type AS tier, least(value / 500, 1.0::DOUBLE) AS confidence, 'c' || (event_id % 5) AS prediction,
 CASE WHEN event_id % 3 = 0 THEN 'c' || ((event_id + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) % 5) END AS feedback,
 CASE WHEN event_id % 12 = 0 THEN 'audit' WHEN event_id % 3 = 0 AND event_id % 4 = 1 THEN 'user' END AS feedback_source,
 'q' || user_id AS text, substr(sha256('q' || user_id), 1, 16) AS input_hash FROM events)"""


def predictions(s, d):
    i = F.col("doc_id")
    said = F.when(i % 11 == 0, "other").when(F.col("toxic") == 1, "Q0 ").otherwise("q1")
    return table(s, d, "labels").select(i, F.concat(F.lit("q"), "quality").alias("gold"), said.alias("predicted"), F.when(i % 4 == 0, "q0").otherwise("q1").alias("second"))


PREDS = """p AS (SELECT doc_id, 'q' || quality AS gold, CASE WHEN doc_id % 11 = 0 THEN 'other' WHEN toxic = 1 THEN 'q0' ELSE 'q1' END AS predicted,
 CASE WHEN doc_id % 4 = 0 THEN 'q0' ELSE 'q1' END AS second FROM labels),
k AS (SELECT gold, predicted, count(*) AS n FROM p GROUP BY ALL),
g AS (SELECT gold AS label, CAST(sum(n) AS BIGINT) AS support, CAST(sum(CASE WHEN gold = predicted THEN n ELSE 0 END) AS BIGINT) AS tp FROM k GROUP BY 1),
q AS (SELECT label, support, tp, coalesce((SELECT sum(n) FROM k WHERE predicted = label), 0) AS said FROM g),
f AS (SELECT label, support, CASE WHEN said > 0 THEN tp::DOUBLE / said ELSE 0 END AS precision, tp::DOUBLE / support AS recall FROM q),
c AS (SELECT label, support, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM f)"""
NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


# Text and records


@query(f"SELECT doc_id, md5({NORM}) AS norm_md5 FROM documents")
def normalize_text(s, d):
    return docs(s, d).select("doc_id", F.md5(tx.normalize_text(F.col("text"))).alias("norm_md5"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS input_hash FROM documents")
def input_hash(s, d):
    return docs(s, d).select("doc_id", tx.input_hash(F.col("text")).alias("input_hash"))


@query("SELECT lang, count(*) AS n, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, max(length(text) // 4) AS most FROM documents GROUP BY lang")
def approx_tokens_by_lang(s, d):
    return docs(s, d).withColumn("t", tx.approx_tokens(F.col("text"))).groupBy("lang").agg(F.count("*").alias("n"), F.sum("t").alias("tokens"), F.max("t").alias("most"))


@query(f"SELECT doc_id, CAST(CASE WHEN len(c) = 0 THEN 0 WHEN len(c) < 4 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(c) - 2), lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3]))) END AS BIGINT) AS n FROM (SELECT doc_id, regexp_extract_all({NORM}, '(?s).') AS c FROM documents)")
def shingle_counts(s, d):
    return docs(s, d).select("doc_id", grams.shingle_count(tx.normalize_text(F.col("text"))).alias("n"))


@query("""WITH m AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<think>a</think> ' || text WHEN 1 THEN 'x</think>' || text ELSE text || '<think>tail' END AS t FROM documents)
SELECT doc_id, md5(trim(string_split(string_split(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g'), '</think>')[-1], '<think>')[1], E' \\t\\n\\r\\f')) AS answer,
md5(trim(regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g'), '</?think>', '', 'g'), E' \\t\\n\\r\\f')) AS untagged FROM m""")
def strip_thinking(s, d):
    i, c = F.col("doc_id") % 3, F.col("text")
    t = F.when(i == 0, F.concat(F.lit("<think>a</think> "), c)).when(i == 1, F.concat(F.lit("x</think>"), c)).otherwise(F.concat(c, F.lit("<think>tail")))
    return docs(s, d).select("doc_id", F.md5(tx.strip_thinking(t)).alias("answer"), F.md5(tx.strip_think_tags(t)).alias("untagged"))


def _records(s, d):
    """Records of each format, made of turns; one in six has none of the known keys."""
    i, keys = F.col("turn") + F.col("conv_id"), (("prompt", "completion"), ("messages", "tools"), ("messages",), ("text", "messages"), ("text",), ("label",))
    v = None
    for k, names in enumerate(keys):
        one = F.to_json(F.struct(*[F.col("text").alias(n) for n in names]), {"ignoreNullFields": "false"})
        v = F.when(i % 6 == k, one) if v is None else v.when(i % 6 == k, one)
    return table(s, d, "conversations").select("conv_id", "turn", v.alias("v"))


@query("""WITH r AS (SELECT conv_id, turn, CASE (turn + conv_id) % 6 WHEN 0 THEN json_object('prompt', text, 'completion', text) WHEN 1 THEN json_object('messages', text, 'tools', text) WHEN 2 THEN json_object('messages', text)
 WHEN 3 THEN json_object('text', text, 'messages', text) WHEN 4 THEN json_object('text', text) ELSE json_object('label', text) END AS v FROM conversations), k AS (SELECT conv_id, turn, json_keys(v) AS k FROM r)
SELECT conv_id, turn, CASE WHEN list_contains(k, 'prompt') AND list_contains(k, 'completion') THEN 'completions' WHEN list_contains(k, 'messages') AND list_contains(k, 'tools') THEN 'tools'
 WHEN list_contains(k, 'messages') THEN 'chat' WHEN list_contains(k, 'text') THEN 'text' END AS format FROM k""")
def format_detect(s, d):
    return _records(s, d).select("conv_id", "turn", rec.detect_format(F.col("v")).alias("format"))


@query("""SELECT conv_id, turn, CAST(CASE (turn + conv_id) % 6 WHEN 0 THEN 2 * n WHEN 3 THEN n WHEN 4 THEN n END AS BIGINT) AS chars FROM (SELECT conv_id, turn, length(text) AS n FROM conversations) WHERE (turn + conv_id) % 6 IN (0, 3, 4)""")
def record_sizes(s, d):
    return _records(s, d).filter((F.col("turn") + F.col("conv_id")) % 6 % 4 != 1).filter(~((F.col("turn") + F.col("conv_id")) % 6).isin(2)).select("conv_id", "turn", rec.record_chars("v").alias("chars"))


@query("SELECT conv_id, coalesce(string_agg(coalesce(text, 'None'), ' ' ORDER BY turn) FILTER (WHERE role IS DISTINCT FROM 'system'), '') AS text FROM conversations GROUP BY conv_id")
def record_text_chat(s, d):
    return rec.turns_to_chats(table(s, d, "conversations")).select("conv_id", rec.message_text(F.col("messages")).alias("text"))


@query("""SELECT conv_id, CAST(count(*) - CASE WHEN arg_max(role, turn) = 'assistant' THEN 1 ELSE 0 END AS BIGINT) AS n_prompt,
CASE WHEN arg_max(role, turn) = 'assistant' THEN coalesce(arg_max(text, turn), '') ELSE '' END AS expected,
coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '') AS first_user FROM conversations GROUP BY conv_id""")
def split_record(s, d):
    prompt, expected = rec.split_record(F.col("messages"))
    return rec.turns_to_chats(table(s, d, "conversations")).select("conv_id", F.size(prompt).cast("long").alias("n_prompt"), expected.alias("expected"), rec.first_user(prompt).alias("first_user"))


@query("SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant'), '_all') AS label FROM conversations GROUP BY conv_id")
def label_from_assistant(s, d):
    return rec.turns_to_chats(table(s, d, "conversations")).select("conv_id", rec.label_of(F.col("messages")).alias("label"))


@query("""WITH c AS (SELECT conv_id, arg_max(role, turn) AS last, bool_or(role = 'user') AS has_user, bool_or(role NOT IN ('system', 'user', 'assistant')) AS bad, bool_or(trim(coalesce(text, '')) = '') AS empty, sum(length(coalesce(text, ''))) AS chars FROM conversations GROUP BY 1),
i AS (SELECT 'error' AS severity, 'last_not_assistant' AS rule FROM c WHERE last <> 'assistant' UNION ALL SELECT 'error', 'no_user_turn' FROM c WHERE NOT has_user UNION ALL SELECT 'error', 'bad_role' FROM c WHERE bad UNION ALL SELECT 'error', 'empty_content' FROM c WHERE empty UNION ALL SELECT 'warning', 'over_long' FROM c WHERE chars // 4 > 4096)
SELECT severity, rule, count(*) AS n FROM i GROUP BY ALL""")
def validate_chat(s, d):
    rows = rec.turns_to_chats(table(s, d, "conversations")).select(F.lit("train").alias("split"), F.col("conv_id").alias("line"), F.to_json(F.struct("messages")).alias("value"))
    return validate.issues(rows).groupBy("severity", "rule").agg(F.count("*").alias("n"))


# Deduplication


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {NORM} ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def exact_dedup(s, d):
    return dedup.exact_dedup(docs(s, d).select("doc_id", "text"), "doc_id").select("doc_id")


@query(f"SELECT lang, count(*) AS n_rows, count(DISTINCT {NORM}) AS n_distinct FROM documents GROUP BY lang")
def exact_dedup_stats(s, d):
    return dedup.duplicate_stats(docs(s, d), ["lang"])


@query(f"SELECT source, lang, count(*) AS n_rows, count(DISTINCT {NORM}) AS n_distinct FROM documents GROUP BY ALL")
def leakage_report(s, d):
    return dedup.duplicate_stats(docs(s, d), ["source", "lang"])


@query()
def near_dedup(s, d):
    return dedup.near_dedup(docs(s, d).select("doc_id", "text"), "doc_id").select("doc_id")


@query()
def family_head_share(s, d):
    return dedup.head_share(dedup.families(docs(s, d), "doc_id"))


@query(f"""WITH t AS (SELECT DISTINCT source AS s, {NORM} AS t FROM documents)
SELECT a.s AS split_a, b.s AS split_b, count(*) AS n FROM t a JOIN t b ON a.t = b.t AND a.s < b.s GROUP BY ALL""")
def split_overlap(s, d):
    return dedup.split_overlap(docs(s, d), "source")


def _grams(t: str, key: str) -> str:
    w = f"list_filter(string_split({NORM}, ' '), lambda x: x <> '')"
    return f"SELECT {key}, unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] || ' ' || w[i + 5] || ' ' || w[i + 6] || ' ' || w[i + 7]))) AS g FROM (SELECT {key}, {w} AS w FROM {t})"


@query(f"WITH a AS ({_grams('documents', 'doc_id')}), b AS ({_grams('benchmark', 'item_id')}), z AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1) SELECT doc_id, item_id, round(count(*)::DOUBLE / any_value(n), 6) AS overlap FROM a JOIN b USING (g) JOIN z USING (item_id) GROUP BY ALL HAVING count(*)::DOUBLE / any_value(n) >= 0.5")
def contamination(s, d):
    return dedup.contamination(docs(s, d), table(s, d, "benchmark")).withColumn("overlap", r6("overlap"))


@query(f"""WITH a AS ({_grams('documents', 'doc_id')}), b AS ({_grams('benchmark', 'item_id')}), x AS (SELECT doc_id, count(*) AS n FROM a GROUP BY 1), y AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1),
j AS (SELECT item_id, doc_id, count(*) AS m FROM a JOIN b USING (g) GROUP BY ALL), r AS (SELECT item_id, doc_id, m::DOUBLE / (x.n + y.n - m) AS j FROM j JOIN x USING (doc_id) JOIN y USING (item_id))
SELECT item_id, doc_id, round(j, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY j DESC, doc_id) AS k FROM r) WHERE k = 1""")
def cross_corpus(s, d):
    return dedup.cross_corpus(docs(s, d), table(s, d, "benchmark")).withColumn("jaccard", r6("jaccard"))


@query()
def collapse_report(s, d):
    return dedup.collapse_report(docs(s, d).select("doc_id", "text"), "doc_id")


@query()
def family_holdout(s, d):
    fam = dedup.families(docs(s, d).select("doc_id", "text"), "doc_id")
    return split.group_holdout(fam, "family").select("doc_id", "family", "split")


# Splits and samples

_LABELLED = "l AS (SELECT d.doc_id, d.lang, quality FROM documents d JOIN labels USING (doc_id))"
_SPLIT = f"""WITH {_LABELLED}, n AS (SELECT *, count(*) OVER (PARTITION BY quality) AS n, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) AS r FROM l),
s AS (SELECT doc_id, quality, CASE WHEN r <= round_even(n * 0.8::DOUBLE, 0) THEN 'train' WHEN r <= round_even(n * 0.8::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'valid' ELSE 'test' END AS split FROM n)"""


def labelled(s, d):
    return docs(s, d).join(table(s, d, "labels"), "doc_id").select("doc_id", "lang", "quality", "text")


@query(f"{_SPLIT} SELECT * FROM s")
def stratified_split(s, d):
    return split.split_dataset(labelled(s, d).select("doc_id", "quality"), "doc_id", "quality")


@query(f"""{_SPLIT}, c AS (SELECT split, CAST(quality AS VARCHAR) AS label, count(*) AS n FROM s GROUP BY ALL), z AS (SELECT v.split, coalesce(CAST(sum(n) AS BIGINT), 0) AS n FROM (VALUES ('train'), ('valid'), ('test')) v(split) LEFT JOIN c USING (split) GROUP BY 1),
t AS (SELECT label, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1)
SELECT 'empty_split' AS rule, split AS subject, n FROM z WHERE n = 0 UNION ALL SELECT 'small_class', label, n FROM t WHERE n < 1000
UNION ALL SELECT 'class_not_in_split', t.label || '/' || z.split, t.n FROM t, z WHERE z.n > 0 AND NOT EXISTS (SELECT 1 FROM c WHERE c.label = t.label AND c.split = z.split)""")
def split_warnings(s, d):
    return split.split_warnings(stratified_split(s, d), "quality", small=1000)


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, lang FROM r WHERE r % greatest(1, n // 4) = 0 AND r < 4 * greatest(1, n // 4)")
def stride_sample(s, d):
    return files.stride_sample(docs(s, d).select("doc_id", "lang"), "doc_id", 4)


@query(f"{_SPLIT} SELECT split, quality, count(*) AS n FROM s GROUP BY ALL")
def split_summary(s, d):
    return split.split_summary(stratified_split(s, d), "quality")


@query("SELECT doc_id, source, CASE WHEN ('0x' || substr(md5('42|' || source), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 THEN 'test' ELSE 'train' END AS split FROM documents")
def group_holdout(s, d):
    return split.group_holdout(docs(s, d).select("doc_id", "source"), "source")


@query("SELECT doc_id FROM documents WHERE ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.05")
def audit_sample(s, d):
    return split.audit_slice(docs(s, d).select("doc_id"), "doc_id")


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) <= 20")
def stratified_sample(s, d):
    return split.stratified_sample(docs(s, d).select("lang", "doc_id"), "doc_id", "lang", 20)


# Vectors and classifiers

_CENT = """v AS (SELECT vec_id, label, i, x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-12) AS x FROM (SELECT vec_id, label, embedding, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
m AS (SELECT label, i, avg(x) AS x FROM v GROUP BY ALL), z AS (SELECT label, sqrt(sum(x * x)) + 1e-12 AS z FROM m GROUP BY 1), ce AS (SELECT label, i, x / z AS x FROM m JOIN z USING (label))"""
_NEAR = f"""{_CENT}, sim AS (SELECT vec_id, v.label AS gold, ce.label AS label, sum(v.x * ce.x) AS sim FROM v JOIN ce USING (i) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label DESC) AS r FROM sim),
near AS (SELECT vec_id, any_value(gold) AS gold, max(CASE WHEN r = 1 THEN label END) AS predicted, max(CASE WHEN r = 1 THEN sim END) - max(CASE WHEN r = 2 THEN sim END) AS confidence FROM rk GROUP BY vec_id)"""


def _near(s, d):
    e = table(s, d, "embeddings")
    return vectors.nearest_centroid(e, vectors.centroids(e), "vec_id")


@query(f"WITH {_CENT} SELECT label, CAST(i - 1 AS BIGINT) AS i, round(x, 6) AS x FROM ce")
def centroids(s, d):
    return vectors.centroids(table(s, d, "embeddings")).select("label", F.posexplode("centroid").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), r6("x").alias("x"))


@query(f"WITH {_NEAR} SELECT vec_id, predicted, round(confidence, 4) AS confidence FROM near")
def nearest_centroid(s, d):
    return _near(s, d).withColumn("confidence", r6("confidence", 4))


@query(f"WITH {_NEAR} SELECT round(quantile_cont(confidence, 0.25), 6) AS p25, round(quantile_cont(confidence, 0.5), 6) AS p50, round(quantile_cont(confidence, 0.75), 6) AS p75, round(median(confidence), 6) AS median FROM near")
def margin_quantiles(s, d):
    q = metrics.quantiles(_near(s, d), "confidence")
    return q.select(*[r6(c).alias(c) for c in q.columns])


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda y: y::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z::DOUBLE))) + 1e-12)) AS v FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_dot_product(a.v, b.v) AS sim FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 12) DESC, neighbour) AS rank FROM p) SELECT vec_id, neighbour, rank, round(sim, 6) AS sim FROM r WHERE rank <= 3""")
def knn_fewshot(s, d):
    """The query set is every vector whose id is divisible by 50; it is compared with all vectors."""
    e = table(s, d, "embeddings")
    return vectors.top_k(e.filter("vec_id % 50 = 0"), e, "vec_id", blocks=vectors.blocks_for(e.count())).withColumn("sim", r6("sim"))


@query()
def logreg_holdout(s, d):
    _, report = classify.train_classifier(table(s, d, "embeddings"), "vec_id")
    return s.createDataFrame([report])


# Scores


@query(f"WITH {PREDS} SELECT round((SELECT sum(CASE WHEN gold = predicted THEN n ELSE 0 END) / sum(n) FROM k), 6) AS accuracy, round((SELECT avg(f1) FROM c), 6) AS macro_f1, (SELECT CAST(sum(n) AS BIGINT) FROM k) AS n, (SELECT count(*) FROM c) AS classes, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM k WHERE predicted NOT IN (SELECT label FROM c)) AS hallucinated")
def accuracy_macro_f1(s, d):
    return metrics.summary(predictions(s, d)).withColumn("accuracy", r6("accuracy")).withColumn("macro_f1", r6("macro_f1"))


@query(f"WITH {PREDS} SELECT * FROM k")
def confusion_long(s, d):
    return metrics.confusion(predictions(s, d))


@query(f"WITH {PREDS} SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM c")
def per_class_prf(s, d):
    return metrics.per_class(predictions(s, d)).select("label", "support", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {PREDS} SELECT predicted AS label, CAST(sum(n) AS BIGINT) AS n FROM k WHERE predicted NOT IN (SELECT gold FROM k) GROUP BY 1")
def hallucinated_labels(s, d):
    return metrics.hallucinated(predictions(s, d))


@query("SELECT quality AS label, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY 1")
def label_distribution(s, d):
    return metrics.distribution(table(s, d, "labels"), "quality").withColumn("share", r6("share"))


@query(f"""WITH {PREDS}, o AS (SELECT count(*) AS n, avg((gold = second)::INT) AS a FROM p), e AS (SELECT sum(na * nb)::DOUBLE AS m FROM (SELECT gold AS x, count(*) AS na FROM p GROUP BY 1) JOIN (SELECT second AS x, count(*) AS nb FROM p GROUP BY 1) USING (x))
SELECT gold AS label, count(*) AS n, round(avg((gold = second)::INT), 6) AS agreement, NULL::DOUBLE AS kappa FROM p GROUP BY 1 UNION ALL SELECT '_all', n, round(a, 6), round((a - m / n / n) / (1 - m / n / n), 6) FROM o, e""")
def agreement(s, d):
    return metrics.agreement(predictions(s, d), "gold", "second").withColumn("agreement", r6("agreement")).withColumn("kappa", r6("kappa"))


@query(f"WITH {PREDS} SELECT least(gold, second) AS label_1, greatest(gold, second) AS label_2, count(*) AS n FROM p WHERE gold <> second GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 1")
def confused_pair(s, d):
    return metrics.confused_pair(predictions(s, d), "gold", "second")


@query(f"WITH {PREDS} SELECT CASE WHEN gold = predicted AND gold = second THEN 'both' WHEN gold = predicted THEN 'only_a' WHEN gold = second THEN 'only_b' ELSE 'neither' END AS outcome, count(*) AS n FROM p GROUP BY 1")
def oracle_ensemble(s, d):
    return metrics.ensemble(predictions(s, d).withColumn("predicted", tx.norm_label(F.col("predicted"))), "gold", "predicted", "second")


@query(f"WITH {LOG}, g AS (SELECT i::DOUBLE / 40 AS threshold FROM range(41) v(i)), t AS (SELECT threshold, count(pos) AS covered, sum((feedback IS NOT DISTINCT FROM prediction)::INT) AS ok, sum((tier = 'click')::INT) AS hard FROM g LEFT JOIN log ON confidence >= threshold GROUP BY 1) SELECT threshold, covered, round(covered::DOUBLE / (SELECT count(*) FROM log), 6) AS coverage, CASE WHEN covered > 0 THEN round(ok::DOUBLE / covered, 6) END AS accuracy, CAST(CASE WHEN covered > 0 THEN coalesce(hard, 0) ELSE 0 END AS BIGINT) AS false_cheap FROM t")
def threshold_sweep(s, d):
    t = metrics.threshold_sweep(prediction_log(s, d), "confidence", F.col("feedback").eqNullSafe(F.col("prediction")), F.col("tier") == "click")
    return t.withColumn("coverage", r6("coverage")).withColumn("accuracy", r6("accuracy"))


@query(f"WITH {LOG}, f AS (SELECT row_number() OVER (ORDER BY pos) AS r, (feedback = prediction)::INT AS ok FROM log WHERE feedback IS NOT NULL), b AS (SELECT (r - 1) // 50 AS b, count(*) AS n, sum(ok) AS c FROM f GROUP BY 1) SELECT CAST(sum(n) OVER w AS BIGINT) AS n_seen, round((sum(c) OVER w)::DOUBLE / sum(n) OVER w, 6) AS accuracy FROM b WINDOW w AS (ORDER BY b)")
def running_accuracy(s, d):
    return metrics.running_accuracy(prediction_log(s, d).filter("feedback is not null"), "pos", F.col("feedback") == F.col("prediction")).withColumn("accuracy", r6("accuracy"))


@query(f"WITH {LOG} SELECT pos, round(confidence, 6) AS confidence FROM log ORDER BY log.confidence, pos LIMIT 100")
def uncertainty_queue(s, d):
    return metrics.uncertainty_queue(prediction_log(s, d).select("pos", "confidence"), "confidence", "pos").withColumn("confidence", r6("confidence"))


@query("WITH t AS (SELECT length(text) // 4 + 300 AS t, length(text) < 1500 AS cheap FROM documents) SELECT count(*) AS events, CAST(sum(cheap::INT) AS BIGINT) AS cheap, round(sum(t) * 15.0::DOUBLE / 1e6, 6) AS cost_all_dear, round((sum(CASE WHEN cheap THEN t ELSE 0 END) * 0.5::DOUBLE + sum(CASE WHEN cheap THEN 0 ELSE t END) * 15.0::DOUBLE) / 1e6, 6) AS cost_routed FROM t")
def routing_cost(s, d):
    c = metrics.routing_cost(docs(s, d), F.length("text"), F.length("text") < 1500, 0.5, 15.0)
    return c.withColumn("cost_all_dear", r6("cost_all_dear")).withColumn("cost_routed", r6("cost_routed"))


@query("SELECT lang AS label, count(*) AS n, count(*) >= 50 AS enough FROM documents GROUP BY 1")
def dataset_sizing(s, d):
    return metrics.sizing(docs(s, d), "lang")


@query(f"WITH {PREDS} SELECT round(avg((gold = predicted)::INT), 6) AS accuracy_a, round(avg((gold = second)::INT), 6) AS accuracy_b, round(avg((gold = predicted)::INT) - avg((gold = second)::INT), 6) AS gap FROM p")
def scoring_gap(s, d):
    p = predictions(s, d)
    g = metrics.scoring_gap(p, p.select("gold", F.col("second").alias("predicted")))
    return g.select(*[r6(c).alias(c) for c in g.columns])


@query("SELECT round(avg(json_valid(props)::INT), 6) AS json_rate, round(avg(length(props)), 6) AS mean_output, round(avg(length(event_type)), 6) AS mean_source, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg((event_type = 'click')::INT), 6) AS escalation FROM events")
def output_guardrails(s, d):
    g = metrics.output_guardrails(table(s, d, "events"), "props", "event_type", "value", F.col("event_type") == "click")
    return g.select(*[r6(c).alias(c) for c in g.columns])


# Grounding


def _hard(t: str) -> str:
    sep = grounding.SEPARATORS.replace("'", "''")
    is_hard = lambda x: "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in (grounding.NUMERIC, grounding.PATH, grounding.DOTTED, grounding.CODE)) + ")"
    raw = f"list_filter(list_transform(regexp_split_to_array({t}, '{sep}'), lambda x: trim(x, '.,:;)(')), lambda x: x <> '' AND {is_hard('x')})"
    parts = "list_filter(regexp_split_to_array(y, '[./:]+'), lambda p: p <> '')"
    return f"flatten(list_transform({raw}, lambda y: list_concat([y], CASE WHEN len({parts}) > 1 THEN list_filter({parts}, lambda z: {is_hard('z')}) ELSE [] END)))"


#: Every text is its own output, one in five with other values in it.
_OUT = "CASE WHEN doc_id % 5 = 0 THEN translate(text, '1', '7') || ' ref 2031-' || doc_id ELSE text END"
_GATE = f"WITH o AS (SELECT doc_id, text, {_OUT} AS out FROM documents), h AS (SELECT doc_id, length(out)::DOUBLE / greatest(length(text), 1) AS ratio, CAST(len(list_filter({_hard('out')}, lambda t: NOT contains(lower(text), lower(t)))) AS BIGINT) AS n_ungrounded FROM o)"


def _gated(s, d):
    out = F.when(F.col("doc_id") % 5 == 0, F.concat(F.translate("text", "1", "7"), F.lit(" ref 2031-"), F.col("doc_id"))).otherwise(F.col("text"))
    return grounding.gate(docs(s, d).withColumn("out", out), "text", "out")


@query(f"SELECT doc_id, array_to_string({_hard('text')}, ' ') AS tokens FROM documents")
def ground_hard_tokens(s, d):
    return docs(s, d).select("doc_id", F.array_join(grounding.hard_tokens(F.col("text")), " ").alias("tokens"))


@query(f"{_GATE} SELECT doc_id, n_ungrounded, round(ratio, 6) AS ratio, ratio > 0.4 AS over_budget, n_ungrounded = 0 AS clean FROM h")
def grounding_gate(s, d):
    return _gated(s, d).select("doc_id", "n_ungrounded", r6("ratio").alias("ratio"), "over_budget", "clean")


@query(f"{_GATE}, r AS (SELECT list_sort(list(round(ratio, 4))) AS r FROM h) SELECT count(*) AS n, round(avg((n_ungrounded = 0)::INT), 6) AS zero_rate, round(1 - avg((n_ungrounded = 0)::INT), 6) AS hallucinated_rate, (SELECT r[least(floor(0.5 * len(r))::INT, len(r) - 1) + 1] FROM r) AS ratio_p50, (SELECT r[least(floor(0.9 * len(r))::INT, len(r) - 1) + 1] FROM r) AS ratio_p90, max(round(ratio, 4)) AS ratio_max, CAST(sum((ratio > 0.4)::INT) AS BIGINT) AS over_budget, avg((n_ungrounded = 0)::INT) >= 0.99 AS passed FROM h")
def gate_summary(s, d):
    return grounding.gate_summary(_gated(s, d)).withColumn("zero_rate", r6("zero_rate")).withColumn("hallucinated_rate", r6("hallucinated_rate"))


# Generators, pairs and labels


@query(f"WITH {PREDS}, j AS (SELECT CASE WHEN predicted = second THEN 'tie' WHEN (substr(md5('7|' || doc_id), 1, 1) < '8') = (predicted = gold) THEN '2' ELSE '1' END AS w, substr(md5('7|' || doc_id), 1, 1) < '8' AS fl FROM p), v AS (SELECT CASE WHEN w = 'tie' THEN 'tie' WHEN (w = '1') <> fl THEN 'a' ELSE 'b' END AS result FROM j) SELECT result, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM v GROUP BY 1")
def pair_and_unblind(s, d):
    p = predictions(s, d).withColumn("predicted", tx.norm_label(F.col("predicted"))).withColumn("pos", F.lit(0))
    _, keys = generation.blind(generation.pair_predictions(p, p.select("doc_id", "pos", F.col("second").alias("predicted")), "doc_id"), "doc_id")
    good = F.col("predicted") == F.col("gold")
    judged = p.withColumn("winner", F.when(F.col("predicted") == F.col("second"), "tie").when(generation.flip("doc_id") == good, "2").otherwise("1")).select("doc_id", "winner")
    return generation.tally(generation.verdicts(judged, keys, "doc_id")).withColumn("percent", r6("percent"))


@query("""WITH l AS (SELECT DISTINCT event_type AS label, trim(regexp_replace(lower(event_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM events),
a AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN upper(event_type) || '!' WHEN 1 THEN substr(event_type, 1, 3) ELSE 'none of these' END AS answer FROM events), b AS (SELECT event_id, trim(regexp_replace(lower(answer), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM a),
m AS (SELECT event_id, max(CASE WHEN slug = s THEN label END) AS exact, count(*) FILTER (WHERE starts_with(slug, s) OR starts_with(s, slug)) AS k, max(label) FILTER (WHERE starts_with(slug, s) OR starts_with(s, slug)) AS near FROM b, l GROUP BY 1)
SELECT event_id, coalesce(exact, CASE WHEN k = 1 THEN near END) AS predicted, coalesce(exact, CASE WHEN k = 1 THEN near END) IS NULL AS out_of_label_space FROM m""")
def match_label(s, d):
    e, i = table(s, d, "events"), F.col("event_id") % 3
    a = e.select("event_id", F.when(i == 0, F.concat(F.upper("event_type"), F.lit("!"))).when(i == 1, F.substring("event_type", 1, 3)).otherwise("none of these").alias("answer"))
    return generation.match_label(a, e.select("event_type").distinct(), "answer").drop("answer")


@query()
def distill_stub(s, d):
    return generation.distill(docs(s, d).select(F.col("doc_id").alias("id"), "text"), generation.stub_teacher(["billing", "refund", "other"])).select("id", "generated")


# Cascades

TIERS = "t AS (SELECT event_id AS id, 'c' || (event_id % 4) AS gold, (event_id % 10 < 7)::INT AS ok_a, (event_id % 10 < 9)::INT AS ok_b, least(value / 500, 1.0::DOUBLE) AS conf_a, ((event_id * 37) % 100)::DOUBLE / 100 AS conf_b FROM events)"


def tiers(s, d):
    e, i = table(s, d, "events"), F.col("event_id")
    gold = F.concat(F.lit("c"), i % 4)
    tier = lambda least, conf: e.select(i.alias("id"), gold.alias("gold"), F.when(i % 10 < least, gold).otherwise("wrong").alias("predicted"), conf.alias("confidence"))
    return {"a": tier(7, F.least(F.col("value") / 500, F.lit(1.0))), "b": tier(9, (i * 37) % 100 / F.lit(100.0)), "c": tier(10, F.lit(1.0))}


@query(f"WITH {TIERS} SELECT gold, count(*) AS n, CAST(sum(ok_a) AS BIGINT) AS right_a, CAST(sum(ok_b) AS BIGINT) AS right_b, count(*) AS right_c FROM t GROUP BY gold")
def align_tiers(s, d):
    a = cascade.align(tiers(s, d))
    return a.groupBy("gold").agg(F.count("*").alias("n"), *[F.sum((F.col("gold") == F.col(f"predicted_{t}")).cast("long")).alias(f"right_{t}") for t in "abc"])


@query(f"""WITH {TIERS}, g AS (SELECT a.i AS i_a, b.i AS i_b FROM range(21) a(i), range(21) b(i))
SELECT CAST(i_a AS BIGINT) AS i_a, CAST(i_b AS BIGINT) AS i_b, count(*) AS n, CAST(sum(CASE WHEN conf_a >= i_a * 0.05::DOUBLE THEN ok_a WHEN conf_b >= i_b * 0.05::DOUBLE THEN ok_b ELSE 1 END) AS BIGINT) AS "right",
count(*) FILTER (WHERE conf_a >= i_a * 0.05::DOUBLE) AS by_a, count(*) FILTER (WHERE conf_a < i_a * 0.05::DOUBLE AND conf_b >= i_b * 0.05::DOUBLE) AS by_b, count(*) FILTER (WHERE conf_a < i_a * 0.05::DOUBLE AND conf_b < i_b * 0.05::DOUBLE) AS by_c FROM t, g GROUP BY ALL""")
def cascade_grid(s, d):
    out = cascade.simulate_grid(cascade.grid_cells(cascade.align(tiers(s, d)), ["a", "b", "c"], 21), ("a", "b", "c"), 21)
    return out.withColumn("i_a", F.col("i_a").cast("long")).withColumn("i_b", F.col("i_b").cast("long"))


@query()
def cascade_calibrated(s, d):
    rows = cascade.compose(tiers(s, d), {"a": 0.0, "b": 0.1, "c": 2.0}, {"a": 1, "b": 120, "c": 800}, grid=11, max_terminal=0.5)
    return s.createDataFrame([(r["architecture"], r["accuracy"], r["terminal_share"], r["cost"], r["latency_ms"]) for r in rows], "architecture string, accuracy double, terminal_share double, cost double, latency_ms double")


@query()
def clopper_pearson(s, d):
    """Upper bounds of the share of documents of low quality, by source."""
    n = docs(s, d).join(table(s, d, "labels"), "doc_id").groupBy("source").agg(F.sum((F.col("quality") == 0).cast("long")).alias("errors"), F.count("*").alias("n"))
    return n.withColumn("bound", cascade.upper_bounds("errors", "n"))


# The feedback loop


@query(f"WITH {LOG} SELECT tier, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM log GROUP BY 1")
def tier_coverage(s, d):
    return loop.tier_coverage(prediction_log(s, d)).withColumn("share", r6("share"))


_FED = f"WITH {LOG}, fed AS (SELECT count(*) AS n_feedback, avg((feedback = prediction)::INT) AS accuracy, count(*) FILTER (WHERE feedback_source = 'audit') AS n_audit, avg((feedback = prediction)::INT) FILTER (WHERE feedback_source = 'audit') AS audit_accuracy, avg((feedback = prediction)::INT) FILTER (WHERE feedback_source IS DISTINCT FROM 'audit') AS biased_accuracy FROM log WHERE feedback IS NOT NULL)"
_PSI = """, cf AS (SELECT confidence AS c, row_number() OVER (ORDER BY pos DESC) <= 200 AS now FROM log WHERE confidence IS NOT NULL),
bn AS (SELECT i, (SELECT count(*) FROM cf WHERE NOT now AND least(floor(c * 10), 9) = i) AS r, (SELECT count(*) FROM cf WHERE now AND least(floor(c * 10), 9) = i) AS w FROM range(10) v(i)),
sh AS (SELECT greatest(r::DOUBLE / (SELECT sum(r) FROM bn), 1e-6) AS r, greatest(w::DOUBLE / (SELECT sum(w) FROM bn), 1e-6) AS w FROM bn), psi AS (SELECT sum((w - r) * ln(w / r)) AS psi FROM sh)"""


@query(f"{_FED} SELECT n_feedback, round(accuracy, 6) AS accuracy, n_audit, round(audit_accuracy, 6) AS audit_accuracy, round(biased_accuracy, 6) AS biased_accuracy FROM fed")
def feedback_audit_accuracy(s, d):
    f = loop.feedback_accuracy(prediction_log(s, d))
    return f.select("n_feedback", "n_audit", *[r6(c).alias(c) for c in ("accuracy", "audit_accuracy", "biased_accuracy")])


@query(f"WITH {LOG}{_PSI} SELECT (SELECT CAST(sum(r) AS BIGINT) FROM bn) AS n_before, (SELECT CAST(sum(w) AS BIGINT) FROM bn) AS n_window, round(psi, 6) AS psi FROM psi")
def psi_drift(s, d):
    return loop.drift(prediction_log(s, d)).withColumn("psi", r6("psi"))


@query(f"{_FED}{_PSI} SELECT n_feedback, n_feedback >= 200 AS fire_labels, audit_accuracy < 0.9 AS fire_accuracy, psi >= 0.2 AS fire_drift, n_feedback >= 200 OR audit_accuracy < 0.9 OR psi >= 0.2 AS retrain FROM fed, psi")
def retrain_triggers(s, d):
    return loop.status(prediction_log(s, d)).select("n_feedback", "fire_labels", "fire_accuracy", "fire_drift", "retrain")


_HELD = f"WITH {LOG}, h AS (SELECT DISTINCT input_hash FROM log WHERE substr(input_hash, 1, 1) = '0')"


def _holdout(log):
    return log.filter(F.substring("input_hash", 1, 1) == "0").select("input_hash")


@query(f"{_HELD} SELECT text, arg_max(feedback, pos) AS label, input_hash, min(pos) AS first_pos FROM log WHERE feedback IS NOT NULL AND input_hash NOT IN (SELECT input_hash FROM h) GROUP BY text, input_hash")
def curate_feedback(s, d):
    log = prediction_log(s, d)
    return loop.curate(log, _holdout(log))


@query(f"{_HELD} SELECT count(DISTINCT CASE WHEN input_hash NOT IN (SELECT input_hash FROM h) THEN input_hash END) AS curated, count(*) FILTER (WHERE input_hash IN (SELECT input_hash FROM h)) AS excluded, count(*) AS labelled FROM log WHERE feedback IS NOT NULL")
def curation_counts(s, d):
    log = prediction_log(s, d)
    return loop.curation_counts(log, _holdout(log))


@query(f"WITH {PREDS}, x AS (SELECT avg((gold = second)::INT) AS champion, avg((gold = predicted)::INT) AS challenger FROM p) SELECT round(champion, 6) AS champion, round(challenger, 6) AS challenger, round(challenger - champion, 6) AS margin, CASE WHEN challenger >= 0.5 AND challenger - champion >= 0.005 AND challenger - champion > 0 THEN 'PROMOTE' ELSE 'RETAIN' END AS decision FROM x")
def promote_decision(s, d):
    p = predictions(s, d)
    out = loop.promote_frame(metrics.summary(p.select("gold", F.col("second").alias("predicted"))), metrics.summary(p), 0.5, 0.005)
    return out.select(*[r6(c).alias(c) for c in ("champion", "challenger", "margin")], "decision")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(s, d):
    return loop.resume(docs(s, d).select("doc_id"), table(s, d, "labels"), "doc_id")


@query()
def chunk_documents(s, d):
    return chunk.chunk_documents(docs(s, d), "doc_id", target=200, most=400, least=10)


@query("""WITH c AS (SELECT conv_id, sum(length(coalesce(text, ''))) AS chars FROM conversations GROUP BY 1), m AS (SELECT count(*) AS n, max(chars) AS longest FROM c),
e AS (SELECT *, CASE WHEN n < 1000 THEN 5 WHEN n < 5000 THEN 3 ELSE 2 END AS epochs, greatest(1, least(4, CASE WHEN n >= 10 THEN n // 10 ELSE 1 END)) AS b FROM m), i AS (SELECT *, greatest(100, epochs * n // b) AS it FROM e)
SELECT n, CAST(longest AS BIGINT) AS longest, CAST(epochs AS BIGINT) AS epochs, CAST(b AS BIGINT) AS batch_size, CAST(it AS BIGINT) AS iters, CAST(greatest(25, it // 12) AS BIGINT) AS steps_per_eval, CAST(CASE WHEN n < 300 THEN 8 ELSE 16 END AS BIGINT) AS num_layers, CAST(CASE WHEN longest // 4 > 1843 THEN greatest(3072, ceil(longest // 4 / 1024.0) * 1024) ELSE 2048 END AS BIGINT) AS max_seq_length FROM i""")
def recommend_hparams(s, d):
    return hparams.recommend_frame(rec.turns_to_chats(table(s, d, "conversations")), rec.message_chars(F.col("messages")))


@query(f"""WITH {LOG}, f AS (SELECT * FROM log WHERE feedback IS NOT NULL), k AS (SELECT * FROM f WHERE substr(input_hash, 1, 1) <> '0'), w AS (SELECT arg_max(coalesce(feedback_source, ''), pos) AS source FROM k GROUP BY input_hash)
SELECT 3::BIGINT AS round, (SELECT count(DISTINCT input_hash) FROM k) AS curated_records, (SELECT count(*) FROM f WHERE substr(input_hash, 1, 1) = '0') AS excluded_holdout,
(SELECT count(*) FROM w WHERE source = 'audit') AS structural_labels, 'tier1,tier2' AS target_tiers, 0.9::DOUBLE AS promotion_bar""")
def curation_manifest(s, d):
    log = prediction_log(s, d)
    seen = log.withColumn("feedback_source", F.when(F.col("feedback_source") == "audit", "structural").otherwise(F.col("feedback_source")))
    return loop.manifest(seen, _holdout(log), 3, 0.9, ("tier1", "tier2"))


@query(f"""WITH {LOG}, f AS (SELECT * FROM log WHERE feedback IS NOT NULL) SELECT input_hash, arg_max(feedback, pos) AS label FROM f GROUP BY input_hash""")
def curate_stream(s, d):
    """The prediction log as a stream whose state keeps the last feedback of each text."""
    base = f"{stream_log.shared_folder(s)}/curate-{uuid.uuid4().hex}"
    prediction_log(s, d).write.parquet(f"{base}/in")
    stream = s.readStream.schema(loop.LOG).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    stream_log.curate_stream(stream, f"{base}/state", f"{base}/checkpoint", 8).awaitTermination()
    return stream_log.curated(s, f"{base}/state").select("input_hash", "label")


@query("SELECT event_type AS tier, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def prediction_log_stream(s, d):
    import os

    path = f"{d}/events.parquet"  # a stream reads folders; a file is picked by name in its folder
    read = s.readStream.schema(table(s, d, "events").schema)
    rows = read.parquet(path) if os.path.isdir(path) else read.option("pathGlobFilter", "events.parquet").parquet(d)
    rows = rows.select(F.col("event_id").alias("pos"), "ts", F.col("event_type").alias("tier"), F.concat(F.lit("q"), F.col("user_id")).alias("text"), F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"))
    return loop.tier_coverage(stream_log.run_through(s, rows)).withColumn("share", r6("share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
