"""Validation of training records (C5, A6, D17): rules become rows (split, line, severity, rule).

``rows`` has ``split, line`` and ``value``, one JSON record as a string. Rules follow each other as
in a reader: a record that isn't JSON, has no known key, is of another format than its split's
first known record, or whose messages aren't a list of objects is judged no further.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.records import detect_format

_MESSAGES = "array<struct<role:string,content:string,tool_calls:string>>"


def parse(rows: DataFrame) -> DataFrame:
    """Adds the format of each record, that of its split, and the parsed parts. Blank lines go."""
    rows = rows.filter(F.trim("value") != "")
    ok = F.expr("try_parse_json(value) is not null")
    out = rows.withColumn("json", ok).withColumn("format", F.when(ok, detect_format(F.col("value"))))
    locked = out.filter("format is not null").groupBy("split").agg(F.min_by("format", "line").alias("locked")).withColumnRenamed("split", "_split")
    out = out.join(locked, out["split"].eqNullSafe(locked["_split"]), "left").drop("_split")
    raw = F.get_json_object("value", "$.messages")
    return out.withColumn("raw", raw).withColumn("m", F.from_json("raw", _MESSAGES)).withColumn("tools", F.get_json_object("value", "$.tools"))


def issues(rows: DataFrame, max_tokens: int = 4096) -> DataFrame:
    """split, line, severity, rule of every broken rule."""
    d = parse(rows)
    chat = F.col("format").isin("chat", "tools")
    both = F.col("locked").isin("chat", "tools") & chat
    no_list = chat & ~F.coalesce(F.col("raw").startswith("["), F.lit(False))
    no_object = chat & F.coalesce(F.expr("exists(from_json(raw, 'array<string>'), x -> not startswith(x, '{'))"), F.lit(False))
    mixed = F.col("format") != F.col("locked")
    first = F.when(~F.col("json"), "invalid_json").when(F.col("format").isNull(), "no_known_key").when(mixed & ~both, "format_differs").when(no_list, "messages_not_list").when(no_object, "message_not_object")
    later = first.isNull()
    has = lambda f: F.exists("m", f)
    role_ok = lambda m: F.coalesce(m["role"].isin("system", "user", "assistant") | ((m["role"] == "tool") & (F.col("format") == "tools")), F.lit(False))
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    key = lambda k: F.get_json_object("value", f"$.{k}")
    chars = F.when(chat, F.aggregate("m", F.lit(0), lambda s, m: s + F.coalesce(F.length(m["content"]), F.lit(0)) + F.coalesce(F.length(m["tool_calls"]), F.lit(0))) + F.coalesce(F.length("tools"), F.lit(0)))
    chars = chars.when(F.col("format") == "text", F.length(key("text"))).otherwise(F.coalesce(F.length(key("prompt")), F.lit(0)) + F.coalesce(F.length(key("completion")), F.lit(0)))
    rule = lambda cond, severity, name: F.when(later & F.coalesce(cond, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("rule")))
    found = F.array(
        F.when(first.isNotNull(), F.struct(F.lit("error").alias("severity"), first.alias("rule"))),
        rule(mixed & both, "warning", "chat_tools_mix"),
        rule(chat & ~(F.coalesce(F.try_element_at("m", F.lit(-1))["role"], F.lit("")) == "assistant"), "error", "last_not_assistant"),
        rule(chat & ~has(lambda m: m["role"].eqNullSafe("user")), "error", "no_user_turn"),
        rule(chat & has(lambda m: ~role_ok(m)), "error", "bad_role"),
        rule(chat & has(lambda m: empty(m["content"]) & ~(m["role"].eqNullSafe("assistant") & m["tool_calls"].isNotNull())), "error", "empty_content"),
        rule(chat & has(lambda m: m["tool_calls"].isNotNull()) & F.col("tools").isNull(), "warning", "tool_calls_without_tools"),
        rule((F.col("format") == "tools") & ~F.coalesce(F.col("tools").startswith("["), F.lit(False)), "error", "tools_not_list"),
        rule((F.col("format") == "completions") & (empty(key("prompt")) | empty(key("completion"))), "error", "empty_prompt_or_completion"),
        rule((F.col("format") == "text") & empty(key("text")), "error", "empty_text"),
        rule(F.floor(chars / 4) > max_tokens, "warning", "over_long"),
    )
    return d.select("split", "line", F.explode(F.array_compact(found)).alias("i")).select("split", "line", "i.severity", "i.rule")


def split_report(rows: DataFrame, max_tokens: int = 4096) -> DataFrame:
    """One row for train, valid and test: rows, errors, warnings, format and whether it passes. An
    empty train split is an error, other empty splits are warnings, and formats must agree."""
    d = parse(rows).groupBy("split").agg(F.count("*").alias("n"), F.first("locked").alias("format"))
    i = issues(rows, max_tokens).groupBy("split").agg(F.sum((F.col("severity") == "error").cast("long")).alias("errors"), F.sum((F.col("severity") == "warning").cast("long")).alias("warnings"))
    names = rows.sparkSession.createDataFrame([("train",), ("valid",), ("test",)], "split string")
    out = names.join(d, "split", "left").join(i, "split", "left").fillna(0, ["n", "errors", "warnings"])
    none = F.col("n") == 0
    out = out.withColumn("errors", F.col("errors") + F.when(none & (F.col("split") == "train"), 1).otherwise(0)).withColumn("warnings", F.col("warnings") + F.when(none & (F.col("split") != "train"), 1).otherwise(0))
    kinds = out.agg(F.size(F.array_distinct(F.transform(F.collect_set("format"), lambda f: F.when(f == "tools", "chat").otherwise(f)))).alias("kinds"))
    return out.crossJoin(kinds).withColumn("passed", (F.col("errors") == 0) & (F.col("kinds") <= 1)).drop("kinds")


def issue_samples(rows: DataFrame, max_tokens: int = 4096, warnings: int = 5, errors: int = 20) -> DataFrame:
    """The first ``warnings`` warnings and ``errors`` errors of each split, by line."""
    found = issues(rows, max_tokens)
    first = lambda severity, k: found.filter(F.col("severity") == severity).withColumn("_r", F.row_number().over(W.partitionBy("split").orderBy("line", "rule"))).filter(F.col("_r") <= k).drop("_r")
    return first("warning", warnings).unionByName(first("error", errors))
