"""Grounding gate (C10, F6, J10, A11, A15, D13): values of an output must occur in its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = "[\\s,;()\\[\\]{}<>\"'`|=]+"
NUMERIC = r"[0-9][0-9]|[0-9][.,:\-]|[.,:\-][0-9]|^[0-9]+$"
PATH = r"^[~/]|/.*\.[A-Za-z0-9]+|/.*/"
DOTTED = r"^[A-Za-z0-9]+[.:][A-Za-z0-9][A-Za-z0-9.:]*$"
CODE = r"^(?:0x[0-9a-fA-F]+|[0-9a-fA-F]{8,})$"


def is_hard(t: Column) -> Column:
    return t.rlike(NUMERIC) | t.rlike(PATH) | t.rlike(DOTTED) | t.rlike(CODE)


def hard_tokens(text: Column) -> Column:
    """Hard tokens in order, each followed by those of its parts that are hard themselves."""
    raw = F.transform(F.split(text, SEPARATORS), lambda t: F.btrim(t, F.lit(".,:;)(")))
    hard = F.filter(raw, lambda t: (t != "") & is_hard(t))

    def with_parts(t: Column) -> Column:
        parts = F.filter(F.split(t, "[./:]+"), lambda p: p != "")
        return F.concat(F.array(t), F.when(F.size(parts) > 1, F.filter(parts, is_hard)).otherwise(F.array().cast("array<string>")))

    return F.flatten(F.transform(hard, with_parts))


def ungrounded(source: Column, output: Column) -> Column:
    src = F.lower(F.coalesce(source, F.lit("")))
    return F.filter(hard_tokens(F.coalesce(output, F.lit(""))), lambda t: ~F.contains(src, F.lower(t)))


def gate(df: DataFrame, source: str, output: str, max_ratio: float = 0.4) -> DataFrame:
    """Adds ungrounded, n_ungrounded, ratio (unrounded), over_budget and clean."""
    ratio = F.coalesce(F.length(output), F.lit(0)) / F.greatest(F.coalesce(F.length(source), F.lit(0)), F.lit(1))
    return df.withColumn("ungrounded", ungrounded(F.col(source), F.col(output))).withColumn("n_ungrounded", F.size("ungrounded").cast("long")).withColumn("ratio", ratio).withColumn("over_budget", ratio > max_ratio).withColumn("clean", F.col("n_ungrounded") == 0)


def gate_summary(gated: DataFrame, floor: float = 0.99) -> DataFrame:
    """Rates, ratio quantiles by index rule (sorted[min(int(q n), n - 1)] of ratios rounded to 4)
    and the verdict. Quantiles are picked from counts of distinct ratios."""
    n = gated.agg(F.count("*").alias("n"), F.avg(F.col("clean").cast("double")).alias("zero_rate"), F.sum(F.col("over_budget").cast("long")).alias("over_budget"), F.max(F.round("ratio", 4)).alias("ratio_max"))
    from pyspark.sql import Window as W

    by = gated.groupBy(F.round("ratio", 4).alias("r")).agg(F.count("*").alias("m"))
    cum = by.withColumn("hi", F.sum("m").over(W.orderBy("r")))  # distinct rounded ratios, few
    pick = lambda q: F.min(F.when(F.col("hi") > F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1), F.col("r")))
    qs = cum.crossJoin(n.select("n")).agg(pick(0.5).alias("ratio_p50"), pick(0.9).alias("ratio_p90"))
    return n.crossJoin(qs).select("n", "zero_rate", (1 - F.col("zero_rate")).alias("hallucinated_rate"), "ratio_p50", "ratio_p90", "ratio_max", "over_budget", (F.col("zero_rate") >= floor).alias("passed"))


def field_recall(df: DataFrame, used: str, output: str) -> DataFrame:
    """Share of identifiers in ``used`` (array) that the output contains."""
    found = F.size(F.filter(used, lambda t: F.contains(F.lower(F.coalesce(F.col(output), F.lit(""))), F.lower(t))))
    return df.withColumn("recall", F.when(F.size(used) > 0, found / F.size(used)).otherwise(F.lit(1.0)))
