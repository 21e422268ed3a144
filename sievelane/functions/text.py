"""Text expressions (P2, P3, P6, P13-P16, P18, P21-P23): Catalyst columns, no Python on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(t: Column) -> Column:
    """Lower case, runs of Unicode white space to one space, stripped."""
    return F.trim(F.regexp_replace(F.lower(t), r"(?U)\s+", " "))


def shingles(t: Column, n: int = 4) -> Column:
    """Distinct character n-grams; a shorter text is its own n-gram, an empty one has none."""
    # characters are split off once: a substring would be counted from the text's start each time
    chars = F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))
    grams = F.transform(F.array(chars), lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.array_join(F.slice(c, i, n), ""))))[0]
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) < n, F.array(t)).otherwise(grams)


def approx_tokens(t: Column) -> Column:
    return F.floor(F.length(t) / 4).cast("long")


def input_hash(t: Column) -> Column:
    return F.substring(F.sha2(t, 256), 1, 16)


def request_text(t: Column, limit: int = 8000) -> Column:
    return F.substring(F.replace(t, F.lit("\n"), F.lit(" ")), 1, limit)


def strip_thinking(t: Column) -> Column:
    """Closed blocks go; text after the last stray closer; of that, text before the first opener."""
    s = F.regexp_replace(t, r"(?s)<think>.*?</think>", "")
    s = F.substring_index(s, "</think>", -1)
    return F.trim(F.regexp_replace(F.substring_index(s, "<think>", 1), r"^\s+|\s+$", ""))


def strip_think_tags(t: Column) -> Column:
    """Closed blocks go, then stray tags alone; what they enclose stays."""
    s = F.regexp_replace(t, r"(?s)<think>.*?</think>", "")
    return F.regexp_replace(F.regexp_replace(s, "</?think>", ""), r"^\s+|\s+$", "")


def norm_label(t: Column) -> Column:
    """Label as the scorer compares it: null becomes ``none``."""
    return F.lower(F.trim(F.coalesce(t.cast("string"), F.lit("none"))))


def slug_label(t: Column) -> Column:
    """Label as the generator's answer is matched: other than a-z0-9 to ``_``, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(t)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def show_label(t: Column, width: int = 60) -> Column:
    s = F.replace(t, F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, width - 3), F.lit("..."))).otherwise(s)


def is_snake_case(t: Column) -> Column:
    return F.coalesce((t == F.lower(t)) & F.replace(t, F.lit("_"), F.lit("")).rlike(r"^\p{L}+$"), F.lit(False))
