"""Operators around a text generator (C15-C18, J1, J8, P25, W7, D15, K3). The generator, teacher
or judge is a Python function over a batch; deterministic stubs serve tests."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions.records import unblind
from ..functions.text import slug_label, strip_think_tags, strip_thinking

Generator = Callable[[list[str]], list[str | None]]


def stub_teacher(labels: list[str]) -> Generator:
    """Label by checksum of the text: the same everywhere."""
    names = sorted(labels)
    return lambda texts: [names[zlib.crc32(t.encode()) % len(names)] if t else None for t in texts]


def generate(df: DataFrame, prompt: str, fn: Generator, out: str = "output") -> DataFrame:
    """Adds a column of the generator's answers, batch by batch."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: pd.Series(fn(["" if t is None else t for t in b[prompt]]), index=b.index, dtype=object)})

    return df.mapInPandas(run, schema)


def canary(df: DataFrame, prompt: str, fn: Generator, calls: int = 5) -> None:
    """Refuses a run whose first calls all fail."""
    first = [r[0] or "" for r in df.select(prompt).limit(calls).collect()]
    if first and all(a is None for a in fn(first)):
        raise RuntimeError(f"the first {len(first)} calls failed")


def distill(df: DataFrame, fn: Generator, labels: list[str] | None = None, text: str = "text") -> DataFrame:
    """id, text, generated: teacher answers; answers outside the labels and failures are skipped."""
    got = generate(df.select("id", text), text, fn, "generated").filter("generated is not null")
    return got.filter(F.col("generated").isin(labels)) if labels else got


def flip(key: str, seed: int = 7) -> Column:
    """A fair coin for each id, by hash."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 1) < "8"


def pair_predictions(a: DataFrame, b: DataFrame, key: str = "id", value: str = "predicted", pos: str = "pos") -> DataFrame:
    """Pairs of the last record of each id in both tables; refuses tables with no id in common."""
    last = lambda d, n: d.groupBy(key).agg(F.max_by(value, pos).alias(n))
    out = last(a, "a").join(last(b, "b"), key)
    if out.isEmpty():
        raise ValueError("no id is in both tables")
    return out


def blind(pairs: DataFrame, key: str = "id", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(anonymous pairs id, first, second; key id, flipped)."""
    f = pairs.withColumn("flipped", flip(key, seed))
    return f.select(key, F.when(F.col("flipped"), F.col("b")).otherwise(F.col("a")).alias("first"), F.when(F.col("flipped"), F.col("a")).otherwise(F.col("b")).alias("second")), f.select(key, "flipped")


def verdicts(judged: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """id, result (a, b, tie): the winners (1, 2, tie) unblinded; other answers are skipped."""
    return judged.join(keys, key).select(key, unblind(F.col("winner"), F.col("flipped")).alias("result")).filter("result is not null")


def tally(v: DataFrame) -> DataFrame:
    n = v.groupBy("result").agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("t"))).select("result", "n", (100.0 * F.col("n") / F.col("t")).alias("percent"))


def tally_report(judged: DataFrame, keys: DataFrame, key: str = "id", enough: int = 150) -> DataFrame:
    """One row: wins of a and b, ties, pairs that were skipped (no answer, or none of 1, 2, tie) and a note where
    none or fewer than ``enough`` pairs were judged."""
    r = judged.join(keys, key).select(unblind(F.col("winner"), F.col("flipped")).alias("result"))
    n = lambda x: F.coalesce(F.sum(F.col("result").eqNullSafe(x).cast("long")), F.lit(0)).alias(x or "skipped")
    out = r.agg(n("a"), n("b"), n("tie"), n(None)).withColumn("judged", F.col("a") + F.col("b") + F.col("tie"))
    return out.withColumn("note", F.when(F.col("judged") == 0, "no pairs judged").when(F.col("judged") < enough, "differences under about 10 points are noise"))


def judge_pairs(a: DataFrame, b: DataFrame, judge: Callable[[str, str], str], key: str = "id", seed: int = 7) -> DataFrame:
    """id, result of each pair, judged blind in a seeded order."""
    shown, keys = blind(pair_predictions(a, b, key), key, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield pd.DataFrame({key: d[key], "winner": [judge(x, y) for x, y in zip(d["first"], d["second"])]})

    judged = shown.mapInPandas(run, f"{key} {dict(shown.dtypes)[key]}, winner string")
    return verdicts(judged, keys, key)


def match_label(df: DataFrame, labels: DataFrame, answer: str, pos: str | None = None) -> DataFrame:
    """Adds ``predicted`` and ``out_of_label_space``: the label that equals the answer's slug, else
    the only one that begins with it or that it begins with. Of labels with equal slugs the last counts,
    by ``pos`` of ``labels`` if it is given, else by name.
    Labels are few, so they go to every task as one array."""
    table = labels.select(F.col(labels.columns[0]).alias("label"), *([pos] if pos else [])).withColumn("slug", slug_label(F.col("label"))).groupBy("slug").agg((F.max("label") if pos is None else F.max_by("label", pos)).alias("label"))
    one = table.agg(F.array_sort(F.collect_list(F.struct("slug", "label"))).alias("_ls"))
    s = slug_label(strip_think_tags(F.coalesce(F.col(answer), F.lit(""))))
    j = df.withColumn("_s", s).join(F.broadcast(one))
    exact = F.get(F.filter("_ls", lambda x: x["slug"] == F.col("_s")), F.lit(0))["label"]
    near = F.filter("_ls", lambda x: F.startswith(x["slug"], F.col("_s")) | F.startswith(F.col("_s"), x["slug"]))
    got = F.coalesce(exact, F.when(F.size(near) == 1, F.get(near, F.lit(0))["label"]))
    return j.withColumn("predicted", got).withColumn("out_of_label_space", got.isNull()).drop("_s", "_ls")


def token_confidence(df: DataFrame, margins: str, logprobs: str) -> DataFrame:
    """Mean margin (0 without tokens) and mean log probability (-99 without tokens)."""
    mean = lambda c, empty: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)).otherwise(F.lit(empty))
    return df.withColumn("conf_margin", mean(margins, 0.0)).withColumn("conf_logprob", mean(logprobs, -99.0))


def run_test_set(df: DataFrame, fn: Generator) -> DataFrame:
    """id, input, expected, predicted of chat rows (id, messages)."""
    from ..functions.records import first_user, split_record

    prompt, expected = split_record(F.col("messages"))
    rows = df.select("id", first_user(prompt).alias("input"), expected.alias("expected"))
    return generate(rows, "input", fn, "raw").select("id", "input", "expected", strip_thinking(F.coalesce("raw", F.lit(""))).alias("predicted"))


def first_failures(df: DataFrame, pos: str, ok: str, calls: int = 5) -> DataFrame:
    """One row: whether the first calls all failed."""
    head = df.orderBy(pos).limit(calls)
    return head.agg((F.count("*") > 0).alias("any"), F.max(F.col(ok).cast("int")).alias("best")).select((F.col("any") & (F.col("best") == 0)).alias("all_failed"))


def last_by_key(df: DataFrame, key: str, pos: str) -> DataFrame:
    """The last record of each key."""
    w = W.partitionBy(key).orderBy(F.desc(pos))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def limited(df: DataFrame, pos: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``pos``; 0 stands for no limit."""
    return df.orderBy(pos).limit(n) if n else df


def ordered_by_id(df: DataFrame, key: str = "id", natural: bool = True) -> DataFrame:
    """Rows by id: as the numbers or strings that they are, or as strings."""
    return df.orderBy(F.col(key) if natural else F.col(key).cast("string"))


def llm_classify(df: DataFrame, fn: Callable[[list[str]], list[tuple[str, list[float], list[float]]]], labels: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``predicted``, ``out_of_label_space``, ``conf_margin`` and ``conf_logprob``. The model gives an
    answer, the gaps between its two best tokens and the log probabilities of its tokens for each text."""
    schema = T.StructType([*df.schema.fields, T.StructField("_answer", T.StringType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("_margins", "_logprobs")]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = fn(["" if t is None else t for t in b[text]])
            yield b.assign(**{c: pd.Series([g[i] for g in got], index=b.index, dtype=object) for i, c in enumerate(("_answer", "_margins", "_logprobs"))})

    matched = match_label(df.mapInPandas(run, schema), labels, "_answer")
    return token_confidence(matched, "_margins", "_logprobs").drop("_answer", "_margins", "_logprobs")
