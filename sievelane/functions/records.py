"""Record shaping over chat, completion, text and labelled rows.

A record is a row with any of ``messages`` (array of structs role, content and optionally
tool_calls), ``prompt``, ``completion``, ``text`` and ``tools``; a key that is absent is null.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def turns_to_chats(turns: DataFrame) -> DataFrame:
    """One row (conv_id, messages) of each conversation of (conv_id, turn, role, text)."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def message_text(messages: Column) -> Column:
    """Contents of all but system messages, joined by spaces; a null content reads ``None``."""
    said = F.filter(messages, lambda m: ~m["role"].eqNullSafe(F.lit("system")))
    return F.array_join(F.transform(said, lambda m: F.coalesce(m["content"], F.lit("None"))), " ")


def record_text(row: dict[str, Column], raw: Column | None = None) -> Column:
    """Text to deduplicate on: messages, else prompt and completion, else text, else the record ``raw``
    (one JSON object as a string) with its keys in order."""
    out = row.get("text", F.lit(None).cast("string"))
    if raw is not None:
        out = F.coalesce(out, sorted_json(raw))
    if "prompt" in row:
        out = F.when(row["prompt"].isNotNull(), F.concat(row["prompt"], F.lit(" "), F.coalesce(row.get("completion", F.lit("")), F.lit("")))).otherwise(out)
    if "messages" in row:
        out = F.when(row["messages"].isNotNull(), message_text(row["messages"])).otherwise(out)
    return out


def _dumped(value: object, ordered: bool) -> str:
    return json.dumps(value, sort_keys=ordered)


@F.pandas_udf(T.StringType())
def sorted_json(values: pd.Series) -> pd.Series:
    """A JSON value with the keys of all objects in order, spaces after colons and commas, and ASCII
    escapes. Null stays null, text that isn't JSON stays as it is."""
    return values.map(lambda v: _redumped(v, True))


@F.pandas_udf(T.StringType())
def spaced_json(values: pd.Series) -> pd.Series:
    """The same with keys as they come; its length is what sizes of tool calls are counted in."""
    return values.map(lambda v: _redumped(v, False))


def _redumped(value: str | None, ordered: bool) -> str | None:
    if value is None:
        return None
    try:
        return _dumped(json.loads(value), ordered)
    except ValueError:
        return value


def detect_format(v: Column) -> Column:
    """completions, tools, chat, text or null from a JSON object (string), by key presence: an
    explicit null counts as present."""
    keys = F.json_object_keys(v)
    has = lambda k: F.array_contains(keys, k)
    return F.when(has("prompt") & has("completion"), "completions").when(has("messages") & has("tools"), "tools").when(has("messages"), "chat").when(has("text"), "text")


@F.pandas_udf(T.StringType())
def content_text(values: pd.Series) -> pd.Series:
    """What a chat template renders of a record (one JSON object as a string): contents that are strings
    and tool calls, by lines, and the tools of a record that has them; prompt, completion and tools without
    separators; else the text. Null for what isn't an object."""
    return values.map(_content)


def _content(value: str | None) -> str | None:
    r = _object(value)
    if r is None:
        return None
    if isinstance(r.get("messages"), list) and not ("prompt" in r and "completion" in r):
        parts = []
        for m in (m for m in r["messages"] if isinstance(m, dict)):
            if isinstance(m.get("content"), str):
                parts.append(m["content"])
            if m.get("tool_calls"):
                parts.append(_dumped(m["tool_calls"], False))
        return "\n".join([*parts, *([_dumped(r["tools"], False)] if "tools" in r else [])])
    if "prompt" in r and "completion" in r:
        return f"{r['prompt']}{r['completion']}" + (_dumped(r["tools"], False) if "tools" in r else "")
    return str(r.get("text", ""))


@F.pandas_udf(T.LongType())
def record_chars(values: pd.Series) -> pd.Series:
    """Size of a record (one JSON object as a string) in characters: contents, other contents than strings and
    tool calls by their JSON, tools; else text, prompt and completion, or the whole line."""
    return values.map(_chars).astype("Int64")


def _chars(line: str | None) -> int | None:
    r = _object(line)
    if r is None:
        return None
    if isinstance(r.get("messages"), list):
        total = len(_dumped(r["tools"], False)) if r.get("tools") else 0
        for m in (m for m in r["messages"] if isinstance(m, dict)):
            c = m.get("content")
            total += len(c) if isinstance(c, str) else len(_dumped(c, False)) if c else 0
            total += len(_dumped(m["tool_calls"], False)) if m.get("tool_calls") else 0
        return total
    if isinstance(r.get("text"), str):
        return len(r["text"])
    if "prompt" in r and "text" not in r:
        return len(str(r["prompt"])) + len(str(r.get("completion", "")))
    return len(line)


def _object(value: str | None) -> dict | None:
    try:
        r = json.loads(value) if value is not None else None
    except ValueError:
        return None
    return r if isinstance(r, dict) else None


def message_chars(messages: Column) -> Column:
    """Characters of the contents of messages that are already parsed."""
    return F.coalesce(F.aggregate(messages, F.lit(0).cast("long"), lambda s, m: s + F.coalesce(F.length(m["content"]), F.lit(0))), F.lit(0).cast("long"))


def label_of(messages: Column) -> Column:
    """Content of the last assistant message, ``_all`` without one."""
    said = F.filter(messages, lambda m: m["role"] == "assistant")
    return F.coalesce(F.try_element_at(said, F.lit(-1))["content"], F.lit("_all"))


def key_label(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("_none"))


def to_chat(system: Column, user: Column, assistant: Column) -> Column:
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.array(turn("system", system), turn("user", user), turn("assistant", assistant))


def split_record(messages: Column) -> tuple[Column, Column]:
    """(prompt turns, expected answer): a final assistant turn is the answer, else it is empty."""
    last = F.try_element_at(messages, F.lit(-1))
    answered = F.coalesce(last["role"] == "assistant", F.lit(False))
    prompt = F.when(answered, F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    return prompt, F.when(answered, F.coalesce(last["content"], F.lit(""))).otherwise(F.lit(""))


def first_user(prompt: Column) -> Column:
    return F.coalesce(F.get(F.filter(prompt, lambda m: m["role"] == "user"), F.lit(0))["content"], F.lit(""))


def gold(row: DataFrame, order: tuple[str, ...] = ("expected", "label")) -> Column:
    """The gold label: the first of the columns that the table has (presence, not null)."""
    for c in order:
        if c in row.columns:
            return F.col(c)
    raise ValueError(f"none of {order} in {row.columns}")


def gold_of(v: Column, order: tuple[str, ...] = ("expected", "label")) -> Column:
    """The gold label of each record (one JSON object as a string): that of the first key which the record has, a
    null among them; a record without any of them fails the query."""
    keys, out = F.json_object_keys(v), F.raise_error(F.concat(F.lit("no gold in "), F.substring(v, 1, 80))).cast("string")
    for k in reversed(order):
        out = F.when(F.array_contains(keys, k), F.get_json_object(v, f"$.{k}")).otherwise(out)
    return F.when(v.isNotNull(), out)


def gold_projection(df: DataFrame, pred: str = "predicted", label: str = "label") -> DataFrame:
    """id, text, predicted, expected; refuses a table with rows that have no gold."""
    bad = df.filter(F.col(label).isNull()).agg(F.count("*").alias("n"), F.min("id").alias("id")).first()
    if bad.n:
        raise ValueError(f"{bad.n} rows without gold, first id {bad.id}")
    return df.select("id", "text", F.col(pred).alias("predicted"), F.col(label).alias("expected"))


def classify_prompt(labels: list[str]) -> str:
    """System prompt that asks for exactly one label."""
    return "Choose the one label that fits. Reply with the label alone.\nLabels: " + ", ".join(sorted(labels))


def judge_prompt(question: Column, first: Column, second: Column) -> Column:
    return F.concat(F.lit("Task:\n"), question, F.lit("\n\nAnswer 1:\n"), first, F.lit("\n\nAnswer 2:\n"), second, F.lit("\n\nWhich is better: 1, 2 or tie?"))


def unblind(winner: Column, flipped: Column) -> Column:
    """a, b or tie from the blinded winner (1, 2, tie); null outside of these."""
    return F.when(winner == "tie", "tie").when(winner == "1", F.when(flipped, "b").otherwise("a")).when(winner == "2", F.when(flipped, "a").otherwise("b"))
