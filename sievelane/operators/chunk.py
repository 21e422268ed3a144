"""Chunking of documents along their structure."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEAD, _FENCE = re.compile(r"#{1,6} "), re.compile(r"```|~~~")


def _scan(text: str) -> Iterator[tuple[str, bool]]:
    """Lines with whether a code fence is open at them (a fence line counts as its new state)."""
    fenced = False
    for line in text.splitlines():
        fenced ^= _FENCE.match(line) is not None
        yield line, fenced


def sections(text: str) -> list[str]:
    """Text before and from each heading outside of fences; sections of white space join the next."""
    out: list[list[str]] = [[]]
    for line, fenced in _scan(text):
        if not fenced and _HEAD.match(line) and "".join(out[-1]).strip():
            out.append([])
        out[-1].append(line)
    return ["\n".join(s) for s in out if "".join(s).strip()]


def paragraphs(section: str) -> list[str]:
    """Runs of lines between blank ones outside of fences."""
    out: list[list[str]] = [[]]
    for line, fenced in _scan(section):
        if line.strip() or fenced:
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return ["\n".join(p) for p in out if p]


def hard_cut(text: str, target: int, most: int) -> list[str]:
    """Cuts at the last newline, else the last space, in [target/2, target), which goes; cold at
    ``target`` without either."""
    out, at = [], 0
    while len(text) - at > most:
        lo, hi = at + target // 2, at + target
        where = max(text.rfind("\n", lo, hi), -1)
        where = where if where >= 0 else text.rfind(" ", lo, hi)
        end = where if where >= 0 else hi
        out.append(text[at:end])
        at = end + (where >= 0)
    return [*out, text[at:]] if at < len(text) else out


def chunks(text: str, target: int = 8000, most: int = 16000) -> list[str]:
    pieces: list[str] = []
    for s in sections(text):
        if len(s) <= most:
            pieces.append(s)
        else:
            for p in paragraphs(s):
                pieces += hard_cut(p, target, most) if len(p) > most else [p]
    out: list[list[str]] = [[]]
    size = 0
    for p in pieces:
        if out[-1] and size + 2 + len(p) > most:
            out.append([])
            size = 0
        size += len(p) + 2 * bool(size)
        out[-1].append(p)
        if size >= target:
            out.append([])
            size = 0
    return ["\n\n".join(c) for c in out if c]


def chunk_documents(df: DataFrame, key: str = "source", text: str = "text", target: int = 2000, most: int = 4000, least: int = 50) -> DataFrame:
    """key, chunk_no, text, approx_tokens: sizes in tokens of four characters; chunks below
    ``least`` are dropped, numbers count before that."""
    schema = f"{key} {dict(df.dtypes)[key]}, chunk_no long, text string, approx_tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, c, len(c) // 4) for k, t in zip(b[key], b[text]) if t is not None for i, c in enumerate(chunks(t, target * 4, most * 4)) if len(c) >= least * 4]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "text", "approx_tokens"])

    return df.select(F.col(key), F.col(text)).mapInPandas(run, schema)


def chunk_counts(df: DataFrame, key: str = "source", text: str = "text", target: int = 2000, most: int = 4000, least: int = 50) -> DataFrame:
    """key, kept, dropped: chunks of each document that ``chunk_documents`` keeps, and those that are too small."""
    every = chunk_documents(df, key, text, target, most, 0)
    small = F.col("approx_tokens") < least
    return every.groupBy(key).agg(F.sum((~small).cast("long")).alias("kept"), F.sum(small.cast("long")).alias("dropped"))


def chunk_summary(ch: DataFrame) -> DataFrame:
    return ch.agg(F.count("*").alias("n"), F.min("approx_tokens").alias("least"), F.median("approx_tokens").cast("long").alias("median"), F.max("approx_tokens").alias("most"), F.sum("approx_tokens").alias("tokens"))
