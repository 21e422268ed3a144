"""Operator 2: personal identifiers by bootstrapped contextual extraction.

*Candidates* are spans that look like identifiers at all: addresses with ``@``, digit groups with
at most two separators between digits (seven digits at least), four groups of digits with dots, of
any length, and codes of capitals and digits; they may follow ``=`` and ``/``. They are found in one pass
over whole texts and written to the shared folder.

*Seeds* are candidates that pass a strict test: e-mail syntax, an IPv4 address with octets up to
255, a telephone number with country code or area code in brackets, a payment card with a right
check digit, an IBAN with right check digits, a US social security number.

*Patterns* are lexical: the candidate's shape (each run of digits or letters becomes one sign, punctuation stays; lengths are
kept for bare digit runs) and its shape class with the word before it and with the word after it. Seeds induce patterns;
distinct values and patterns form a bipartite graph, which Spark scores in ``ROUNDS`` rounds: a
pattern's confidence for a kind is the summed score of its values divided by their number plus
``DOUBT``; a value's score is 1 for seeds and otherwise 1 - prod(1 - confidence) over its patterns
with at least ``TRUST``. Values that reach ``ACCEPT`` are identifiers of the best kind, though they
fail every strict test (a card number with a mistyped digit, say); in the next round they lend
support to their patterns. Candidates of a shape that often fails its checksum are evidence against
that shape, since a pattern's confidence divides by all its values.

The word before and the word after are looked for within ``CONTEXT`` characters of the candidate. Groups of
digits that only spaces separate, as in a table of numbers, are read from the left, see ``pieces``.

``extract(docs)`` returns ``doc_id, start, length, kind, score, origin`` (``seed`` or
``induced``), ``value_md5``; positions count characters. Values aren't repeated in the result.

Edge cases: null and empty texts have no candidates; repeated rows are reported each; a null
``doc_id`` stays null; ties between kinds go to the alphabetically first; a table without seeds
has no result; other columns are ignored; whole texts of any length are searched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, flat, join_classes

ROUNDS, DOUBT, TRUST, ACCEPT = 3, 2.0, 0.6, 0.6
CANDIDATE = re.compile(
    r"(?P<at>(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*+)"
    r"|(?<![\w.@+\-])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)"
    r"|(?<![\w.@+\-])(?P<code>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[A-Z]{1,3}\d{6,9})(?!\w)"
    r"|(?<![\w.@\-])(?P<num>\+?\(?\d(?:[ .()/\-]{0,2}\d){5,})(?!\w)"
)
#: Trusted patterns that are broadcast at most.
FEW = 100_000
#: Java's filter before Python: a text without these has no candidate.
HINT = "@|[0-9]"
MIN_DIGITS, WORD = 7, re.compile(r"[^\W\d_]+")
#: Digits of the longest identifier, groups of digits that one may have, and characters of context.
MAX_DIGITS, GROUPS, CONTEXT = 19, 6, 40
PHONE = re.compile(r"\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}")
IPV4 = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
SSN = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}")


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def email(value: str) -> bool:
    local, _, domain = value.rpartition("@")
    labels = domain.split(".")
    return local[:1].isalnum() and "@" not in local and len(labels) > 1 and all(x and x[0] != "-" and x[-1] != "-" for x in labels) and len(labels[-1]) > 1 and labels[-1].isalpha()


def seed(value: str) -> str | None:
    """The kind of a value that passes a strict test."""
    if "@" in value:
        return "email" if email(value) else None
    digits = re.sub(r"\D", "", value)
    if IPV4.fullmatch(value):
        return "ip" if all(int(x) < 256 for x in value.split(".")) else None
    if SSN.fullmatch(value):
        return "ssn"
    if PHONE.fullmatch(value) and 10 <= len(digits) <= 15:
        return "phone"
    if 13 <= len(digits) <= 19 and re.fullmatch(r"\d+|\d{4}(?:[ -]\d{2,7})+", value) and luhn(digits):
        return "card"
    if re.match(r"[A-Z]{2}\d{2}", value):
        s = value.replace(" ", "")
        if 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
            return "iban"
    return None


def shape(value: str) -> str:
    if value.isdigit():
        return f"9{{{len(value)}}}"
    return re.sub(r"[A-Za-z]+", "a", re.sub(r"\d+", "9", value))


def pieces(value: str) -> Iterator[tuple[int, str]]:
    """(offset, part) of identifiers that only a space separates. Groups are read from the left: the
    longest run of at most ``GROUPS`` that is a seed is a part; groups between two seeds stay together
    unless they have more digits than any identifier. Linear in the number of groups."""
    groups, at = [], 0
    for g in value.split(" "):
        if g:
            groups.append((at, g))
        at += len(g) + 1
    held: list[tuple[int, str]] = []

    def rest() -> Iterator[tuple[int, str]]:
        if held:
            end = held[-1][0] + len(held[-1][1])
            if end - held[0][0] <= 4 * MAX_DIGITS and sum(c.isdigit() for _, g in held for c in g) <= MAX_DIGITS:
                yield held[0][0], value[held[0][0] : end]
            else:
                yield from held
            held.clear()

    i = 0
    while i < len(groups):
        lo = groups[i][0]
        for j in range(min(i + GROUPS, len(groups)), i, -1):
            part = value[lo : groups[j - 1][0] + len(groups[j - 1][1])]
            if len(part) <= 4 * MAX_DIGITS and seed(part) is not None:
                yield from rest()
                yield lo, part
                i = j
                break
        else:
            held.append(groups[i])
            i += 1
    yield from rest()


def candidates(text: str) -> Iterator[tuple[int, str, str | None, list[str]]]:
    """(start, value, seed kind, patterns) of one text."""
    for m in CANDIDATE.finditer(text):
        whole, c = m.group().rstrip(".-_ ("), "num" if m.lastgroup == "ip" else m.lastgroup
        start = m.end() - len(m.group().lstrip("._%+-")) if c == "at" else m.start()
        whole = whole[start - m.start() :]
        before = WORD.findall(text[max(0, start - CONTEXT) : start])
        after = WORD.match(text[start + len(whole) : start + len(whole) + CONTEXT].lstrip(" ,;:"))
        for at, value in pieces(whole) if c == "num" else ((0, whole),):
            if c == "num" and sum(x.isdigit() for x in value) < MIN_DIGITS and not IPV4.fullmatch(value):
                continue
            pats = ["shape " + shape(value)]
            if before:
                pats.append(f"before {before[-1].lower()} {c}")
            if after:
                pats.append(f"after {after.group().lower()} {c}")
            yield start + at, value, seed(value), pats


def _find(batches: Iterator[pa.RecordBatch]):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()))
    for batch in batches:
        rows = [(d, *c) for d, t in zip(flat(batch, "doc_id").to_pylist(), flat(batch, "text").to_pylist()) for c in candidates(t)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "value", "seed", "patterns"])


def md5(value: str) -> str:
    return hashlib.md5(value.encode()).hexdigest()


def score(found: DataFrame, rounds: int = ROUNDS, doubt: float = DOUBT, trust: float = TRUST, accept: float = ACCEPT) -> DataFrame:
    """``value, kind, score, origin`` of the values that are identifiers, from the graph of values
    and patterns."""
    edges = cut(found.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("value", "pattern").agg(F.max("seed").alias("seed")))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.filter("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    scored = seeds
    for _ in range(rounds):
        sums = edges.select("value", "pattern").join(scored, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("s"))
        conf = cut(sums.join(sizes, "pattern").select("pattern", "kind", (F.col("s") / (F.col("n") + doubt)).alias("conf")).filter(F.col("conf") >= trust))
        if conf.count() <= FEW:  # then a pattern that very many values have isn't shuffled
            conf = F.broadcast(conf)
        new = edges.filter("seed is null").select("value", "pattern").join(conf, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("conf"))))).alias("score"))
        new = new.filter(F.col("score") >= accept).groupBy("value").agg(F.expr("max_by(struct(kind, score), struct(score, -ascii(kind), reverse(kind)))").alias("b")).select("value", "b.kind", "b.score")
        scored = cut(seeds.unionByName(new))
    return scored.join(seeds.select("value", F.lit(True).alias("is_seed")), "value", "left").select("value", "kind", "score", F.when(F.col("is_seed"), "seed").otherwise("induced").alias("origin"))


def extract(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike(HINT))
    found = cut(docs.mapInArrow(_find, "doc_id long, start long, value string, seed string, patterns array<string>"))
    # a value may be in a third of all rows, so frequent ones are joined by broadcast
    kinds = cut(score(found).join(found.groupBy("value").agg(F.count("*").alias("m")), "value"))
    return join_classes(found.select("doc_id", "start", "value"), kinds, "value").select("doc_id", "start", F.length("value").cast("long").alias("length"), "kind", F.round("score", 6).alias("score"), "origin", F.md5("value").alias("value_md5"))
