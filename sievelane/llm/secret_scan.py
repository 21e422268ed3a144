"""Operator 9: secret scans by token efficiency.

Random strings are long under a subword vocabulary that was fitted to language: a hexadecimal key
takes a token for about 1.7 characters, base64 for 1.3, prose for 2.4 and more. ``scan(docs, vocabulary)``
encodes each run of at least ``MIN_LENGTH`` characters of ``A-Za-z0-9+/_-=`` with a tiktoken vocabulary. A
run is a candidate if it has at most ``MAX_RATIO`` characters per token (``LETTERS_RATIO`` if it is letters of
one case and nothing says that it is a secret, since rare words come near; ``DIGITS_RATIO`` if it has no
letters, as numbers have tokens of three digits). Candidates are reported unless they are known digests
or identifiers:

* a run with the length of a digest (32, 40, 56, 64, 96 or 128 hexadecimal digits) that isn't the
  value of a secret (``token =``, ``api_key:``, ``password=`` ... in the ``BEFORE`` characters before it), whether it
  follows ``sha1:``, ``commit`` and so on or stands alone; also runs after a label of digests in any
  encoding, and the digests in ``known``;
* UUIDs, and numbers and dates that aren't the value of a secret;
* names made of words: a run cut at separators and changes of case whose letters, a third of it at
  least, have more than ``WORD_RATIO`` characters per token; and runs of which a quarter are separators.

``scan`` returns ``doc_id, start, length, ratio, kind, secret_md5`` (positions in characters; the
secret itself isn't repeated). ``redact(docs)`` returns the input rows and columns in which the
secrets of ``text`` are replaced by ``MASK``; ``n_chars`` follows where the column exists.

The whole text is scanned. Edge cases: null and empty texts have no findings and stay as they are;
repeated rows are reported each; a null ``doc_id`` is kept as null; other columns are left alone
whatever their names; an empty table gives an empty result; matches don't overlap, and of nested
runs the longest is reported. Only rows with a candidate reach the tokenizer.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat

MIN_LENGTH, MAX_RATIO, MASK = 20, 2.2, "[SECRET]"
LETTERS_RATIO, DIGITS_RATIO, WORD_RATIO, BEFORE = 1.9, 2.9, 2.4, 48
RUN = re.compile(r"[A-Za-z0-9+/_\-]{%d,}={0,2}" % MIN_LENGTH)
#: Java's form of RUN, for the filter before Python.
RUN_SQL = "[A-Za-z0-9+/_\\-]{%d}" % MIN_LENGTH
ASSIGNED = re.compile(r"(?i)(?:secret|token|passw(?:or)?d|pwd|api[_\- ]?key|access[_\- ]?key|private[_\- ]?key|credential|bearer|auth\w*)[\w\-]*[\"']?\s*(?:[:=]|=>|\bis\b)?\s*[\"']?$")
DIGEST_LABEL = re.compile(r"(?i)(?:md5|sha-?\d+|sha\d*sum|checksum|digest|commit|revision|etag|fingerprint|integrity|blake\w*|crc\d*)[\"']?\s*[:=\-]?\s*[\"']?$")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_HEX_SIZES = {32, 40, 56, 64, 96, 128}


@lru_cache(2)
def encoder(vocabulary: str):
    """The tiktoken encoding of a file of ranks; loaded once in each Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("sievelane", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def made_of_words(run: str, enc) -> bool:
    if 4 * sum(c in "+/_-=" for c in run) >= len(run):
        return True
    words = WORDS.findall(run)
    letters = sum(map(len, words))
    return 3 * letters >= len(run) and letters > WORD_RATIO * sum(map(len, enc.encode_ordinary_batch(words, num_threads=1)))


def findings(text: str, enc, known: frozenset[str] = frozenset()) -> Iterator[tuple[int, str, float, str]]:
    """(start, run, ratio, kind) of the secrets of one text."""
    for m in RUN.finditer(text):
        run = m.group()
        ratio = len(run) / len(enc.encode_ordinary(run))
        letters = WORDS.search(run) is not None
        if ratio > (MAX_RATIO if letters else DIGITS_RATIO):
            continue
        before = text[max(0, m.start() - BEFORE) : m.start()]
        assigned = ASSIGNED.search(before) is not None
        if not assigned and (not letters or ratio > LETTERS_RATIO and WORDS.fullmatch(run)):
            continue
        if run in known or run.lower() in known or UUID.fullmatch(run) or DIGEST_LABEL.search(before) or (not assigned and len(run) in _HEX_SIZES and DIGEST.fullmatch(run)) or made_of_words(run, enc):
            continue
        yield m.start(), run, ratio, "assigned" if assigned else "bare"


def _scan(vocabulary: str, known: frozenset[str]):
    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            rows = [(d, s, len(r), round(q, 6), k, hashlib.md5(r.encode()).hexdigest()) for d, t in zip(flat(batch, "doc_id").to_pylist(), flat(batch, "text").to_pylist()) for s, r, q, k in findings(t, enc, known)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "length", "ratio", "kind", "secret_md5"])

    return run


def scan(docs: DataFrame, vocabulary: str, known: frozenset[str] = frozenset()) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike(RUN_SQL))
    return docs.mapInArrow(_scan(vocabulary, known), "doc_id long, start long, length long, ratio double, kind string, secret_md5 string")


def redact(docs: DataFrame, vocabulary: str, known: frozenset[str] = frozenset()) -> DataFrame:
    """The rows of ``docs`` with their secrets masked. Texts without a candidate run stay in the
    JVM: the function below is evaluated for the others only."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        enc, out = encoder(vocabulary), []
        for t in texts:
            if t is not None:
                parts, at = [], 0
                for s, r, _, _ in findings(t, enc, known):
                    parts += [t[at:s], MASK]
                    at = s + len(r)
                t = "".join([*parts, t[at:]]) if parts else None
            out.append(t)
        return pd.Series(out, dtype=object)

    masked = clean(F.when(F.col("text").rlike(RUN_SQL), F.col("text")))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), masked.alias("masked"))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.coalesce("masked", F.col("row.text")).alias(c))
        elif c == "n_chars":
            kind = dict(docs.dtypes)[c]
            cols.append(F.when(F.col("masked").isNull(), F.col("row.n_chars")).otherwise(F.length("masked").cast(kind)).alias(c))
        else:
            cols.append(F.col(f"row.`{c}`").alias(c))
    return row.select(*cols)

