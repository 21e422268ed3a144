"""Operator 6: URL filters as a sort-merge range join.

A URL becomes a canonical key: the labels of its host in reverse order, each followed by a dot,
then path and query (``https://Blog.Example.com/a?b#c`` is ``com.example.blog./a?b``). Scheme,
user, port, fragment and the case of the host don't count. A rule is a host with an optional path
prefix; by the same reversal it becomes a prefix of keys, that is the interval of keys from the
prefix up. ``example.com`` covers the host and its subdomains; ``example.com/a`` covers paths of
that host which begin with ``/a``.

Intervals of prefixes are nested or disjoint. Keys and rules are range-partitioned by bounds drawn
from the keys; a rule goes to each part that its interval meets; in each part, sorted by key, one
sweep keeps the stack of the rules that are open at the current key. Every rule on the stack
matches; the innermost decides.

``match(pages, rules)`` returns ``page_id, url, key, rule_id, action, n_rules`` of each page
(``rule_id`` of the innermost rule, number of open rules). Without a match the action is
``DEFAULT`` and rule_id 0; rules need ids above 0.

Edge cases: a null URL and one without a host have a null key and the action ``invalid``; of rules
with equal prefixes the one with the largest id is innermost and all count; rules with a null or
empty pattern are ignored; repeated pages are matched each; other columns are ignored; empty
tables give empty results or default actions; URLs of any length are compared whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, split_partitions

DEFAULT, INVALID, TOP = "allow", "invalid", "\U0010ffff"
#: Keys drawn for each part to place the bounds; they decide balance only, never the result.
DRAWN = 64
RULES = [
    (1, "cheap-pills.example.com", "block"),
    (2, "casino-win.example.org", "block"),
    (3, "adult-x.example.net", "block"),
    (4, "free-bets.example.com", "block"),
    (5, "ads-track.example.org", "block"),
    (6, "ads-track.example.org/en/", "review"),
    (7, "www.casino-win.example.org/en/", "review"),
    (8, "example.net", "allow"),
    (9, "m.example.net", "review"),
    (10, "blog.tionsh.example.net/en/3", "block"),
    (11, "blog.tionsh.example.net/en/", "review"),
    (12, "www.example.org/es", "review"),
]


def rule_table(spark: SparkSession, rules: list[tuple[int, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_id long, pattern string, action string")


def key(url: Column) -> Column:
    """Canonical key of a URL, null without a host."""
    bare = F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.\\-]*://", "")
    authority = F.regexp_extract(bare, "^[^/?#]*", 0)
    rest = F.regexp_replace(F.substr(bare, F.length(authority) + 1), "(?s)#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))
    labels = F.filter(F.split(host, "\\."), lambda x: x != "")
    return F.when(F.size(labels) > 0, F.concat(F.array_join(F.reverse(labels), "."), F.lit("."), rest))


def _bounds(keys: DataFrame, parts: int) -> list[str]:
    """At most ``parts - 1`` keys that split the keys into parts of about equal size, from a sample of about
    ``2 DRAWN`` keys for each part; no more than twice as many reach the driver."""
    keys = keys.filter("key is not null")
    share = 2 * DRAWN * parts / max(1, keys.count())
    drawn = sorted(r.key for r in (keys.sample(share, 7) if share < 1 else keys).limit(4 * DRAWN * parts).collect())
    return sorted({drawn[i * len(drawn) // parts] for i in range(1, parts)}) if drawn else []


def _sweep(batches: Iterator[pa.RecordBatch]):
    """Rows come by part and key, a rule before the keys that it covers. A rule covers the rows from its own
    to the end of its prefix; rules are applied in order, so of nested ones the innermost stays. ``open_`` is
    the stack of rules whose prefix may go on in the next batch."""
    part, open_ = None, []
    for batch in batches:
        parts, keys, n = np.asarray(flat(batch, "part")), flat(batch, "key"), len(batch)
        is_rule = np.asarray(flat(batch, "rule_id").is_valid())
        ids, actions = flat(batch, "rule_id"), flat(batch, "action")
        inner, count, known = np.zeros(n, np.int64), np.zeros(n, np.int64), [(0, DEFAULT)]
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), n]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if parts[lo] != part:
                part, open_ = parts[lo], []
            rules = [(lo, *x) for x in open_] + [(i, keys[i].as_py(), ids[i].as_py(), actions[i].as_py()) for i in (lo + np.flatnonzero(is_rule[lo:hi])).tolist()]
            open_ = []
            for i, prefix, rule, action in rules:
                end = i + bisect_left(range(i, hi), True, key=lambda j: not keys[j].as_py().startswith(prefix))
                inner[i:end] = len(known)
                count[i:end] += 1
                known.append((rule, action))
                if end == hi:
                    open_.append((prefix, rule, action))
        pages = pa.array(np.flatnonzero(~is_rule))
        which = pa.array(inner[~is_rule])
        of = [pa.array(c, t).take(which) for c, t in zip(zip(*known), (pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*(flat(batch, c).take(pages) for c in ("page_id", "url", "key")), *of, pa.array(count[~is_rule])], names=["page_id", "url", "key", "rule_id", "action", "n_rules"])


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", key(F.col("url")).alias("key"))
    rules = rules.select(F.col("rule_id").cast("long").alias("rule_id"), key(F.col("pattern")).alias("key"), "action").filter("key is not null and rule_id is not null")
    parts = split_partitions(pages.sparkSession)
    bounds = _bounds(keyed.select("key"), parts)

    @F.pandas_udf("int")
    def part(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, object), keys.to_numpy(object), "right").astype(np.int32))

    good = keyed.filter("key is not null").select(part("key").alias("part"), "key", F.lit(None).cast("long").alias("rule_id"), "page_id", "url", F.lit(None).cast("string").alias("action"))
    spread = rules.select(F.explode(F.sequence(part("key"), part(F.concat("key", F.lit(TOP))))).alias("part"), "key", "rule_id", F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), "action")
    rows = good.unionByName(spread).repartition(parts, "part").sortWithinPartitions("part", "key", F.col("rule_id").asc_nulls_last())
    found = rows.mapInArrow(_sweep, "page_id long, url string, key string, rule_id long, action string, n_rules long")
    bad = keyed.filter("key is null").select("page_id", "url", "key", F.lit(0).cast("long").alias("rule_id"), F.lit(INVALID).alias("action"), F.lit(0).cast("long").alias("n_rules"))
    return found.unionByName(bad)


def sql(rules: list[tuple[int, str, str]] = RULES) -> str:
    """The same in DuckDB's dialect, over the table ``pages``."""
    values = ", ".join(f"({i}, '{p}', '{a}')" for i, p, a in rules)

    def k(c: str) -> str:
        bare = f"regexp_replace(trim({c}), '^[A-Za-z][A-Za-z0-9+.\\-]*://', '')"
        authority = f"regexp_extract({bare}, '^[^/?#]*')"
        rest = f"regexp_replace(substr({bare}, length({authority}) + 1), '#.*$', '', 's')"
        host = f"lower(regexp_replace(regexp_replace({authority}, '^.*@', ''), ':[0-9]*$', ''))"
        labels = f"list_filter(string_split({host}, '.'), lambda x: x <> '')"
        return f"CASE WHEN len({labels}) > 0 THEN array_to_string(list_reverse({labels}), '.') || '.' || {rest} END"

    return f"""
WITH r AS (SELECT CAST(i AS BIGINT) AS rule_id, {k("p")} AS prefix, a AS action FROM (VALUES {values}) v(i, p, a)),
p AS (SELECT page_id, url, {k("url")} AS key FROM pages),
m AS (SELECT page_id, url, key, rule_id, action, row_number() OVER (PARTITION BY page_id, url ORDER BY length(prefix) DESC NULLS LAST, rule_id DESC) AS n,
      count(rule_id) OVER (PARTITION BY page_id, url) AS n_rules
      FROM p LEFT JOIN r ON starts_with(key, prefix))
SELECT page_id, url, key, coalesce(rule_id, 0) AS rule_id, CASE WHEN key IS NULL THEN 'invalid' ELSE coalesce(action, 'allow') END AS action, n_rules FROM m WHERE n = 1"""
