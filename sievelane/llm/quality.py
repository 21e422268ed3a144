"""Operator 3: quality rules. A table of thresholds is compiled into one Spark projection that
measures length, symbol, stop-word, repetition and line ratios and compares them. No user
functions, no shuffle.

``score(docs)`` adds nothing to the input's columns; it returns ``doc_id``, the measures,
``failed`` (names of the rules that the text breaks, comma-separated, in the table's order, empty
if none) and ``keep``. ``accept(docs)`` returns the rows of ``docs`` that break no rule, with their
own columns.

Words are what white space (space, tab, CR, LF, FF) and ``.,;:!?"()`` separate in the lower-cased
text; lines are what LF separates, without lines of white space only.

Edge cases: a null text counts as an empty one and breaks ``min_words``; ratios of an empty text
are 0; a rule with a guard holds for every text whose guard measure is too small for the ratio to
mean anything; repeated rows are judged alike, each by itself; other columns, nulls in them and
names that equal a measure's are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most frequent function words of the languages that are accepted.
STOP_WORDS = tuple(
    sorted(
        set(
            "the of and to in is that for it on with as be by this are was from at or an a not have has "
            "der die das und den von zu mit für ist im auf des dem ein eine nicht als auch sich es "
            "le la les de et en un une que qui du par pour pas sur dans au aux il elle est des ce "
            "el los las y se del con al lo por para una su no sin más como".split()
        )
    )
)
#: Inside of character classes that Java and RE2 read alike.
SYMBOLS = "#$%&*|<>{}~"
BREAKS = ' \\t\\n\\r\\f.,;:!?"()'
MEASURES = ("n_chars_text", "n_words", "n_lines", "mean_word_len", "symbol_ratio", "upper_ratio", "digit_ratio", "stop_ratio", "repeat_ratio", "dup_line_ratio", "ellipsis_line_ratio", "bullet_line_ratio")


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``, asked only where ``guard >= at_least``."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    guard: str | None = None
    at_least: float = 0


RULES = (
    Rule("min_words", "n_words", low=1),
    Rule("word_length", "mean_word_len", low=2, high=15, guard="n_words", at_least=20),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("upper_case", "upper_ratio", high=0.35, guard="n_words", at_least=8),
    Rule("digits", "digit_ratio", high=0.4, guard="n_words", at_least=20),
    Rule("stop_words", "stop_ratio", low=0.03, guard="n_words", at_least=80),
    Rule("word_repeats", "repeat_ratio", high=0.3, guard="n_words", at_least=10),
    Rule("line_repeats", "dup_line_ratio", high=0.4, guard="n_lines", at_least=4),
    Rule("ellipsis_lines", "ellipsis_line_ratio", high=0.5, guard="n_lines", at_least=4),
    Rule("bullet_lines", "bullet_line_ratio", high=0.9, guard="n_lines", at_least=4),
)


def measures(text: Column) -> Column:
    """A struct of all measures. The words, lines and the text are bound once, as the variable of a
    lambda over an array of one element: no rewrite of the plan (such as pushing the filter of
    ``accept`` down) can make Spark split the text again for each measure."""
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    gone = lambda c, chars: F.length(c) - F.length(F.regexp_replace(c, f"[{chars}]+", ""))
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.lower(t), f"[{BREAKS}]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda s: s.rlike("[^ \t\r\f]"))

    def of(x: Column) -> Column:
        t, w, lines = x["t"], x["w"], x["l"]
        n_words, n_lines, n_chars = F.size(w), F.size(lines), F.length(t)
        return F.struct(
            n_chars.cast("long").alias("n_chars_text"),
            n_words.cast("long").alias("n_words"),
            n_lines.cast("long").alias("n_lines"),
            over(F.length(F.array_join(w, "")), n_words).alias("mean_word_len"),
            over(gone(t, SYMBOLS), n_words).alias("symbol_ratio"),
            over(gone(t, "A-Z"), n_chars).alias("upper_ratio"),
            over(gone(t, "0-9"), n_chars).alias("digit_ratio"),
            over(F.size(F.filter(w, lambda v: v.isin(*STOP_WORDS))), n_words).alias("stop_ratio"),
            over(F.size(F.filter(w, lambda v, i: (i > 0) & (v == F.get(w, i - 1)))), n_words).alias("repeat_ratio"),
            over(n_lines - F.size(F.array_distinct(lines)), n_lines).alias("dup_line_ratio"),
            over(F.size(F.filter(lines, lambda s: s.endswith("...") | s.endswith("…"))), n_lines).alias("ellipsis_line_ratio"),
            over(F.size(F.filter(lines, lambda s: s.startswith("- ") | s.startswith("* ") | s.startswith("• "))), n_lines).alias("bullet_line_ratio"),
        )

    return F.transform(F.array(F.struct(t.alias("t"), words.alias("w"), lines.alias("l"))), of)[0]


def broken(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that the measures ``m`` (a struct) break, as a comma-separated string."""
    parts = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (m[r.measure] < r.low)
        if r.high is not None:
            bad = bad | (m[r.measure] > r.high)
        if r.guard:
            bad = bad & (m[r.guard] >= r.at_least)
        parts.append(F.when(bad, F.lit(r.name)))
    return F.concat_ws(",", *parts)


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    judged = F.transform(F.array(measures(F.col("text"))), lambda m: F.struct(m.alias("m"), broken(m, rules).alias("failed")))[0]
    return docs.select("doc_id", judged.alias("j")).select("doc_id", "j.m.*", F.col("j.failed").alias("failed"), (F.col("j.failed") == "").alias("keep"))


def accept(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return docs.filter(F.transform(F.array(measures(F.col("text"))), lambda m: broken(m, rules) == "")[0])


def sql() -> str:
    """The same in DuckDB's dialect, over the table ``documents``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    gone = lambda c, chars: f"(length({c}) - length(regexp_replace({c}, '[{chars}]+', '', 'g')))"
    over = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0.0::DOUBLE END"
    stops = ", ".join(q(s) for s in STOP_WORDS)
    tests = []
    for r in RULES:
        bad = " OR ".join(x for x in (f"{r.measure} < {r.low}" if r.low is not None else "", f"{r.measure} > {r.high}" if r.high is not None else "") if x)
        tests.append(f"CASE WHEN ({bad})" + (f" AND {r.guard} >= {r.at_least}" if r.guard else "") + f" THEN '{r.name}' END")
    return f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t,
  list_filter(regexp_split_to_array(lower(t), '[{BREAKS}]+'), lambda w: w <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^ \t\r\f]')) AS l FROM a),
c AS (SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars_text, CAST(len(w) AS BIGINT) AS n_words, CAST(len(l) AS BIGINT) AS n_lines,
  {over("length(array_to_string(w, ''))", "len(w)")} AS mean_word_len,
  {over(gone("t", SYMBOLS), "len(w)")} AS symbol_ratio,
  {over(gone("t", "A-Z"), "length(t)")} AS upper_ratio,
  {over(gone("t", "0-9"), "length(t)")} AS digit_ratio,
  {over(f"len(list_filter(w, lambda x: x IN ({stops})))", "len(w)")} AS stop_ratio,
  {over("len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1]))", "len(w)")} AS repeat_ratio,
  {over("(len(l) - len(list_distinct(l)))", "len(l)")} AS dup_line_ratio,
  {over("len(list_filter(l, lambda s: s LIKE '%...' OR s LIKE '%…'))", "len(l)")} AS ellipsis_line_ratio,
  {over("len(list_filter(l, lambda s: s LIKE '- %' OR s LIKE '* %' OR s LIKE '• %'))", "len(l)")} AS bullet_line_ratio
  FROM b),
d AS (SELECT *, concat_ws(',', {", ".join(tests)}) AS failed FROM c)
SELECT *, failed = '' AS keep FROM d"""
