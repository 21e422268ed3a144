"""Operators of the subpackage against brute force, and their edge cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelane.llm import dedup, fingerprint, langid, lm_score, mixing, ngram_join, packing, pii, quality, secret_scan, url_filter
from sievelane.llm.queries import VOCABULARY

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, pos string"
LONG = " ".join(f"word{i % 977} the of" for i in range(20000))
TEXTS = ["the cat sat on the mat and the dog ran off to see the sea again", "The cat sat on the mat, and the dog ran off to see the sea again!", "the cat sat on the mat and the dog ran off to see the sea today", None, "", "...", "one", "one", LONG, "le chat est sur la table et il regarde dans la rue pour voir", "mail a.b@mail1.example.com or +1 (555) 555-0199 190.137.223.204 now", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here']


def frame(spark, texts=TEXTS):
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}" if i % 5 else None, None if t is None else len(t), 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id at all here", None, None, None, None, None), rows[0]], DOCS)


def grams(t, n=3):
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({" ".join(w)} if w else set())


def test_join_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 60, 40)) for _ in range(12)]
    texts = list(TEXTS)
    for b in base:
        words = b.split()
        for k in (0, 0, 1, 3, 6):
            w = list(words)
            for at in rng.integers(0, 40, k):
                w[at] = "zz"
            texts.append(" ".join(w))
    got = {(r.doc_a, r.doc_b): r.jaccard for r in ngram_join.similar_pairs(frame(spark, texts)).collect()}
    sets = [frozenset(grams(t)) for t in texts]
    first = {}
    for i, s in enumerate(sets):
        if s:
            first.setdefault(s, i)
    want = {(first[s], i): 1.0 for i, s in enumerate(sets) if s and first[s] != i}
    reps = sorted(first.items(), key=lambda x: x[1])
    for x, (s, a) in enumerate(reps):
        for t, b in reps[x + 1 :]:
            j = len(s & t) / len(s | t)
            if j >= ngram_join.THRESHOLD:
                want[a, b] = round(j, 6)
    assert got == want


def test_keep_one(spark):
    kept = sorted((r.doc_id if r.doc_id is not None else -1) for r in dedup.keep_one(frame(spark)).collect())
    assert kept == [-1, 0, 3, 4, 5, 6, 8, 9, 10, 11]


def test_pii(spark):
    got = {(r.doc_id, r.kind) for r in pii.extract(frame(spark)).collect()}
    assert got == {(10, "email"), (10, "phone"), (10, "ip")}


def test_pii_induces_unseen_card(spark):
    def card(i, valid=True):
        head = f"4{i:014d}"
        check = next(c for c in "0123456789" if pii.luhn(head + c))
        return head + (check if valid else str((int(check) + 1) % 10))

    texts = [f"please charge card {card(i * 7919)} today" for i in range(20)] + [f"please charge card {card(5, False)} today"]
    got = {r.doc_id: r.origin for r in pii.extract(frame(spark, texts)).collect() if r.doc_id}
    assert got[20] == "induced" and got[3] == "seed"


def test_quality_edges(spark):
    got = {r.doc_id: r.keep for r in quality.score(frame(spark)).collect()}
    assert not got[3] and not got[4] and got[0] and got[8]
    assert quality.accept(frame(spark)).columns == frame(spark).columns


def test_langid_held_out(spark):
    en, fr = "the of and to in is that for it was".split(), "le la les de et des une que pour dans".split()
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(en if i % 2 else fr, 12)), "en" if i % 2 else "fr") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.filter("doc_id < 100"))
    got = langid.identify(df.filter("doc_id >= 100"), model).collect()
    assert np.mean([r.language == ("en" if r.doc_id % 2 else "fr") for r in got]) > 0.97
    assert {r.doc_id: r.language for r in langid.identify(frame(spark), model).collect()}[3] == "und"


def test_mixing_targets(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"))
    rows = mixing.copies(df, {"a": 0.3, "b": 0.7}, budget=1000.0).groupBy("source").agg(F.sum("copies").alias("n"), F.max("copies").alias("m")).collect()
    assert {r.source: r.n for r in rows} == {"a": 300, "b": 700}
    f = frame(spark)
    assert mixing.mix(f).columns == f.columns


def test_pivot_keeps_sum_and_expectation():
    keys = np.arange(40, dtype=np.int64)
    p = np.full(40, 0.25)
    runs = np.array([mixing.pivot(keys, p, seed) for seed in range(400)])
    assert np.allclose(runs.sum(1), 10) and np.abs(runs.mean(0) - 0.25).max() < 0.1


def test_url_matches_brute_force(spark):
    urls = ["https://blog.Example.com/a?b#c", "http://example.com", "notexample.com/a", None, "", "https://u@x.example.com:80/ab", "example.com/a" * 500]
    rules = [(1, "example.com", "block"), (2, "example.com/a", "review"), (3, "blog.example.com", "allow"), (4, "", "block"), (5, "example.com/a", "allow")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule_id, r.action, r.n_rules) for r in url_filter.match(pages, spark.createDataFrame(rules, "rule_id long, pattern string, action string")).collect()}
    assert got == {0: (3, "allow", 2), 1: (1, "block", 1), 2: (0, "allow", 0), 3: (0, "invalid", 0), 4: (0, "invalid", 0), 5: (1, "block", 1), 6: (5, "allow", 3)}


def test_packing_round_trip(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.pmod(F.xxhash64("id"), F.lit(20000)).cast("int")).alias("text"))
    rows = packing.pack(df).collect()
    by, packs = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
        packs.setdefault(r.pack_id, []).append((r.offset, r.n_tokens))
    for r in df.collect():
        assert sum(n for _, n in by.get(r.doc_id, [])) == -(-len(r.text) // 4)
    for spans in packs.values():
        spans.sort()
        assert sum(n for _, n in spans) <= packing.CAPACITY and all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_lm_scores_every_token_once(spark):
    got = {r.doc_id: r for r in lm_score.score(frame(spark), VOCABULARY).collect() if r.doc_id is not None}
    enc = secret_scan.encoder(VOCABULARY)
    for i, t in enumerate(TEXTS):
        assert got[i].n_tokens == len(enc.encode_ordinary(t or ""))
    assert got[3].nll is None and got[8].nll < 9


def test_secret_scan(spark):
    found = secret_scan.scan(frame(spark), VOCABULARY).collect()
    assert [(r.doc_id, r.start, r.length) for r in found] == [(11, 9, 40)]
    masked = {r.doc_id: r for r in secret_scan.redact(frame(spark), VOCABULARY).collect()}
    assert masked[11].text == 'token = "[SECRET]" here' and masked[11].n_chars == len(masked[11].text) and masked[8].text == LONG


def test_fingerprints(spark):
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark)).collect()}
    assert got[3].distinct_shingles == 0 and got[0].distinct_shingles == len(grams(TEXTS[0])) and got[0].sketch == got[1].sketch
    assert abs(got[8].distinct_shingles / len(grams(LONG)) - 1) < 0.35


@pytest.mark.parametrize("op", [ngram_join.similar_pairs, dedup.keep_one, pii.extract, quality.score, quality.accept, mixing.mix, packing.pack, fingerprint.fingerprints, lambda d: secret_scan.scan(d, VOCABULARY), lambda d: secret_scan.redact(d, VOCABULARY), lambda d: lm_score.score(d, VOCABULARY), lambda d: langid.identify(d, langid.train(d))])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], DOCS)).count() == 0
