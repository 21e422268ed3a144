"""Whole jobs where a query of the catalogue once did less."""

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelane import catalogue
from sievelane.operators import cascade, common, dedup, metrics, split, vectors


def test_gate_reads_whole_texts(spark, tmp_path):
    texts = ["word " * 300 + "call 2911 now", "word " * 300 + "call 2911 now", "short"]
    spark.createDataFrame([(5 * i, t) for i, t in enumerate(texts[:1])] + [(i, t) for i, t in enumerate(texts[1:], 1)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_ungrounded, r.ratio > 0.99) for r in catalogue.queries()["grounding_gate"](spark, str(tmp_path)).collect()}
    assert got == {0: (2, True), 1: (0, True), 2: (0, True)}


def test_upper_bound_matches_sums_and_scales():
    def below(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for k, n in ((0, 1), (1, 10), (3, 200), (40, 90), (89, 90)):
        assert abs(below(k, n, cascade.upper_bound(k, n)) - 0.05) < 1e-9
    assert 0.1 < cascade.upper_bound(10**8, 10**9) < 0.10002


def test_certified_point_bounds_the_local_risk(spark):
    # tier a answers 600 rows with confidence 0.9, all right, and 400 with 0.1, all wrong; b is always right
    a = spark.range(1000).select("id", F.lit("g").alias("gold"), F.when(F.col("id") < 600, "g").otherwise("x").alias("predicted"), F.when(F.col("id") < 600, 0.9).otherwise(0.1).alias("confidence"))
    b = a.withColumn("predicted", F.lit("g")).withColumn("confidence", F.lit(1.0))
    rows = cascade.compose({"a": a, "b": b}, {"a": 0, "b": 1}, grid=5, max_error=0.05, calibrated=False)
    by = {r["architecture"]: r for r in rows}
    assert by["a->b"]["accuracy"] == 1.0 and by["a->b"]["certified"]["error_bound"] == cascade.upper_bound(0, 600)
    assert by["a"]["certified"] is None and by["b"]["certified"] is None
    assert cascade.compose({"a": a, "b": b}, {"a": 0, "b": 1}, grid=5, max_error=0.004, calibrated=False)[0]["certified"] is None


def test_split_warnings_and_gates(spark):
    df = spark.createDataFrame([(i, "big" if i < 12 else "tiny") for i in range(14)], "id long, label string")
    got = {(r.rule, r.subject): r.n for r in split.split_warnings(split.split_dataset(df, "id", "label"), "label").collect()}
    assert got[("small_class", "tiny")] == 2 and any(r == "class_not_in_split" and x.startswith("tiny/") for r, x in got)
    one = split.split_warnings(split.split_dataset(df, "id", "label", (1.0, 0.0, 0.0)), "label").collect()
    assert {r.subject for r in one if r.rule == "empty_split"} == {"valid", "test"}
    with pytest.raises(ValueError):
        split.split_gates(spark.range(20), "id")
    with pytest.raises(ValueError):
        split.split_gates(df.limit(3), "label")


def test_ranks_and_running_accuracy(spark, monkeypatch):
    monkeypatch.setattr(metrics, "GROUP", 2)
    df = spark.range(230).select((F.col("id") * 37 % 1009).alias("pos"), (F.col("id") % 3 == 0).alias("ok"))
    order = sorted((r.pos, r.ok) for r in df.collect())
    assert [r.rank for r in common.global_rank(df, "pos").orderBy("pos").collect()] == list(range(1, 231))
    want = {n: sum(ok for _, ok in order[:n]) / n for n in (50, 100, 150, 200, 230)}
    assert {r.n_seen: r.accuracy for r in metrics.running_accuracy(df, "pos", F.col("ok")).collect()} == pytest.approx(want)


def test_grams_are_those_of_the_text():
    texts = ["", "abc", "abcd", "aaaaaaaa", "né €𝄞 xy né €𝄞", "the same the same"]
    for t, got in zip(texts, dedup.Grams()(texts)):
        want = {t[i : i + 4] for i in range(max(1, len(t) - 3))} if t else set()
        assert sorted(got.tolist()) == sorted(int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big") for g in want)
    assert dedup.signature(np.zeros(0, np.uint64)) is None and len(dedup.signature(np.arange(9, dtype=np.uint64))) == 64


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(120, 6)).round(1)
    v[3] = v[9] = v[50]
    df = spark.createDataFrame([(i, f"l{i % 4}", x.tolist()) for i, x in enumerate(v)] + [(500, None, None)], "vec_id long, label string, embedding array<double>")
    n = v / (np.linalg.norm(v, axis=1, keepdims=True) + vectors.EPS)
    cents = np.stack([n[np.arange(120) % 4 == k].mean(0) for k in range(4)])
    sims = n @ (cents / np.linalg.norm(cents, axis=1, keepdims=True)).T
    got = {r.vec_id: r for r in vectors.nearest_centroid(df, vectors.centroids(df), "vec_id").collect()}
    assert all(got[i].predicted == f"l{s.argmax()}" and abs(got[i].confidence - (np.sort(s)[-1] - np.sort(s)[-2])) < 1e-9 for i, s in enumerate(sims)) and got[500].predicted is None
    near = n @ n.T
    want = {(i, r + 1): int(j) for i in range(0, 120, 10) for r, j in enumerate([j for j in np.lexsort((np.arange(120), -near[i].round(12))) if j != i][:3])}
    for blocks in (1, 3):
        assert {(r.vec_id, r.rank): r.neighbour for r in vectors.top_k(df.filter("vec_id % 10 = 0"), df, "vec_id", blocks=blocks).collect() if r.vec_id < 500} == want
    texts = spark.createDataFrame([("abab",), ("ab",), (None,)], "t string")
    assert [sum(r.embedding) for r in vectors.hashed_embedding(texts, "t", 16).collect()] == [2.0, 0.0, 0.0]


def test_rows_drop_as_in_the_sequential_rule(spark):
    rng = np.random.default_rng(13)
    for n in (6, 40, 90):
        pairs = {tuple(sorted(int(x) for x in rng.integers(0, n, 2))) for _ in range(2 * n)}
        rows = [(int(rng.integers(0, 5)), int(rng.integers(0, 3)), a, b) for a, b in pairs if a != b for _ in range(int(rng.integers(1, 3)))]
        rows += [(0, 0, i, i + 1) for i in range(n, n + 12)]  # a chain
        edges = pd.DataFrame(rows, columns=["first", "band", "a", "b"])
        got = sorted(r.p for r in dedup.dropped(spark.createDataFrame(rows, "first long, band int, a long, b long")).collect())
        assert got == dedup.replay(edges)["p"].tolist()
    assert dedup.dropped(spark.createDataFrame([], "first long, band int, a long, b long")).count() == 0


def test_bounds_of_a_table(spark):
    got = spark.createDataFrame([(0, 10), (3, 200), (5, 5)], "k long, n long").withColumn("b", cascade.upper_bounds("k", "n")).collect()
    assert [r.b for r in got] == [cascade.upper_bound(r.k, r.n) for r in got]


def test_bands_and_grams_belong_to_their_rows(monkeypatch):
    monkeypatch.setattr(dedup, "AT_ONCE", 30)
    texts = [f"text number {i} with some words {i * 7}" for i in range(9)] + ["", "tiny"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100, 111), pa.int64()), pa.array(texts)], names=["p", "t"])
    grams = {100 + i: np.sort(dedup.Grams()([t])[0]) for i, t in enumerate(texts)}
    got = {p: np.asarray(g).view(np.uint64) for out in dedup._gram_hashes(iter([batch])) for p, g in zip(out.column("p").to_pylist(), (np.array(x, np.int64) for x in out.column("g").to_pylist()))}
    assert got.keys() == grams.keys() and all((got[p] == grams[p]).all() for p in grams)
    bands = [r for out in dedup._bands(iter([batch])) for r in out.to_pylist()]
    width = dedup.HASHES // dedup.BANDS
    want = {(p, b): (dedup.signature(g)[b * width : (b + 1) * width].tobytes(), len(g)) for p, g in grams.items() if len(g) for b in range(dedup.BANDS)}
    assert {(r["p"], r["band"]): (r["key"], r["n"]) for r in bands} == want
