"""Golden values, decision rules and brute-force versions of the library's own operators."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievelane.functions import text as tx
from sievelane.operators import cascade, chunk, dedup, grounding, hparams, loop, metrics, split, validate


def test_shingles(spark):
    got = spark.createDataFrame([("",), ("abc",), ("aaaaaa",), ("añb cdé",)], "t string").select("t", F.array_sort(tx.shingles(F.col("t"))).alias("s")).collect()
    for r in got:
        want = {r.t[i : i + 4] for i in range(max(1, len(r.t) - 3))} if r.t else set()
        assert set(r.s) == want


def test_thinking(spark):
    rows = [("<think>a</think> x",), ("a</think>b</think> c",), ("x<think>tail",)]
    got = spark.createDataFrame(rows, "t string").select(tx.strip_thinking(F.col("t")).alias("a")).collect()
    assert [r.a for r in got] == ["x", "c", "x"]


def test_near_dedup_matches_sequential_rule(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from the old grey wolf "
    texts = [base * 3, base * 3 + "x", base.upper() * 3, "something else entirely, with other words", None, "", base * 3 + "yz"]
    df = spark.createDataFrame(list(enumerate(texts)), "p long, text string")
    kept = sorted(r.p for r in dedup.near_dedup(df, "p").collect())
    norm = [" ".join((t or "").lower().split()) for t in texts]
    grams = [{t[i : i + 4] for i in range(max(1, len(t) - 3))} if t else set() for t in norm]
    want, seen = [], set()
    for i, t in enumerate(norm):
        if texts[i] is None or (t not in seen and all(len(grams[i] & grams[j]) < 0.8 * len(grams[i] | grams[j]) or not grams[i] for j in want if grams[j])):
            want.append(i)
        if texts[i] is not None:  # a null is a text of its own, not an empty one
            seen.add(t)
    assert kept == sorted(want)


def test_replay_order():
    edges = pd.DataFrame([(0, 1, 2, 3), (1, 0, 1, 2)], columns=["first", "band", "a", "b"])
    assert dedup.replay(edges)["p"].tolist() == [2, 3]


def test_split_counts(spark):
    df = spark.range(100).withColumn("label", F.when(F.col("id") < 95, "common").otherwise("rare"))
    got = {(r.split, r.label): r.n for r in split.split_summary(split.split_dataset(df, "id", "label"), "label").collect()}
    assert sum(got.values()) == 100 and got["train", "common"] == 76 and got["train", "rare"] == 4
    with pytest.raises(ValueError):
        split.split_dataset(df, "id", "label", (0.9, 0.2, 0.1))


def test_metrics_empty_and_values(spark):
    rows = [("a", "a"), ("A ", "a"), ("b", "a"), ("b", "c")]
    s = metrics.summary(spark.createDataFrame(rows, "gold string, predicted string")).first()
    assert s.accuracy == 0.5 and s.n == 4 and s.hallucinated == 1 and s.classes == 2
    assert metrics.per_class(spark.createDataFrame([], "gold string, predicted string")).count() == 0


def test_grounding(spark):
    df = spark.createDataFrame([("See v1.2 at 512 in /a/b.py", "see v1.2, 12"), ("none", "port 8080"), (None, None)], "s string, o string")
    got = grounding.gate(df, "s", "o").select("ungrounded", "clean").collect()
    assert got[0].clean and not got[1].clean and got[1].ungrounded == ["8080"] and got[2].clean


def test_upper_bound():
    assert abs(cascade.upper_bound(0, 10) - (1 - 0.05 ** (1 / 10))) < 1e-9
    assert cascade.upper_bound(5, 5) == 1.0 and cascade.upper_bound(0, 0) == 1.0


def test_compose_synthetic(spark):
    rows = cascade.compose(cascade.synthetic(spark, 1000), {"a": 0.0, "b": 0.1, "c": 2.0}, {"a": 1, "b": 120, "c": 800}, grid=6, max_terminal=0.5)
    assert rows[0]["architecture"] in ("a->b->c", "a->c", "b->c", "c") and rows[0]["accuracy"] >= 0.95


def test_promote():
    assert loop.promote(0.8, 0.85, 0.8, 0.01)["decision"] == "PROMOTE"
    assert loop.promote(0.8, 0.8, 0.8, -1.0)["decision"] == "RETAIN"
    with pytest.raises(ValueError):
        loop.promote(0.8, 0.9, 0.8, slice_id="s", ledger={"s"})


def test_validate(spark):
    rows = ["{bad", '{"messages": [{"role": "user", "content": "a"}]}', '{"messages": [{"role": "user", "content": " "}, {"role": "assistant", "content": "b"}]}', '{"text": "t"}', '{"messages": "x"}']
    df = spark.createDataFrame([("train", i, v) for i, v in enumerate(rows)], "split string, line long, value string")
    got = {(r.line, r.rule) for r in validate.issues(df).collect()}
    assert got == {(0, "invalid_json"), (1, "last_not_assistant"), (2, "empty_content"), (3, "format_differs"), (4, "messages_not_list")}


def test_chunks_keep_words():
    text = "# A\n\n" + " ".join(f"w{i}" for i in range(3000)) + "\n\n# B\n\nshort"
    got = chunk.chunks(text, 400, 800)
    assert " ".join(got).split() == text.split() and max(map(len, got)) <= 800


def test_hparams():
    small = hparams.recommend(45, 7376, 4.0)
    assert (small["epochs"], small["batch_size"], small["iters"], small["num_layers"], small["max_seq_length"]) == (5, 4, 100, 8, 3072)
    large = hparams.recommend(90_000, 50_000, 14.0, task="cpt", memory_gb=24)
    assert (large["epochs"], large["learning_rate"], large["batch_size"], large["iters"], large["steps_per_eval"], large["save_every"], large["max_seq_length"], large["mask_prompt"]) == (1.5, 1e-5, 8, 16875, 1406, 100, 13312, False)
    assert hparams.recommend(15, 0, 8.0, memory_gb=16)["grad_checkpoint"] and not hparams.recommend(15, 0, 4.0)["grad_checkpoint"]
    with pytest.raises(ValueError):
        hparams.recommend(0, 0, 4.0)
    text = hparams.config(small, "m", "d", 8)
    assert "batch_size: 4\n" in text and "scale: 16.0" in text and "epochs" not in text
