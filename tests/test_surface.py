"""Sources, sinks, reports and streams that no query covers."""

import json

import pytest
from pyspark.sql import functions as F

from sievelane.functions import records
from sievelane.operators import chunk, classify, dedup, generation, loop, metrics, validate, vectors
from sievelane.sources import files
from sievelane.streaming import log as stream_log


def lines(tmp_path, name, rows):
    (tmp_path / name).write_text("\n".join(rows) + "\n")
    return str(tmp_path / name)


def test_predictions_fail_with_file_line_and_kind(spark, tmp_path):
    good = lines(tmp_path, "p.jsonl", ['{"expected": "a", "label": "z", "predicted": "a"}', "", '{"label": "b", "predicted": "c"}'])
    assert {(r.gold, r.predicted) for r in files.read_predictions(spark, good).collect()} == {("a", "a"), ("b", "c")}
    for bad, kind in (("{oops", "JSONDecodeError"), ('{"predicted": "a"}', "KeyError: label"), ('{"label": "a"}', "KeyError: predicted"), ("[1]", "TypeError")):
        with pytest.raises(Exception, match=rf"b\.jsonl:2: bad prediction line \({kind}"):
            files.read_predictions(spark, lines(tmp_path, "b.jsonl", ['{"label": "b", "predicted": "c"}', bad])).collect()


def test_lines_jsonl_and_strings(spark, tmp_path):
    path = lines(tmp_path, "r.jsonl", ['{"a": 1}', " ", '{"a": 2}'])
    assert [(r.line, r.value) for r in files.read_lines(spark, path).orderBy("line").collect()] == [(1, '{"a": 1}'), (2, " "), (3, '{"a": 2}')]
    assert sorted(r.a for r in files.read_jsonl(spark, path, "a int").collect()) == [1, 2]
    with pytest.raises(Exception, match="malformed"):
        files.read_jsonl(spark, path, "a int", blank="error").collect()
    assert files.read_errors(spark, lines(tmp_path, "e.jsonl", ["{}", "x"])).select("line").first().line == 2
    assert {r.value for r in files.read_strings(spark, lines(tmp_path, "s.txt", [" a ", "b", "a", ""])).collect()} == {"a", "b"}
    assert files.read_document(spark, lines(tmp_path, "d.json", ["{", '"k": 3', "}"])).first().k == 3


def test_corpus_takes_a_named_file_of_any_extension(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.TXT", "sub/b.md", "c.rst"):
        (tmp_path / name).write_bytes(b"t\xff" + name.encode())
    names = lambda p: {r.source.rsplit("/", 1)[1]: r.text for r in files.read_corpus(spark, str(p)).collect()}
    assert set(names(tmp_path)) == {"a.TXT", "b.md"} and names(tmp_path)["b.md"].startswith("t�") and set(names(tmp_path / "c.rst")) == {"c.rst"}


def test_samples(spark):
    df = spark.range(10).select((F.col("id") * 7 % 10).alias("pos"))
    assert [r.pos for r in files.head(df, "pos", 3).collect()] == [0, 1, 2]
    assert [r.pos for r in files.stride_sample(df, "pos", 4).collect()] == [0, 2, 4, 6]
    assert files.stride_sample(df.limit(2), "pos", 4).count() == 2


def test_logs_and_sinks(spark, tmp_path):
    log = str(tmp_path / "log")
    files.init_log(spark, log, loop.LOG)
    files.init_log(spark, log, loop.LOG)  # empty, so it may be made again
    files.append_log(spark.createDataFrame([(1, "t", "p")], "pos long, text string, prediction string"), log)
    row = spark.read.parquet(log).first()
    assert row.prediction == "p" and len(row.input_hash) == 16 and row.feedback is None
    with pytest.raises(ValueError):
        files.init_log(spark, log, loop.LOG)
    gated = spark.createDataFrame([(1, True, False), (2, False, False), (3, True, True)], "id long, clean boolean, over_budget boolean")
    files.write_flagged(gated, str(tmp_path / "flagged"))
    assert {r.id for r in spark.read.json(str(tmp_path / "flagged")).collect()} == {2, 3}
    files.write_metrics(spark.createDataFrame([(0.5,)], "accuracy double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().accuracy == 0.5
    with pytest.raises(ValueError):
        files.write_metrics(gated, str(tmp_path / "m"))
    files.write_splits(gated.withColumn("split", F.lit("train")), str(tmp_path / "splits"))
    assert spark.read.json(str(tmp_path / "splits")).count() == 3
    assert "| 0.5000 |" in files.report(spark.createDataFrame([(0.5,)], "accuracy double"), "Scores")


def test_adjudication_writes_ledger_and_version(spark, tmp_path):
    one = lambda a, v: spark.createDataFrame([(a, v)], "accuracy double, version int")
    ledger, versions = str(tmp_path / "ledger"), str(tmp_path / "versions")
    assert loop.adjudicate(one(0.8, 3), one(0.9, 1), 0.85, "s1", ledger, versions)["decision"] == "PROMOTE"
    assert loop.adjudicate(one(0.9, 4), one(0.9, 1), 0.85, "s2", ledger, versions)["decision"] == "RETAIN"
    assert [(r.version, r.promoted_from_slice, r.accuracy) for r in spark.read.parquet(versions).collect()] == [(4, "s1", 0.9)]
    assert {r.slice for r in spark.read.parquet(ledger).collect()} == {"s1", "s2"}
    with pytest.raises(ValueError):
        loop.adjudicate(one(0.8, 3), one(0.9, 1), 0.85, "s2", ledger, versions)


def test_manifest_counts_structural_labels(spark):
    rows = [(1, "h1", "a", "x", "user"), (2, "h1", "a", "y", "structural"), (3, "h2", "b", "x", "structural"), (4, "h3", "c", "x", "audit"), (5, "h4", "d", None, None)]
    log = loop.conform(spark.createDataFrame(rows, "pos long, input_hash string, text string, feedback string, feedback_source string"))
    got = loop.manifest(log, spark.createDataFrame([("h2",)], "h string"), 3, 0.9, ("tier1", "tier2")).first()
    assert got.asDict() == {"round": 3, "curated_records": 2, "excluded_holdout": 1, "structural_labels": 1, "target_tiers": "tier1,tier2", "promotion_bar": 0.9}


def test_stream_keeps_the_last_feedback_of_each_text(spark, tmp_path):
    src, state = str(tmp_path / "src"), str(tmp_path / "state")
    schema = "pos long, text string, feedback string"
    for batch in ([(1, "a", "x"), (2, "b", "x"), (3, "c", None)], [(5, "a", "z"), (4, "a", "y"), (6, "d", "w")], [(7, "b", None)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream_log.curate_stream(spark.readStream.schema(schema).parquet(src), state, str(tmp_path / "ck"), 4).awaitTermination()
    assert {(r.text, r.label) for r in stream_log.curated(spark, state).collect()} == {("a", "z"), ("b", "x"), ("d", "w")}


def test_record_sizes_and_texts(spark):
    rows = ['{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": null, "tool_calls": [{"a":1}]}], "tools": [{"n":"é"}]}', '{"prompt": "p", "completion": "cc"}', '{"text": "ttt"}', '{"z": 1, "a": {"d": 2, "b": 3}}', "nope", None]
    call, tools = json.dumps([{"a": 1}]), json.dumps([{"n": "é"}])
    df = spark.createDataFrame([(v,) for v in rows], "v string").select(records.content_text("v").alias("t"), records.record_chars("v").alias("n"), records.sorted_json("v").alias("s"))
    got = df.collect()
    assert [r.t for r in got] == [f"hi\n{call}\n{tools}", "pcc", "ttt", "", None, None]
    assert [r.n for r in got] == [2 + len(call) + len(tools), 3, 3, len(rows[3]), None, None]
    assert got[3].s == '{"a": {"b": 3, "d": 2}, "z": 1}' and got[4].s == "nope"
    text = spark.createDataFrame([(None, rows[3]), ("t", rows[2])], "text string, v string").select(records.record_text({"text": F.col("text")}, F.col("v")).alias("r"))
    assert [r.r for r in text.collect()] == ['{"a": {"b": 3, "d": 2}, "z": 1}', "t"]


def test_pairs_without_a_common_id_and_tally(spark):
    df = lambda rows: spark.createDataFrame(rows, "id string, predicted string, pos long")
    with pytest.raises(ValueError):
        generation.pair_predictions(df([("a", "x", 1)]), df([("b", "x", 1)]))
    keys = spark.createDataFrame([(str(i), i % 2 == 0) for i in range(5)], "id string, flipped boolean")
    judged = spark.createDataFrame([("0", "1"), ("1", "1"), ("2", "tie"), ("3", "what"), ("4", None)], "id string, winner string")
    got = generation.tally_report(judged, keys).first()
    assert (got.a, got.b, got.tie, got.skipped, got.judged) == (1, 1, 1, 2, 3) and "noise" in got.note
    labels = spark.createDataFrame([("B c", 2), ("b-c", 1)], "label string, pos int")
    assert generation.match_label(spark.createDataFrame([("b c",)], "answer string"), labels, "answer", "pos").first().predicted == "B c"


def test_judge_pairs_runs_blind(spark):
    a = spark.createDataFrame([(str(i), f"long answer {i}", 1) for i in range(20)], "id string, predicted string, pos long")
    b = a.withColumn("predicted", F.lit("short"))
    got = generation.judge_pairs(a, b, lambda x, y: "1" if len(x) > len(y) else "2").collect()
    assert len(got) == 20 and {r.result for r in got} == {"a"}


def test_collapse_report_and_overlaps(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from the old grey wolf "
    texts = [base * 3, base * 3 + "x", base * 3 + "yz", "something else entirely, with other words", base * 3]
    df = spark.createDataFrame([(i, t, "train" if i < 4 else "test") for i, t in enumerate(texts)], "p long, text string, split string")
    got = dedup.collapse_report(df, "p").first()
    assert (got.n_rows, got.n_exact, got.n_near, got.collapsed) == (5, 4, 2, True) and got.examples[0].kept == base[:80]
    assert [tuple(r) for r in dedup.split_overlap(df, "split").collect()] == [("test", "train", 1)]
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i z")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e f g h i j k"), (8, "nothing in common at all with these two texts")], "item_id long, text string")
    grams = lambda t: {tuple(t.split()[i : i + 8]) for i in range(len(t.split()) - 7)}
    want = len(grams("a b c d e f g h i j") & grams("a b c d e f g h i j k")) / len(grams("a b c d e f g h i j k"))
    assert [(r.item_id, r.doc_id, r.jaccard) for r in dedup.cross_corpus(docs, items).collect()] == [(7, 1, want)]


def test_issue_samples(spark):
    rows = spark.createDataFrame([("train", i, "{bad") for i in range(30)], "split string, line long, value string")
    assert sorted(r.line for r in validate.issue_samples(rows).collect()) == list(range(20))


def test_chunk_counts(spark):
    df = spark.createDataFrame([("a", "# A\n\n" + "word " * 900 + "\n\n# B\n\nshort"), ("b", "tiny"), ("c", None)], "source string, text string")
    got = {r.source: (r.kept, r.dropped) for r in chunk.chunk_counts(df, target=200, most=400, least=10).collect()}
    kept = {r.source: r["count"] for r in chunk.chunk_documents(df, target=200, most=400, least=10).groupBy("source").count().collect()}
    assert {k: v[0] for k, v in got.items() if v[0]} == kept and got["b"] == (0, 1)


def test_embedder_and_model_are_functions(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    assert [r.embedding for r in vectors.embed(df, "text", lambda ts: [[len(t), 1] for t in ts]).orderBy("id").collect()] == [[3.0, 1.0], [0.0, 1.0]]
    labels = spark.createDataFrame([("Billing",), ("Refund",)], "label string")
    answers = {"abc": ("billing!", [0.5, 0.1], [-1.0, -3.0]), "": ("what", [], [])}
    got = {r.id: r for r in generation.llm_classify(df, lambda ts: [answers[t] for t in ts], labels).collect()}
    assert (got[1].predicted, got[1].out_of_label_space) == ("Billing", False) and abs(got[1].conf_margin - 0.3) < 1e-9 and got[1].conf_logprob == -2.0
    assert got[2].out_of_label_space and (got[2].conf_margin, got[2].conf_logprob) == (0.0, -99.0)


def test_matrix_headroom_drift_receipts_report(spark):
    rows = [(i, "ab"[i % 2], "ab"[i % 2] if i % 4 else "c", "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, gold string, predicted string, strong string")
    m = {r.label: r for r in metrics.confusion_matrix(df).collect()}
    assert set(m) == {"a", "b", "c"} and (m["a"].a, m["a"].c, m["b"].b, m["c"].a) == (10, 10, 20, 0)
    with pytest.raises(ValueError):
        metrics.confusion_matrix(df, most=2)
    h = metrics.headroom(df, "id", "gold", "predicted", "strong", 20).first()
    assert (h.n, h.floor, h.ceiling, h.headroom) == (40, 0.75, 1.0, 0.25)
    d = metrics.drift_check(df, 0.9).first()
    assert (d.accuracy, d.drifted) == (0.75, True) and not metrics.drift_check(df, 0.76).first().drifted
    events = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2 + [(99,)], "id long")
    r = metrics.receipts(events, df, "id", F.col("gold") == F.col("predicted")).first()
    assert (r.events, r.by_volume, r.distinct_keys, r.by_key) == (8, 0.25, 2, 0.5)
    assert "accuracy 0.7500" in metrics.evaluation_report(df) and "| a | c | 10 |" in metrics.evaluation_report(df)


def test_limits_orders_unions_and_gold(spark):
    df = spark.createDataFrame([(2,), (10,), (1,)], "id long")
    assert [r.id for r in generation.limited(df, "id", 2).collect()] == [1, 2] and generation.limited(df, "id", 0).count() == 3
    assert [r.id for r in generation.ordered_by_id(df).collect()] == [1, 2, 10] and [r.id for r in generation.ordered_by_id(df, natural=False).collect()] == [1, 10, 2]
    log = loop.conform(spark.createDataFrame([(1, "t")], "pos long, text string"))
    assert loop.with_records(log, spark.createDataFrame([("u", "fixed")], "text string, feedback string")).filter("feedback = 'fixed'").count() == 1
    v = spark.createDataFrame([('{"expected": null, "label": "x"}',), ('{"label": "y"}',), (None,)], "v string").select(records.gold_of(F.col("v")).alias("g"))
    assert [r.g for r in v.collect()] == [None, "y", None]
    with pytest.raises(Exception, match="no gold"):
        spark.createDataFrame([("{}",)], "v string").select(records.gold_of(F.col("v"))).collect()


def test_boosted_trees_and_refusals(spark):
    rows = [(i, "ab"[i % 2], [float(i % 2), 0.5], float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label string, embedding array<double>, extra double")
    bundle, report = classify.train_classifier(df, "id", extras=["extra"], trees=3)
    assert bundle.classifier == "gbt" and report["accuracy"] == 1.0 and {r.predicted for r in classify.predict(bundle, df).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        classify.train_classifier(df.filter("label = 'a'"), "id")
    with pytest.raises(ValueError):
        classify.train_classifier(df.withColumn("extra", F.lit(None).cast("double")), "id", extras=["extra"])
