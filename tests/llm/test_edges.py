"""Brute force and edge cases of the operators: nulls, empty and long texts, ties, repeated rows, empty
tables, columns with clashing names."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievelane.llm import components, dedup, fingerprint, langid, lm_score, mixing, ngram_join, packing, pii, quality, secret_scan, url_filter
from sievelane.llm.queries import VOCABULARY

#: Names that operators use inside; here they are columns of the input.
ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, count string, name string, rank string, piece string, n string, _t string, _h string, _id string"
LONG = " ".join(f"word{i % 977} the of" for i in range(30_000))
TEXTS = [None, "", "...", "one", "one", "the cat sat on the mat and saw the dog of the sea in it", "the cat sat on the mat and saw the dog of the sea in it", LONG, 'password = "xkqzvwpjhgtrbnmlcdfsqz"', "call +1 (555) 555-0199 or me@example.org"]


def odd(spark, texts=TEXTS):
    rows = [(i, t, "en" if i % 2 else "fr", None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t), *"abcdefghij") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id here at all", None, None, None, *[None] * 10), (None, "no id here at all", None, None, None, *[None] * 10), rows[5]], ODD)


KEEP = {"accept": quality.accept, "keep_one": dedup.keep_one, "redact": lambda d: secret_scan.redact(d, VOCABULARY), "mix": mixing.mix}
GIVE = {
    "groups": ngram_join.groups,
    "pairs": ngram_join.similar_pairs,
    "pii": pii.extract,
    "quality": quality.score,
    "langid": lambda d: langid.identify(d, langid.train(d)),
    "copies": mixing.copies,
    "pack": packing.pack,
    "lm": lambda d: lm_score.score(d, VOCABULARY),
    "secrets": lambda d: secret_scan.scan(d, VOCABULARY),
    "fingerprints": lambda d: fingerprint.overlaps(d, F.expr("doc_id % 2 = 0")),
}


@pytest.mark.parametrize("name", [*KEEP, *GIVE])
def test_odd_rows_and_names(spark, name):
    df = odd(spark)
    out = {**KEEP, **GIVE}[name](df)
    rows = out.collect()
    if name in KEEP:
        assert out.columns == df.columns and len(rows) > 0
    assert ({**KEEP, **GIVE}[name](df.limit(0)).count()) == 0
    if name in ("quality", "langid", "copies", "lm"):
        assert len(rows) == df.count()
    if name in ("groups", "fingerprints"):
        assert Counter(r.doc_id for r in rows if r.doc_id is not None) == Counter(range(len(TEXTS)))


def test_keep_one_keeps_what_it_says(spark):
    kept = dedup.keep_one(odd(spark)).collect()
    ids = Counter(r.doc_id for r in kept)
    assert ids == Counter([0, 1, 2, 3, 5, 7, 8, 9, None])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (100, 101)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 160)}}
    assert components.components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(3)
    edges = [tuple(int(x) for x in e) for e in rng.integers(0, 300, (170, 2))]
    of = {x: x for e in edges for x in e}
    for _ in of:
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    want = {x: c for x, c in of.items() if any(a != b and x in (a, b) for a, b in edges)}
    assert {r.node: r.component for r in components.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()} == want


def url_rows(spark, urls):
    return spark.createDataFrame([(i if i % 7 else None, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, part string, action string")


def test_urls_in_many_parts_match_brute_force(spark):
    rng = np.random.default_rng(2)
    hosts = [".".join(rng.choice(["a", "b", "cc", "example"], int(k))) + ".org" for k in rng.integers(1, 4, 12)]
    urls = [f"http://{h}/{'/'.join(rng.choice(['x', 'y', 'zz'], int(k)))}" for h, k in zip(rng.choice(hosts, 400), rng.integers(0, 4, 400))]
    urls += urls[:30] + [None, "", "http://"]
    rules = [(i + 1, h + p, f"act{i}") for i, (h, p) in enumerate(zip(rng.choice(hosts, 40), rng.choice(["", "/x", "/x/y", "/zz"], 40)))] + [(90, None, "no"), (91, "", "no"), (None, hosts[0], "no")]

    def key(u):
        bare = u.split("://", 1)[-1]
        host, _, rest = bare.partition("/")
        return ".".join(reversed(host.lower().split("."))) + "." + ("/" + rest if "/" in bare else "")

    good = sorted(((key(p), i, a) for i, p, a in rules if i and p), key=lambda r: (len(r[0]), r[1]))
    want = Counter()
    for i, u in enumerate(urls):
        hit = [r for r in good if u and u != "http://" and key(u).startswith(r[0])]
        want[i if i % 7 else None, u, *((hit[-1][1], hit[-1][2]) if hit else (0, "allow" if u and u != "http://" else "invalid")), len(hit)] += 1
    table = spark.createDataFrame(rules, "rule_id long, pattern string, action string")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        got = Counter((r.page_id, r.url, r.rule_id, r.action, r.n_rules) for r in url_filter.match(url_rows(spark, urls), table).collect())
        assert url_filter.match(url_rows(spark, []), table).count() == 0
        assert {r.action for r in url_filter.match(url_rows(spark, ["http://a.org"]), table.limit(0)).collect()} == {"allow"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == want


def test_sweep_across_batches_matches_one_batch(spark):
    rows = [("a.", 1, None), ("a.b.", None, 5), ("a.b.", 2, None), ("a.b./x", None, 6), ("a.c.", None, 7), ("d.", None, 8)]
    import pyarrow as pa

    batch = pa.table({"part": [0] * 6, "key": [r[0] for r in rows], "page_id": pa.array([r[2] for r in rows], pa.int64()), "url": [r[0] for r in rows], "rule_id": pa.array([r[1] for r in rows], pa.int64()), "action": ["A" if r[1] else None for r in rows]}).to_batches()[0]
    whole = [x for b in url_filter._sweep(iter([batch])) for x in b.to_pylist()]
    split = [x for b in url_filter._sweep(iter([batch.slice(i, 1) for i in range(6)])) for x in b.to_pylist()]
    assert whole == split and [(r["page_id"], r["rule_id"], r["n_rules"]) for r in whole] == [(5, 1, 1), (6, 2, 2), (7, 1, 1), (8, 0, 0)]


def test_mixing_matches_pivot_in_one_cell(spark):
    df = spark.createDataFrame([(i, ["a", "b", None][i % 3], 10 + i % 5) for i in range(200)] + [(7, "b", 12)] * 3 + [(None, "a", 11)] * 50, "doc_id long, source string, n_chars long")
    rows = mixing.copies(df, {"a": 2, "b": 1, None: 1}, budget=300.0, size="n_chars").collect()
    assert len(rows) == df.count() == 253
    per = Counter()
    for r in df.collect():
        per[r.source] += r.n_chars
    rate = {s: w / 4 * 300 / per[s] for s, w in (("a", 2), ("b", 1), (None, 1))}
    totals, numbers = Counter(), Counter()
    for r in rows:
        assert abs(r.expected - rate[r.source]) < 1e-9 and np.floor(r.expected) <= r.copies <= np.ceil(r.expected)
        totals[r.source] += r.copies
        numbers[r.source] += 1
    for s, n in numbers.items():
        assert np.floor(n * rate[s]) <= totals[s] <= np.ceil(n * rate[s])
    want = sum(n * rate[s] for s, n in numbers.items())
    assert np.floor(want) <= sum(totals.values()) <= np.ceil(want)
    again = {(r.doc_id, r.source, r._r): r.copies for r in mixing.copies(df.repartition(7), {"a": 2, "b": 1, None: 1}, budget=300.0, size="n_chars").collect()}
    assert Counter(again.values()) == Counter(r.copies for r in rows)


def test_mixing_in_many_cells_keeps_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 10)
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 600, "hot").otherwise("rare").alias("source"))
    rows = mixing.copies(df, {"hot": 0.5, "rare": 0.5}, budget=301.0).collect()
    totals = Counter()
    for r in rows:
        totals[r.source] += r.copies
    assert sum(totals.values()) == 301 and set(totals.values()) == {150, 151}


def test_mix_repeats_rows_as_copies_says(spark):
    df = spark.createDataFrame([(i, f"t{i % 3}", "s") for i in range(30)] + [(1, "t1", "s")] * 4 + [(None, "u", "s")] * 3 + [(None, "v", None)], "doc_id long, text string, source string")
    rows = mixing.mix(df, budget=80.0).collect()
    assert len(rows) == 80 and {tuple(r) for r in rows} <= {tuple(r) for r in df.collect()}
    assert mixing.mix(df, {"s": 1.0}, budget=50.0).filter("source is null").count() == 0


def best_fit(lengths, capacity):
    """Number of bins of best-fit decreasing, one piece at a time."""
    free = []
    for n in sorted(lengths, reverse=True):
        fit = [f for f in free if f >= n]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - n)
        else:
            free.append(capacity - n)
    return len(free)


def test_packing_places_every_piece_once_and_about_as_well_as_best_fit(spark):
    rng = np.random.default_rng(9)
    sizes = [int(x) for x in rng.integers(0, 9000, 300)] + [0, 1, 4, 8192, 8193, 40_000]
    df = spark.createDataFrame([(i if i % 9 else None, "x" * n, "c", "d") for i, n in enumerate(sizes)] + [(5, "x" * 100, "c", "d")] * 3 + [(6, None, "c", "d")], "doc_id long, text string, slot string, bin string")
    rows = packing.pack(df).collect()
    tokens = [-(-n // 4) for n in [*sizes, 100, 100, 100]]
    assert sum(r.n_tokens for r in rows) == sum(tokens) and len(rows) == sum(-(-t // packing.CAPACITY) for t in tokens)
    packs = {}
    for r in rows:
        assert 0 < r.n_tokens <= packing.CAPACITY and r.start == r.piece * packing.CAPACITY
        packs.setdefault(r.pack_id, []).append((r.offset, r.n_tokens, r.slot))
    for own in packs.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= packing.CAPACITY
    pieces = [r.n_tokens for r in rows]
    width = packing.CAPACITY // packing.BINS
    rounded = best_fit([-(-n // width) * width for n in pieces], packing.CAPACITY)
    assert best_fit(pieces, packing.CAPACITY) <= len(packs) <= 1.1 * rounded


def test_nnls_matches_projected_gradient():
    rng = np.random.default_rng(4)
    a, b = rng.random((20, 8)), rng.random(20)
    x = np.zeros(8)
    for _ in range(20_000):
        x = np.maximum(0, x - a.T @ (a @ x - b) / np.linalg.norm(a.T @ a, 2))
    assert np.allclose(packing.nnls(a, b), x, atol=1e-6) and (packing.nnls(a, -b) == 0).all()


def test_langid_without_choice(spark):
    one = spark.createDataFrame([(i, "the of and to in is that", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r.language for r in langid.identify(one, langid.train(one)).collect()} == {"en"}
    none = one.withColumn("lang", F.lit(None).cast("string"))
    assert {r.language for r in langid.identify(none, langid.train(none)).collect()} == {"und"}
    tie = spark.createDataFrame([(i, "same words here", "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    model = langid.train(tie)
    assert len({r.language for r in langid.identify(tie, model).collect()}) == 1


def test_fingerprints_are_the_smallest_hashes(spark):
    from sievelane.llm.textkit import distinct_shingles
    import pyarrow as pa

    got = {r.doc_id: r.sketch for r in fingerprint.sketch(odd(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    for i, t in enumerate(TEXTS):
        values = distinct_shingles(pa.array([t], pa.string()), fingerprint.NGRAM)[0]
        assert got[i] == sorted(int(v) - 2**63 for v in values)[: fingerprint.K]


def test_merge_of_parts_is_the_sketch_of_the_whole(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "MERGE_KEYS", 3)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50))) for i in range(12)]).alias("text"), (F.col("id") % 11).alias("part"))
    each = df.join(fingerprint.sketch(df, k=20), "doc_id")
    whole = {}
    for r in each.collect():
        whole.setdefault(str(r.part), set()).update(r.sketch)
    merged = {r.key: r.sketch for r in fingerprint.merge(each.select("part", "sketch"), "part", 20).collect()}
    assert merged == {k: sorted(v)[:20] for k, v in whole.items()}
    nulls = fingerprint.merge(each.select(F.lit(None).cast("string").alias("part"), "sketch"), "part", 20).collect()
    assert len(nulls) == 1 and nulls[0].key is None


def test_pipeline_stages(spark, tmp_path):
    base = "the cat sat on the mat and it was not in the sea of the dog and he is that to be as with a"
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(1)
    texts = [f"{base} " + " ".join(rng.choice(words, 60)) + " and the end of it is in the text that we have" for _ in range(40)]
    texts += [texts[0], texts[1] + " more", "$$$ %%% ###", texts[2].replace("the end", 'password = "aB3dE9xQ7zRtY2mN5kLpW8"')]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    seen, docs = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == df.columns
    ids = lambda name: {r.doc_id for r in seen[name]}
    good = {r.doc_id for r in quality.score(df).collect() if r.keep}
    assert ids("quality_rules") == good and 42 not in good and {0, 1, 2, 40, 41, 43} <= good
    grams = {i: {tuple(texts[i].split()[k : k + 3]) for k in range(len(texts[i].split()) - 2)} for i in good}
    near = {(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) >= ngram_join.THRESHOLD * len(grams[a] | grams[b])}
    of = {i: i for i in good}
    for _ in good:
        for a, b in near:
            of[a] = of[b] = min(of[a], of[b])
    assert {40: 0, 41: 1, 43: 2}.items() <= of.items() and ids("near_duplicates") == {i for i in good if of[i] == i}
    assert ids("secrets") == ids("near_duplicates") and not any("aB3dE9xQ7zRtY2mN5kLpW8" in r.text for r in seen["secrets"])
    assert ids("source_mix") <= ids("secrets") and {r.text for r in seen["source_mix"]} <= {r.text for r in seen["secrets"]}
    assert sum(r.n_tokens for r in seen["best_fit_packing"]) == sum(-(-len(r.text) // 4) for r in seen["source_mix"])
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.n_tokens) for r in run) == Counter((r.doc_id, r.piece, r.n_tokens) for r in seen["best_fit_packing"])
