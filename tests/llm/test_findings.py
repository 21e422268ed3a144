"""Whole jobs where an operator once did less; each against brute force."""

import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sievelane.llm import fingerprint, lm_score, ngram_join, packing, pairing, pii, secret_scan
from sievelane.llm.queries import VOCABULARY


def similar(rows):
    """{(doc_a, doc_b): jaccard} of all pairs of rows of different documents, the highest each."""
    out = {}
    for a, s in rows:
        for b, t in rows:
            w, v = s.split(), t.split()
            s3, t3 = ({tuple(x[i : i + 3]) for i in range(len(x) - 2)} for x in (w, v))
            j = len(s3 & t3) / len(s3 | t3)
            if a < b and j >= ngram_join.THRESHOLD:
                out[a, b] = max(out.get((a, b), 0.0), round(j, 6))
    return out


X, Y = (" ".join(f"{c}{i}" for i in range(20)) for c in "xy")


def test_join_of_a_document_with_two_texts(spark):
    rows = [(1, X), (5, X), (5, Y), (7, Y), (9, Y + " end"), (8, X + " end"), (3, "alone in the world")]
    got = {(r.doc_a, r.doc_b): r.jaccard for r in ngram_join.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = similar(rows)
    assert {(1, 5), (5, 7), (5, 9), (1, 8)} == set(got) and all(want[p] == j for p, j in got.items())


def test_join_gives_every_pair(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", 2)
    rows = [(1, X), (5, X), (5, Y), (7, Y), (9, Y + " end"), (8, X + " end"), (4, X + " end"), (5, X + " other end"), *((i, X) for i in range(20, 26))]
    got = {(r.doc_a, r.doc_b): r.jaccard for r in ngram_join.all_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == similar(rows)


def estimates(x, y, k):
    """Resemblance and both containments from two ascending sketches."""
    a, b = set(x), set(y)
    if not a or not b:
        return 0.0, 0.0, 0.0
    low = sorted(a | b)[:k]
    top = min(s[-1] if len(s) >= k else 2**63 - 1 for s in (x, y))
    part = lambda s, t: len([v for v in s if v <= top and v in t]) / max(1, len([v for v in s if v <= top]))
    return len([v for v in low if v in a and v in b]) / len(low), part(x, b), part(y, a)


def test_fingerprint_pairs_match_brute_force(spark):
    k, rng = 16, np.random.default_rng(4)
    line = "this line of licence text is found in very many documents of the corpus and says little"
    texts = []
    for i in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(3, 90)))]
        texts += [" ".join(words), " ".join(words), " ".join(words[: len(words) // 2]), " ".join(words) + " and more", " ".join([line] * (i % 3) + words)]
    rows = [(i, t) for i, t in enumerate([*texts, line, line, "", "..."])] + [(0, "another part of the first document"), (None, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = {}
    for r in fingerprint.sketch(df, k=k).collect():
        if r.doc_id is not None:
            parts.setdefault(r.doc_id, set()).update(r.sketch)
    sketches = {d: sorted(v)[:k] for d, v in parts.items()}
    merged = {int(r.key): r.sketch for r in fingerprint.merge(fingerprint.sketch(df, k=k).filter("doc_id is not null"), "doc_id", k).collect()}
    assert merged == sketches
    want = {(a, b): e for a in sketches for b in sketches if a < b and max(e := estimates(sketches[a], sketches[b], k)) >= fingerprint.LEAST}
    got = [((r.query, r.doc_id), (r.resemblance, r.containment, r.contained)) for r in fingerprint.search(df, F.lit(True), k=k).collect()]
    turned = {(b, a): (r, ba, ab) for (a, b), (r, ab, ba) in want.items()}
    assert len(got) == len(dict(got)) and dict(got).keys() == want.keys() | turned.keys() and all(np.allclose((want | turned)[p], e) for p, e in got)
    some = {(r.query, r.doc_id) for r in fingerprint.search(df, F.expr("doc_id % 5 = 0"), k=k).collect()}
    assert some == {p for p in want | turned if p[0] % 5 == 0}
    links, best, held = dict.fromkeys(sketches, 0), {}, {}
    for (a, b), (r, ab, _) in (want | turned).items():
        if r >= fingerprint.LEAST:
            links[a], best[a], held[a] = links[a] + 1, max(best.get(a, 0), r), max(held.get(a, 0), ab)
    for queries, asked in ((F.lit(True), set(sketches)), (F.expr("doc_id % 5 = 0"), {d for d in sketches if d % 5 == 0})):
        rows_out = fingerprint.overlaps(df, queries, k=k).collect()
        assert len(rows_out) == len({d for d, _ in rows}) and {r.doc_id: r.sketch for r in rows_out if r.doc_id is not None} == sketches
        same = {d: sorted(e for e in sketches if e == d or sketches[e] and sketches[e] == sketches[d]) for d in sketches}
        assert {r.doc_id: (r.class_id, r.copies) for r in rows_out if r.doc_id is not None} == {d: (e[0], len(e)) for d, e in same.items()}
        assert {r.doc_id: r.links for r in rows_out if r.links is not None} == {d: links[d] for d in asked}
        assert all(np.allclose((r.best, r.contained), (best[r.doc_id], held[r.doc_id])) for r in rows_out if r.links)
    a, b = sketches[0], sketches[3]
    cols = [F.array(*map(F.lit, x)) for x in (a, b)]
    one = spark.range(1).select(fingerprint.resemblance(*cols, k), fingerprint.containment(*cols, k), fingerprint.containment(*cols[::-1], k)).first()
    assert np.allclose(tuple(one), estimates(a, b, k))


def test_lm_trains_on_every_window_once():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 300, int(m)).astype(np.uint32) for m in rng.integers(0, 400, 60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array([t.astype("<u2").tobytes() for t in texts], pa.binary())], names=["doc_id", "ids"])
    voc = lm_score.Vocabulary(np.bincount(np.concatenate(texts), minlength=300))
    shared = SimpleNamespace(value=(lm_score.initial(voc), voc))
    seen = [t for turn in range(lm_score.ROUNDS) for out in lm_score._train(shared, turn, lm_score.ROUNDS)(iter([batch])) for t in out.column("tokens").to_pylist()]
    assert sum(seen) == sum(map(len, texts))


def test_pii_short_addresses_and_keyed_values(spark):
    texts = ["use 8.8.8.8 first", "from 10.0.0.1 to 10.1.2.34.", "ip=192.168.100.20;", "ssn=123-45-6789", "http://10.9.8.7/index", "room 5 1.2.3.4", "version 1.2.3.4.5"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.kind, texts[r.doc_id][r.start : r.start + r.length]) for r in pii.extract(docs).collect()}
    assert got == {(0, "ip", "8.8.8.8"), (1, "ip", "10.0.0.1"), (1, "ip", "10.1.2.34"), (2, "ip", "192.168.100.20"), (3, "ssn", "123-45-6789"), (4, "ip", "10.9.8.7"), (5, "ip", "1.2.3.4")}


def test_packing_fits_small_tables_by_least_squares():
    histogram = np.zeros(64, np.int64)
    histogram[[27, 17]] = 2, 4
    assert packing.plan(histogram) == [((18, 18, 28), 2)]


def grouped(rows):
    """{doc: (smallest document of its group, links, best)} by brute force."""
    sets = {(d, tuple(sorted({tuple(t.split()[i : i + 3]) for i in range(max(1, len(t.split()) - 2))}))) for d, t in rows if t}
    of, links, best = {d: d for d, _ in rows}, dict.fromkeys((d for d, _ in rows), 0), {}
    pairs = [(a, b, len(set(s) & set(t)) / len(set(s) | set(t))) for a, s in sets for b, t in sets if (a, s) != (b, t)]
    for a, b, j in pairs:
        if j >= ngram_join.THRESHOLD:
            links[a] += 1
            best[a] = max(best.get(a, 0), round(j, 6))
    for _ in rows:
        for a, b, j in pairs:
            if j >= ngram_join.THRESHOLD:
                of[a] = of[b] = min(of[a], of[b])
    return {d: (of[d], links[d], best.get(d)) for d in of}


def test_join_groups_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pairing, "BLOCK_WEIGHT", 100)
    rng = np.random.default_rng(5)
    rows = [(1, X), (5, X), (5, Y), (7, Y), (9, Y + " end"), (8, X + " end"), (4, X + " end"), (5, X + " other end"), (5, X), (30, ""), (31, None), *((i, X) for i in range(20, 26))]
    for i in range(40):
        w = [f"v{x}" for x in rng.integers(0, 400, 30)]
        rows += [(100 + 10 * i + k, " ".join(w[k:] + [f"t{i}{k}{x}" for x in range(k * (k % 3))])) for k in range(6)]
    got = {r.doc_id: (r.class_id, r.links, r.best) for r in ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == grouped(rows)


def test_connected_groups_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pairing, "BLOCK_SETS", 3)
    rng = np.random.default_rng(7)
    rows = [(1, X), (5, X), (5, Y), (7, Y), (9, Y + " end"), (8, X + " end"), (30, ""), (31, None), *((i, X) for i in range(20, 23))]
    for i in range(30):
        w = [f"v{x}" for x in rng.integers(0, 400, 40)]
        rows += [(100 + 40 * i + k, " ".join(w[k:] + [f"t{i}{k}{x}" for x in range(k)])) for k in range(12 + 20 * (i == 0))]
    want = {d: of for d, (of, _, _) in grouped(rows).items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "NEAR", 1)
    monkeypatch.setattr(pairing, "KNOWN", 20)
    got = {r.doc_id: r.class_id for r in ngram_join.connected(docs).collect()}
    assert got == {d: want[d] for d in got} and {d for d, x in want.items() if x != d} <= set(got)


def test_known_groups_take_few_steps_and_lose_no_pair():
    k, r = 400, 5
    names = np.arange(1, k + 1, dtype=np.uint64)
    packer = pairing.Packer(1)
    rows = [*packer.add(names, np.full(k, 30), np.repeat(np.arange(k), r), np.tile(np.arange(r, dtype=np.uint64), k), np.zeros(k * r, np.uint32)), *packer.flush()]
    looked = []

    def reach(n, m):
        looked.append(len(n))
        return np.ones(len(n), bool)

    got = set()
    known = SimpleNamespace(value=(names[:-2], (np.arange(k - 2) >= 390).astype(np.uint32)))  # groups of 390 and 8, two sets of none
    for pairs in pairing._match(reach, lambda n, *p: np.ones(len(n), bool), 1, False, None, known)(iter(rows)):
        for x in pairing._distinct(lambda met, n, m: met > 0)(iter([pairs])):
            got |= set(zip(np.asarray(x.column("a")).tolist(), np.asarray(x.column("b")).tolist()))
    of = [0] * 390 + [1] * 8 + [2, 3]
    assert got == {(a + 1, b + 1) for b in range(k) for a in range(b) if of[a] != of[b]}
    assert sum(looked) < 15 * k * r


def test_blocks_have_a_bounded_number_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairing, "BLOCK_SETS", 8)
    pairs = spark.createDataFrame([(a, b, 9, 9) for b in range(80) for a in range(b)], "a long, b long, w_a long, w_b long")
    cells = pairing.blocks(pairs).groupBy("key").count().collect()
    assert sum(r["count"] for r in cells) == 80 * 79 // 2 and max(r["count"] for r in cells) <= 4 * 8**2


def test_frequent_hashes_are_spread_without_loss(monkeypatch):
    monkeypatch.setattr(pairing, "HOT", 4)
    rng = np.random.default_rng(6)
    names, sizes = rng.integers(1, 2**63, 60).astype(np.uint64), np.full(60, 3)
    h = np.sort(rng.integers(0, 9, (60, 3)), 1).astype(np.uint64)
    counts = np.zeros(1024, np.uint32)
    counts[:9] = np.bincount(h.ravel().astype(int), minlength=9) + 40
    packer = pairing.Packer(5, pairing.grid_of(counts))
    rows = [*packer.add(names, sizes, np.repeat(np.arange(60), 3), h.ravel(), np.tile(np.arange(3), 60).astype(np.uint32)), *packer.flush()]
    always = lambda n, m, *p: np.ones(len(n), bool)
    got = set()
    for part in range(5):
        own = [pa.RecordBatch.from_arrays([c.filter(pa.array(np.asarray(b.column("part")) == part)) for c in b.columns], names=b.schema.names) for b in rows]
        for pairs in pairing._match(always, always, 1, False)(iter(own)):
            for x in pairing._distinct(lambda met, n, m: met > 0)(iter([pairs])):
                got |= set(zip(np.asarray(x.column("a")).tolist(), np.asarray(x.column("b")).tolist()))
    assert (pairing.grid_of(counts)[:9] > 1).all()
    key = [set(x.tolist()) for x in h]
    assert got == {tuple(sorted((int(names[i]), int(names[j])))) for i in range(60) for j in range(i) if key[i] & key[j]}


def test_pii_is_linear():
    def timed(text):
        began = time.perf_counter()
        out = [(v, k) for _, v, k, _ in pii.candidates(text)]
        assert time.perf_counter() - began < 1.5
        return out

    assert timed(" ".join(["555-555-0199"] * 5000)) == [("555-555-0199", "phone")] * 5000
    assert timed(" ".join(["190.137.223.204"] * 5000)) == [("190.137.223.204", "ip")] * 5000
    assert {k for _, k in timed(" ".join(str(i) for i in range(50_000)))} <= {"card", None}  # what passes a checksum by chance
    assert timed("a" * 200_000) == [] and timed("a." * 100_000) == [] and timed("a@" + "a-" * 100_000)[0][1] is None
    assert timed("x 4111 1111 1111 1111 4111 1111 1111 1111 y") == [("4111 1111 1111 1111", "card")] * 2
    assert timed("write to ..me@example.org.")[0] == ("me@example.org", "email")


def graph(edges, seeds, rounds=pii.ROUNDS):
    """Scores of values by the docstring's rule, one dict at a time."""
    scored = {v: (k, 1.0) for v, k in seeds.items()}
    for _ in range(rounds):
        conf = {}
        for p in {p for _, p in edges}:
            own = {v for v, q in edges if q == p}
            for k in {scored[v][0] for v in own if v in scored}:
                c = sum(scored[v][1] for v in own if v in scored and scored[v][0] == k) / (len(own) + pii.DOUBT)
                if c >= pii.TRUST:
                    conf.setdefault(p, {})[k] = c
        scored = {v: (k, 1.0) for v, k in seeds.items()}
        for v in {v for v, _ in edges} - seeds.keys():
            by = {}
            for w, p in edges:
                if w == v:
                    for k, c in conf.get(p, {}).items():
                        by[k] = 1 - (1 - by.get(k, 0.0)) * (1 - c)
            if by and max(by.values()) >= pii.ACCEPT:
                scored[v] = max(by.items(), key=lambda x: (x[1], x[0]))
    return scored


def test_pii_graph_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = [f"{w} {''.join(map(str, rng.integers(0, 10, 16)))} {x}" for w, x in zip(rng.choice(["card", "order", "visa"], 12), rng.choice(["paid", "sent"], 12))]
    for i in range(40):
        head = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        texts.append(f"{['card', 'visa'][i % 2]} {head}{next(c for c in '0123456789' if pii.luhn(head + c))} paid")
    texts += ["mail me@example.org now", "mail you@example.org now", "mail root@localhost now"]
    found = [(v, s, p) for t in texts for _, v, s, ps in pii.candidates(t) for p in ps]
    want = graph({(v, p) for v, _, p in found}, {v: s for v, s, _ in found if s})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {texts[r.doc_id][r.start : r.start + r.length]: (r.kind, r.score) for r in pii.extract(docs).collect()}
    assert got.keys() == want.keys() and all(got[v][0] == k and abs(got[v][1] - s) < 1e-5 for v, (k, s) in want.items())
    assert any(s < 1 for _, s in want.values())


def test_secrets_of_one_kind_of_character():
    enc = secret_scan.encoder(VOCABULARY)
    secret = lambda t: [r for _, r, _, _ in secret_scan.findings(t, enc)]
    for value in ("xkqzvwpjhgtrbnmlcdfsqz", "XKQZVWPJHGTRBNMLCDFSQZ", "8391048572610394857261", "aB3dE9xQ7zRtY2mN5kLpW8"):
        assert secret(f'password = "{value}"') == [value]
    assert secret("see xkqzvwpjhgtrbnmlcdfsqz there") == ["xkqzvwpjhgtrbnmlcdfsqz"]
    for value in ("2024-01-02-03-04-05-06-07", "8391048572610394857261", "the-cat-sat-on-the-mat-in-a-hat", "MAX_NUMBER_OF_OPEN_FILES", "it-is-to-be-on-at-an-in-of-so", "123e4567-e89b-12d3-a456-426614174000", "d" * 8 + "0123456789abcdef01234567"):
        assert secret(f"see {value} there") == []
    began = time.perf_counter()
    assert secret("/" + "-".join(["word", "of", "it"] * 20) + "-a1B") == [] and secret("a-" * 50_000 + "B") == []
    secret("x" * 300_000)
    assert time.perf_counter() - began < 3


def naive_log_probs(p, voc, ids):
    """log P of each id of one text, one token at a time, by the docstring's rules."""
    out, w, s = [], lm_score.WINDOW, lm_score.STRIDE
    for t, target in enumerate(ids):
        begin = t // s * s - (w - s)
        inputs = [(u - begin, 0 if u == 0 else voc.slot[ids[u - 1]]) for u in range(max(begin, 0), t + 1)]
        h = np.array([p["emb"][slot] + p["pos"][place] for place, slot in inputs], np.float64)
        k, v = h @ p["wkv"][:, : lm_score.DIM], h @ p["wkv"][:, lm_score.DIM :]
        a = (h[-1] @ p["wq"]) @ k.T / np.sqrt(lm_score.DIM)
        a = np.exp(a - a.max())
        g = h[-1] + (a / a.sum() @ v) @ p["wo"]
        z = g + np.maximum(g @ p["w1"] + p["b1"], 0) @ p["w2"]
        own = voc.group[target]
        branch, leaf = divmod(own, lm_score.BRANCH)
        share = lambda logits, i: logits[i] - logits.max() - np.log(np.exp(logits - logits.max()).sum())
        before = voc.classes if t == 0 else voc.group[ids[t - 1]]
        among = voc.pairs[before] + lm_score.PULL * voc.within
        among = among[target] / among[voc.group == own].sum()
        out.append(share(z @ p["wtop"] + p["btop"], branch) + share(z @ p["wlow"][branch] + p["blow"][branch], leaf) + np.log(among))
    return out


def lm_case(seed=11):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(0, 300, int(m)).astype("<u2") for m in (0, 1, 35, 36, 37, 100, 7)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t.tobytes() for t in texts], pa.binary())], names=["doc_id", "ids"])
    voc = lm_score.Vocabulary(np.bincount(np.concatenate(texts), minlength=300), 50, 24)
    return texts, batch, voc, {n: m * 3 for n, m in lm_score.initial(voc).items()}


def test_lm_scores_match_a_naive_model():
    texts, batch, voc, p = lm_case()
    pairs = np.zeros((voc.classes + 1, 300), np.int64)
    for t in texts:
        for i, x in enumerate(t):
            pairs[voc.classes if i == 0 else voc.group[t[i - 1]], x] += 1
    got = next(lm_score._pairs(SimpleNamespace(value=voc))(iter([batch])))
    counted = lm_score._dense(zip(got.column("before").to_pylist(), got.column("counts").to_pylist()), 300)
    assert all((counted.get(c, np.zeros(300)) == row).all() for c, row in enumerate(pairs))
    voc.learn(pairs)
    for scale in (1, 40):  # the second has rows that vanish beside the largest value of the batch
        q = {n: (m * scale).astype(np.float32) if n in ("wq", "wtop", "wlow") else m for n, m in p.items()}
        out = next(lm_score._score(SimpleNamespace(value=(q, voc)))(iter([batch])))
        for t, total, nll in zip(texts, out.column("log_prob").to_pylist(), out.column("nll").to_pylist()):
            want = sum(naive_log_probs(q, voc, t)) if scale == 1 else None
            assert np.isfinite(total) and (scale > 1 or np.isclose(total, want, rtol=1e-4, atol=1e-4)) and (nll is None) == (len(t) == 0)
    for before in range(voc.classes + 1):  # probabilities of the ids of a class sum to one
        ids = np.arange(300)
        assert np.allclose(np.bincount(voc.group, np.exp(voc.log_within(ids, np.full(300, before)))), 1, atol=1e-4)


def test_lm_gradients_match_differences():
    rng = np.random.default_rng(12)
    _, _, voc, p = lm_case()
    p = {n: m.astype(np.float64) for n, m in p.items()}
    x, live = rng.integers(0, 50, (3, lm_score.WINDOW)), np.ones((3, lm_score.WINDOW), bool)
    live[0, :5], live[2, 40:] = False, False
    y, ask = rng.integers(0, voc.classes, (3, lm_score.STRIDE)), live[:, lm_score.WINDOW - lm_score.STRIDE :]
    _, grads = lm_score.gradients(p, x, live, y, ask)
    for n in lm_score.SHAPES:
        for at in rng.integers(0, p[n].size, 4):
            q = {m: v.copy() for m, v in p.items()}
            change = []
            for step in (1e-5, -2e-5):
                q[n].ravel()[at] += step
                change.append(lm_score.gradients(q, x, live, y, ask)[0])
            assert np.isclose(grads[n].ravel()[at], (change[0] - change[1]) / 2e-5, rtol=2e-2, atol=1e-6), n


def test_lm_rounds_do_not_depend_on_batches():
    texts, batch, voc, _ = lm_case()
    one = []
    for group in ([batch], [batch.slice(i, 1) for i in range(len(batch))]):
        turns = []
        for docs, ids, off in lm_score._texts(iter(group), voc.kind):
            _, begin, left, text = lm_score.windows(ids, off, voc.slot)
            turns += [(docs[int(i)].as_py(), int(b - off[i]), int(r)) for i, b, r in zip(text, begin, lm_score._round(ids, off, begin, left, text, 3))] if len(text) else []
        one.append(sorted(turns))
    assert one[0] == one[1]


def test_lm_scores_of_very_unlikely_ids():
    """A class far below the largest one has its own probability, not a least one."""
    texts, batch, voc, p = lm_case()
    pairs = np.zeros((voc.classes + 1, 300), np.int64)
    voc.learn(pairs)
    q = {n: (m * 400).astype(np.float32) if n in ("wtop", "wlow") else m for n, m in p.items()}
    naive = [naive_log_probs(q, voc, t) for t in texts]
    assert min(map(min, filter(None, naive))) < -160
    out = next(lm_score._score(SimpleNamespace(value=(q, voc)))(iter([batch])))
    assert np.allclose(out.column("log_prob").to_pylist(), [sum(t) for t in naive], rtol=1e-4, atol=1e-3)


def test_lm_gradients_of_blocks_add_up():
    rng = np.random.default_rng(13)
    _, _, voc, p = lm_case()
    x, live = rng.integers(0, 5, (7, lm_score.WINDOW)), np.ones((7, lm_score.WINDOW), bool)  # few slots: rows repeat
    live[1, :12], live[4, 20:] = False, False
    y, ask = rng.integers(0, voc.classes, (7, lm_score.STRIDE)), live[:, lm_score.WINDOW - lm_score.STRIDE :]
    loss, want = lm_score.gradients(p, x, live, y, ask)
    got = {n: np.zeros_like(m) for n, m in p.items()}
    parts = [lm_score.add_gradients(p, x[i : i + 3], live[i : i + 3], y[i : i + 3], ask[i : i + 3], int(ask.sum()), got) for i in range(0, 7, 3)]
    assert np.isclose(sum(parts), loss, rtol=1e-5) and all(np.allclose(got[n], want[n], rtol=1e-3, atol=1e-6) for n in p)
