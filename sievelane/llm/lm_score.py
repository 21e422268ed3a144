"""Operator 8: language-model scoring with a small causal self-attention model.

The model is trained here, in numpy, on subword ids of a public tiktoken vocabulary:

1. *Ids.* One pass turns each whole text into the ids that tiktoken gives, written to the shared folder, and
   counts all ids of the corpus.
2. *Vocabulary.* The most frequent ids have input vectors of their own, the others share one. The
   output is factored, P(id | context) = P(class | context) P(id | class, class before): the most frequent
   ids are classes of their own, the rest share classes of equal mass. P(class | context) is the
   attention model's, in two softmaxes: over groups of ``BRANCH`` classes, then within the group. P(id | class, class before) comes from counts of all pairs of the corpus, drawn
   towards the frequency in the class by ``PULL`` pseudo-counts. Probabilities of all ids sum to one.
3. *Training.* Data-parallel in ``ROUNDS`` rounds: each task takes the current weights, runs Adam
   over its share of windows, and the weights are averaged in a tree, weighted by tokens. A hash of a
   window's ids and place in its document splits the windows over the rounds, so each window of each
   document is seen exactly once. Weights depend on how the table is partitioned, as in any training
   that averages replicas; what is seen doesn't.
4. *Scoring.* Windows of ``WINDOW`` inputs overlap by ``WINDOW - STRIDE``: each predicts its last
   ``STRIDE`` tokens and sees the ones before as context, so each token of each document is scored
   exactly once. Attention is batched over windows, masked for causality and padding. Softmaxes are
   shifted by their maximum where values are far from zero.

``score(docs)`` returns ``doc_id, n_tokens, log_prob`` (natural log of the whole text),
``nll`` (per token) and ``perplexity``.

Edge cases: null and empty texts have 0 tokens, log_prob 0 and null nll and perplexity; repeated
rows and rows with a null ``doc_id`` are scored each; whole texts of any length are scored; other
columns are ignored; an empty table gives an empty result; a corpus without text is scored by the
untrained model.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, flat, slices
from .secret_scan import encoder
from .textkit import mix64

DIM, HIDDEN, WINDOW, STRIDE, SLOTS, CLASSES, BRANCH, PULL = 16, 32, 48, 36, 4096, 256, 16, 50.0
ROUNDS, BATCH, RATE, SEED = 2, 64, 0.01, 7
#: Windows that numpy works on at a time (a step sums several if it has more), and bytes of text that are
#: encoded at a time.
MICRO, TEXT_BYTES = 64, 1 << 22


def encode(enc, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of texts and the offsets of its texts; a null counts as an empty text."""
    parts = [np.array(enc.encode_ordinary(t) if t else [], np.uint32) for t in col.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.cumsum([0, *map(len, parts)])


def _kind(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def _tokenize(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]):
        enc, counts = encoder(vocabulary), None
        for batch in batches:
            text, docs = flat(batch, "text"), flat(batch, "doc_id")
            for lo, hi in slices(text, TEXT_BYTES):
                ids, off = encode(enc, text.slice(lo, hi - lo))
                if counts is None:
                    counts = np.zeros(enc.n_vocab, np.int64)
                counts += np.bincount(ids, minlength=len(counts))
                kind = _kind(len(counts))
                blob = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((off * kind.itemsize).astype(np.int64)), pa.py_buffer(ids.astype(kind).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([docs.slice(lo, hi - lo).cast(pa.int64()), pc.fill_null(blob, b""), pa.nulls(hi - lo, pa.binary())], names=["doc_id", "ids", "counts"])
        if counts is not None and counts.any():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([np.stack((at, counts[at])).astype(np.int64).tobytes()], pa.binary())], names=["doc_id", "ids", "counts"])

    return run


def _unpack(batches):
    for batch in batches:
        for c in flat(batch, "counts"):
            at, n = np.frombuffer(c.as_buffer(), np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["id", "n"])


class Vocabulary:
    """Input slot, output class and log P(id | class) of each id, from counts of the corpus. ``pairs``
    has the counts of (class before, id), the last row for ids that begin a text; ``joint`` those of
    (class before, class)."""

    def __init__(self, counts: np.ndarray, slots: int = SLOTS, classes: int = CLASSES):
        v = len(counts)
        slots, classes = min(slots, v + 2), min(classes, v)
        order = np.lexsort((np.arange(v), -counts))
        self.slot = np.full(v, 1, np.uint16)  # 0 begins a text, 1 stands for rare ids
        self.slot[order[: slots - 2]] = np.arange(2, slots)
        self.group = np.zeros(v, np.int32)
        own = classes * 7 // 8
        self.group[order[:own]] = np.arange(own)
        rest, shared = order[own:], classes - own
        mass = np.cumsum(counts[rest] + 0.5)
        if len(rest):
            self.group[rest] = own + np.minimum((mass - 1e-9) / mass[-1] * shared, shared - 1).astype(np.int32)
        w = counts + 0.5
        self.within = (w / np.bincount(self.group, w, minlength=classes)[self.group]).astype(np.float32)
        self.slots, self.classes = slots, classes
        self.pairs, self.joint, self.kind = np.zeros((classes + 1, v), np.float32), np.zeros((classes + 1, classes)), _kind(v)
        self.branches = -(-classes // BRANCH)
        share = np.maximum(np.bincount(self.group, w, minlength=self.branches * BRANCH), 1e-9).reshape(-1, BRANCH)
        self.top, self.low = np.log(share.sum(1) / share.sum()).astype(np.float32), np.log(share / share.sum(1, keepdims=True)).astype(np.float32)

    def learn(self, pairs: np.ndarray) -> None:
        self.pairs = pairs.astype(np.float32)
        self.joint = np.stack([np.bincount(self.group, row, minlength=self.classes) for row in pairs])

    def light(self) -> "Vocabulary":
        """Without the counts of pairs, which training doesn't need."""
        out = copy(self)
        out.pairs = out.joint = None
        return out

    def log_within(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log P(id | class of id, class before)."""
        return np.log((self.pairs[before, ids] + PULL * self.within[ids]) / (self.joint[before, self.group[ids]] + PULL))

    def before(self, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Class of the id before each id; ``classes`` where a text begins."""
        out = np.empty(len(ids), np.int32)
        out[1:] = self.group[ids[:-1]]
        out[off[:-1][np.diff(off) > 0]] = self.classes
        return out


SHAPES = ("emb", "pos", "wq", "wkv", "wo", "w1", "b1", "w2", "wtop", "btop", "wlow", "blow")


def initial(voc: Vocabulary, seed: int = SEED) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    g = lambda scale, *s: (r.standard_normal(s) * scale).astype(np.float32)
    d = 0.3 / np.sqrt(DIM)
    return {"emb": g(0.1, voc.slots, DIM), "pos": g(0.02, WINDOW, DIM), "wq": g(d, DIM, DIM), "wkv": g(d, DIM, 2 * DIM), "wo": g(d, DIM, DIM), "w1": g(d, DIM, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": g(0.3 / np.sqrt(HIDDEN), HIDDEN, DIM), "wtop": g(d, DIM, voc.branches), "btop": voc.top.copy(), "wlow": g(d, voc.branches, DIM, BRANCH), "blow": voc.low.copy()}


_OPEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))[WINDOW - STRIDE :]
_SHUT = np.where(np.tril(np.ones((WINDOW, WINDOW), bool))[WINDOW - STRIDE :], 0, -1e9).astype(np.float32)


def steady_heap() -> None:
    """Let this worker keep freed memory up to 128 MB. The arrays of a batch are freed and made again all the
    time; without it the C library returns their pages to the system, which clears them each time."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):  # another C library
        return
    for option, size in ((-3, 1 << 28), (-1, 1 << 27), (-2, 1 << 24)):  # mmap and trim thresholds, top pad
        mallopt(option, size)


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(x) and its sums over the first axis, which a softmax is the quotient of. If a value is large or a
    sum vanishes, x is shifted by the maxima of its columns first, in place."""
    if x.max(initial=0) < 60:
        e = np.exp(x)
        total = e.sum(0)
        if total.min(initial=1) > 1e-25:
            return e, total
    x -= x.max(0)
    e = np.exp(x)
    return e, e.sum(0)


def encode_windows(p: dict[str, np.ndarray], x: np.ndarray, live: np.ndarray, exact: bool = False):
    """Vectors of the last STRIDE positions of windows x (b, WINDOW) and what the gradients need; ``live``
    marks inputs that aren't padding. Attention isn't divided by its totals, which are divided out of its
    result. It is shifted by its largest value if that is large, and by that of each row if a total vanishes.
    Keys come with positions last, as the product with queries takes them."""
    b, kind = len(x), p["emb"].dtype
    h = p["emb"].take(x.ravel(), 0).reshape(b, WINDOW, DIM)
    h += p["pos"]
    hq = np.ascontiguousarray(h[:, WINDOW - STRIDE :]).reshape(-1, DIM)
    q = (hq @ (p["wq"] / np.sqrt(DIM).astype(kind))).reshape(b, STRIDE, DIM)
    k = p["wkv"][:, :DIM].T @ h.transpose(0, 2, 1)
    v = (h.reshape(-1, DIM) @ p["wkv"][:, DIM:]).reshape(b, WINDOW, DIM)
    a = q @ k
    part = np.flatnonzero(~live.all(1))
    if exact:
        a += _SHUT + np.where(live, 0, -1e9).astype(kind)[:, None, :]
        a -= a.max(2, keepdims=True)
    elif (top := a.max(initial=0)) > 60:
        a -= top
    np.exp(a, out=a)
    a *= _OPEN
    if len(part):
        a[part] *= live[part].astype(kind)[:, None, :]
    total = a.reshape(-1, WINDOW) @ np.ones(WINDOW, kind)
    if not exact and total.min(initial=1) < 1e-25:
        return encode_windows(p, x, live, True)
    share = (1 / np.maximum(total, 1e-30))[:, None]
    o = (a @ v).reshape(-1, DIM)
    o *= share
    g = o @ p["wo"]
    g += hq
    r = g @ p["w1"]
    wide, bias = r.reshape(b, -1), np.empty((STRIDE, HIDDEN), kind)  # long rows: numpy is slow over short ones
    bias[:] = p["b1"]
    bias = bias.ravel()
    np.maximum(wide, -bias, out=wide)
    wide += bias
    z = r @ p["w2"]
    z += g
    return z, (h, hq, q, k, v, a, share, o, g, r)


def class_log_probs(p: dict[str, np.ndarray], z: np.ndarray, y: np.ndarray):
    """log P(class y) of each row of z, and what the gradients need: rows sorted by branch, the branches'
    ends, and both softmaxes before they are divided by their totals; their columns are the sorted rows."""
    branch = (y // BRANCH).astype(np.uint16)
    order = np.argsort(branch, kind="stable")
    z, branch, leaf = z.take(order, 0), branch.take(order), y.take(order) % BRANCH
    ends = [0, *np.cumsum(np.bincount(branch, minlength=len(p["wlow"]))).tolist()]
    top = p["wtop"].T @ z.T
    top += p["btop"][:, None]
    low = np.empty((len(z), BRANCH), z.dtype)
    for w, i, j in zip(p["wlow"], ends, ends[1:]):
        if i < j:
            np.dot(z[i:j], w, low[i:j])
    low += p["blow"].take(branch, 0)
    low = np.ascontiguousarray(low.T)
    at = np.arange(len(z))
    at_top, at_low = branch * np.int64(len(z)) + at, leaf * np.int64(len(z)) + at
    (e_top, all_top), (e_low, all_low) = _exp(top), _exp(low)
    got = np.empty(len(z), z.dtype)
    got[order] = top.take(at_top) - np.log(all_top) + low.take(at_low) - np.log(all_low)
    return got, (order, z, at_top, at_low, ends, e_top, e_low, all_top, all_low)


def add_gradients(p, x, live, y, ask, n: int, into: dict[str, np.ndarray]) -> float:
    """Loss over asked targets, divided by n; its gradients are added to ``into``."""
    z, (h, hq, q, k, v, a, share, o, g, r) = encode_windows(p, x, live)
    b, kind = len(x), z.dtype
    got, (order, zs, at_top, at_low, ends, top, low, all_top, all_low) = class_log_probs(p, z, y.ravel())
    weight = ask.ravel().astype(kind)
    weight /= n
    loss = -float(got @ weight)
    weight = weight.take(order)
    for d, total, at in ((top, all_top, at_top), (low, all_low, at_low)):
        d *= weight / total
        d.ravel()[at] -= weight
    ones = np.ones(len(zs), kind)
    into["wtop"] += zs.T @ top.T
    into["btop"] += top @ ones
    ds = top.T @ p["wtop"].T
    low, dl = np.ascontiguousarray(low.T), np.empty_like(ds)
    dw, db = np.zeros_like(p["wlow"]), np.zeros_like(p["blow"])
    for s, w in enumerate(np.ascontiguousarray(p["wlow"].transpose(0, 2, 1))):
        if (i := ends[s]) < (j := ends[s + 1]):
            own = low[i:j]
            np.dot(zs[i:j].T, own, dw[s])
            np.dot(ones[i:j], own, db[s])
            np.dot(own, w, dl[i:j])
    into["wlow"] += dw
    into["blow"] += db
    ds += dl
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    dz = ds.take(back, 0)
    dr = dz @ p["w2"].T
    dr *= (r > 0).view(np.int8)
    into["w2"] += r.T @ dz
    into["w1"] += g.T @ dr
    into["b1"] += ones @ dr
    dg = dr @ p["w1"].T
    dg += dz
    into["wo"] += o.T @ dg
    do = dg @ p["wo"].T
    do *= share
    back = ((do * o) @ np.ones(DIM, kind)).reshape(b, STRIDE, 1)  # sum of da * a over keys
    do = do.reshape(b, STRIDE, DIM)
    dkv = np.empty((b, WINDOW, 2 * DIM), kind)
    np.matmul(a.transpose(0, 2, 1), do, out=dkv[:, :, DIM:])
    ds = do @ np.ascontiguousarray(v.transpose(0, 2, 1))
    ds -= back
    ds *= a
    dq = (ds @ k.transpose(0, 2, 1)).reshape(-1, DIM)
    dq /= np.sqrt(DIM).astype(kind)
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :DIM])
    dkv = dkv.reshape(-1, 2 * DIM)
    into["wq"] += hq.T @ dq
    into["wkv"] += h.reshape(-1, DIM).T @ dkv
    dh = (dkv @ p["wkv"].T).reshape(b, WINDOW, DIM)
    dg += dq @ p["wq"].T
    dh[:, WINDOW - STRIDE :] += dg.reshape(b, STRIDE, DIM)
    into["pos"] += dh.sum(0)
    _add_rows(into["emb"], x.ravel(), dh.reshape(-1, DIM))
    return loss


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add rows to those of ``to`` by index. Two numbers count as one complex number: half the additions."""
    two, half = np.result_type(to, np.complex64), rows.shape[1] // 2
    places = np.arange(len(to) * half).reshape(-1, half).take(at, 0)
    np.add.at(to.reshape(-1).view(two), places.ravel(), rows.reshape(-1).view(two))


def gradients(p, x, live, y, ask) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over asked targets and its gradients."""
    into = {name: np.zeros_like(m) for name, m in p.items()}
    return add_gradients(p, x, live, y, ask, max(1, int(ask.sum())), into), into


def windows(ids: np.ndarray, off: np.ndarray, slot: np.ndarray):
    """(inputs, live, index of the first target, number of targets, text) of all windows of a
    batch of texts, as functions of chosen windows. Input t is the id before t, 0 where a text begins."""
    size = np.diff(off)
    count = -(-size // STRIDE)
    text = np.repeat(np.arange(len(size)), count)
    begin = off[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    left = np.minimum(off[text + 1] - begin, STRIDE)
    before = WINDOW - STRIDE
    padded = np.zeros(len(ids) + WINDOW + 1, slot.dtype)
    padded[before + 1 : before + 1 + len(ids)] = slot[ids]
    padded[before + off[:-1][size > 0]] = 0  # what precedes a text is no input of it
    views = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
    lead = np.where(begin == off[text], before, 0).astype(np.int8)
    ends, at = (before + left).astype(np.int8), np.arange(WINDOW, dtype=np.int8)

    def take(rows: np.ndarray):
        live = (at >= lead[rows, None]) & (at < ends[rows, None])
        return views[begin[rows]] * live, live

    return take, begin, left, text


def _texts(batches: Iterator[pa.RecordBatch], kind: np.dtype, limit: int = 1 << 18):
    """(doc ids, ids, offsets) of groups of texts that hold about ``limit`` ids."""
    for batch in batches:
        blob, docs = flat(batch, "ids"), flat(batch, "doc_id")
        for lo, hi in slices(blob, limit * kind.itemsize):
            part = blob.slice(lo, hi - lo).cast(pa.large_binary())
            o = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
            ids = np.frombuffer(part.buffers()[2], np.uint8)[o[0] : o[-1]].view(kind).astype(np.uint32) if o[-1] > o[0] else np.zeros(0, np.uint32)
            yield docs.slice(lo, hi - lo), ids, (o - o[0]) // kind.itemsize


def _round(ids: np.ndarray, off: np.ndarray, begin: np.ndarray, left: np.ndarray, text: np.ndarray, rounds: int) -> np.ndarray:
    """The round of each window, from its first and last ids and its place in its document."""
    place = (begin - off[text]).astype(np.uint64) << np.uint64(40)
    ends = ids[begin].astype(np.uint64) << np.uint64(20) ^ ids[begin + left - 1].astype(np.uint64)
    return (mix64(mix64(ends) + place) % np.uint64(rounds)).astype(np.int64)


def _views(flat_: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The weights that lie one after the other in a vector."""
    ends = np.cumsum([like[n].size for n in SHAPES])
    return {n: flat_[e - like[n].size : e].reshape(like[n].shape) for n, e in zip(SHAPES, ends.tolist())}


def _train(shared, turn: int, rounds: int):
    def run(batches):
        steady_heap()
        start, voc = shared.value
        flat_ = np.concatenate([start[n].ravel() for n in SHAPES]).astype(np.float32)
        p, grad = _views(flat_, start), np.zeros_like(flat_)
        into = _views(grad, start)
        one, two, free = (np.zeros_like(flat_) for _ in range(3))
        step, tokens, held = 0, 0, []

        def learn(x, live, y, ask):
            nonlocal step, tokens
            step += 1
            whole = int(ask.sum())
            tokens += whole
            grad[:] = 0
            for i in range(0, len(x), MICRO):
                own = slice(i, i + MICRO)
                add_gradients(p, x[own], live[own], y[own], ask[own], max(1, whole), into)
            rate = np.float32(RATE * min(1, step / 20) * np.sqrt(1 - 0.98**step) / (1 - 0.9**step))
            np.multiply(one, np.float32(0.9), out=one)
            np.multiply(two, np.float32(0.98), out=two)
            np.multiply(grad, grad, out=free)
            np.multiply(free, np.float32(0.02), out=free)
            np.add(two, free, out=two)
            np.multiply(grad, np.float32(0.1), out=grad)
            np.add(one, grad, out=one)
            np.sqrt(two, out=free)
            np.add(free, np.float32(1e-8), out=free)
            np.divide(one, free, out=free)
            np.multiply(free, rate, out=free)
            np.subtract(flat_, free, out=flat_)

        for _, ids, off in _texts(batches, voc.kind):
            take, begin, left, text = windows(ids, off, voc.slot)
            if not len(text):
                continue
            rows = np.flatnonzero(_round(ids, off, begin, left, text, rounds) == turn)
            if not len(rows):
                continue
            x, live = take(rows)
            ask = np.arange(STRIDE) < left[rows, None]
            y = voc.group[ids[np.minimum(begin[rows, None] + np.arange(STRIDE), len(ids) - 1)]]
            held.append((x, live, y, ask))
            if sum(len(h[0]) for h in held) >= BATCH:
                x, live, y, ask = (np.concatenate(c) for c in zip(*held))
                whole = len(x) // BATCH * BATCH
                for i in range(0, whole, BATCH):
                    learn(x[i : i + BATCH], live[i : i + BATCH], y[i : i + BATCH], ask[i : i + BATCH])
                held = [(x[whole:], live[whole:], y[whole:], ask[whole:])] if whole < len(x) else []
        if held:
            learn(*(np.concatenate(c) for c in zip(*held)))
        if tokens:
            yield _packed(p, float(tokens))

    return run


def _packed(p: dict[str, np.ndarray], weight: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.concatenate([p[n].ravel() for n in SHAPES]).astype(np.float32).tobytes()], pa.binary()), pa.array([weight])], names=["weights", "tokens"])


def _average(batches):
    total, weight = 0.0, 0.0
    for batch in batches:
        for w, t in zip(flat(batch, "weights"), flat(batch, "tokens").to_pylist()):
            total = total + np.frombuffer(w.as_buffer(), np.float32).astype(np.float64) * t
            weight += t
    if weight:
        yield pa.RecordBatch.from_arrays([pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary()), pa.array([weight])], names=["weights", "tokens"])


def train(tokens: DataFrame, voc: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights after ``rounds`` of parallel training and tree averaging."""
    sc = tokens.sparkSession.sparkContext
    p = initial(voc)
    for turn in range(rounds):
        shared = sc.broadcast((p, voc.light()))
        kind = "weights binary, tokens double"
        got = tokens.select("doc_id", "ids").mapInArrow(_train(shared, turn, rounds), kind)
        for width in (64, 8, 1):  # a reduction tree: no task and not the driver holds all replicas
            got = got.repartition(width).mapInArrow(_average, kind)
        best = got.collect()
        shared.unpersist()
        if best:
            p = _views(np.frombuffer(best[0].weights, np.float32).copy(), p)
    return p


def _pairs(shared):
    """Counts of (class before, id) of a task: one row for each class before."""

    def run(batches):
        voc = shared.value
        v = len(voc.group)
        total = np.zeros((voc.classes + 1) * v, np.int64)
        for _, ids, off in _texts(batches, voc.kind):
            if len(ids):
                np.add.at(total, voc.before(ids, off).astype(np.int64) * v + ids, 1)
        rows = [(c, np.flatnonzero(row), row) for c, row in enumerate(total.reshape(-1, v))]
        yield _sparse([(c, at, row[at]) for c, at, row in rows if len(at)])

    return run


def _sparse(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    packed = [at.astype("<u4").tobytes() + n.astype("<u8").tobytes() for _, at, n in rows]
    return pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in rows], pa.int32()), pa.array(packed, pa.binary())], names=["before", "counts"])


def _dense(rows, v: int) -> dict[int, np.ndarray]:
    total: dict[int, np.ndarray] = {}
    for c, raw in rows:
        k = len(raw) // 12
        total.setdefault(c, np.zeros(v, np.int64))[np.frombuffer(raw, "<u4", k)] += np.frombuffer(raw, "<u8", k, 4 * k).astype(np.int64)
    return total


def _add_pairs(v: int):
    def run(batches):
        total = _dense(((c, n) for batch in batches for c, n in zip(flat(batch, "before").to_pylist(), flat(batch, "counts").to_pylist())), v)
        yield _sparse([(c, np.flatnonzero(row), row[row > 0]) for c, row in total.items()])

    return run


def count_pairs(tokens: DataFrame, voc: Vocabulary) -> np.ndarray:
    """Counts of (class before, id) over all tokens: (classes + 1) x ids, whatever the corpus."""
    shared, v, kind = tokens.sparkSession.sparkContext.broadcast(voc.light()), len(voc.group), "before int, counts binary"
    got = tokens.select("doc_id", "ids").mapInArrow(_pairs(shared), kind)
    for lanes in (16, 1):
        got = got.repartition("before", F.expr(f"pmod(xxhash64(counts), {lanes})")).mapInArrow(_add_pairs(v), kind)
    out = np.zeros((voc.classes + 1, v), np.int64)
    for c, row in _dense(((r.before, r.counts) for r in got.collect()), v).items():
        out[c] = row
    shared.unpersist()
    return out


def _score(shared):
    def run(batches):
        steady_heap()
        p, voc = shared.value
        for docs, ids, off in _texts(batches, voc.kind):
            n = len(off) - 1
            take, begin, left, text = windows(ids, off, voc.slot)
            total = np.zeros(len(ids))
            y = voc.group[ids]
            for i in range(0, len(text), MICRO):
                rows = np.arange(i, min(i + MICRO, len(text)))
                x, live = take(rows)
                z, _ = encode_windows(p, x, live)
                lo, hi = begin[rows[0]], begin[rows[-1]] + left[rows[-1]]  # windows lie side by side
                if hi - lo < len(z):
                    z = z.take(np.flatnonzero(np.arange(STRIDE) < left[rows, None]), 0)
                total[lo:hi] = class_log_probs(p, z, y[lo:hi])[0]
            size = np.diff(off)
            if len(ids):
                total += voc.log_within(ids, voc.before(ids, off))
            log_prob = np.bincount(np.repeat(np.arange(n), size), total, minlength=n)
            nll = pa.array(-log_prob / np.maximum(size, 1), mask=size == 0)
            yield pa.RecordBatch.from_arrays([docs.cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(log_prob), nll, pc.exp(nll)], names=["doc_id", "n_tokens", "log_prob", "nll", "perplexity"])

    return run


def tokenize(docs: DataFrame, vocabulary: str) -> tuple[DataFrame, Vocabulary]:
    """The table (doc_id, ids) in the shared folder and the vocabulary made of all its counts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    both = cut(docs.mapInArrow(_tokenize(vocabulary), "doc_id long, ids binary, counts binary"))
    counts = np.zeros(encoder(vocabulary).n_vocab, np.int64)
    for r in both.filter("counts is not null").select("counts").mapInArrow(_unpack, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n  # one row for each id of the vocabulary at most
    return both.filter("counts is null").select("doc_id", "ids"), Vocabulary(counts)


def score(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> DataFrame:
    tokens, voc = tokenize(docs, vocabulary)
    weights = train(tokens, voc, rounds)
    voc.learn(count_pairs(tokens, voc))
    shared = docs.sparkSession.sparkContext.broadcast((weights, voc))
    return tokens.mapInArrow(_score(shared), "doc_id long, n_tokens long, log_prob double, nll double, perplexity double")
