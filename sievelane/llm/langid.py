"""Operator 4: hierarchical language identification.

A linear support vector machine first chooses the family, then, inside it, one-versus-one linear
support vector machines separate the related languages by votes (margins break ties). Features are the relative
frequencies of hashed byte trigrams of the lower-cased text, whose every run of characters other
than ASCII letters and non-ASCII characters counts as one space. A linear score of relative
frequencies is the mean of the weights met along the text, so whole texts are scored by looking up
one weight for each byte; no feature vector is made.

The machines are trained here, on a sample of labelled rows that is bounded by ``per_language``
for each language (the rows with the smallest hashes), by accelerated gradient descent on the
squared hinge loss. Everything else covers all rows.

``identify(docs, model)`` returns ``doc_id, family, language, margin`` (margin: the smallest
distance from a boundary on the way, larger is surer).

Edge cases: null and empty texts and texts without letters are ``und`` in both with margin 0;
texts of less than three bytes are padded with spaces; ties go to the first class in alphabetical
order; a family of one language needs no machine; with labels of one family only, no family machine
is used; languages that ``FAMILIES`` doesn't name form the family ``other``; rows without label
aren't trained on but classified; without any labelled text all rows are ``und``; repeated rows
and rows with a null ``doc_id`` are classified each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, slices
from .textkit import buffers

BUCKETS, PER_LANGUAGE, L2, STEPS, SCALE = 4096, 400, 1e-3, 400, 50.0
FAMILIES = {"de": "germanic", "en": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic"}
_MAP = np.full(256, 32, np.uint8)
for _c in (*range(97, 123), *range(128, 256)):
    _MAP[_c] = _c


def trigrams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all texts and the offsets of the texts. Each text is put between
    spaces; trigrams of three spaces and those that cross texts aren't made."""
    col = pc.utf8_lower(pc.fill_null(col, ""))
    raw, off = buffers(col)
    n = len(off) - 1
    wide = np.full(len(raw) + 2 * n, 32, np.uint8)
    owner = np.repeat(np.arange(n), np.diff(off))
    wide[np.arange(len(raw)) + 2 * owner + 1] = _MAP[raw]
    off = off + 2 * np.arange(n + 1)
    start = np.concatenate(([True], ~((wide[1:] == 32) & (wide[:-1] == 32))))
    start[off[:-1]] = True  # the runs of spaces become one, within each text
    keep = np.flatnonzero(start)
    off = np.searchsorted(keep, off)
    wide = wide[keep].astype(np.uint32)
    if len(wide) < 3:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    code = wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))
    h = (code * np.uint32(2654435761)) >> np.uint32(32 - int(np.log2(BUCKETS)))
    inside = np.ones(len(code), bool)
    for e in (1, 2):
        cross = off[1:] - e
        cross = cross[(cross >= 0) & (cross < len(code))]
        inside[cross] = False
    at = np.flatnonzero(inside)
    return h[at].astype(np.int64), np.searchsorted(at, off)


def _features(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        text, label = flat(batch, "text"), flat(batch, "label")
        for lo, hi in slices(text):
            h, off = trigrams(text.slice(lo, hi - lo))
            n = hi - lo
            owner = np.repeat(np.arange(n), np.diff(off))
            x = np.bincount(owner * BUCKETS + h, minlength=n * BUCKETS).reshape(n, BUCKETS)
            x = (x / np.maximum(x.sum(1, keepdims=True), 1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([label.slice(lo, n), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])


def svm(x: np.ndarray, y: np.ndarray, steps: int = STEPS, l2: float = L2) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss and balanced classes; y is -1 or 1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    x1 = np.hstack((x, np.ones((len(x), 1), x.dtype)))
    lip = 2 * float((weight * (x1**2).sum(1)).sum()) + l2
    x1, y, weight = x1.astype(np.float32), y.astype(np.float32), weight.astype(np.float32)
    w = v = np.zeros(x1.shape[1], np.float32)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        grad = -2 * x1.T @ (weight * y * slack) + l2 * v
        grad[-1] -= l2 * v[-1]
        new = (v - grad / lip).astype(np.float32)
        v, w = (new + k / (k + 3) * (new - w)).astype(np.float32), new
    return w[:-1], float(w[-1])


class Model:
    """``machines``: (first class, second class) of each level with a weight for each bucket and
    an offset; a positive score votes for the first."""

    def __init__(self, labels: list[str], x: np.ndarray, families: dict[str, str] | None = None):
        families = FAMILIES if families is None else families
        self.languages = sorted(set(labels))
        self.family = {c: families.get(c, "other") for c in self.languages}
        self.families = sorted(set(self.family.values()))
        y = np.array(labels)
        f = np.array([self.family[c] for c in labels])
        x = x * np.float32(SCALE)
        fit = lambda names, a, b: (a, b, *svm(x[(names == a) | (names == b)], np.where(names[(names == a) | (names == b)] == a, 1.0, -1.0)))
        self.top = [fit(f, a, b) for a, b in combinations(self.families, 2)]
        self.inner = {g: [fit(y, a, b) for a, b in combinations([c for c in self.languages if self.family[c] == g], 2)] for g in self.families}


def train(docs: DataFrame, label: str = "lang", per_language: int = PER_LANGUAGE, families: dict[str, str] | None = None) -> Model:
    """Machines from at most ``per_language`` labelled rows of each language. Which rows is
    decided on ids alone; their number bounds what is broadcast and what reaches the driver."""
    rows = docs.select(F.col(label).alias("label"), "text", F.xxhash64("doc_id", F.length("text")).alias("h")).filter("label is not null and length(text) > 0")
    chosen = rows.select("label", "h").distinct().withColumn("r", F.expr("row_number() over (partition by label order by h)")).filter(f"r <= {int(per_language)}").select("label", "h")
    chosen = chosen.withColumnsRenamed({"label": "l2", "h": "h2"})
    sample = rows.join(F.broadcast(chosen), (F.col("label") == F.col("l2")) & (F.col("h") == F.col("h2")), "left_semi").select("label", "text")
    got = sample.mapInArrow(_features, "label string, x binary").collect()
    got.sort(key=lambda r: (r.label, bytes(r.x)))
    if not got:
        return Model([], np.zeros((0, BUCKETS), np.float32), families)
    return Model([r.label for r in got], np.stack([np.frombuffer(r.x, np.float32) for r in got]), families)


def _vote(classes: list[str], machines, mean, margin: np.ndarray) -> np.ndarray:
    """Index of the class with most votes, then the largest sum of margins; lowers ``margin`` to
    the winner's closest call."""
    n = len(margin)
    if len(classes) == 1:
        return np.zeros(n, np.int64)
    votes, sums, scores = np.zeros((n, len(classes))), np.zeros((n, len(classes))), []
    for a, b, w, bias in machines:
        s = mean(w) * SCALE + bias
        i, j = classes.index(a), classes.index(b)
        votes[:, i] += s >= 0
        votes[:, j] += s < 0
        sums[:, i] += s
        sums[:, j] -= s
        scores.append((i, j, s))
    best = np.lexsort((-np.arange(len(classes))[None, :].repeat(n, 0), sums, votes), axis=1)[:, -1]
    for i, j, s in scores:
        at = (best == i) | (best == j)
        margin[at] = np.minimum(margin[at], np.abs(s[at]))
    return best


def classify(col: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, off = trigrams(col)
    n, size = len(col), np.diff(off)
    live = np.flatnonzero(size > 0)
    margin = np.full(n, np.inf)
    family, language = np.full(n, "und", object), np.full(n, "und", object)
    if len(model.languages) and len(live):

        def means(rows):
            lo, cnt = off[rows], size[rows]
            whole = len(rows) == len(live)
            at = h if whole else h[np.repeat(lo - (np.cumsum(cnt) - cnt), cnt) + np.arange(cnt.sum())]
            first = np.cumsum(cnt) - cnt
            return lambda w: np.add.reduceat(w[at], first) / cnt

        m = margin[live].copy()
        fam = _vote(model.families, model.top, means(live), m)
        margin[live] = m
        for g, name in enumerate(model.families):
            rows = live[fam == g]
            if not len(rows):
                continue
            inside = [c for c in model.languages if model.family[c] == name]
            m = margin[rows].copy()
            pick = _vote(inside, model.inner[name], means(rows), m)
            margin[rows] = m
            family[rows] = name
            language[rows] = np.array(inside, object)[pick]
    return family, language, np.where(np.isfinite(margin), margin, 0.0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (families + languages)^2 x BUCKETS weights at most

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            text, ids = flat(batch, "text"), flat(batch, "doc_id")
            for lo, hi in slices(text):
                f, c, m = classify(text.slice(lo, hi - lo), shared.value)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(f, pa.string()), pa.array(c, pa.string()), pa.array(m)], names=["doc_id", "family", "language", "margin"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, family string, language string, margin double")
