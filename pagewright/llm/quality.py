"""Quality classifier from positive and unlabelled texts.

A small network scores style features of the whole text.  It is trained by the
non-negative unbiased risk (Kiryo et al., 2017): with class prior ``p``,

    p * R_pos(+) + max(0, R_unl(-) - p * R_pos(-)),

where R_pos(+) and R_pos(-) are the mean losses of the trusted positives taken
as positive and as negative, and R_unl(-) the mean loss of unlabelled texts
taken as negative.  When the second term falls under zero the step goes the
other way, so that it can't be won by overfitting.  The prior is estimated as
the share of trusted positives among the labelled training rows; negatives are
not used otherwise.

Trusted positives and unlabelled texts are bounded samples (``TRAIN_ROWS`` of
each, chosen by a hash of doc_id): the features are made by Spark, the few
numbers per sampled row are fitted on the driver.  Scoring covers every text.

Defined cases: null texts count as empty; empty texts get the score that the
features of an empty text have; without positives or unlabelled rows every
score is the prior; repeated labels of a document count once (the lowest);
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

TRAIN_ROWS = 6000   # trusted positives, and as many unlabelled texts, at most
HIDDEN = 24
STEPS = 1500
RATE = 0.01
DECAY = 1e-4
KEEP_SCORE = 0.3

#: Byte classes that features count one by one.
_SYMBOLS = b"#*$%&|<>!?.,;:@/=_-+~^{}[]()\"'\\`"
_CLASSES = len(_SYMBOLS) + 7
_CLASS = np.full(256, len(_SYMBOLS), np.int64)           # other bytes
_CLASS[list(_SYMBOLS)] = np.arange(len(_SYMBOLS))
_CLASS[[9, 11, 12, 13, 32]] = len(_SYMBOLS) + 1           # blanks
_CLASS[10] = len(_SYMBOLS) + 2                            # line feeds
_CLASS[48:58] = len(_SYMBOLS) + 3                         # digits
_CLASS[65:91] = len(_SYMBOLS) + 4                         # capitals
_CLASS[97:123] = len(_SYMBOLS) + 5                        # small letters
_CLASS[128:] = len(_SYMBOLS) + 6                          # letters of more bytes
_NOISE = np.zeros(256, bool)
_NOISE[list(b"#*$%&|<>!@=_~^{}[]\\`")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\"')")] = True


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _repeats(keys: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """How many entries of each text equal an earlier entry of the text."""
    with np.errstate(over="ignore"):
        own = W.mix(keys + W.mix(of.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(own, return_index=True)
    return np.bincount(of, minlength=n) - np.bincount(of[first], minlength=n)


def features_of(w: W.Words) -> np.ndarray:
    """Style features of the texts of a slice, one row each."""
    n = w.n_texts
    size = np.diff(w.text_at)
    of_byte = np.repeat(np.arange(n), size)
    chars = np.bincount(of_byte * _CLASSES + _CLASS[w.data], minlength=n * _CLASSES).reshape(n, _CLASSES)
    per_text = np.diff(w.bounds)
    of = np.repeat(np.arange(n), per_text)
    lengths = w.ends - w.starts
    total = lambda x: np.bincount(of, x, n)
    small = np.concatenate([[0], np.cumsum((w.data >= 97) & (w.data <= 122))])
    large = np.concatenate([[0], np.cumsum((w.data >= 65) & (w.data <= 90))])
    has_small = small[w.ends] > small[w.starts] if len(of) else np.zeros(0, bool)
    capitals = large[w.ends] - large[w.starts] if len(of) else np.zeros(0, np.int64)
    last = w.data[w.ends - 1] if len(of) else np.zeros(0, np.uint8)
    first = w.data[w.starts] if len(of) else np.zeros(0, np.uint8)
    three = W.window_hashes(w.hashes, 3)
    inside = of[:len(three)] == of[2:2 + len(three)] if len(three) else np.zeros(0, bool)
    twin = (w.hashes[1:] == w.hashes[:-1]) & (of[1:] == of[:-1]) if len(of) > 1 else np.zeros(0, bool)
    # lines: bounds of the texts and line feeds
    feed = np.flatnonzero(w.data == 10)
    edge = np.sort(np.concatenate([w.text_at[:-1], feed + 1]))
    stop = np.sort(np.concatenate([w.text_at[1:], feed]))
    line_of = np.minimum(np.searchsorted(w.text_at, edge, "right") - 1, n - 1)
    tail = np.where(stop > edge, w.data[np.maximum(stop - 1, 0)] if len(w.data) else 0, 0)
    words_in = np.searchsorted(w.starts, stop) - np.searchsorted(w.starts, edge)
    full = words_in > 0
    lines = np.bincount(line_of[full], minlength=n)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(w.hashes) if len(of) else np.zeros(0, np.uint64), dtype=np.uint64)])
    with np.errstate(over="ignore"):
        line_key = prefix[np.searchsorted(w.starts, stop)] - prefix[np.searchsorted(w.starts, edge)]
    columns = [
        *_share(chars, size[:, None]).T,
        np.log1p(size) / 10, np.log1p(per_text) / 10, _share(total(lengths), per_text) / 10, np.sqrt(np.maximum(0, _share(total(lengths**2.0), per_text) - _share(total(lengths), per_text) ** 2)) / 10,
        _share(total(~has_small & (capitals > 1)), per_text), _share(total(_NOISE[last]), per_text), _share(total((lengths == 1) & _NOISE[first]), per_text),
        _share(total((first >= 65) & (first <= 90)), per_text), _share(total(_STOP[last]), per_text),
        _share(_repeats(w.hashes, of, n), per_text), _share(_repeats(three[inside], of[:len(three)][inside], n), per_text),
        _share(np.bincount(of[1:][twin], minlength=n) if len(of) > 1 else np.zeros(n), per_text),
        np.log1p(lines) / 5, _share(per_text, lines) / 50, _share(_repeats(line_key[full], line_of[full], n), lines),
        _share(np.bincount(line_of[full & _STOP[tail]], minlength=n), lines), _share(np.bincount(line_of[full & (words_in < 4)], minlength=n), lines),
        (per_text == 0).astype(float), (per_text < 5).astype(float), (per_text < 30).astype(float),
    ]
    return np.stack(columns, 1).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.mean):
            return np.full(len(x), self.prior)
        h = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.inner + self.inner_bias)
        return 1 / (1 + np.exp(-np.clip(h @ self.outer + self.outer_bias, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 3) -> Model:
    """Adam steps on the non-negative risk with the sigmoid loss of each row."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(0), np.zeros(0), np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0, prior)
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    d = p.shape[1]
    w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    x = np.concatenate([p, u])
    is_p = np.arange(len(x)) < len(p)
    for step in range(1, STEPS + 1):
        h = np.tanh(x @ w[0] + w[1])
        z = h @ w[2] + w[3]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        plus, minus = np.logaddexp(0, -z), np.logaddexp(0, z)  # logistic losses as positive and as negative
        negative = minus[~is_p].mean() - prior * minus[is_p].mean()
        d_minus = np.where(is_p, -prior / len(p), 1 / len(u)) * s
        d_plus = np.where(is_p, prior / len(p), 0) * (s - 1)
        g = d_plus + d_minus if negative >= 0 else -d_minus
        del plus
        back = np.outer(g, w[2]) * (1 - h * h)
        grads = [x.T @ back + DECAY * w[0], back.sum(0), h.T @ g + DECAY * w[2], g.sum(keepdims=True)]
        for j, q in enumerate(grads):
            m[j] = 0.9 * m[j] + 0.1 * q
            v[j] = 0.999 * v[j] + 0.001 * q * q
            w[j] = w[j] - RATE * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w[0], w[1], w[2], float(w[3][0]), prior)


def is_held_out(doc_id="doc_id"):
    """crc32 of the decimal doc_id leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for w in W.words_of(batch.column("text"), lower=False):
                x = features_of(w)
                yield pa.RecordBatch.from_arrays([ids.slice(w.first, w.n_texts).cast(pa.int64()), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<float>")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the training rows' positives and of unlabelled documents."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    trusted = known.filter(~is_held_out())
    counts = trusted.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good")).first()
    prior = min(0.99, max(0.01, counts.good / counts.n)) if counts.n else 0.5
    order = F.xxhash64(F.col("doc_id"), F.lit(5))
    good = trusted.filter("quality = 1").orderBy(order, "doc_id").limit(TRAIN_ROWS).select("doc_id", F.lit(1).alias("kind"))
    free = (docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~is_held_out()).join(known, "doc_id", "left_anti").distinct()
            .orderBy(order, "doc_id").limit(TRAIN_ROWS).select("doc_id", F.lit(0).alias("kind")))
    chosen = good.unionByName(free)  # at most 2 * TRAIN_ROWS ids: small enough to broadcast
    rows = _features(docs.join(F.broadcast(chosen), "doc_id", "left_semi")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").select("x", "kind").collect()
    pick = lambda kind: np.array([r.x for r in rows if r.kind == kind], np.float32)
    return train(pick(1), pick(0), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document; only doc_id and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for w in W.words_of(batch.column("text"), lower=False):
                s = shared.value.scores(features_of(w))
                yield pa.RecordBatch.from_arrays([ids.slice(w.first, w.n_texts).cast(pa.int64()), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
