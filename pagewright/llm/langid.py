"""Language identification by a linear-chain conditional random field.

Every word of a text is labelled with a language; emissions are sums of
learned weights of the word's features (byte trigrams and four-grams with word
marks, four-byte prefixes and suffixes, the whole word), and a learned matrix
scores the transition between the labels of neighbouring words.  The labels'
marginals come from forward-backward over the whole text, so a code-switched
text is labelled word by word.  A document's language is the label with the
largest sum of marginals over its words with letters, its score that sum's
share.

Every language value of the training rows is learned.  Training takes at most
``TRAIN_PER_LANG`` documents of each (``TRAIN_ROWS`` in all, dealt evenly) and at
most ``TRAIN_WORDS`` words (documented bounds; the choice is by a hash of
doc_id), and joins runs of words of several documents into short sequences, so
that label changes are seen.  The weights (buckets x languages, at most
``WEIGHTS`` numbers: with very many languages features share buckets) are
broadcast.  Prediction covers every whole text.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
rows with a null or repeated doc_id are predicted like others; with no training
rows every text is ``und``; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W

BUCKETS = 1 << 18
TRAIN_PER_LANG = 600
TRAIN_ROWS = 38_400
WEIGHTS = 1 << 25   # buckets x languages
CELLS = 1 << 26     # numbers of the block products that are held at once
TRAIN_WORDS = 400_000
SEQUENCE = 48   # words of a training sequence
BATCH = 256     # sequences of a gradient step
EPOCHS = 3
BLOCK = 48       # words of a block of forward-backward
RATE = 0.15
KNOWN_WORDS = 300_000  # emissions that a worker keeps

_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray      # BUCKETS x languages, float32
    transitions: np.ndarray  # languages x languages, log scores
    start: np.ndarray


def buckets_for(languages: int) -> int:
    """Buckets of features, a power of two: BUCKETS, or as many as WEIGHTS allows."""
    return min(BUCKETS, max(1 << 12, 1 << ((WEIGHTS // max(languages, 1)).bit_length() - 1)))


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every feature of the given words."""
    n = len(starts)
    size = ends - starts
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop = np.cumsum(size + 2)
    step = np.arange(int(stop[-1])) - np.repeat(stop - size - 2, size + 2)
    marked = data[np.clip(np.repeat(starts - 1, size + 2) + step, 0, len(data) - 1)].astype(np.uint64)
    marked[stop - size - 2] = 2
    marked[stop - 1] = 3
    owner = np.repeat(np.arange(n), size + 2)
    found, of = [], []
    code = marked[:-2] << np.uint64(16) | marked[1:-1] << np.uint64(8) | marked[2:]
    ok = owner[:-2] == owner[2:]
    found.append(code[ok] + np.uint64(1 << 40))
    of.append(owner[:-2][ok])
    code = (code[:-1] << np.uint64(8)) | marked[3:]
    ok = owner[:-3] == owner[3:]
    found.append(code[ok] + np.uint64(2 << 40))
    of.append(owner[:-3][ok])
    padded = np.concatenate([marked, np.full(6, 3, np.uint64)])
    at = stop - size - 2
    head = sum(padded[np.minimum(at + 1 + j, stop - 1)] << np.uint64(8 * j) for j in range(4))
    tail = sum(padded[np.maximum(stop - 2 - j, at)] << np.uint64(8 * j) for j in range(4))
    found += [head + np.uint64(3 << 40), tail + np.uint64(4 << 40)]
    of += [np.arange(n), np.arange(n)]
    with np.errstate(over="ignore"):
        powers = W._powers(int(size.max()) + 2)
        whole = np.add.reduceat(marked * powers[step], at)
    found.append(whole)
    of.append(np.arange(n))
    bucket = (W.mix(np.concatenate(found)) & np.uint64(buckets - 1)).astype(np.int64)
    return bucket, np.concatenate(of)


def emissions(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    bucket, owner = features(data, starts, ends, len(model.weights))
    return np.stack([np.bincount(owner, model.weights[bucket, j], len(starts)) for j in range(len(model.langs))], 1).astype(np.float32)


def marginals(scores: np.ndarray, bounds: np.ndarray, transitions: np.ndarray, start: np.ndarray,
              pairs: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward over all sequences together: scores[bounds[i]:bounds[i + 1]]
    is a sequence.  Sequences are cut into blocks; the product of a block's
    steps is made for all blocks at once, vectors are carried from block to
    block, and then every block runs from its own vectors.  Exact.  ``pairs``
    (labels x labels) gets the expected transitions added."""
    n = scores.shape[1]
    if not len(scores):
        return np.zeros_like(scores)
    e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float32)
    move = np.exp(transitions - transitions.max()).astype(np.float32)
    first = np.exp(start - start.max()).astype(np.float32)
    size = np.diff(bounds)
    count = -(-size // BLOCK)
    of = np.repeat(np.arange(len(size)), count)
    base = np.cumsum(count) - count
    number = np.arange(len(of)) - base[of]
    begin = bounds[:-1][of] + number * BLOCK
    length = np.minimum(BLOCK, bounds[1:][of] - begin)
    order = np.argsort(-length, kind="stable")
    begin_o, length_o = begin[order], length[order]
    alive = np.searchsorted(-length_o, -np.arange(int(length_o[0])), "left")

    step = np.repeat(np.eye(n, dtype=np.float32)[None], len(order), 0)  # of each block, from its prior to its last word
    for t, k in enumerate(alive):
        now = (step[:k] if t == 0 else step[:k] @ move) * e[begin_o[:k] + t][:, None, :]
        step[:k] = now / now.max((1, 2), keepdims=True)
    product = np.empty_like(step)
    product[order] = step

    prior, last = np.empty((len(of), n), np.float32), np.empty((len(of), n), np.float32)
    by_count = np.argsort(-count, kind="stable")
    deep = np.searchsorted(-count[by_count], -np.arange(int(count.max())), "left")
    v = np.repeat(first[None], len(size), 0)
    for j, k in enumerate(deep):
        at = base[by_count[:k]] + j
        prior[at] = v[:k]
        v = (v[:k, None, :] @ product[at])[:, 0] @ move
        v /= v.sum(1, keepdims=True)
    u = np.zeros((0, n), np.float32)
    for j in range(len(deep) - 1, -1, -1):
        k = deep[j]
        u = np.concatenate([u, np.ones((k - len(u), n), np.float32)])
        at = base[by_count[:k]] + j
        last[at] = u
        u = (product[at] @ u[:, :, None])[:, :, 0] @ move.T
        u /= u.max(1, keepdims=True)

    forward = np.empty_like(e)
    a = prior[order]
    for t, k in enumerate(alive):
        a = (a[:k] if t == 0 else a[:k] @ move) * e[begin_o[:k] + t]
        a /= a.sum(1, keepdims=True)
        forward[begin_o[:k] + t] = a
    back, b = np.empty_like(e), np.zeros((0, n), np.float32)
    ends = last[order]
    for t in range(len(alive) - 1, -1, -1):
        k = alive[t]
        b = np.concatenate([b, ends[len(b):k]])
        at = begin_o[:k] + t
        back[at] = b
        b = (b * e[at]) @ move.T
        b /= b.max(1, keepdims=True)
    if pairs is not None:
        inner = np.setdiff1d(np.arange(len(e) - 1), bounds[1:] - 1)
        both = forward[inner][:, :, None] * move[None] * (e * back)[inner + 1][:, None, :]
        pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
    out = forward * back
    return out / out.sum(1, keepdims=True)


def _sequences(texts: list[str], labels: np.ndarray, rng: np.random.Generator):
    """Training sequences: (data, starts, ends, label per word) of SEQUENCE
    words each, made of runs of words of documents in random order."""
    words = [w for w in W.words_of(pa.array(texts, pa.large_string()))]
    runs = []  # (slice, first word, words, label)
    for k, w in enumerate(words):
        for i in range(w.n_texts):
            at = int(w.bounds[i])
            while at < w.bounds[i + 1]:
                n = int(min(rng.integers(4, 2 * SEQUENCE), w.bounds[i + 1] - at))
                runs.append((k, at, n, int(labels[w.first + i])))
                at += n
    rng.shuffle(runs)
    total, data, starts, ends, tags, base = 0, [], [], [], [], np.concatenate([[0], np.cumsum([len(w.data) for w in words])])
    for k, at, n, tag in runs:
        if total >= TRAIN_WORDS:
            break
        starts.append(words[k].starts[at:at + n] + base[k])
        ends.append(words[k].ends[at:at + n] + base[k])
        tags.append(np.full(n, tag))
        total += n
    data = W.folded(np.concatenate([w.data for w in words])) if words else np.zeros(0, np.uint8)
    if not tags:
        return data, np.zeros((0, SEQUENCE), np.int64), np.zeros((0, SEQUENCE), np.int64), np.zeros((0, SEQUENCE), np.int64)
    whole = total // SEQUENCE * SEQUENCE
    whole = whole or total
    shape = (-1, SEQUENCE) if whole >= SEQUENCE else (1, whole)
    return data, *(np.concatenate(x)[:whole].reshape(shape) for x in (starts, ends, tags))


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Maximum-likelihood weights by Adagrad on (text, language) rows."""
    langs = sorted({lang for _, lang in rows})
    n = len(langs)
    rng = np.random.default_rng(seed)
    number = {lang: i for i, lang in enumerate(langs)}
    labels = np.array([number[lang] for _, lang in rows], np.int64)
    buckets = buckets_for(n)
    data, starts, ends, tags = _sequences([t for t, _ in rows], labels, rng)
    model = Model(langs, np.zeros((buckets, n), np.float32), np.zeros((n, n), np.float32), np.zeros(n, np.float32))
    if not n or not len(tags):
        return model
    seen_w, seen_t = np.full((buckets, n), 1e-6, np.float32), np.full((n, n), 1e-6)
    width = tags.shape[1]
    for _ in range(EPOCHS):
        order = rng.permutation(len(tags))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            bucket, owner = features(data, starts[pick].ravel(), ends[pick].ravel(), buckets)
            scores = np.stack([np.bincount(owner, model.weights[bucket, j], pick.size * width) for j in range(n)], 1).astype(np.float32)
            expected, counted = np.zeros((n, n)), np.zeros((n, n))
            delta = marginals(scores, np.arange(len(pick) + 1) * width, model.transitions, model.start, expected)
            gold = tags[pick].ravel()
            if width > 1:
                np.add.at(counted, (tags[pick][:, :-1].ravel(), tags[pick][:, 1:].ravel()), 1)
            delta[np.arange(len(gold)), gold] -= 1
            grad = np.stack([np.bincount(bucket, delta[owner, j], buckets) for j in range(n)], 1).astype(np.float32) / len(pick)
            seen_w += grad * grad
            model.weights -= RATE * grad / np.sqrt(seen_w)
            step = (expected - counted) / len(pick)
            seen_t += step * step
            model.transitions -= (RATE * step / np.sqrt(seen_t)).astype(np.float32)
    return model


class Labeller:
    """Predicts whole texts with a fitted model; keeps the emissions of frequent words."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros((0, len(self.model.langs)), np.float32)

    def _scores(self, w: W.Words) -> np.ndarray:
        keys, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > KNOWN_WORDS:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            rows = emissions(self.model, W.folded(w.data), w.starts[first[new]], w.ends[first[new]])
            all_keys = np.concatenate([self.keys, keys[new]])
            order = np.argsort(all_keys, kind="stable")
            self.keys, self.rows = all_keys[order], np.concatenate([self.rows, rows])[order]
            at = np.searchsorted(self.keys, keys)
        return self.rows[at][back]

    def words(self, w: W.Words) -> np.ndarray:
        """Marginals of every word of a slice (words x languages); with many
        languages some texts at a time, so that the block products stay small."""
        scores, n = self._scores(w), len(self.model.langs)
        most, out, lo = max(BLOCK, CELLS // (n * n) * BLOCK), [], 0
        while lo < w.n_texts:
            hi = max(lo + 1, int(np.searchsorted(w.bounds, w.bounds[lo] + most, "right")) - 1)
            part = w.bounds[lo:hi + 1]
            out.append(marginals(scores[part[0]:part[-1]], part - part[0], self.model.transitions, self.model.start))
            lo = hi
        return np.concatenate(out) if out else scores

    def predict(self, column: pa.Array) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for w in W.words_of(column):
            if self.model.langs and len(w.hashes):
                p = self.words(w)
                letter = np.zeros(len(w.data) + 1, np.int64)
                np.cumsum(((w.data >= 65) & (w.data <= 90)) | ((w.data >= 97) & (w.data <= 122)) | (w.data >= 0x80), out=letter[1:])
                p[letter[w.ends] == letter[w.starts]] = 0  # words without a letter do not vote
                total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0, dtype=np.float64)])
                votes = total[w.bounds[1:]] - total[w.bounds[:-1]]
            else:
                votes = np.zeros((w.n_texts, max(1, len(self.model.langs))))
            for i in range(w.n_texts):
                text = w.data[w.text_at[i]:w.text_at[i + 1]].tobytes().decode("utf-8", "replace")
                if not self.model.langs or not _LETTER.search(text):
                    langs.append("und")
                    scores.append(0.0)
                else:
                    best, whole = int(votes[i].argmax()), votes[i].sum()
                    langs.append(self.model.langs[best])
                    scores.append(float(min(1.0, votes[i][best] / whole)) if whole > 0 else 1.0 / len(self.model.langs))
        return langs, scores


def is_held_out(doc_id="doc_id"):
    """crc32 of the decimal doc_id leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """A model of the rows of ``docs`` that are not held out and have a language."""
    labelled = docs.select("doc_id", "lang").filter(~is_held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    languages = labelled.agg(F.count_distinct("lang")).first()[0]
    if not languages:
        return train([])
    each = min(TRAIN_PER_LANG, max(1, TRAIN_ROWS // languages))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")  # so many rows per language and task go on
    # at most TRAIN_ROWS ids, or one of each language: small enough to broadcast
    chosen = labelled.distinct().withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= each).select("doc_id").distinct()
    texts = (docs.filter(~is_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id", "left_semi")
             .dropDuplicates(["doc_id"]).select("text", "lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((t, lang) for batch in batches for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows))], pa.binary())], ["model"])

    # the bounded sample is fitted in one task; the driver gets the weights only
    fitted = texts.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(fitted.model) if fitted else train([])


def identify(docs: DataFrame, model: Model, lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` with the prediction and its score added under the given names;
    columns of these names are replaced, all others stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size fixed by BUCKETS
    kept = [f for f in docs.schema if f.name not in (lang_name, score_name)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            langs, scores = labeller.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             [*names, lang_name, score_name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{lang_name}` string", f"`{score_name}` double"])
    return docs.select(*(f"`{c}`" for c in names)).mapInArrow(run, schema)
