"""Toxicity score: gradient-boosted trees over dense features of the whole
text, with isotonic calibration.

Features (:data:`FEATURES`): densities of lexicon words, how near they stand to
a second-person word, capitals, punctuation, obfuscation (words that are in the
lexicon only after digits, symbols, stretched letters or gaps between letters
are undone), repetition and length.  There are two lexicons.  One is a short
fixed list (a parameter).  The other is learned: the words and word beginnings
whose density in toxic training texts exceeds that in the others most clearly
(:func:`learn_lexicon`), so abuse in any language of the labels counts.

Learning is cross-fitted.  The training rows are dealt into ``FOLDS`` by a hash.
A row's features use a lexicon of the other folds, and the scores that isotonic
regression maps to probabilities come from trees of the other folds; so neither
the trees nor the calibration see a score that was learned from the row itself.

At scale: word statistics are one grouped sum over the training texts; the
features of at most ``TRAIN_ROWS`` rows of each label (chosen by a hash of
doc_id, weighted back to the labels' true shares) are fitted in one task; the
driver gets ``LEXICON`` keys and the fitted trees.  Scoring is one pass over
the texts, slice by slice of about 1 MB.

Defined cases: null texts count as empty; empty texts get the score that the
features of an empty text have; labels of a document that contradict each other
count as the highest; null labels and null ids are no training rows; with one
label only every score is that label's share, without labels 0; repeated rows
get equal scores; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .jobs import cut

TRAIN_ROWS = 6000     # of each label, at most
FOLDS = 3
LEXICON = 512         # learned keys
LEAST_TEXTS = 3       # toxic training texts that must have a learned key
ROUNDS, DEPTH, RATE, BINS = 80, 3, 0.15, 32
TOXIC_SCORE = 0.5
NEAR = 5              # words between a lexicon word and a second-person word

#: A general starting list, any other may be given.
INSULTS = ("idiot idiots idiotic moron morons moronic stupid dumb fool fools loser losers clown clowns trash garbage scum filth vermin pathetic "
           "worthless disgusting useless retard retarded imbecile dumbass asshole bastard bitch whore slut pig pigs freak creep coward liar scumbag "
           "dirtbag jerk ugly shit crap fuck fucking fucker damn piss idiota imbécil estúpido basura asqueroso patético idiote imbécile stupide "
           "ordure dégoûtant pathétique dumm dummkopf trottel abschaum widerlich erbärmlich wertlos").split()
THREATS = "kill die hurt destroy burn hang shoot stab beat murder strangle hate matar morir tuer mourir töten sterben".split()
SECOND = "you your yours yourself u ur you're du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split()
#: Characters that stand for letters.
LEET = str.maketrans("013457@$!|€", "oieastasile")

PREFIXES = (4, 5, 6, 7, 8, 10)  # bytes of a word's beginning that are keys of their own

_INK = np.zeros(256, bool)  # letters and digits: a word's core starts and ends with one
_INK[48:58] = _INK[65:91] = _INK[97:123] = True
_INK[128:] = True
_ODD = np.ones(256, bool)   # anything but plain letters
_ODD[65:91] = _ODD[97:123] = False
_ODD[128:] = False
_SEED = W.mix(np.arange(1, len(PREFIXES) + 1, dtype=np.uint64))


@dataclass
class Cores:
    """Words of a slice without the punctuation around them."""

    of: np.ndarray      # text of each word
    starts: np.ndarray
    ends: np.ndarray
    keys: np.ndarray    # hash of the whole folded core
    data: np.ndarray    # folded bytes


def cores_of(w: W.Words) -> Cores:
    data = W.folded(w.data)
    of = np.repeat(np.arange(w.n_texts), np.diff(w.bounds))
    if not len(of):
        return Cores(of, w.starts, w.ends, np.zeros(0, np.uint64), data)
    place = np.arange(len(data))
    ink = _INK[data]
    following = np.minimum.accumulate(np.where(ink, place, len(data))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(ink, place, -1))
    starts, ends = following[w.starts], before[w.ends - 1] + 1
    bare = starts >= ends  # no letter or digit in the word: kept as it is
    starts, ends = np.where(bare, w.starts, starts), np.where(bare, w.ends, ends)
    return Cores(of, starts, ends, W.range_hashes(data, starts, ends, False), data)


def word_keys(c: Cores) -> np.ndarray:
    """(words x (1 + prefixes)) keys of each word: the whole core and its
    beginnings; 0 where the word is not longer than a beginning."""
    out = np.zeros((len(c.starts), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = c.keys
    size = c.ends - c.starts
    for j, k in enumerate(PREFIXES):
        long = np.flatnonzero(size > k)
        out[long, j + 1] = W.mix(W.range_hashes(c.data, c.starts[long], c.starts[long] + k, False) ^ _SEED[j])
    return out


def key_of(word: str) -> np.uint64:
    data = W.folded(np.frombuffer(word.encode(), np.uint8))
    return W.range_hashes(data, np.array([0]), np.array([len(data)]), False)[0]


def _sorted_keys(words) -> np.ndarray:
    return np.unique(np.array([key_of(x) for x in words], np.uint64))


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(keys.shape, bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


@dataclass
class Lexicon:
    """Fixed keys, and learned keys with their log ratio of densities."""

    insults: np.ndarray = field(default_factory=lambda: _sorted_keys(INSULTS))
    threats: np.ndarray = field(default_factory=lambda: _sorted_keys(THREATS))
    second: np.ndarray = field(default_factory=lambda: _sorted_keys(SECOND))
    plain: frozenset = frozenset(INSULTS) | frozenset(THREATS)
    learned: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def with_learned(self, keys: np.ndarray, weights: np.ndarray) -> Lexicon:
        order = np.argsort(keys)
        return Lexicon(self.insults, self.threats, self.second, self.plain, keys[order], weights[order])

    def weight(self, keys: np.ndarray) -> np.ndarray:
        """Largest weight among the keys of each word, 0 for none."""
        if not len(self.learned):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.learned, keys), len(self.learned) - 1)
        return np.where(self.learned[at] == keys, self.weights[at], 0).max(1, initial=0)


def undone(word: str) -> list[str]:
    """Spellings that a disguised word may stand for: digits and symbols read as
    letters, marks inside removed, stretched letters shortened."""
    out = []
    for x in (word, word.translate(LEET)):
        letters = "".join(ch for ch in x if ch.isalpha())
        once = "".join(ch for i, ch in enumerate(letters) if i == 0 or ch != letters[i - 1])
        twice = "".join(ch for i, ch in enumerate(letters) if i < 2 or not ch == letters[i - 1] == letters[i - 2])
        out += [letters, twice, once]
    return out


def disguised(w: W.Words, c: Cores, lexicon: Lexicon) -> np.ndarray:
    """True for words that are in the fixed lexicon only once their disguise is
    undone; for letters that stand apart (three single ones or more) the first."""
    hit = np.zeros(len(c.of), bool)
    if not len(c.of):
        return hit
    data = c.data
    odd = np.concatenate([[0], np.cumsum(_ODD[data])])
    same3 = np.zeros(len(data), bool)
    same3[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (data[2:] >= 97)
    stretched = np.concatenate([[0], np.cumsum(same3)])
    size = c.ends - c.starts
    inner = (odd[c.ends] > odd[c.starts]) | ((odd[w.ends] - odd[w.starts] > 0) & ((data[w.starts] == 36) | (data[w.starts] == 64)))
    strange = np.flatnonzero((inner | (stretched[c.ends] > stretched[c.starts])) & (size >= 3) & (size <= 40))
    _, first, back = np.unique(c.keys[strange], return_index=True, return_inverse=True)
    known = [any(x in lexicon.plain for x in undone(data[w.starts[i]:c.ends[i]].tobytes().decode("utf-8", "replace"))) for i in strange[first]]
    hit[strange] = np.array(known, bool)[back] if len(known) else False
    hit &= ~(_among(c.keys, lexicon.insults) | _among(c.keys, lexicon.threats))
    single = (size == 1) & ~_ODD[data[c.starts]] & (data[c.starts] < 128)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    for lo, hi in zip(edge[::2], edge[1::2], strict=True):
        if 3 <= hi - lo <= 40 and c.of[lo] == c.of[hi - 1] and data[c.starts[lo:hi]].tobytes().decode() in lexicon.plain:
            hit[lo] = True
    return hit


FEATURES = ("insults", "threats", "any_fixed", "disguised", "learned_1", "learned_2", "learned_weight", "learned_top", "learned_count", "all_count",
            "second", "near_second", "near_share", "capital_words", "capital_letters", "capital_hits", "exclaims", "questions", "runs", "symbols", "digits", "odd_words",
            "repeats", "words", "mean_length", "lines", "blank")


def features_of(w: W.Words, lexicon: Lexicon) -> np.ndarray:
    """(texts x features) of a slice."""
    n = w.n_texts
    c = cores_of(w)
    per = np.diff(w.bounds).astype(np.float64)
    rate = lambda x: np.bincount(c.of, x, n) / np.maximum(per, 1)
    insult, threat, second = (_among(c.keys, k) for k in (lexicon.insults, lexicon.threats, lexicon.second))
    hidden = disguised(w, c, lexicon)
    weight = np.zeros(len(c.of))
    if len(lexicon.learned) and len(c.of):  # frequent words are looked up once
        _, first, back = np.unique(c.keys, return_index=True, return_inverse=True)
        weight = lexicon.weight(word_keys(Cores(c.of[first], c.starts[first], c.ends[first], c.keys[first], c.data)))[back]
    any_hit = insult | threat | hidden | (weight > 2)
    # second-person words within NEAR words, in the same text
    place = np.flatnonzero(second)
    near = np.zeros(len(c.of), bool)
    hits = np.flatnonzero(any_hit)
    if len(place) and len(hits):
        right = np.searchsorted(place, hits)
        for at, ok in ((np.minimum(right, len(place) - 1), right < len(place)), (np.maximum(right - 1, 0), right > 0)):
            near[hits] |= ok & (np.abs(place[at] - hits) <= NEAR) & (c.of[place[at]] == c.of[hits])
    size = np.maximum(np.diff(w.text_at), 1).astype(np.float64)
    of_byte = np.repeat(np.arange(n), np.diff(w.text_at))
    share = lambda x: np.bincount(of_byte, x, n) / size
    upper = (w.data >= 65) & (w.data <= 90)
    lower = (w.data >= 97) & (w.data <= 122)
    bang, ask = w.data == 33, w.data == 63
    run = np.zeros(len(w.data), bool)
    run[1:] = (bang | ask)[1:] & (bang | ask)[:-1]
    symbol = _ODD[w.data] & ~np.isin(w.data, np.frombuffer(b" \t\n\r.,;:'\"-()?!0123456789", np.uint8))
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    ups, lows, odds = total(upper), total(lower), total(_ODD[w.data])
    shout = (ups[w.ends] - ups[w.starts] > 1) & (lows[w.ends] == lows[w.starts])
    odd_word = odds[c.ends] > odds[c.starts]
    twin = np.zeros(len(c.of), bool)
    twin[1:] = (c.keys[1:] == c.keys[:-1]) & (c.of[1:] == c.of[:-1])
    count = np.bincount(c.of, any_hit, n)
    top = np.zeros(n)
    np.maximum.at(top, c.of, weight)
    columns = [rate(insult), rate(threat), rate(insult | threat), rate(hidden), rate(weight > 1), rate(weight > 2.5), rate(weight), top, np.log1p(np.bincount(c.of, weight > 2.5, n)), np.log1p(count),
               rate(second), rate(near), np.bincount(c.of, near, n) / np.maximum(count, 1), rate(shout), share(upper), np.bincount(c.of, any_hit & shout, n) / np.maximum(count, 1),
               share(bang), share(ask), share(run), share(symbol), share((w.data >= 48) & (w.data <= 57)), rate(odd_word),
               rate(twin), np.log1p(per), np.bincount(c.of, c.ends - c.starts, n) / np.maximum(per, 1), np.log1p(share(w.data == 10) * size), (per == 0).astype(np.float64)]
    return np.stack(columns, 1).astype(np.float32)


# trees -----------------------------------------------------------------------
@dataclass
class Trees:
    """Boosted trees of a fixed depth: a heap of (feature, limit) and leaf values."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    leaf: np.ndarray     # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for f, t, v in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, f[node]] > t[node])
            out += v[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss on histograms of quantile bins."""
    x = x.astype(np.float32)
    n, d = x.shape
    edges = [np.unique(np.concatenate([np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"), np.quantile(col[col > 0], np.linspace(0, 1, 9)[:-1], method="lower") * 0.999 if (col > 0).any() else []])).astype(np.float32)
             for col in x.T]
    bins = max(len(e) for e in edges) + 1
    code = np.stack([np.searchsorted(e, col, "left") for e, col in zip(edges, x.T, strict=True)], 1)  # x > edge[b] <=> code > b
    share = float((weight * y).sum() / weight.sum())
    base = float(np.log(share / (1 - share)))
    raw, inner, leaves = np.full(n, base), 2**DEPTH - 1, 2**DEPTH
    trees = Trees(base, np.zeros((ROUNDS, inner), np.int64), np.zeros((ROUNDS, inner), np.float32), np.zeros((ROUNDS, leaves)))
    for r in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        g, h = weight * (y - p), weight * p * (1 - p) + 1e-9
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            cell = ((node - first)[:, None] * d + np.arange(d)) * bins + code
            shape = (width, d, bins)
            gs, hs = (np.bincount(cell.ravel(), np.repeat(q, d), width * d * bins).reshape(shape).cumsum(2) for q in (g, h))
            cs = np.bincount(cell.ravel(), minlength=width * d * bins).reshape(shape).cumsum(2)
            gt, ht, ct = gs[:, :1, -1:], hs[:, :1, -1:], cs[:, :1, -1:]
            gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
            gain[(cs < 5) | (ct - cs < 5)] = -1
            flat = gain[:, :, :-1].reshape(width, -1)
            best = flat.argmax(1)
            f, b = np.divmod(best, bins - 1)
            useful = flat[np.arange(width), best] > 1e-6
            for j in range(width):
                e = edges[f[j]]
                trees.feature[r, first + j] = f[j]
                trees.limit[r, first + j] = e[b[j]] if useful[j] and b[j] < len(e) else np.inf
            at = node - first
            node = 2 * node + 1 + (x[np.arange(n), trees.feature[r, first + at]] > trees.limit[r, first + at])
        at = node - inner
        trees.leaf[r] = RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + 1)
        raw += trees.leaf[r][at]
    return trees


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the knots (score, probability) of the rising
    step function that is nearest to the labels."""
    at, group = np.unique(score, return_inverse=True)
    mass, mean = np.bincount(group, weight), np.bincount(group, weight * y)
    mean = mean / mass
    blocks: list[list[float]] = []  # mean, mass, first, last
    for i in range(len(at)):
        blocks.append([mean[i], mass[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, k, _, hi = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + m * k) / (b[1] + k), b[1] + k, hi
    knots = [(at[int(i)], b[0]) for b in blocks for i in dict.fromkeys((b[2], b[3]))]
    return np.array([k for k, _ in knots]), np.array([p for _, p in knots])


@dataclass
class Model:
    lexicon: Lexicon
    share: float = 0.0
    trees: Trees | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def scores(self, w: W.Words) -> np.ndarray:
        if self.trees is None:
            return np.full(w.n_texts, self.share)
        raw = self.trees.raw(features_of(w, self.lexicon))
        # the trees order texts within a flat step of the calibration, by at most a thousandth
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-np.clip(raw, -30, 30))), 0, 1)


def fit_rows(x: np.ndarray, y: np.ndarray, fold: np.ndarray, weight: np.ndarray) -> tuple[Trees, tuple[np.ndarray, np.ndarray]]:
    """Trees of all rows, and the calibration of scores made out of fold."""
    raw, done = np.zeros(len(y)), np.zeros(len(y), bool)
    for f in range(FOLDS):
        rest, own = fold != f, fold == f
        if own.any() and 0 < y[rest].sum() < rest.sum():
            raw[own] = boost(x[rest], y[rest], weight[rest]).raw(x[own])
            done |= own
    trees = boost(x, y, weight)
    if not 0 < y[done].sum() < done.sum():
        raw, done = trees.raw(x), np.ones(len(y), bool)
    return trees, isotonic(raw[done], y[done], weight[done])


# Spark -------------------------------------------------------------------------
def is_held_out(doc_id="doc_id"):
    """crc32 of the decimal doc_id leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_densities(rows: DataFrame) -> DataFrame:
    """(k, and per fold f and label t: s<f><t> summed densities, n<f><t> texts)
    of every word and word beginning of the rows (text, y, fold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold"))
            for w in W.words_of(batch.column("text"), lower=False):
                c = cores_of(w)
                keys = word_keys(c)
                for t in range(w.n_texts):
                    lo, hi = w.bounds[t], w.bounds[t + 1]
                    k, n = np.unique(keys[lo:hi], return_counts=True)
                    k, n = k[k != 0], n[k != 0]
                    i = w.first + t
                    yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n / max(hi - lo, 1)), pa.array(np.full(len(k), fold[i] * 2 + y[i], np.int32))], ["k", "s", "cell"])

    cells = rows.select("text", "y", "fold").mapInArrow(run, "k long, s double, cell int")
    of = lambda cell, x: F.sum(F.when(F.col("cell") == cell, x).otherwise(F.lit(0.0)))
    return cells.groupBy("k").agg(*(of(2 * f + t, F.col("s")).alias(f"s{f}{t}") for f in range(FOLDS) for t in (0, 1)),
                                  *(of(2 * f + t, F.lit(1.0)).alias(f"n{f}{t}") for f in range(FOLDS) for t in (0, 1)))


def learn_lexicon(densities: DataFrame, texts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Learned keys and weights without fold 0, 1, ..., and of all folds.
    ``texts``: folds x 2 numbers of training texts.  A key counts if
    ``LEAST_TEXTS`` toxic texts have it and its mean density there is at least
    twice that of the others; the ``LEXICON`` keys whose toxic texts exceed
    chance most clearly are taken."""
    out = []
    for skip in [*range(FOLDS), None]:
        folds = [f for f in range(FOLDS) if f != skip]
        n0, n1 = (max(1.0, float(texts[folds, t].sum())) for t in (0, 1))
        add = lambda kind, t: sum((F.col(f"{kind}{f}{t}") for f in folds[1:]), F.col(f"{kind}{folds[0]}{t}"))  # noqa: B023, E731
        floor = 0.1 / n0 / 10
        ratio = F.log((add("s", 1) / n1 + floor) / (add("s", 0) / n0 + floor))
        chance = (add("n", 0) + 0.5) / (n0 + 1)
        excess = (add("n", 1) / n1 - chance) / F.sqrt(chance / n1)
        best = (densities.filter(add("n", 1) >= LEAST_TEXTS).select("k", ratio.alias("w"), (excess * ratio).alias("z"))
                .filter("w >= 0.7 and z > 3").orderBy(F.desc("z"), "k").limit(LEXICON).collect())
        out.append((np.array([r.k for r in best], np.int64).astype(np.uint64), np.minimum(np.array([r.w for r in best]), 6.0)))
    return out


def fit(docs: DataFrame, labels: DataFrame, lexicon: Lexicon | None = None) -> Model:
    """A model of the rows of ``labels`` that are not held out."""
    lexicon = lexicon or Lexicon()
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out())
             .groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("y")))
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not total:
        return Model(lexicon)
    share = total.get(1, 0) / sum(total.values())
    if len(total) < 2:
        return Model(lexicon, share)
    order = F.xxhash64(F.col("doc_id"), F.lit(13))
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(31)), F.lit(FOLDS)).cast("int")
    chosen = None
    for y in (0, 1):  # at most 2 * TRAIN_ROWS ids: small enough to broadcast
        some = known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(TRAIN_ROWS).select("doc_id", "y", fold.alias("fold"))
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = (docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & ~is_held_out()).join(F.broadcast(chosen), "doc_id")
            .dropDuplicates(["doc_id"]))
    texts = np.zeros((FOLDS, 2))
    for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect():
        texts[r.fold, r.y] = r.n
    if not texts[:, 1].sum() or not texts[:, 0].sum():
        return Model(lexicon, share)
    toxic_texts = sum((F.col(f"n{f}1") for f in range(1, FOLDS)), F.col("n01"))
    densities = cut(word_densities(rows).filter(toxic_texts >= LEAST_TEXTS))  # read once per lexicon
    found = learn_lexicon(densities, texts)
    lexicons = [lexicon.with_learned(*f) for f in found]
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)  # at most (FOLDS + 1) * LEXICON keys
    weight = {y: total[y] / texts[:, y].sum() for y in (0, 1)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in W.words_of(batch.column("text"), lower=False):
                folds = batch.column("fold").slice(w.first, w.n_texts).to_numpy(zero_copy_only=False)
                by = np.stack([features_of(w, x) for x in shared.value[:FOLDS]])
                x = by[folds, np.arange(w.n_texts)]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(w.first, w.n_texts) for c in ("doc_id", "y", "fold")] + [pa.array(list(x), pa.list_(pa.float32()))],
                                                 ["doc_id", "y", "fold", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("doc_id")
        y, f = (t.column(c).to_numpy() for c in ("y", "fold"))
        x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        fitted = fit_rows(x, y.astype(np.float64), f, np.where(y == 1, weight[1], weight[0]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted)], pa.binary())], ["model"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    # a bounded sample's numbers are fitted in one task; the driver gets the trees only
    fitted = rows.mapInArrow(measure, f"doc_id {kind}, y int, fold int, x array<float>").repartition(1).mapInArrow(learn, "model binary").first()
    return Model(lexicons[-1], share, *pickle.loads(fitted.model))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document; only doc_id and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in W.words_of(batch.column("text"), lower=False):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(w.first, w.n_texts), pa.array(shared.value.scores(w), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
