"""Line-first cleaning: rules per line, then a verdict on what is left.

A text is split at \\n.  A line with a word fails when it is

* navigation: at least two separator words, and a quarter of its words,
* noise: more than half of its words end in one of ``#*$%&|<>``,
* shouting: five words or more, more than half without a small letter and with
  two capitals (ASCII letters),
* repetitive: eight words or more, under a quarter of them distinct,
* unpunctuated: thirty words or more without any of ``.!?``,
* boilerplate: at most thirty words with one of ``BOILERPLATE``,
* a copy of an earlier line of the text.

The failing lines are removed; the document is rejected if they held more than
``MAX_LOST`` percent of its words.  All measures are counts, so every check is
exact integer arithmetic.

Defined cases: null and empty texts have no words and fail the base rules; a
text of any length is processed whole; repeated rows give repeated results;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words in repeated three-word windows
MAX_LOST = 30      # percent of words in failing lines

SEPARATORS = ("|", "»", "›", ">", "/", "·", "•")
BOILERPLATE = ("all rights reserved", "privacy policy", "cookie policy", "uses cookies", "accept cookies", "terms of use", "terms of service",
               "enable javascript", "lorem ipsum", "click here", "subscribe to our newsletter", "sign up for our", "share this article", "read more")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_END = np.zeros(256, bool)
_END[list(b".!?")] = True
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)).encode(), re.I)
_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _seen_before(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether an entry equals an earlier entry of its group."""
    with np.errstate(over="ignore"):
        own = W.mix(keys + W.mix(of.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(own, return_index=True)
    out = np.ones(len(keys), bool)
    out[first] = False
    return out


class Lines:
    """Lines with a word of the texts of a slice, and which of them fail."""

    def __init__(self, w: W.Words):
        n = w.n_texts
        feed = np.flatnonzero(w.data == 10)
        start = np.sort(np.concatenate([w.text_at[:-1], feed + 1]))
        stop = np.sort(np.concatenate([w.text_at[1:], feed]))
        first, last = np.searchsorted(w.starts, start), np.searchsorted(w.starts, stop)
        full = last > first
        self.start, self.stop, self.first, self.last = start[full], stop[full], first[full], last[full]
        self.of = np.minimum(np.searchsorted(w.text_at, self.start, "right") - 1, n - 1)
        k = len(self.start)
        self.words = self.last - self.first
        line = np.repeat(np.arange(k), self.words)  # of each word
        size = w.ends - w.starts
        count = lambda flag: np.bincount(line[flag], minlength=k)
        small = np.concatenate([[0], np.cumsum((w.data >= 97) & (w.data <= 122))])
        pair = np.zeros(len(w.data) + 1, np.int64)
        large = (w.data >= 65) & (w.data <= 90)
        if len(w.data) > 1:
            pair[1:-1] = np.cumsum(large[:-1] & large[1:])
            pair[-1] = pair[-2]
        separator = np.isin(w.hashes, _separator_hashes())
        noise = _SYMBOL[w.data[w.ends - 1]] if k else np.zeros(0, bool)
        shout = (small[w.ends] == small[w.starts]) & (pair[np.maximum(w.ends - 1, 0)] > pair[w.starts]) if k else np.zeros(0, bool)
        repeated = _seen_before(w.hashes, line)
        ends = np.concatenate([[0], np.cumsum(_END[w.data])])
        del size
        copy = _seen_before(self._keys(w), self.of)
        seps = count(separator)
        self.copy = copy
        self.fails = (
            ((seps >= 2) & (4 * seps >= self.words))
            | (2 * count(noise) > self.words)
            | ((self.words >= 5) & (2 * count(shout) > self.words))
            | ((self.words >= 8) & (4 * (self.words - count(repeated)) < self.words))
            | ((self.words >= 30) & (ends[self.stop] == ends[self.start]))
            | copy)
        raw = w.data.tobytes()
        for m in _BOILER.finditer(raw):
            i = int(np.searchsorted(self.start, m.start(), "right")) - 1
            if i >= 0 and m.end() <= self.stop[i] and self.words[i] <= 30:
                self.fails[i] = True

    def _keys(self, w: W.Words) -> np.ndarray:
        """Hash of the bytes of each line."""
        k = len(self.start)
        if not k:
            return np.zeros(0, np.uint64)
        size = self.stop - self.start
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        with np.errstate(over="ignore"):
            letters = (w.data[np.repeat(self.start, size) + step].astype(np.uint64) + np.uint64(1)) * W._powers(int(size.max()))[step]
            return W.mix(np.add.reduceat(letters, np.cumsum(size) - size) + size.astype(np.uint64))


def _separator_hashes() -> np.ndarray:
    return next(iter(W.words_of(pa.array([" ".join(SEPARATORS)]), lower=False))).hashes


def measures(w: W.Words) -> dict[str, np.ndarray]:
    """Base measures and verdicts of the texts of a slice."""
    n = w.n_texts
    n_words = np.diff(w.bounds)
    of = np.repeat(np.arange(n), n_words)
    points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[w.data])])
    three = W.window_hashes(w.hashes, 3)
    inside = np.flatnonzero(of[:len(three)] == of[2:2 + len(three)]) if len(three) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        own = W.mix(three[inside] + W.mix(of[inside].astype(np.uint64) + np.uint64(1)))
    _, back, times = np.unique(own, return_inverse=True, return_counts=True)
    again = inside[times[back] > 1] if len(inside) else inside
    covered = np.zeros(len(of) + 2, bool)
    for j in range(3):
        covered[again + j] = True
    lines = Lines(w)
    lost = np.bincount(lines.of, np.where(lines.fails, lines.words, 0), n).astype(np.int64)
    repeat = np.bincount(of[covered[:len(of)]], minlength=n)
    base_failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEATED * n_words)
    return {
        "n_words": n_words, "word_chars": np.bincount(of, points[w.ends] - points[w.starts], n).astype(np.int64) if len(of) else np.zeros(n, np.int64),
        "n_symbols": symbols[w.text_at[1:]] - symbols[w.text_at[:-1]], "n_dup_lines": np.bincount(lines.of[lines.copy], minlength=n),
        "n_repeat_words": repeat, "base_failed": base_failed, "lost_words": lost, "kept": ~base_failed & (100 * lost <= MAX_LOST * n_words),
    }


def evaluate(docs: DataFrame) -> DataFrame:
    """(doc_id, measures, base_failed, lost_words, kept) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for w in W.words_of(batch.column("text"), lower=False):
                got = measures(w)
                yield pa.RecordBatch.from_arrays([ids.slice(w.first, w.n_texts).cast(pa.int64()), *map(pa.array, got.values())], ["doc_id", *got])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in _COLUMNS) + ", base_failed boolean, lost_words long, kept boolean")


def clean(docs: DataFrame) -> DataFrame:
    """(doc_id, text, kept): texts without their failing lines (lines without
    a word stay as they are)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for w in W.words_of(batch.column("text"), lower=False):
                lines, kept = Lines(w), measures(w)["kept"]
                drop = np.zeros(len(w.data) + 1, bool)
                for a, b in zip(lines.start[lines.fails], lines.stop[lines.fails], strict=True):
                    drop[a:b + 1] = True  # with its line feed
                texts = []
                for i in range(w.n_texts):
                    a, b = w.text_at[i], w.text_at[i + 1]
                    texts.append(w.data[a:b][~drop[a:b]].tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([ids.slice(w.first, w.n_texts).cast(pa.int64()), pa.array(texts, pa.string()), pa.array(kept)], ["doc_id", "text", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, kept boolean")
