"""Word arrays: whole texts of an Arrow batch as numpy arrays of word hashes.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Texts are
taken from the Arrow buffers in slices of about ``SLICE_BYTES`` cut at text
borders (one longer text is a slice of its own), so the temporary arrays stay
small however many rows a batch has.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator: spreads every bit of a 64-bit key."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_POWERS = np.ones(64, np.uint64)


def _powers(n: int) -> np.ndarray:
    """_BASE ** 0 .. n-1 modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n or _POWERS[1] == 1:
        size = max(n, 64)
        p = np.full(size, _BASE, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(p, dtype=np.uint64)
    return _POWERS


@dataclass
class Words:
    """The words of the texts ``first .. first + n_texts`` of a batch."""

    first: int
    n_texts: int
    data: np.ndarray      # bytes of the slice, as they are
    text_at: np.ndarray   # n_texts + 1 byte offsets of the texts
    starts: np.ndarray    # first byte of each word
    ends: np.ndarray      # byte behind each word
    bounds: np.ndarray    # n_texts + 1: words of text i are bounds[i] .. bounds[i + 1]
    hashes: np.ndarray    # uint64 of each word


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, one text at least."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words_of(column: pa.Array, lower: bool = True) -> Iterator[Words]:
    raw, at = text_buffers(column)
    for lo, hi in slices(at):
        yield _slice_words(raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], lo, lower)


def _slice_words(data: np.ndarray, at: np.ndarray, first: int, lower: bool) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(first, len(at) - 1, data, at, none, none, np.zeros(len(at), np.int64), np.zeros(0, np.uint64))
    ink = ~_BLANK[data]
    border = np.zeros(n + 1, bool)  # a word never runs over the end of its text
    border[at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | border[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = ink[1:]
    ends = np.flatnonzero(ink & (~after | border[1:])) + 1
    bounds = np.searchsorted(starts, at)
    if not len(starts):
        return Words(first, len(at) - 1, data, at, starts, ends, bounds, np.zeros(0, np.uint64))
    hashes = range_hashes(data, starts, ends, lower)
    return Words(first, len(at) - 1, data, at, starts, ends, bounds, hashes)


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte capitals U+00C0-U+00DE."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[wide] += 32
    return out


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """Hash of the bytes of each (non-empty) range."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    letters = (_LOWER if lower else _SAME)[data[np.repeat(starts, lengths) + within]].astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        letters *= _powers(int(lengths.max()))[within]
        return mix(np.add.reduceat(letters, begin) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _weights(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words (runs over text borders too)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j, w in enumerate(_weights(k)):
            out += hashes[j:j + n] * w
    return mix(out)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole (short) word sequence."""
    with np.errstate(over="ignore"):
        return mix(np.array([(hashes * _weights(len(hashes))).sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64))[0]


def shingle_sets(words: Words, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of the k-word shingles) of every text.  A
    text of fewer than k words has its whole sequence as its only shingle; a
    text without words has none."""
    windows = window_hashes(words.hashes, k)
    for i in range(words.n_texts):
        lo, hi = int(words.bounds[i]), int(words.bounds[i + 1])
        if hi - lo >= k:
            yield words.first + i, np.unique(windows[lo:hi - k + 1])
        elif hi > lo:
            yield words.first + i, np.array([sequence_hash(words.hashes[lo:hi])], np.uint64)
        else:
            yield words.first + i, np.zeros(0, np.uint64)
