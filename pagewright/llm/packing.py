"""Packing of tokenised documents into sequences of at most ``WINDOW`` tokens.

Tokens are made once, where the text is read; what is shuffled afterwards is
one small row per piece.  A document longer than a window is cut into full
windows, which need no packing, and a rest.  Rests are packed online by the
sum-of-squares rule (Csirik et al., 2006): with N(h) open windows filled to
level h, a rest of size s goes to the level, or to a new window, for which the
sum of N(h)**2 becomes least; a window that gets full leaves the array.

Rests are dealt by a hash of (doc_id, checksum, length) into groups of about
``GROUP_ROWS`` rows, so one hot document, source or text does not gather; each
group packs its rests in hash order with its own level array, and an executor
that is lost repeats its groups with the same result.  What a group leaves
open (a few windows) is the price, measured in the README.

Defined cases: a null or empty text is the single end token; repeated rows are
packed as often as they occur; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .jobs import cut, groups_of

WINDOW = 2048
END_ID = 1
GROUP_ROWS = 4096
CACHED_CHUNKS = 400_000  # token ids of frequent chunks that a worker keeps

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PACKED = _PIECE + ", sequence_id long, offset long"


def _wide_blanks(data: np.ndarray) -> np.ndarray:
    """Positions of the first byte of white space other than 0x09-0x0D and 0x20."""
    if not len(data):
        return np.zeros(0, np.int64)
    x = np.concatenate([data, np.zeros(2, np.uint8)])
    one, two = x[1:-1], x[2:]
    low = (data >= 0x1C) & (data <= 0x1F)
    latin = (data == 0xC2) & ((one == 0x85) | (one == 0xA0))
    ogham = (data == 0xE1) & (one == 0x9A) & (two == 0x80)
    general = (data == 0xE2) & (one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))
    wide = ((data == 0xE2) & (one == 0x81) & (two == 0x9F)) | ((data == 0xE3) & (one == 0x80) & (two == 0x80))
    return np.flatnonzero(low | latin | ogham | general | wide)


class ChunkTokens:
    """Token ids of whole texts, each distinct chunk encoded once.

    The pre-tokeniser of the byte-level BPE always splits before a single space
    that has a non-blank on both sides, and around a single line feed between
    non-blanks.  So a text whose words are separated that way is the
    concatenation of the ids of `` word``, ``\\n`` and ``word``; distinct chunks
    are found with numpy and encoded once, by the rank file of the same
    vocabulary (``.tiktoken`` beside the ``.json``), which is some times faster.
    A text with any other separator or other white space is encoded as a
    whole by the tokenizer file itself.
    """

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line = self.ranked.encode_ordinary("\n")
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = [len(token) for token in ranks]
        self._forget()

    def _forget(self) -> None:
        self.keys, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, column: pa.Array) -> Iterator[np.ndarray]:
        """uint32 ids of each text, in row order."""
        for words in W.words_of(column, lower=False):
            yield from self._slice(words)

    def _slice(self, w: W.Words) -> Iterator[np.ndarray]:
        n = len(w.starts)
        per_text = np.diff(w.bounds)
        first = np.zeros(n, bool)
        first[w.bounds[:-1][per_text > 0]] = True
        gap = np.empty(n, np.int64)
        text_of = np.repeat(np.arange(w.n_texts), per_text)
        gap[first] = w.starts[first] - w.text_at[text_of[first]]
        rest = np.flatnonzero(~first)
        gap[rest] = w.starts[rest] - w.ends[rest - 1]
        before = w.data[np.maximum(w.starts - 1, 0)] if n else np.zeros(0, np.uint8)
        spaced = ~first & (gap == 1) & (before == 32)
        broken = ~first & (gap == 1) & (before == 10)
        odd_word = ~(spaced | broken | (first & (gap == 0)))
        odd = np.zeros(w.n_texts, bool)
        odd[text_of[odd_word]] = True
        full = per_text > 0
        odd[full] |= w.ends[w.bounds[1:][full] - 1] != w.text_at[1:][full]
        odd[~full] = w.text_at[1:][~full] > w.text_at[:-1][~full]
        odd[np.searchsorted(w.text_at, _wide_blanks(w.data), "right") - 1] = True

        with np.errstate(over="ignore"):
            keys = w.hashes ^ np.where(spaced, np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
        distinct, at, back = np.unique(keys, return_index=True, return_inverse=True)
        place = self._places(distinct, w.starts[at], w.ends[at], spaced[at], w.data)
        line, flat = self.line, self.flat
        word_len, word_from = self.count[place][back], self.begin[place][back]
        extra = broken * len(line)
        sizes = word_len + extra
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if n else 0
        out = np.empty(total, np.uint32)
        where = ends - word_len  # first id of each word in out
        body = int(word_len.sum())
        step = np.arange(body) - np.repeat(np.cumsum(word_len) - word_len, word_len)
        out[np.repeat(where, word_len) + step] = flat[np.repeat(word_from, word_len) + step]
        for j, x in enumerate(line):
            out[where[broken] - len(line) + j] = x
        edge = np.concatenate([[0], ends])[w.bounds]
        for i in range(w.n_texts):
            if odd[i]:
                yield self.whole(w.data[w.text_at[i]:w.text_at[i + 1]].tobytes().decode("utf-8", "replace"))
            else:
                yield out[edge[i]:edge[i + 1]]

    def _places(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, spaced: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Places of the (sorted, distinct) chunk keys among the known chunks;
        new chunks are encoded in one string, each behind its separator."""
        if len(self.keys) > CACHED_CHUNKS:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            size = ends[new] - starts[new] + 1
            stop = np.cumsum(size)
            step = np.arange(int(stop[-1])) - np.repeat(stop - size, size)
            joined = data[np.maximum(np.repeat(starts[new] - 1, size) + step, 0)]
            joined[stop - size] = np.where(spaced[new], 32, 10)
            ids = np.array(self.ranked.encode_ordinary(joined.tobytes().decode("utf-8", "replace")), np.uint32)
            token_stop = np.searchsorted(np.cumsum(self.bytes_of[ids]), stop) + 1
            token_start = np.concatenate([[0], token_stop[:-1]]) + ~spaced[new]  # without the line feed's id
            keys_now = np.concatenate([self.keys, keys[new]])
            order = np.argsort(keys_now, kind="stable")
            self.begin = np.concatenate([self.begin, token_start + len(self.flat)])[order]
            self.count = np.concatenate([self.count, token_stop - token_start])[order]
            self.flat = np.concatenate([self.flat, ids])
            self.keys = keys_now[order]
            at = np.searchsorted(self.keys, keys)
        return at


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows and rests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = ChunkTokens(tokenizer_path)
        end = np.array([END_ID], "<u4")
        for batch in batches:
            row, start, length, crc, count = [], [], [], [], []
            for i, ids in enumerate(tokens.ids(batch.column("text"))):
                ids = np.concatenate([ids.astype("<u4"), end])
                for at in range(0, len(ids), window):
                    part = ids[at:at + window]
                    row.append(i)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    count.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, count))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, _PIECE)


def sum_of_squares(sizes: list[int], window: int) -> tuple[list[int], list[int]]:
    """(window number, offset) of each size, placed in the given order."""
    levels = np.zeros(window + 1, np.int64)  # N(h) of open windows, 0 < h < window
    at_level: dict[int, list[int]] = {}
    numbers, offsets, made = [], [], 0
    for s in sizes:
        best = 2 * int(levels[s]) + 1 if s < window else 0  # change by a new window
        level = 0
        if s < window:
            before = levels[1:window - s + 1]
            change = 2 * (levels[1 + s:window + 1] - before) + 2
            change[-1] -= 1  # a full window is not counted
            usable = np.flatnonzero(before)
            if len(usable):
                values = change[usable]
                least = int(values.min())
                if least <= best:
                    level = int(usable[values == least][-1]) + 1  # of equals, the fullest
        if level:
            levels[level] -= 1
            number = at_level[level].pop()
        else:
            number, made = made, made + 1
        filled = level + s
        if filled < window:
            levels[filled] += 1
            at_level.setdefault(filled, []).append(number)
        numbers.append(number)
        offsets.append(level)
    return numbers, offsets


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    parts = cut(pieces(docs, tokenizer_path, window))
    rests = parts.filter(F.col("length") < window)
    groups = max(1, math.ceil(rests.count() / GROUP_ROWS))
    order = F.xxhash64("doc_id", "ids_crc32", "length", "start")
    dealt = (rests.withColumn("place", order).withColumn("group", F.pmod("place", F.lit(groups)))
             .repartition("group").sortWithinPartitions("group", "place", "doc_id", "start", "length", "ids_crc32"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, ["group"]):
            keys = table.column("group").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = table.slice(lo, hi - lo)
                numbers, offsets = sum_of_squares(part.column("length").to_pylist(), window)
                sequence = np.array(numbers, np.int64) + (int(keys[lo]) << 32)
                done = part.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                done = done.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets, pa.int64()))
                yield from done.to_batches()

    packed = dealt.mapInArrow(run, _PACKED)
    full = parts.filter(F.col("length") == window).withColumns(
        {"sequence_id": F.monotonically_increasing_id() + (1 << 62), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)
