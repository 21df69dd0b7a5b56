"""Benchmark decontamination by template windows.

Texts become template tokens: words without outer punctuation, in small
letters, where numbers (a digit, or a number word) become NUM, units UNIT and
words inside a sentence with a capital first and small letters after it NAME.
Neighbouring NAME words, and neighbouring numbers, with blanks only between them
are one token.  Every window of ``TOKENS`` tokens with at least ``LITERALS``
literal words is hashed.  Beside them stand the plain windows: of ``TOKENS``
words in small letters as they are, whatever they are.  Documents are
hash-joined with the windows of the benchmark: each document's windows are made
and looked up where its text is read, so only hits are shuffled.

Hits of a (document, item) on one diagonal are a piece; pieces that follow one
another in both texts, at most the item's length apart, belong together.  Each
carries the values behind its placeholders; ``AGREE`` percent of the slots must
have the value that is the most frequent one in the document for the item's
value.  Equal values make an ``exact`` copy, other values a ``reparameterised``
one: the same question with other numbers, names or units.  A document is
contaminated when the template windows cover ``SHARE`` percent of the item, or
the plain ones ``PLAIN_SHARE`` percent, and at least ``COVER`` tokens (or the
whole item, if it is shorter).  ``start_token`` counts words.

The hashes of the benchmark's windows are sent to the tasks while they are at
most ``MOST_SENT``, which is checked; beyond that all windows are shuffled and
joined, with the same result.

Defined cases: null texts and items have no windows; items with fewer than
``LITERALS`` literal words are looked for by plain windows only; items shorter
than a window are looked for as one window of their own length; repeated rows give one finding per
(doc_id, item_id); null ids are left out; extra columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .jobs import cut, groups_of, without

TOKENS = 8
LITERALS = 5
SHARE = 50
COVER = 12
AGREE = 75
PLAIN_SHARE = 80
MOST_SENT = 4_000_000

NUMBERS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
           "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion").split()
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces pound pounds ml l liter liters litre litres "
         "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent "
         "degree degrees meter meters metre metres gram grams kilogram kilograms kilometer kilometers kmh mph").split()

_NUM, _UNIT, _NAME = (np.uint64(0x1111111111111111 * k) for k in (1, 2, 3))
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[list(b".!?:")] = True


def _hashes(names: list[str]) -> np.ndarray:
    return np.sort(next(iter(W.words_of(pa.array([" ".join(names)])))).hashes)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


_NUMBER_HASHES, _UNIT_HASHES = _hashes(NUMBERS), _hashes(UNITS)


class Templates:
    """Template tokens of the texts of a slice."""

    def __init__(self, w: W.Words):
        self.data = w.data
        n = len(w.data)
        index = np.arange(n, dtype=np.int64)
        alnum = _ALNUM[w.data]
        following = np.minimum.accumulate(np.where(alnum, index, n)[::-1])[::-1]
        previous = np.maximum.accumulate(np.where(alnum, index, -1))
        first = following[w.starts] if len(w.starts) else w.starts
        last = previous[w.ends - 1] if len(w.starts) else w.ends
        solid = np.flatnonzero((first < w.ends) & (last >= w.starts)) if len(w.starts) else np.zeros(0, np.int64)
        self.starts, self.ends = first[solid], last[solid] + 1
        self.of = np.repeat(np.arange(w.n_texts), np.diff(w.bounds))[solid]
        self.bounds = np.searchsorted(self.of, np.arange(w.n_texts + 1))
        digits = np.concatenate([[0], np.cumsum(_DIGIT[w.data])])
        feeds = np.concatenate([[0], np.cumsum(w.data == 10)])
        flat = W.folded(w.data)
        small = np.concatenate([[0], np.cumsum(((w.data >= 97) & (w.data <= 122)) | ((w.data >= 0xA0) & (np.concatenate([[0], w.data[:-1]]) == 0xC3)))])
        hashes = W.range_hashes(flat, self.starts, self.ends, False)
        is_num = (digits[self.ends] > digits[self.starts]) | _among(hashes, _NUMBER_HASHES)
        is_unit = ~is_num & _among(hashes, _UNIT_HASHES)
        head = w.data[self.starts] if len(solid) else np.zeros(0, np.uint8)
        after = w.data[np.minimum(self.starts + 1, max(n - 1, 0))] if len(solid) else head
        capital = (small[self.ends] > small[self.starts]) & (((head >= 65) & (head <= 90)) | ((head == 0xC3) & (after >= 0x80) & (after <= 0x9E)))
        opening = np.ones(len(solid), bool)  # first of a text, line or sentence
        if len(solid) > 1:
            # last byte of the word before, with its punctuation, and a line feed between
            closing = _CLOSE[w.data[w.ends[solid[:-1]] - 1]]
            opening[1:] = closing | (feeds[self.starts[1:]] > feeds[self.ends[:-1]]) | (self.of[1:] != self.of[:-1])
        is_name = capital & ~opening & ~is_num & ~is_unit
        self.plain, self.plain_of, self.plain_bounds = hashes, self.of, self.bounds
        blanks = np.concatenate([[0], np.cumsum(W._BLANK[w.data])])
        first = np.ones(len(solid), bool)  # of a run of names or of numbers
        if len(solid) > 1:
            near = (blanks[self.starts[1:]] - blanks[self.ends[:-1]] == self.starts[1:] - self.ends[:-1]) & (self.of[1:] == self.of[:-1])
            first[1:] = ~(near & ((is_num[1:] & is_num[:-1]) | (is_name[1:] & is_name[:-1])))
        self.word = np.flatnonzero(first)  # the plain token of each token
        self.starts, self.ends, self.of = self.starts[self.word], self.ends[np.append(self.word[1:], len(solid))[:len(self.word)] - 1], self.of[self.word]
        self.bounds = np.searchsorted(self.of, np.arange(w.n_texts + 1))
        self.slot = (is_num | is_unit | is_name)[self.word]
        self.tokens = np.where(is_num, _NUM, np.where(is_unit, _UNIT, np.where(is_name, _NAME, hashes)))[self.word]

    def plain_windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first plain token, hash) of the windows of words inside one text."""
        found = W.window_hashes(self.plain, size)
        at = np.arange(len(found))
        ok = self.plain_of[at] == self.plain_of[at + size - 1]
        return at[ok], found[ok] ^ W.mix(np.array([size], np.uint64))[0]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash) of the windows inside one text with enough literals."""
        found = W.window_hashes(self.tokens, size)
        literal = np.concatenate([[0], np.cumsum(~self.slot)])
        at = np.arange(len(found))
        ok = (self.of[at] == self.of[at + size - 1]) & (literal[at + size] - literal[at] >= LITERALS) if len(at) else np.zeros(0, bool)
        return at[ok], found[ok] + np.uint64(size)

    def values(self, at: int, size: int) -> list[str]:
        """The slots' values behind their place in the window and a colon."""
        return [f"{i - at}:" + " ".join(self.data[self.starts[i]:self.ends[i]].tobytes().decode("utf-8", "replace").lower().split())
                for i in range(at, at + size) if self.slot[i]]


_WINDOW = "id long, pos long, word long, plain boolean, size int, h long, slots array<string>"
_NAMES = ["id", "pos", "word", "plain", "size", "h", "slots"]


def _window_rows(rows: DataFrame, sizes: list[tuple[int, bool]], known=None) -> DataFrame:
    """(id, pos, word, plain, size, h, slots): windows of (id, text) rows, of the known hashes only if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value if known is not None else None
        seen = np.zeros(1 << 20, bool)  # a first look that most windows don't pass
        if wanted is not None:
            seen[(wanted & np.uint64(len(seen) - 1)).astype(np.int64)] = True
        for batch in batches:
            ids = batch.column("id")
            for w in W.words_of(batch.column("text"), lower=False):
                t = Templates(w)
                for size, plain in sizes:
                    at, h = t.plain_windows(size) if plain else t.windows(size)
                    if wanted is not None:
                        some = seen[(h & np.uint64(len(seen) - 1)).astype(np.int64)]
                        at, h = at[some], h[some]
                        hit = _among(h, wanted)
                        at, h = at[hit], h[hit]
                    of = (t.plain_of if plain else t.of)[at]
                    word = (at if plain else t.word[at]) - t.plain_bounds[of]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(of + w.first)).cast(pa.int64()), pa.array(word if plain else at - t.bounds[of]), pa.array(word), pa.array(np.full(len(at), plain)),
                         pa.array(np.full(len(at), size, np.int32)), pa.array(h.view(np.int64)),
                         pa.array([[] if plain else t.values(i, size) for i in at.tolist()], pa.list_(pa.string()))], _NAMES)

    return rows.filter("id is not null").mapInArrow(run, _WINDOW)


def _item_rows(items: DataFrame) -> DataFrame:
    """(id, pos, word, plain, size, h, slots, tokens): windows of the items; an
    item shorter than a window is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            out = []
            for w in W.words_of(batch.column("text"), lower=False):
                t = Templates(w)
                for plain in (False, True):
                    of, bounds = (t.plain_of, t.plain_bounds) if plain else (t.of, t.bounds)
                    lengths = np.diff(bounds)
                    for size in sorted({min(TOKENS, int(n)) for n in lengths if n >= (1 if plain else LITERALS)}):
                        for i, h in zip(*(x.tolist() for x in (t.plain_windows if plain else t.windows)(size)), strict=True):
                            k = int(of[i])
                            if min(TOKENS, int(lengths[k])) == size:
                                word = (i if plain else int(t.word[i])) - int(t.plain_bounds[k])
                                out.append((ids[w.first + k], i - int(bounds[k]), word, plain, size, np.uint64(h).astype(np.int64).item(),
                                            [] if plain else t.values(i, size), int(lengths[k])))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*_NAMES, "tokens"])

    return items.filter("id is not null").mapInArrow(run, _WINDOW + ", tokens long")


def _pieces(hits: list[dict]) -> list[tuple[int, int, int, list[dict]]]:
    """(first document token, first item token, item tokens, hits) of the runs
    of overlapping windows on one diagonal, by place in the document."""
    out, last = [], None
    for r in sorted(hits, key=lambda r: (r["at"] - r["pos"], r["at"])):
        if last and r["at"] - r["pos"] == last["at"] - last["pos"] and r["pos"] <= last["pos"] + last["size"]:
            at, pos, _, own = out[-1]
            out[-1] = at, pos, r["pos"] + r["size"] - pos, [*own, r] if r["pos"] != last["pos"] else own
        else:
            out.append((r["at"], r["pos"], r["size"], [r]))
        last = r
    return sorted(out, key=lambda p: p[:3])


def _judged(hits: list[dict]) -> tuple | None:
    """(covered, -changed slots, n_slots, -first word, tokens) of the best copy
    that the hits of a document, an item and a kind of windows make."""
    tokens, share, found = hits[0]["tokens"], PLAIN_SHARE if hits[0]["plain"] else SHARE, None
    pieces = _pieces(hits)
    covered, before = [p[2] for p in pieces], [-1] * len(pieces)
    for j, (at, pos, size, _) in enumerate(pieces):
        for i in range(j - 1, -1, -1):  # a piece has at most the item's length, so farther ones are out of reach
            x, y, n, _ = pieces[i]
            if at - x > 2 * tokens:
                break
            new = pos + size - max(pos, y + n)
            if x < at <= x + n + tokens and y < pos and new > 0 and covered[i] + new > covered[j]:
                covered[j], before[j] = covered[i] + new, i
    for j in range(len(pieces)):
        if covered[j] * 100 < tokens * share or covered[j] < min(tokens, COVER):
            continue
        path, i = [], j
        while i >= 0:
            path.append(i)
            i = before[i]
        slots = {}
        for i in path:
            for r in pieces[i][3]:
                for ours, theirs in zip(r["ours"], r["theirs"], strict=True):
                    k, _, value = ours.partition(":")
                    slots.setdefault(r["pos"] + int(k), (value, theirs.partition(":")[2]))
        votes = defaultdict(Counter)
        for ours, theirs in slots.values():
            votes[ours][theirs] += 1
        if 100 * sum(max(v.values()) for v in votes.values()) < AGREE * len(slots):
            continue
        changed = sum(ours != theirs for ours, theirs in slots.values())
        entry = covered[j], -changed, len(slots), -pieces[path[-1]][3][0]["word"], tokens
        found = max(found, entry) if found else entry
    return found


def findings(docs: DataFrame, items: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, item_id, start_token, covered, item_tokens, n_slots,
    changed_slots, kind): one row per contaminated document and item."""
    spark = docs.sparkSession
    sides = cut(_item_rows(items.select(F.col("item_id").cast("long").alias("id"), "text")))
    sizes = sorted((r["size"], r["plain"]) for r in sides.select("size", "plain").distinct().collect())  # at most TOKENS values, twice
    hashes = sides.select("h").distinct()
    known = None
    if hashes.limit(most_sent + 1).count() <= most_sent:
        known = spark.sparkContext.broadcast(np.sort(np.array([r.h for r in hashes.collect()], np.int64).view(np.uint64)))
    hits = _window_rows(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), sizes, known)
    pairs = (hits.select(F.col("id").alias("doc_id"), F.col("pos").alias("at"), "word", "plain", "h", F.col("slots").alias("theirs"))
             .join(sides.select(F.col("id").alias("item_id"), "pos", "plain", "size", "h", F.col("slots").alias("ours"), "tokens"), ["h", "plain"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, ["doc_id", "item_id"]):
            groups = defaultdict(lambda: ([], []))
            for r in table.to_pylist():
                groups[r["doc_id"], r["item_id"]][r["plain"]].append(r)
            rows = []
            for (doc, item), kinds in groups.items():
                found = [b for hits in kinds if hits and (b := _judged(hits))]
                if found:
                    covered, same, n_slots, first, tokens = max(found, key=lambda b: (b[0] / b[4], *b[1:]))
                    rows.append((doc, item, -first, covered, tokens, n_slots, -same, "exact" if same == 0 else "reparameterised"))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7])],
                                                 ["doc_id", "item_id", "start_token", "covered", "item_tokens", "n_slots", "changed_slots", "kind"])

    return (pairs.repartition("doc_id", "item_id").sortWithinPartitions("doc_id", "item_id")
            .mapInArrow(run, "doc_id long, item_id long, start_token long, covered long, item_tokens long, n_slots long, changed_slots long, kind string"))


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item."""
    return without(docs, cut(findings(docs, items).select("doc_id").distinct()), "doc_id")
