"""Repeated passages across documents by collinear chaining of word k-mers.

1. Seeds: one k-mer in ``SAMPLE`` by its own hash, whatever stands around it, so
   an edited passage keeps the seeds of its untouched places; of ``FILL``
   k-mers in a row without one, the least.  A seed carries one bit of each of
   the ``SIDE`` words left and right of it.  Words are lower-cased in A-Z.
2. Partners: an occurrence is matched with the first, the second and the
   directly preceding document of its k-mer, of those with the same left side
   and of those with the same right side, if a side agrees in ``AGREE`` bits.  So
   a passage in thousands of documents gives matches in proportion to its
   occurrences, never the pairs among them, and a document that has a fragment
   of a passage does not stand between two that have all of it.  A task first
   matches what it has itself and sends three documents of each group on: one
   shuffle of the seeds, and a group of copies arrives combined.
3. Matches of one (document, owner) are chained: ordered by position in the
   document, each takes the best predecessor to its left in both texts, found
   in a Fenwick tree of prefix maxima over the owner's positions.  A chain's
   score is the words its seeds cover less ``GAP_COST`` per word of distance, so
   that far seeds start a chain of their own.
4. Every chain is aligned, one of a single seed too: its words (16 bits of each
   hash, ``REACH`` words more on both sides) are cut out where the document's
   words are and sent to where the owner's are; outwards from the chain while
   words agree, over small insertions and deletions; between seeds by the
   longest common subsequence of the gap.  A passage has ``MIN_WORDS`` words,
   ``SIMILARITY`` of which agree; a chain below that is cut at its worst gap.
5. With at most four documents of equal left side, each of which has it once,
   a seed meets all of them.  Where all seeds of a place have more, and some
   word of it is in no passage yet, every window of ``MIN_WORDS`` words is hashed, there and at all other
   places of these seeds.  Each window has its own owner; windows that follow
   one another on one diagonal are one passage.  So every run of ``MIN_WORDS``
   equal words is reported.

What memory a task needs: one batch of texts and ``CHUNK`` seeds; ``HELD``
matched rows (a larger group of one k-mer is taken in parts that leave groups
of equal left side whole); the words of one document; chains of a document with
very many are dealt to several tasks, each with its words.

Defined cases: null and short texts have no passage; null doc_ids are left
out; documents that share a doc_id are one document (a passage is not compared
with itself); repeated rows of a document repeat nothing; of passages inside one
another the widest stays; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .jobs import cut, groups_of, parted

K = 4
SAMPLE = 6           # one k-mer in so many is a seed
FILL = 24            # k-mers in a row that have a seed at least
SIDE = 16            # words on either side of a seed of which it carries a bit
AGREE = 13           # bits of one side that agree in a match
GAP_COST = 0.1
MIN_WORDS = 50
SIMILARITY = 0.8
LEAST_TEXT = 40      # words; a shorter text can't hold either side of a passage
REACH = 96           # words taken on both sides of a chain, for its ends
CHUNK = 1 << 19      # seeds that a task matches by itself at a time
HELD = 1 << 20
SENT = 3             # documents of a group that a task sends on
DEALT = 20000        # chains of one document that one task aligns
BESIDE = 4096        # words of a document whose chains with one owner are aligned in one task
_NEAR = 32           # words between seeds of one segment
_MORE = 1 << 30      # mark in a position: the task had more documents of equal left side


def _seed_rows(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash, sides) of the seeds of a slice."""
    kmers = W.window_hashes(words.hashes, K)
    size = np.diff(words.bounds)
    row = np.repeat(np.arange(words.n_texts), size)
    if not len(kmers):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(0, np.int32)
    inside = (row[:len(kmers)] == row[K - 1:]) & (size[row[:len(kmers)]] >= LEAST_TEXT)
    picked = inside & (kmers % np.uint64(SAMPLE) == 0)
    chosen = [np.flatnonzero(picked)]
    if len(kmers) >= FILL:
        sums = np.concatenate([[0], np.cumsum(picked)])
        ends = np.concatenate([[0], np.cumsum(inside)])
        bare = np.flatnonzero((sums[FILL:] == sums[:-FILL]) & (ends[FILL:] - ends[:-FILL] == FILL) & (row[:len(kmers) - FILL + 1] == row[FILL - 1:len(kmers)]))
        for lo in range(0, len(bare), 1 << 15):  # a few windows in a hundred
            some = bare[lo:lo + (1 << 15)]
            chosen.append(np.unique(some + kmers[some[:, None] + np.arange(FILL)].argmin(1)))
    at = np.unique(np.concatenate(chosen))
    h, pos = kmers[at], at - words.bounds[row[at]]
    none = np.zeros(SIDE, np.uint32)
    code, width = np.concatenate([none, (words.hashes >> np.uint64(40)).astype(np.uint32) & 1, none, none]), 1
    while width < SIDE:  # code[i]: bits of the words i - SIDE .. i - 1
        code = code[:len(code) - width] | (code[width:] << np.uint32(width))
        width *= 2
    whole = np.uint32((1 << SIDE) - 1)  # words beyond the text count as 0
    before, after = (np.minimum(x, SIDE).astype(np.uint32) for x in (pos, size[row[at]] - pos - K))
    left = code[at] & ((whole << (np.uint32(SIDE) - before)) & whole)
    right = code[at + SIDE + K] & ((np.uint32(1) << after) - np.uint32(1))
    of, sides = row[at], ((left << np.uint32(SIDE)) | right).view(np.int32)
    # in text of a short period a seed comes again and again with equal sides: one in SIDE words is
    # enough, and of one word over and over the ends
    by = np.lexsort((pos, sides, h, of))
    o, k, e, p = of[by], h[by], sides[by], pos[by]
    near = (o[1:] == o[:-1]) & (k[1:] == k[:-1]) & (e[1:] == e[:-1]) & (np.diff(p) <= SIDE)
    block = p // SIDE
    keep = np.ones(len(at), bool)
    keep[by[1:-1][near[1:] & near[:-1] & ((block[1:-1] == block[:-2]) | (p[2:] - p[:-2] == 2))]] = False
    return of[keep], pos[keep], h[keep], sides[keep]


_BITS = np.array([bin(i).count("1") for i in range(1 << SIDE)], np.int8)


def _ranked(key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """(order, group's first document row, document's first row, rank of the
    document in its group, documents of the group, whether one of them has
    several places in it, whether its first one has) of the rows in that order."""
    order = np.lexsort((pos, doc, key))
    k, d, p = key[order], doc[order], pos[order]
    new_group = np.concatenate([[True], k[1:] != k[:-1]])
    new_doc = new_group | np.concatenate([[True], d[1:] != d[:-1]])
    group = np.cumsum(new_group) - 1
    document = np.cumsum(new_doc) - 1
    first_of_doc = np.flatnonzero(new_doc)
    first_doc = document[np.flatnonzero(new_group)]  # number of each group's first document
    docs_in = np.diff(np.append(first_doc, len(first_of_doc)))
    again = np.concatenate([[False], p[1:] != p[:-1]]) & ~new_doc
    rank = document - first_doc[group]
    several, first_several = (np.bincount(group[x], minlength=len(docs_in)) > 0 for x in (again, again & (rank == 0)))
    return order, first_doc[group], first_of_doc, rank, docs_in[group], several[group], first_several[group]


def _groupings(h: np.ndarray, sides: np.ndarray) -> list[np.ndarray]:
    """Keys of the k-mer, of the k-mer with its left and with its right side;
    the second comes first."""
    side = sides.view(np.uint32)
    with np.errstate(over="ignore"):
        left = W.mix(h ^ ((side >> np.uint32(SIDE)).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        right = W.mix(h ^ ((side & np.uint32((1 << SIDE) - 1)).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    return [left, h, right]


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a side of two seeds agrees in AGREE bits."""
    x = a.view(np.uint32) ^ b.view(np.uint32)
    return np.minimum(_BITS[x >> np.uint32(SIDE)], _BITS[x & np.uint32((1 << SIDE) - 1)]) <= SIDE - AGREE


_MATCH = ["g", "doc_id", "pos", "owner", "owner_pos", "lead"]


def _matched(h: np.ndarray, sides: np.ndarray, doc: np.ndarray, pos: np.ndarray, local: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns of _MATCH, mask of rows to send on).  ``local``: rows of the first
    SENT documents of a group are sent on instead of matched.  An occurrence is
    matched with a partner's first place in the group; of a group in which a
    document has several places all occurrences are leads, those of its first
    document too (as rows whose owner is the document itself)."""
    at = pos & ~_MORE
    send, ranked = np.zeros(len(h), bool), []
    for n, key in enumerate(_groupings(h, sides)):
        ranked.append(_ranked(key, doc, at))
        order, _, _, rank, many, _, _ = ranked[-1]
        if local:
            send[order[rank < SENT]] = True
            if n == 0:  # the mark tells the others that the group is larger than what is sent
                pos[order[(rank == SENT - 1) & (many > SENT)]] |= _MORE
    found = []
    for n, (order, first_doc, first_of_doc, rank, many, several, first_several) in enumerate(ranked):
        if n == 0 and not local:
            itself = order[(rank == 0) & (many > 1) & first_several]
            found.append((itself, itself, np.ones(len(itself), bool)))
        own = np.flatnonzero(rank > 0)
        if local:
            own = own[~send[order[own]]]
        if not len(own):
            continue
        big = np.zeros(len(order), bool)
        if n == 0:
            marked = np.flatnonzero(pos[order] & _MORE)
            more = np.zeros(int(first_doc.max()) + 1, bool)
            more[first_doc[marked]] = True
            big = (many > SENT + 1) | several | more[first_doc] | local
        document = first_doc[own] + rank[own]
        for step, partner in enumerate((first_doc[own], first_doc[own] + np.minimum(1, rank[own] - 1), document - 1)):
            new = np.ones(len(own), bool) if step == 0 else rank[own] >= (2 if step == 1 else 3)
            a, b = order[own[new]], order[first_of_doc[partner[new]]]
            lead = big[own[new]] if n == 0 and step == 0 else np.zeros(len(a), bool)
            ok = lead | _agree(sides[a], sides[b])
            found.append((a[ok], b[ok], lead[ok]))
    if not found:
        none = np.zeros(0, np.int64)
        return [none, none, none, none, none, np.zeros(0, bool)], send
    a, b, lead = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((~lead, at[b], doc[b], at[a], doc[a]))
    a, b, lead = a[by], b[by], lead[by]
    new = np.ones(len(a), bool)  # the same place of a partner by several groupings: once
    new[1:] = (doc[a][1:] != doc[a][:-1]) | (at[a][1:] != at[a][:-1]) | (doc[b][1:] != doc[b][:-1]) | (at[b][1:] != at[b][:-1])
    a, b, lead = a[new], b[new], lead[new]
    g = _groupings(h[a], sides[a])[0].view(np.int64)
    return [g, doc[a], at[a], doc[b], at[b], lead], send


def _arrays(table: pa.Table, names) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def matches(docs: DataFrame) -> DataFrame:
    """(g, doc_id, pos, owner, owner_pos, lead): seeds of documents and where a
    smaller doc_id has the same.  ``lead`` marks one row of each occurrence in a
    group ``g`` (k-mer and left side) of which not all places were met; of the
    group's first document it has the owner doc_id itself."""
    sent = "h long, sides int, doc_id long, pos int, owner long, owner_pos int, lead boolean"
    names = ["h", "sides", "doc_id", "pos", "owner", "owner_pos", "lead"]

    def batch(h, sides, doc, pos, owner=None, owner_pos=None, lead=None) -> pa.RecordBatch:
        null = pa.nulls(len(h))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(sides), pa.array(doc), pa.array(pos.astype(np.int32)),
                                           *(null.cast(t) if v is None else pa.array(v).cast(t) for v, t in ((owner, pa.int64()), (owner_pos, pa.int32()), (lead, pa.bool_())))], names)

    def combine(parts) -> Iterator[pa.RecordBatch]:
        h, sides, doc, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(h):
            return
        found, send = _matched(h, sides, doc, pos, True)
        yield batch(h[send], sides[send], doc[send], pos[send])
        if len(found[0]):  # what is matched here travels as it is
            yield batch(found[0].view(np.uint64), np.zeros(len(found[0]), np.int32), found[1], found[2], found[3], found[4], found[5])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            for words in W.words_of(b.column("text")):
                row, pos, h, sides = _seed_rows(words)
                parts.append((h, sides, ids[row + words.first], pos))
                held += len(h)
                if held >= CHUNK:
                    yield from combine(parts)
                    parts, held = [], 0
        if parts:
            yield from combine(parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
        out = lambda columns: pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)], _MATCH)

        def seeds(table: pa.Table) -> Iterator[pa.RecordBatch]:
            done = table.filter(table.column("owner").is_valid())
            if done.num_rows:
                yield out(_arrays(done, ["h", "doc_id", "pos", "owner", "owner_pos", "lead"]))
            h, sides, doc, pos = _arrays(table.filter(table.column("owner").is_null()), ["h", "sides", "doc_id", "pos"])
            if len(h):
                found, _ = _matched(h.view(np.uint64), sides, doc, pos.astype(np.int64), False)
                if len(found[0]):
                    yield out(found)

        held: list[pa.Table] = []
        for table in groups_of(batches, ["h", "side"]):
            held.append(table)
            if sum(t.num_rows for t in held) < HELD:
                continue
            whole = pa.concat_tables(held)
            h = whole.column("h").to_numpy()
            last = int(np.searchsorted(h, h[-1]))  # rows before the last k-mer; all, if it alone fills the table
            last = last or len(h)
            yield from seeds(whole.slice(0, last))
            held = [whole.slice(last)] if last < len(h) else []
        if held:
            yield from seeds(pa.concat_tables(held))

    rows = docs.select("doc_id", "text").filter("doc_id is not null").mapInArrow(scan, sent).withColumn("side", F.shiftright("sides", SIDE))
    return rows.repartition("h").sortWithinPartitions("h", "side").mapInArrow(meet, "g long, doc_id long, pos int, owner long, owner_pos int, lead boolean")


def owned(found: DataFrame) -> DataFrame:
    """(h, doc_id, pos, owner, owner_pos): the rows (h, doc_id, pos) whose hash
    a smaller doc_id has."""
    owners = (found.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("o"), F.max("doc_id").alias("last"))
              .filter("o.doc_id < last").select("h", F.col("o.doc_id").alias("owner"), F.col("o.pos").alias("owner_pos")))
    return found.join(owners, "h").filter("doc_id <> owner").select("doc_id", "owner", "pos", "owner_pos")


class PrefixMax:
    """Fenwick tree of (value, index) maxima over ranks 0 .. n-1."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, rank: int, value: float, index: int) -> None:
        i, entry = rank + 1, (value, index)
        while i < len(self.best):
            if entry > self.best[i]:
                self.best[i] = entry
            i += i & -i

    def below(self, rank: int) -> tuple[float, int]:
        """The largest entry of ranks under ``rank``."""
        found = (float("-inf"), -1)
        while rank > 0:
            if self.best[rank] > found:
                found = self.best[rank]
            rank -= rank & -rank
        return found


def chains(a: list[int], b: list[int], length: list[int]) -> list[list[int]]:
    """Chains of the segments (a[i], b[i], length[i]), sorted by a: indices in
    order.  Each segment joins the predecessor with the best score (ends left
    of it in both texts), if that beats a chain of its own."""
    n = len(a)
    ends = [y + z for y, z in zip(b, length, strict=True)]
    ranks = sorted(set(ends))
    tree = PrefixMax(len(ranks))
    score, parent = [0.0] * n, [-1] * n
    order = sorted(range(n), key=lambda i: a[i])
    waiting = sorted(range(n), key=lambda i: a[i] + length[i])  # enter the tree when they end left of the current one
    w = 0
    for i in order:
        while w < n and a[waiting[w]] + length[waiting[w]] <= a[i]:
            j = waiting[w]
            tree.put(bisect.bisect_left(ranks, ends[j]), score[j] + GAP_COST * (a[j] + length[j] + ends[j]), j)
            w += 1
        value, j = tree.below(bisect.bisect_right(ranks, b[i]))
        own = float(length[i])
        gain = value - GAP_COST * (a[i] + b[i]) if j >= 0 else 0.0
        if gain > 0:
            score[i], parent[i] = own + gain, j
        else:
            score[i] = own
    taken, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not taken[i]:
            taken[i] = True
            path.append(i)
            i = parent[i]
        if path:
            out.append(path[::-1])
    return out


_CHAIN = "doc_id long, owner long, pos int, stop int, owner_pos int, owner_stop int, anchors array<int>"


def _segments(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Runs of matches on one diagonal as segments (doc, owner, a, b, length)."""
    doc, owner, pos, own = (table.column(c).to_numpy() for c in ("doc_id", "owner", "pos", "owner_pos"))
    diagonal = pos.astype(np.int64) - own
    order = np.lexsort((pos, diagonal, owner, doc))
    doc, owner, pos, own, diagonal = doc[order], owner[order], pos[order], own[order], diagonal[order]
    new = np.ones(len(doc), bool)
    if len(doc) > 1:
        new[1:] = (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]) | (diagonal[1:] != diagonal[:-1]) | (pos[1:] - pos[:-1] > _NEAR)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], owner[first], pos[first], own[first], pos[last] - pos[first] + K


def chained(found: DataFrame) -> DataFrame:
    """(doc_id, owner, pos, stop, owner_pos, owner_stop, anchors): all chains.
    ``anchors`` has (pos, owner_pos, length) of the segments one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, ["doc_id", "owner"]):
            doc, owner, a, b, length = _segments(table)
            out = []
            edges = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1])])) if len(doc) else []
            sides = [*edges, len(doc)]
            a, b, length = a.tolist(), b.tolist(), length.tolist()
            for lo, hi in zip(sides[:-1], sides[1:], strict=True):
                if hi - lo == 1:
                    paths = [[0]]
                else:
                    by = sorted(range(lo, hi), key=a.__getitem__)
                    paths = chains([a[i] for i in by], [b[i] for i in by], [length[i] for i in by])
                    paths = [[by[i] - lo for i in path] for path in paths]
                for path in paths:
                    x, y = lo + path[0], lo + path[-1]
                    out.append((int(doc[lo]), int(owner[lo]), a[x], a[y] + length[y], b[x], b[y] + length[y],
                                [v for i in path for v in (a[lo + i], b[lo + i], length[lo + i])]))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                                 ["doc_id", "owner", "pos", "stop", "owner_pos", "owner_stop", "anchors"])

    return found.repartition("doc_id").sortWithinPartitions("doc_id", "owner").mapInArrow(run, _CHAIN)


def _word_arrays(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, words): 16 bits of the hash of every word of the wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in W.words_of(batch.column("text")):
                short = (words.hashes >> np.uint64(48)).astype(np.uint16)
                got = [short[lo:hi].tobytes() for lo, hi in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(words.first, words.n_texts), pa.array(got, pa.binary())], ["doc_id", "words"])

    texts = parted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null"), wanted, "doc_id")[0]
    return texts.mapInArrow(run, "doc_id long, words binary")


def _beside_words(rows: DataFrame, key: str, arrays: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(words of each row, rows)`` for batches of the rows, with the words of
    their document ``key``.  Rows follow their document's words in a sorted partition; a document
    with more than DEALT rows is dealt to several places, its words to each."""
    many = (rows.groupBy(F.col(key).alias("doc_id")).agg(F.floor(F.count("*") / DEALT).cast("int").alias("__more")).filter("__more > 0"))  # at most 1 / DEALT of the rows
    many = F.broadcast(cut(many))
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema]
    near = F.floor(F.col("pos") / BESIDE)  # near chains of a pair stay together
    spread = F.pmod(F.xxhash64("doc_id", "owner", near), F.coalesce("__more", F.lit(0)) + 1).cast("int")
    mine = (rows.withColumn("__key", F.col(key)).join(many.withColumnRenamed("doc_id", "__key"), "__key", "left")
            .select("__key", spread.alias("__part"), F.lit(1).alias("__kind"), F.lit(None).cast("binary").alias("__words"), *rows.columns))
    texts = (arrays.withColumnRenamed("doc_id", "__key").join(many.withColumnRenamed("doc_id", "__key"), "__key", "left")
             .select("__key", F.explode(F.sequence(F.lit(0), F.coalesce("__more", F.lit(0)))).alias("__part"), F.lit(0).alias("__kind"), F.col("words").alias("__words"),
                     *(F.lit(None).cast(kind).alias(name) for name, kind in kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_of, words, none = None, np.zeros(0, np.uint16), np.zeros(0, np.uint16)
        for batch in batches:
            own, kind = batch.column("__key").to_numpy(), batch.column("__kind").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (kind[1:] != kind[:-1])])).tolist() if len(own) else []
            beside = []
            for lo, hi in zip(edges, [*edges[1:], len(own)], strict=True):
                if kind[lo] == 0:  # rows that share a doc_id: the last one's words
                    key_of, words = own[lo], np.frombuffer(batch.column("__words")[hi - 1].as_py(), np.uint16)
                else:
                    beside += [words if own[lo] == key_of else none] * (hi - lo)
            if beside:
                yield from fn(beside, batch.filter(pa.array(kind == 1)))

    both = mine.unionByName(texts)
    return both.repartition("__key", "__part").sortWithinPartitions("__key", "__part", "__kind", F.length("__words"), "doc_id", "owner").mapInArrow(run, schema)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Words of the longest common subsequence of two gaps."""
    if not len(x) or not len(y):
        return 0
    row = np.zeros(len(y) + 1, np.int64)
    for v in x:
        new = np.maximum(row[1:], row[:-1] + (y == v))
        row[1:] = np.maximum.accumulate(new)
    return int(row[-1])


_STEP = 5            # words that an insertion or deletion at an end has at most
_FAR = np.add.outer(np.arange(_STEP + 1), np.arange(_STEP + 1)) * 8 + abs(np.subtract.outer(np.arange(_STEP + 1), np.arange(_STEP + 1)))


def _extended(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """How far two sides agree from their start, changed, added and missing
    words included: (words of x, words of y, of which agree)."""
    i = j = agree = 0
    while True:
        n = min(len(x) - i, len(y) - j)
        if n > 0:
            same = x[i:i + n] == y[j:j + n]
            gain = (4 * same - 3).cumsum()  # 1 for a word that agrees, -3 for another
            best = int(gain.argmax())
            if gain[best] > 0:
                i, j, agree = i + best + 1, j + best + 1, agree + int(np.count_nonzero(same[:best + 1]))
        # go on behind the shortest step after which three words agree
        grid = x[i:i + _STEP + 3, None] == y[None, j:j + _STEP + 3]
        runs = grid[:-2, :-2] & grid[1:-1, 1:-1] & grid[2:, 2:]
        if not runs.any():
            return i, j, agree
        p, q = divmod(int(np.where(runs, _FAR[:runs.shape[0], :runs.shape[1]], 1 << 20).argmin()), runs.shape[1])
        if not p + q:
            return i, j, agree
        i, j = i + p, j + q


def aligned(x: np.ndarray, x_at: int, y: np.ndarray, y_at: int, anchors: list[int]) -> tuple[int, int, int, int, int]:
    """(pos, stop, owner_pos, owner_stop, agreeing words) of the passage."""
    parts = [(anchors[i] - x_at, anchors[i + 1] - y_at, anchors[i + 2]) for i in range(0, len(anchors), 3)]
    a, b, _ = parts[0]
    back_x, back_y, agree = _extended(x[:a][::-1], y[:b][::-1])
    for k, (p, q, n) in enumerate(parts):
        m = max(min(n, len(x) - p, len(y) - q), 0)
        agree += int((x[p:p + m] == y[q:q + m]).sum())
        if k + 1 < len(parts):
            agree += _gap(x, y, parts[k], parts[k + 1])[0]
    p, q, n = parts[-1]
    ahead_x, ahead_y, more = _extended(x[p + n:], y[q + n:])
    return a - back_x + x_at, p + n + ahead_x + x_at, b - back_y + y_at, q + n + ahead_y + y_at, agree + more


def _gap(x: np.ndarray, y: np.ndarray, one: tuple, other: tuple) -> tuple[int, int]:
    """(agreeing words, words) of the gap between two parts."""
    u, v = x[one[0] + one[2]:other[0]], y[one[1] + one[2]:other[1]]
    agree = int((u == v).sum()) if len(u) == len(v) and len(u) > 200 else _common(u, v)
    return agree, max(len(u), len(v))


def _accepted(found: tuple[int, int, int, int, int]) -> bool:
    a, a2, b, b2, agree = found
    return a2 - a >= MIN_WORDS and agree >= SIMILARITY * max(a2 - a, b2 - b)


def passages_of(x: np.ndarray, x_at: int, y: np.ndarray, y_at: int, anchors: list[int]) -> list[tuple[int, int, int, int, int]]:
    """The accepted passages of a chain.  It is cut at gaps of which not half
    agrees; what is still too unlike is cut again at its worst gap."""
    cells = [tuple(anchors[i:i + 3]) for i in range(0, len(anchors), 3)]
    local = [(p - x_at, q - y_at, n) for p, q, n in cells]
    gaps = [_gap(x, y, one, other) for one, other in zip(local[:-1], local[1:], strict=True)]
    missing = [size - agree for agree, size in gaps]
    edges = [0, *(i + 1 for i, (agree, size) in enumerate(gaps) if size >= 8 and 2 * agree < size), len(cells)]
    todo, out = [(lo, hi) for lo, hi in zip(edges[:-1], edges[1:], strict=True)], []
    while todo:
        lo, hi = todo.pop()
        whole = aligned(x, x_at, y, y_at, [v for cell in cells[lo:hi] for v in cell])
        if _accepted(whole):
            out.append(whole)
        elif hi - lo > 1:
            worst = max(range(lo, hi - 1), key=missing.__getitem__) + 1
            todo += [(lo, worst), (worst, hi)]
    return list(dict.fromkeys(out))


_PASSAGE = "doc_id long, start_word long, end_word long, owner_id long, owner_start long, owner_end long, similarity double"
_PASSAGE_COLUMNS = ["doc_id", "start_word", "end_word", "owner_id", "owner_start", "owner_end", "similarity"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.float64())], _PASSAGE_COLUMNS)


def _chain_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The passages of the chains, as ``passages`` has them."""
    found = cut(chained(found.filter("doc_id <> owner").select("doc_id", "owner", "pos", "owner_pos")))
    ids = found.select("doc_id").unionByName(found.select(F.col("owner").alias("doc_id")))
    arrays = _word_arrays(docs, ids)

    def mine(words: list[np.ndarray], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pos, stop = batch.column("pos").to_numpy(), batch.column("stop").to_numpy()
        at = np.maximum(pos - REACH, 0)
        spans = [w[lo:hi].tobytes() for w, lo, hi in zip(words, at.tolist(), (stop + REACH).tolist(), strict=True)]
        names = ["doc_id", "owner", "pos", "owner_pos", "owner_stop", "anchors"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(at, pa.int32()), pa.array(spans, pa.binary())], [*names, "x_at", "x"])

    def theirs(words: list[np.ndarray], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        doc, owner, pos, stop, anchors, x_at, xs = (batch.column(c).to_pylist() for c in ("doc_id", "owner", "owner_pos", "owner_stop", "anchors", "x_at", "x"))
        for w, d, o, lo, hi, cells, at, x in zip(words, doc, owner, pos, stop, anchors, x_at, xs, strict=True):
            y_at = max(lo - REACH, 0)
            for a, a2, b, b2, agree in passages_of(np.frombuffer(x, np.uint16), at, w[y_at:hi + REACH], y_at, cells):
                rows.append((d, a, a2, o, b, b2, round(agree / max(a2 - a, b2 - b), 6)))
        if rows:  # far seeds of one pair lead to the same passage
            yield _needed(_outermost(_batch(rows), ["doc_id", "owner_id"]))

    spans = _beside_words(found, "doc_id", arrays, mine, "doc_id long, owner long, pos int, owner_pos int, owner_stop int, anchors array<int>, x_at int, x binary")
    return _beside_words(spans, "owner", arrays, theirs, _PASSAGE)


def _places(pos: np.ndarray) -> list[tuple[int, int]]:
    """Where sorted seed positions allow MIN_WORDS equal words: equal words
    have a common seed in every FILL k-mers, of equal left side behind SIDE words."""
    edges = np.flatnonzero(np.diff(pos) > FILL) + 1
    first, last = pos[np.append(0, edges)], pos[np.append(edges, len(pos)) - 1]
    lo, hi = np.maximum(first - SIDE - FILL + 1, 0), last + K + FILL - 1
    return [(int(x), int(y)) for x, y in zip(lo, hi, strict=True) if y - x >= MIN_WORDS]


def _uncovered(lo: int, hi: int, covers: list[tuple[int, int]]) -> np.ndarray:
    """n of the words lo .. lo + n - 1 that are in no cover, n = 0 .. hi - lo."""
    free = np.ones(hi - lo, bool)
    for x, y in covers:
        free[max(x - lo, 0):max(y - lo, 0)] = False
    return np.concatenate([[0], np.cumsum(free)])


def _open_seeds(shared: DataFrame, done: DataFrame) -> DataFrame:
    """(h): seeds of the windows that can be equal and have a seed that is in
    no passage of ``done``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, ["doc_id"]):
            doc, pos, stop, h = (table.column(c).to_numpy() for c in ("doc_id", "pos", "stop", "h"))
            edges = np.flatnonzero(np.diff(doc)) + 1
            out = [np.zeros(0, np.int64)]
            for lo, hi in zip([0, *edges], [*edges, len(doc)], strict=True):
                seed = stop[lo:hi] < 0
                at, own = pos[lo:hi][seed], h[lo:hi][seed]
                covers = list(zip(pos[lo:hi][~seed].tolist(), stop[lo:hi][~seed].tolist(), strict=True))
                for x, y in _places(np.unique(at)) if len(at) else []:
                    free = _uncovered(x, y, covers)
                    inside = (at >= x) & (at + K <= y)
                    q = at[inside]
                    left = np.sort(q[free[q + K - x] > free[q - x]])
                    out.append(own[inside][np.searchsorted(left, q + MIN_WORDS - K, "right") > np.searchsorted(left, q + K - MIN_WORDS)])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)))], ["h"])

    rows = (shared.select("doc_id", "pos", F.lit(-1).alias("stop"), "h")
            .unionByName(done.select("doc_id", F.col("start_word").cast("int").alias("pos"), F.col("end_word").cast("int").alias("stop"), F.lit(0).cast("long").alias("h"))))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, "h long").distinct()


def _windows(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(h, doc_id, pos): every window of MIN_WORDS words around the seeds."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, ["doc_id"]):
            doc, pos = table.column("doc_id").to_numpy(), table.column("pos").to_numpy()
            edges = np.flatnonzero(np.diff(doc)) + 1
            out = [(int(doc[lo]), found) for lo, hi in zip([0, *edges], [*edges, len(doc)], strict=True)
                   if (found := [v for place in _places(np.unique(pos[lo:hi])) for v in place])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int64()), pa.array([f for _, f in out], pa.list_(pa.int32()))], ["doc_id", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column("doc_id").to_numpy(), batch.column("places").to_pylist()
            for words in W.words_of(batch.column("text")):
                hashes = W.window_hashes(words.hashes, MIN_WORDS)
                at, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i in range(words.n_texts):
                    base, end = int(words.bounds[i]), int(words.bounds[i + 1])
                    spans = wanted[words.first + i]
                    for lo, hi in zip(spans[::2], spans[1::2], strict=True):
                        at.append(np.arange(base + lo, min(base + hi, end) - MIN_WORDS + 1))
                        of.append(np.full(len(at[-1]), i))
                at, of = np.concatenate(at), np.concatenate(of)
                # in text of a short period equal windows follow closely: those kept still cover it
                by = np.lexsort((at, hashes[at], of))
                o, k, p = of[by], hashes[at][by], at[by]
                again = (o[1:] == o[:-1]) & (k[1:] == k[:-1]) & (np.diff(p) <= SIDE) & (p[1:] // (MIN_WORDS // 2) == p[:-1] // (MIN_WORDS // 2))
                kept = np.sort(by[np.concatenate([[True], ~again])[:len(by)]])
                at, of = at[kept], of[kept]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(ids[of + words.first], pa.int64()), pa.array((at - words.bounds[of]).astype(np.int32))],
                                                 ["h", "doc_id", "pos"])

    wanted = cut(shared.select("doc_id", "pos").repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(places, "doc_id long, places array<int>"))
    texts = parted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted.select("doc_id"), "doc_id")[0]
    return wanted.join(texts, "doc_id").mapInArrow(run, "h long, doc_id long, pos int")


def _equal_runs(docs: DataFrame, shared: DataFrame, done: DataFrame) -> DataFrame:
    """Runs of MIN_WORDS equal words and more with a word that ``done`` has not."""
    around = shared.join(_open_seeds(shared, done), "h", "left_semi")
    same = owned(cut(_windows(docs, around)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, ["doc_id"]):
            doc, owner, pos, own, stop = (table.column(c).to_numpy() for c in ("doc_id", "owner", "pos", "owner_pos", "stop"))
            edges = np.flatnonzero(np.diff(doc)) + 1
            rows = []
            for lo, hi in zip([0, *edges], [*edges, len(doc)], strict=True):
                new = stop[lo:hi] < 0
                covers = list(zip(pos[lo:hi][~new].tolist(), stop[lo:hi][~new].tolist(), strict=True))
                a, o, b = pos[lo:hi][new], owner[lo:hi][new], own[lo:hi][new]
                if not len(a):
                    continue
                by = np.lexsort((a, a - b, o))
                a, o, b = a[by], o[by], b[by]
                first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (np.diff(a - b) != 0) | (np.diff(a) > MIN_WORDS)]))
                last = np.append(first[1:], len(a)) - 1
                for x, y in zip(first, last, strict=True):
                    n = int(a[y] - a[x]) + MIN_WORDS
                    if _uncovered(int(a[x]), int(a[x]) + n, covers)[-1]:
                        rows.append((int(doc[lo]), int(a[x]), int(a[x]) + n, int(o[x]), int(b[x]), int(b[x]) + n, 1.0))
            if rows:
                yield _batch(rows)

    rows = same.withColumn("stop", F.lit(-1)).unionByName(done.select(
        "doc_id", F.col("owner_id").alias("owner"), F.col("start_word").cast("int").alias("pos"), F.col("owner_start").cast("int").alias("owner_pos"), F.col("end_word").cast("int").alias("stop")))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, _PASSAGE)


def _outermost(table, by: list[str]):
    """The rows without passages that stand inside another one of equal ``by``."""
    start, end = _arrays(table, ["start_word", "end_word"])
    similarity, owner = _arrays(table, ["similarity", "owner_id"])
    keys = _arrays(table, by)
    order = np.lexsort((owner, -similarity, -end, start, *keys[::-1]))
    e = end[order]
    new = np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)])
    # the largest end before each row of its group: ends lifted per group
    lifted = e + (np.cumsum(new) - 1) * (int(e.max()) + 1)
    before = np.concatenate([[-1], np.maximum.accumulate(lifted)[:-1]])
    return table.take(pa.array(np.sort(order[new | (lifted > before)])))


def _needed(table: pa.RecordBatch) -> pa.RecordBatch:
    """The passages without those all of whose words, and all of whose owner's
    words, are in passages of the same pair that stay: text of a short period
    agrees with itself at every shift.  No word of either text loses its pair."""
    columns = _arrays(table, ["doc_id", "owner_id", "start_word", "end_word", "owner_start", "owner_end"])
    order = np.lexsort((columns[2], columns[1], columns[0]))
    doc, owner, start, end, lo, hi = (c[order].tolist() for c in columns)
    keep, p = np.ones(len(doc), bool), 0  # p: the one before that stays; what it and the next one cover stays covered
    for i in range(1, len(doc) - 1):
        n = i + 1
        if (doc[p] == doc[n] and owner[p] == owner[n] and end[p] >= start[n] and end[i] <= max(end[p], end[n])
                and min(lo[p], lo[n]) <= lo[i] and hi[i] <= max(hi[p], hi[n])
                and (max(lo[p], lo[n]) <= min(hi[p], hi[n]) or lo[p] <= lo[i] and hi[i] <= hi[p] or lo[n] <= lo[i] and hi[i] <= hi[n])):
            keep[order[i]] = False
        else:
            p = i
    return table.filter(pa.array(keep))


def _widest(found: DataFrame) -> DataFrame:
    """Without passages that stand inside another one of their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, ["doc_id"]):
            yield from _outermost(table, ["doc_id"]).to_batches()

    return found.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, _PASSAGE)


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, owner_id, owner_start, owner_end,
    similarity): passages that an earlier document has too."""
    found = cut(matches(docs))
    done = cut(_chain_passages(docs, found))
    shared = found.filter("lead").select(F.col("g").alias("h"), "doc_id", "pos").distinct()
    return _widest(done.unionByName(_equal_runs(docs, shared, done)))


def without_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with each passage that an earlier document has cut out of its
    text (blanks around a cut are one line feed); the owner keeps its copy, so
    one stays.  n_chars, where there is one, is counted anew."""
    spans = cut(found.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("__cut_spans")))  # at most the words of one document
    near, far = parted(docs, spans.select("doc_id"), "doc_id")
    joined = near.join(spans.withColumnRenamed("doc_id", "__cut_id"), F.col("doc_id") == F.col("__cut_id"), "left").drop("__cut_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, texts = batch.column("__cut_spans").to_pylist(), batch.column("text")
            touched = [i for i, c in enumerate(cuts) if c]
            new = dict(zip(touched, _cut_texts(texts.take(pa.array(touched, pa.int64())), [cuts[i] for i in touched]), strict=True))
            column = pa.array([new[i] if i in new else v.as_py() for i, v in enumerate(texts)], pa.string())
            columns = [column if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = joined.select(*(f"`{c}`" for c in names), "__cut_spans").mapInArrow(run, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*(f"`{c}`" for c in names))
    return far.unionByName(out)


def _cut_texts(column: pa.Array, cuts: list[list[dict]]) -> Iterator[str]:
    for words in W.words_of(column, lower=False):
        for i in range(words.n_texts):
            base, end = int(words.bounds[i]), int(words.bounds[i + 1])
            drop = np.zeros(end - base, bool)
            for c in cuts[words.first + i]:
                drop[c["start_word"]:c["end_word"]] = True
            kept = np.flatnonzero(~drop)
            runs = np.split(kept, np.flatnonzero(np.diff(kept) > 1) + 1) if len(kept) else []
            yield "\n".join(words.data[words.starts[base + r[0]]:words.ends[base + r[-1]]].tobytes().decode("utf-8", "replace") for r in runs)
