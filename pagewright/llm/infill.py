"""Fill-in-the-middle transformation over an indexable skip list.

A text is a sequence of *units*: runs of A-Z and a-z, and every other code
point by itself.  Two cut ranks split it into prefix, middle and suffix.  The
units of a text stand in a skip list: lane 0 links every unit to the next, an
express lane links a hashed quarter of the nodes of the lane under it, and each
link carries how many units, code points and bytes it jumps.  A cut rank is
reached by descending: go right while the units passed stay within the rank,
else one lane down; the widths added up on the way are the exact unit, code
point and byte position of the cut.  All texts of a slice share the lanes (a
text's head is in every lane, its last node ends every lane), so both cuts of
all texts descend together in numpy.

Every row is independent: no shuffle, and a task holds the lanes of one slice
of about 1 MB of texts (one longer text is a slice of its own, about 30 bytes
of lanes a unit).

Defined cases: a null text counts as empty; an empty text, and a text that
contains a control string, stays plain (its cuts are null); a null id is
written as nothing in the hashed key; repeated rows give repeated results; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_SHARE = 10   # of 100 texts stay as they are
SPM_SHARE = 20     # of 100 cut texts are written suffix first
HEIGHT_BITS = 2    # a node is in the next lane with chance 1 / 4

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = True
_LETTER[97:123] = True


@dataclass
class Lane:
    """One lane of all lists of a slice; node i links to node i + 1 unless it
    is the last of its list."""

    down: np.ndarray    # the same node in the lane below
    units: np.ndarray   # widths of the link to the next node of the lane
    chars: np.ndarray
    bytes: np.ndarray
    last: np.ndarray    # True: no link


class SkipList:
    """Skip lists over the units of consecutive texts of one byte array."""

    def __init__(self, data: np.ndarray, text_at: np.ndarray):
        """``text_at``: n + 1 byte offsets of the n texts in ``data``."""
        n, size = len(text_at) - 1, len(data)
        letter = _LETTER[data]
        lead = (data & 0xC0) != 0x80
        first = lead.copy()
        first[1:] &= ~(letter[1:] & letter[:-1])
        if size:
            first[text_at[:-1][text_at[:-1] < size]] = True
        # nodes: the border before each unit, and one border behind each text's last unit
        at = np.flatnonzero(first).astype(np.int64)
        per_text = np.searchsorted(at, text_at[1:]) - np.searchsorted(at, text_at[:-1])
        self.counts = per_text
        ends = np.cumsum(per_text)
        border = np.insert(at, ends, text_at[1:])
        head = np.cumsum(per_text + 1) - (per_text + 1)
        passed = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])[border] if size else np.zeros(len(border), np.int64)
        last = np.zeros(len(border), bool)
        last[head + per_text] = True
        is_head = np.zeros(len(border), bool)
        is_head[head] = True
        width = lambda x: np.append(np.diff(x), 0).astype(np.int32)
        nodes = np.arange(len(border), dtype=np.int64)
        self.lanes = [Lane(nodes, np.ones(len(border), np.int32), width(passed), width(border), last)]
        self.heads = [head]
        rank = nodes - np.repeat(head, per_text + 1)
        height = W.mix(rank.astype(np.uint64) + np.uint64(0x51ED2701))
        while (~(is_head | last)).any():
            # a text's last node stays in every lane: links never jump over the end of a list
            height >>= np.uint64(HEIGHT_BITS)
            up = is_head | last | ((height & np.uint64((1 << HEIGHT_BITS) - 1)) == 0)
            below, keep = self.lanes[-1], np.flatnonzero(up)
            over = lambda x, b=below, k=keep: np.add.reduceat(np.where(b.last, 0, x), k).astype(np.int32)
            last, is_head, height = last[keep], is_head[keep], height[keep]
            self.lanes.append(Lane(keep, over(below.units), over(below.chars), over(below.bytes), last))
            self.heads.append(np.flatnonzero(is_head))

    def descend(self, of: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code points, bytes, links passed) before unit ``rank`` of list ``of``."""
        at = self.heads[-1][of]
        units, chars, size, steps = (np.zeros(len(of), np.int64) for _ in range(4))
        for level in range(len(self.lanes) - 1, -1, -1):
            lane = self.lanes[level]
            going = np.arange(len(of))
            while len(going):
                here = at[going]
                going = going[~lane.last[here] & (units[going] + lane.units[here] <= rank[going])]
                here = at[going]
                units[going] += lane.units[here]
                chars[going] += lane.chars[here]
                size[going] += lane.bytes[here]
                steps[going] += 1
                at[going] += 1
            at = lane.down[at] if level else at
        if (units != rank).any():
            raise ValueError("a cut rank lies beyond the end of its text")
        return chars, size, steps


_SHAPE = "n long, form string, prefix_chars long, middle_chars long, prefix string, middle string, suffix string"


def _cut_batch(column: pa.Array, h: list[np.ndarray], plain_share: int, spm_share: int) -> Iterator[tuple[int, list[pa.Array]]]:
    raw, at = W.text_buffers(column)
    for lo, hi in W.slices(at):
        data, text_at = raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lists = SkipList(data, text_at)
        n = lists.counts
        a, b = (x[lo:hi] % (n + 1) for x in h[:2])
        of = np.arange(hi - lo)
        chars, size, _ = lists.descend(np.concatenate([of, of]), np.concatenate([np.minimum(a, b), np.maximum(a, b)]))
        c1, c2 = np.split(chars, 2)
        s1, s2 = np.split(size, 2)
        body = data.tobytes()
        texts = [body[i:j] for i, j in zip(text_at[:-1], text_at[1:], strict=True)]
        marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
        plain = np.array([not t or any(m in t for m in marks) for t in texts], bool) | (h[2][lo:hi] % 100 >= 100 - plain_share)
        form = np.where(plain, "plain", np.where(h[3][lo:hi] % 100 < spm_share, "spm", "psm"))
        parts = [[None if p else t[i:j].decode() for t, p, i, j in zip(texts, plain, x, y, strict=True)]
                 for x, y in ((0 * s1, s1), (s1, s2), (s2, np.diff(text_at)))]
        yield lo, [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(c1, pa.int64(), mask=plain), pa.array(c2 - c1, pa.int64(), mask=plain),
                   *(pa.array(p, pa.string()) for p in parts)]


def cuts(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1", plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """(key, text, n, form, prefix_chars, middle_chars, prefix, middle, suffix):
    the three parts of every text.  Both cut ranks, the form and the order come
    from the sha256 of ``seed:key``, so a row's result depends on the row alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    group = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(group(i) for i in range(4)))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(f"h{i}").to_numpy(zero_copy_only=False) for i in range(4)]
            for lo, columns in _cut_batch(batch.column("text"), h, plain_share, spm_share):
                m = len(columns[0])
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(lo, m), batch.column("text").slice(lo, m), *columns],
                                                 ["key", "text", "n", "form", "prefix_chars", "middle_chars", "prefix", "middle", "suffix"])

    return rows.mapInArrow(run, f"key {kind}, text string, {_SHAPE}").withColumnRenamed("key", key)


def output(form: Column, text: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    """The training text: ``<P>prefix<S>suffix<M>middle``, or suffix first."""
    return (F.when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
            .when(form == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(text))


def restored(form: Column, written: Column) -> Column:
    """The exact text from what ``output`` wrote: a cut text holds each control
    string once, so splitting at them gives the three parts back."""
    part = F.split(written, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "psm", F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2))))
            .when(form == "spm", F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))).otherwise(written))


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1", plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every text."""
    c = cuts(docs, key, text, seed, plain_share, spm_share)
    return c.select(key, "n", "form", "prefix_chars", "middle_chars", output(*(F.col(x) for x in ("form", "text", "prefix", "middle", "suffix"))).alias("output"))
