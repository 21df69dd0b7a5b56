"""Near-duplicate classes by bottom-k sketches (one hash function).

Documents are linked when ``den * |A & B| >= num * |A | B|`` for their sets of
distinct k-word shingles (words lower-cased in A-Z); a class is a connected
component of the links, named by its smallest doc_id.

Plan
----
1. One pass turns each whole text into its set, and keeps the set's size, a
   128-bit digest and its bottom-k sketch.  Equal sets collapse to one
   *representative* (smallest doc_id) by a map-side combined minimum, so a
   group of exact copies of any size is one row from here on.
2. The lowest ``INDEXED`` retained values of every representative form
   inverted lists.  Two linked sets share at least ``NEEDED`` of them (bound
   below), so representatives with fewer shared values drop out, and of the
   others only the rarest ``c - NEEDED + 1`` values are indexed: common lines
   and shingles do not build long lists.
3. Each list gives the pairs (most central member, other member): linear in
   the list.  Pairs are filtered by size, by the Jaccard estimate from the bottom
   of the sketch union, and verified on the full sets.
4. Components of the verified links.  Lists whose members all lie in one
   component can add nothing.  The members of every other list pass an exact
   prefix filter on their full sets, which makes pairs between *different*
   components only: first with the least edited member of each list, then,
   between the components that are left, all that the filter lets through.
   These are verified too, so that no link is lost, and further runs of
   components give the classes.

Miss bounds (the only inexact step is the candidate search): a pair at the
threshold .85 shares fewer than 4 of 16 indexed values with probability below
1e-8, and the estimate filter keeps each true pair with probability
1 - 1e-9 (binomial tail, see ``_least_matches``).

Defined cases: null or empty texts have an empty set, link with nothing and
are their own class; texts under k words have one shingle; repeated doc_ids
and rows are all returned (each gets the class of its own text); extra columns
are ignored; an empty table gives an empty result.  doc_id must not be null to
be a class id: rows with a null doc_id get the class of their set's smallest
non-null id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .jobs import components, cut, parted, sweep, without

RETAINED = 64   # values of a sketch, for the estimate
INDEXED = 16    # lowest values of it that have inverted lists
NEEDED = 4      # of the indexed values that two linked sets share at least
ESTIMATE_MISS = 1e-9

_SKETCH = "doc_id long, n long, d1 long, d2 long, low array<long>, sketch binary"


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, d1, d2, low, sketch): set size, digest of the set, lowest
    retained values, and the bottom of the set as big-endian-ordered uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            ids = batch.column("doc_id")
            for words in W.words_of(batch.column("text")):
                n, d, low, bottom = [], [], [], []
                for _, s in W.shingle_sets(words, shingle):
                    n.append(len(s))
                    d.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    low.append(s[:INDEXED].view(np.int64))
                    bottom.append((s[:RETAINED] >> np.uint64(32)).astype(np.uint32).tobytes())
                digest = np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(words.first, words.n_texts).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest[:, 0].copy()),
                     pa.array(digest[:, 1].copy()), pa.array(low, pa.list_(pa.int64())), pa.array(bottom, pa.binary())],
                    ["doc_id", "n", "d1", "d2", "low", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, _SKETCH)


def _least_matches(k: int, share: float) -> int:
    """Most matches m with P(Binomial(k, share) < m) <= ESTIMATE_MISS."""
    tail = 0.0
    for m in range(k + 1):
        tail += math.comb(k, m) * share**m * (1 - share) ** (k - m)
        if tail > ESTIMATE_MISS:
            return m
    return k


def _estimated(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sketches allow a Jaccard of num / den: of the lowest
    RETAINED values of the sketch union, enough lie in both sketches."""
    least = _least_matches(RETAINED, num / den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, nx, ny in zip(batch.column("sx"), batch.column("sy"), batch.column("nx").to_pylist(), batch.column("ny").to_pylist(), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                both = np.sort(np.concatenate([p, q]))
                same = both[1:] == both[:-1]
                union = np.concatenate([both[:1], both[1:][~same]])[:RETAINED]
                shared = int((both[1:][same] <= union[-1]).sum())
                whole = nx <= RETAINED and ny <= RETAINED and len(union) < RETAINED
                keep.append(den * shared >= num * len(union) if whole else shared >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = reps.select("rep", "n", "sketch")
    joined = (pairs.join(side.select(F.col("rep").alias("a"), F.col("n").alias("nx"), F.col("sketch").alias("sx")), "a")
              .join(side.select(F.col("rep").alias("b"), F.col("n").alias("ny"), F.col("sketch").alias("sy")), "b"))
    return joined.select("a", "b", "nx", "ny", "sx", "sy").mapInArrow(run, "a long, b long")


def _sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    for words in W.words_of(column):
        for _, s in W.shingle_sets(words, shingle):
            yield s


def _verified(pairs: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose full sets are linked.  Only texts of documents that
    occur in a pair are moved; both sets of a pair are built where its texts
    meet."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = parted(docs.select("doc_id", "text"), used, "doc_id")[0]  # with a few others, which the joins leave out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for p, q in zip(_sets(batch.column("tx"), shingle), _sets(batch.column("ty"), shingle), strict=True):
                shared = len(np.intersect1d(p, q, assume_unique=True))
                kept.append(den * shared >= num * (len(p) + len(q) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    joined = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("tx")), "a")
              .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("ty")), "b"))
    return joined.select("a", "b", "tx", "ty").mapInArrow(run, "a long, b long")


def _sizes_fit(num: int, den: int):
    return (F.least("na", "nb") * den >= F.greatest("na", "nb") * num)


def _lists(reps: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, n, values): of each representative that can have links, its
    indexed values in the common rarest-first order, and ``need``, how many of
    them a linked partner shares at least."""
    postings = reps.select("rep", "n", F.explode("low").alias("v"))
    shared = postings.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    # sets of at most INDEXED values are indexed whole: a partner holds num / den of
    # them, at most two of which lie beyond the partner's own INDEXED lowest
    need = F.greatest(F.lit(1), F.least(F.lit(NEEDED), F.ceil(F.col("n") * num / den) - 2)).cast("int")
    return (postings.join(shared, "v").groupBy("rep", "n")
            .agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("ordered"))  # at most INDEXED entries
            .select("rep", "n", F.transform("ordered", lambda x: x["v"]).alias("values"), need.alias("need"),
                    F.aggregate("ordered", F.lit(0).cast("long"), lambda t, x: t + x["df"]).alias("weight"))
            .filter(F.size("values") >= F.col("need")))


def _entries(lists: DataFrame) -> DataFrame:
    """(v, rep, n): inverted lists of the rarest values of each representative."""
    first = F.slice("values", F.lit(1), F.size("values") - F.col("need") + 1)
    return lists.select("rep", "n", "weight", F.explode(first).alias("v"))


def _star_pairs(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of each list's most central member (the one whose values are in
    the most sets: of a family of edited copies, the least edited) with every
    other member."""
    leaders = entries.groupBy("v").agg(F.max(F.struct("weight", "rep", "n")).alias("l"), F.count("*").alias("m")).filter("m > 1")
    return (entries.join(leaders, "v").filter("rep <> l.rep")
            .select(F.col("l.rep").alias("a"), F.col("rep").alias("b"), F.col("l.n").alias("na"), F.col("n").alias("nb"))
            .filter(_sizes_fit(num, den)).select("a", "b").distinct())


def _may_link(members: DataFrame, sketched: DataFrame, num: int, den: int) -> DataFrame:
    """The members (rep, component) of whose retained values enough lie in
    sketches of other components: as many as a linked partner would share."""
    least = _least_matches(RETAINED, num / den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(x.as_py(), np.uint32) for x in batch.column("sketch")]
            at = pa.array(np.repeat(np.arange(len(values)), [len(v) for v in values]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("rep", "component", "n")),
                                              pa.array(np.concatenate(values).astype(np.int64) if values else [], pa.int64())], ["rep", "component", "n", "v"])

    held = members.join(sketched, "rep").select("rep", "component", "n", "sketch").mapInArrow(run, "rep long, component long, n long, v long")
    across = held.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("v")
    # a set of RETAINED values or fewer is its own sketch; a little larger partner may retain two fewer
    needed = F.when(F.col("n") < RETAINED, F.least(F.lit(least), F.ceil(F.col("n") * num / den) - 2)).otherwise(least)
    return held.join(across, "v").groupBy("rep", "component", "n").agg(F.count("*").alias("c")).filter(F.col("c") >= needed).select("rep", "component", "n")


def _prefixes(lists: DataFrame, labels: DataFrame, sketched: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(rep, component, n, c, left, v): the shingles at which members of
    different components may still be found linked.

    Only members of *open* lists (more than one component) can be, and of these
    only those whose sketch allows it.  For them an exact prefix filter on the
    full sets follows: a shingle counts for a
    set if a set of another component has it; a set needs ``num / den`` of its
    shingles to count; of its counting shingles, rarest first, a linked pair
    shares one of the first ``c - need + 1``, and where it shares its first,
    the rest of both orders must still suffice."""
    marked = (_entries(lists).join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
              .withColumn("component", F.coalesce("component", "rep")))
    mixed = marked.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("v")
    able = cut(_may_link(marked.join(mixed, "v").select("rep", "component").distinct(), sketched, num, den))
    members = able.withColumnRenamed("rep", "doc_id")
    texts = cut(parted(docs.select("doc_id", "text"), members.select("doc_id"), "doc_id")[0].join(members.select("doc_id", "component"), "doc_id"))
    del marked, mixed
    sweep(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column("doc_id"), batch.column("component")
            for words in W.words_of(batch.column("text")):
                rows, values = [], []
                for i, x in W.shingle_sets(words, shingle):
                    rows.append(np.full(len(x), i))
                    values.append(x.view(np.int64))
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([ids.take(at), parts.take(at), pa.array(np.concatenate(values))], ["rep", "component", "v"])

    full = texts.mapInArrow(run, "rep long, component long, v long")
    counting = full.groupBy("v").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("v", "df")
    need = F.ceil(F.col("n") * num / den)
    ordered = (full.select("rep", "v").join(counting, "v").groupBy("rep")
               .agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("values"))  # at most the doc's own shingles
               .join(members.withColumnRenamed("doc_id", "rep"), "rep").filter(F.size("values") >= need))
    found = cut(ordered.select("rep", "component", "n", F.size("values").cast("long").alias("c"),
                              F.posexplode(F.expr(f"slice(values, 1, size(values) - cast(ceil(n * {num} / {den}) as int) + 1)")).alias("p", "s"))
               .select("rep", "component", "n", "c", (F.col("c") - F.col("p")).alias("left"), F.col("s.v").alias("v")))
    del full, counting, ordered
    sweep(docs.sparkSession, able, texts)
    return found


def _suffice(x: str, y: str, num: int, den: int):
    most = F.least(f"{x}.left", f"{y}.left")
    return most * den >= (F.col(f"{x}.n") + F.col(f"{y}.n") - most) * num


def _central_pairs(prefix: DataFrame, num: int, den: int) -> DataFrame:
    """Of each list, pairs of the member that shares most of its set (the least
    edited of a family) with members of other components."""
    leaders = prefix.groupBy("v").agg(F.max(F.struct((F.col("c") / F.col("n")).alias("share"), "rep", "n", "left", "component")).alias("y"))
    x = prefix.join(leaders, "v").select(F.struct("rep", "n", "left", "component").alias("x"), "y").filter("x.component <> y.component")
    return x.filter(_suffice("x", "y", num, den)).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def _open_pairs(prefix: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of members of different components that share a list."""
    marked = (prefix.drop("component").join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
              .withColumn("component", F.coalesce("component", "rep")))
    mixed = marked.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("v")
    marked = marked.join(mixed, "v")
    x, y = marked.alias("x"), marked.alias("y")
    return (x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.component") < F.col("y.component"))).filter(_suffice("x", "y", num, den))
            .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    sig = cut(sketches(docs, shingle))
    full = sig.filter("n > 0")
    classes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    reps = (full.join(classes.select("d1", "d2", F.col("rep").alias("doc_id")), ["d1", "d2", "doc_id"], "left_semi")
            .select(F.col("doc_id").alias("rep"), "n", "low", "sketch").dropDuplicates(["rep", "n"]))
    lists = cut(_lists(reps, num, den))
    sketched = cut(reps.select("rep", "n", "sketch").join(lists.select("rep").distinct(), "rep", "left_semi"))
    sweep(docs.sparkSession)

    def confirmed(pairs: DataFrame) -> DataFrame:
        likely = cut(_estimated(pairs, sketched, num, den))
        linked = cut(_verified(likely, docs, shingle, num, den))
        sweep(docs.sparkSession, likely)
        return linked

    links = confirmed(_star_pairs(_entries(lists), num, den))
    labels = components(links)
    sweep(docs.sparkSession)
    prefix = _prefixes(lists, labels, sketched, docs, shingle, num, den)
    for pairs in (lambda: _central_pairs(prefix, num, den), lambda: _open_pairs(prefix, labels, num, den)):
        more = confirmed(pairs())
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
            sweep(docs.sparkSession)
    labels = labels.select(F.col("id").alias("rep"), "component")
    named = classes.join(labels, "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    return (sig.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2").join(named, ["d1", "d2"], "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def keep_one(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without the documents that belong to another document's class:
    one document of each group stays.  A doc_id with several rows stays if one
    of them names its class."""
    gone = cut(near_duplicates(docs, shingle, num, den).groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select("doc_id"))
    return without(docs, gone, "doc_id")
