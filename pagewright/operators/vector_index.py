"""Vector index (W02): coarse lists, product codes, exact re-ranking.

* :func:`fit` trains a quantiser on at most ``TRAIN_ROWS`` unit vectors (chosen
  by a hash of the key): a coarse k-means of about ``sqrt(rows)`` lists, and for
  the rest after the list's centre one small code book per slice of components.
* :func:`build` puts *every* row of the corpus in its nearest list with its
  codes (a byte per slice); nothing but codes is stored.
* :func:`search` sends a query to its nearest lists only, to as many as reached
  ``REACHED`` of the true neighbours in the training sample.  A task
  meets a block of a list with a block of the queries that probe it (both block
  numbers come from counted rows), scores codes from tables, and keeps the best
  few; these are re-ranked by their true cosine after an equi-join with the
  corpus.  ``exact=True`` adds a second step: lists whose nearest possible
  member (distance of the centre less the list's radius) could still beat the
  k-th hit are met with their true vectors, so the result is that of ``knn``.

Zero vectors have no direction: they are neither rows nor queries.  Nulls are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..session import reliable_checkpoint
from .retrieval import _top_k

TRAIN_ROWS = 50000   # vectors that train the quantiser, at most
LEAST_PER_LIST = 8   # training vectors per list and per code, at least
CODES = 256
SLICE = 4            # components per code
STEPS = 12
REACHED = 0.95       # share of true neighbours whose lists the probes reach, in the training sample
TRIED = (200, 10)    # training vectors asked for it, and their neighbours
RERANK = 20          # candidates per wanted hit that are re-ranked
BLOCK_ROWS = 50000   # rows of one side in a task


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(STEPS):
        to = _nearest(x, c)[0]
        sums = np.zeros_like(c)
        np.add.at(sums, to, x)
        n = np.bincount(to, minlength=k)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centre, block by block."""
    to, d = np.zeros(len(x), np.int64), np.zeros(len(x))
    size = (c * c).sum(1)
    for lo in range(0, len(x), 4096):
        y = x[lo:lo + 4096]
        part = (y * y).sum(1)[:, None] + size - 2 * y @ c.T
        to[lo:lo + 4096] = part.argmin(1)
        d[lo:lo + 4096] = part.min(1)
    return to, np.maximum(d, 0)


@dataclass
class Quantiser:
    centres: np.ndarray        # lists x dim
    books: list[np.ndarray]    # per slice: codes x components
    edges: np.ndarray          # first component of each slice, and the end
    probes: int                # lists that a query meets

    def code(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        rest = x - self.centres[to]
        return np.stack([_nearest(rest[:, a:b], book)[0] for a, b, book in zip(self.edges[:-1], self.edges[1:], self.books, strict=True)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray, number: int) -> list[np.ndarray]:
        """Per slice the squared distances of the queries to every code of a list."""
        rest = q - self.centres[number]
        return [((rest[:, None, a:b] - book) ** 2).sum(2) for a, b, book in zip(self.edges[:-1], self.edges[1:], self.books, strict=True)]


def train(x: np.ndarray, lists: int) -> Quantiser:
    lists = max(1, min(lists, len(x) // LEAST_PER_LIST or 1))
    centres = _kmeans(x, lists, 1)
    rest = x - centres[_nearest(x, centres)[0]]
    dim = x.shape[1]
    edges = np.append(np.arange(0, dim, SLICE), dim)
    codes = max(1, min(CODES, len(x) // LEAST_PER_LIST or 1))
    books = [_kmeans(rest[:, a:b], codes, int(a) + 2) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return Quantiser(centres, books, edges, _enough(x, centres))


def _enough(x: np.ndarray, centres: np.ndarray) -> int:
    """How many nearest lists reach ``REACHED`` of the true neighbours of some
    training vectors: few where the vectors form clusters, most where they don't."""
    asked, near = x[:TRIED[0]], min(TRIED[1], len(x))
    own = _nearest(x, centres)[0]
    place = np.empty((len(asked), len(centres)), np.int64)
    order = np.argsort((centres * centres).sum(1) - 2 * asked @ centres.T, 1, kind="stable")
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], 1)
    hits = np.argpartition(-(asked @ x.T), near - 1, 1)[:, :near]
    needed = np.sort(np.take_along_axis(place, own[hits], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(REACHED * len(needed))) - 1)]) + 1


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _directed(vec: str) -> Column:
    """Vectors with a direction: not null, no null component, not zero."""
    return F.coalesce(F.exists(vec, lambda x: x != 0) & F.forall(vec, lambda x: x.isNotNull()), F.lit(False))


@dataclass
class VectorIndex:
    quantiser: Quantiser
    codes: DataFrame    # list int, key, code binary
    lists: DataFrame    # list int, n bigint, radius double; one row per list

    def save(self, path: str) -> None:
        """Codes sorted by list, so that a list's rows stand together on disk."""
        spark = self.codes.sparkSession
        self.codes.repartitionByRange("list").sortWithinPartitions("list").write.mode("overwrite").parquet(f"{path}/codes")
        self.lists.write.mode("overwrite").parquet(f"{path}/lists")
        spark.createDataFrame([(pickle.dumps(self.quantiser),)], "model binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/quantiser")

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        model = pickle.loads(spark.read.parquet(f"{path}/quantiser").first().model)  # written by ``save``
        return VectorIndex(model, spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/lists"))


def fit(corpus: DataFrame, key: str, vec: str, lists: int | None = None) -> Quantiser:
    """A quantiser of a bounded sample; fitted in one task, the driver gets the
    centres and code books only."""
    usable = corpus.where(_directed(vec)).select(key, vec)
    n = lists or max(1, round(usable.count() ** 0.5))
    sample = usable.orderBy(F.xxhash64(key), key).limit(TRAIN_ROWS).select(F.col(key).alias("k"), F.col(vec).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        t = pa.Table.from_batches(found).sort_by("k")
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(_unit(t.column("v").combine_chunks()), n))], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").first()
    if found is None:
        raise ValueError("no vector has a direction")
    return pickle.loads(found.model)


def build(corpus: DataFrame, key: str, vec: str, quantiser: Quantiser | None = None) -> VectorIndex:
    """Every row with a direction in its list, with its codes."""
    q = quantiser or fit(corpus, key, vec)
    shared = corpus.sparkSession.sparkContext.broadcast(q)  # lists x dim numbers
    kind = corpus.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit(b.column("v"))
                to, d = _nearest(x, shared.value.centres)
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), b.column("k"), pa.array([c.tobytes() for c in shared.value.code(x, to)], pa.binary()),
                                                  pa.array(np.sqrt(d))], ["list", "k", "code", "d"])

    rows = corpus.where(_directed(vec)).select(F.col(key).alias("k"), F.col(vec).alias("v")).mapInArrow(run, f"list int, k {kind}, code binary, d double")
    rows = reliable_checkpoint(rows)
    lists = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius"))
    return VectorIndex(q, rows.select("list", F.col("k").alias(key), "code"), lists)


def _probes(queries: DataFrame, quantiser: Quantiser, qkey: str, n: int) -> DataFrame:
    """(query, list, place, far): every list by distance of its centre; the
    first ``n`` are probed.  ``n`` rows per query, or all with ``n = 0``."""
    shared = queries.sparkSession.sparkContext.broadcast(quantiser)
    kind = queries.schema[qkey].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value.centres
        most = min(n or len(c), len(c))
        for b in batches:
            if not b.num_rows:
                continue
            q = _unit(b.column("_q"))
            d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (c * c).sum(1) - 2 * q @ c.T, 0))
            order = np.argsort(d, 1, kind="stable")[:, :most]
            at = pa.array(np.repeat(np.arange(len(q)), most))
            yield pa.RecordBatch.from_arrays([b.column("k").take(at), pa.array(order.ravel(), pa.int32()), pa.array(np.tile(np.arange(most), len(q)), pa.int32()),
                                              pa.array(np.take_along_axis(d, order, 1).ravel())], ["k", "list", "place", "far"])

    return queries.select(F.col(qkey).alias("k"), "_q").mapInArrow(run, f"k {kind}, list int, place int, far double").withColumnRenamed("k", qkey)


def _meet(probes: DataFrame, queries: DataFrame, rows: DataFrame, lists: DataFrame, qkey: str, ckey: str, fn, schema) -> DataFrame:
    """``fn(queries block, rows block)`` for every block of a list with every
    block of the queries that probe it; block numbers from counted rows."""
    asked = probes.groupBy("list").agg(F.count(F.lit(1)).alias("_asked"))
    blocks = lambda c: (F.floor(F.col(c) / BLOCK_ROWS) + 1).cast("int")
    dealt = lists.join(asked, "list").select("list", blocks("n").alias("_rb"), blocks("_asked").alias("_qb"))  # one row per probed list
    place = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (probes.select(qkey, "list").join(queries, qkey).join(dealt, "list").withColumn("_qp", place(qkey, F.col("_qb"))).withColumn("_rp", each("_rb")).drop("_rb", "_qb"))
    right = rows.join(dealt, "list").withColumn("_rp", place(ckey, F.col("_rb"))).withColumn("_qp", each("_qb")).drop("_rb", "_qb")
    return left.groupBy("list", "_rp", "_qp").cogroup(right.groupBy("list", "_rp", "_qp")).applyInPandas(fn, schema)


def _cosine(a: str, b: str) -> Column:
    size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (size(a) * size(b))


def search(index: VectorIndex, queries: DataFrame, corpus: DataFrame, qkey: str, ckey: str, vec: str, k: int = K.RETRIEVAL_TOP_K,
           probes: int | None = None, rerank: int = RERANK, exact: bool = False, score_digits: int | None = None) -> DataFrame:
    """(query, key, similarity, rank): k nearest rows by cosine among the probed
    lists; with ``exact`` among all rows.  Ties rank by key."""
    q = index.quantiser
    n = probes or q.probes
    asked = queries.where(_directed(vec)).select(qkey, F.col(vec).alias("_q"))
    first = _probes(asked, q, qkey, n)
    shared = queries.sparkSession.sparkContext.broadcast(q)
    schema = T.StructType([queries.schema[qkey], corpus.schema[ckey], T.StructField("_d", T.DoubleType())])
    most = k * rerank

    def by_codes(left, right):
        import pandas as pd

        out = []
        if len(left) and len(right):
            x = np.stack(left["_q"].to_numpy()).astype(np.float64)
            x /= np.sqrt((x * x).sum(1))[:, None]
            codes = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1)
            keys = right[ckey].to_numpy()
            tables = shared.value.tables(x, int(left["list"].iloc[0]))
            for i, who in enumerate(left[qkey]):
                d = sum(t[i][codes[:, m]] for m, t in enumerate(tables))
                at = np.argpartition(d, most - 1)[:most] if len(d) > most else np.arange(len(d))
                out.append(pd.DataFrame({qkey: who, ckey: keys[at], "_d": d[at]}))
        return pd.concat(out) if out else pd.DataFrame({qkey: [], ckey: [], "_d": []})

    near = _meet(first, asked, index.codes, index.lists, qkey, ckey, by_codes, schema)
    near = _top_k(near.withColumn("_s", -F.col("_d")), qkey, ckey, "_s", most, "_place").select(qkey, ckey)
    score = _cosine("_q", "_c")
    vectors = corpus.select(ckey, F.col(vec).alias("_c"))
    scored = near.join(vectors, ckey).join(asked, qkey).select(qkey, ckey, (F.round(score, score_digits) if score_digits is not None else score).alias("similarity"))
    top = _top_k(scored, qkey, ckey, "similarity", k)
    if not exact:
        return top
    top = reliable_checkpoint(top)
    # the k-th hit bounds how far a list's nearest member may be: |a - b|^2 = 2 - 2 cos
    bound = top.groupBy(qkey).agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("_least"))
    slack = 1e-6
    reach = F.when(F.col("_least").isNull(), F.lit(4.0)).otherwise(F.sqrt(F.greatest(2 - 2 * F.col("_least"), F.lit(0.0))) + slack)
    rest = (_probes(asked, q, qkey, 0).join(index.lists.select("list", "radius"), "list").join(bound, qkey, "left")
            .where(F.col("far") - F.col("radius") <= reach).select(qkey, "list"))
    rows = index.codes.select("list", ckey).join(vectors, ckey)
    pair = T.StructType([queries.schema[qkey], corpus.schema[ckey], T.StructField("similarity", T.DoubleType())])

    def by_vectors(left, right):
        import pandas as pd

        out = []
        if len(left) and len(right):
            right = right.sort_values(ckey, kind="stable")
            units = [np.stack(p[c].to_numpy()).astype(np.float64) for p, c in ((left, "_q"), (right, "_c"))]
            a, b = (u / np.sqrt((u * u).sum(1))[:, None] for u in units)
            keys = right[ckey].to_numpy()
            for who, v in zip(left[qkey], a, strict=True):
                s = b @ v
                s = np.round(s, score_digits) if score_digits is not None else s
                at = np.argsort(-s, kind="stable")[:k]
                out.append(pd.DataFrame({qkey: who, ckey: keys[at], "similarity": s[at]}))
        return pd.concat(out) if out else pd.DataFrame({qkey: [], ckey: [], "similarity": []})

    more = _meet(rest, asked, rows, index.lists, qkey, ckey, by_vectors, pair)
    both = top.select(qkey, ckey, "similarity").unionByName(more).groupBy(qkey, ckey).agg(F.max("similarity").alias("similarity"))
    return _top_k(both, qkey, ckey, "similarity", k)
