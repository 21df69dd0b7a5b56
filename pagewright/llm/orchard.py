"""Centroid clustering with Orchard's nearest-centre search.

Every centroid has the list of all centroids sorted by their distance from it.
A search starts at some centroid and walks the list of the nearest one found so
far: a centroid that is closer becomes the current one and its own list is
walked from the front, centroids that were measured are marked and skipped, and
the walk ends at the first centroid strictly beyond twice the current distance,
because the triangle inequality leaves none closer behind it.  A centroid at
equal distance is never strictly beyond, so ties are seen and go to the smaller
number.  Components are integers and distances are compared squared, so every
comparison is exact.  The rows of a block walk together in numpy; only pairs
that the walk reaches are measured.

Each round is one scan: a task keeps the component sums of its rows (k rows of
numbers), Spark adds them up, and the driver gets k * dim sums.  Rows never
move.  The last assignment (id, cluster, distance) is cut into the checkpoint
folder, from which the inertias are summed.

Defined cases: vectors that are null, of another length, or hold a null or
non-finite component are left out; with fewer rows than ``k`` there are that
many centroids; repeated rows are rows of their own (their start order is by
hash, then by components); a null id is written as nothing in the hashed key;
centroids without rows stay; scaled components beyond +-2**26 count as that
bound, so that four squared distances fit a long; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import cut, prepare

K = 40
ROUNDS = 5
SCALE = 256
BOUND = float(1 << 26)
BLOCK = 1024  # rows that walk together


class Orchard:
    """Sorted neighbour lists over integer centroids (k x dim)."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, np.int64)
        c = self.centroids
        self.between = np.array([((c - x) ** 2).sum(1) for x in c], np.int64).reshape(len(c), len(c))
        number = np.arange(len(c))
        self.lists = np.array([np.lexsort((number, row)) for row in self.between], np.int64).reshape(len(c), len(c))
        self.reach = np.take_along_axis(self.between, self.lists, 1)  # distances along the lists, squared
        self.start = int(self.between.sum(1, dtype=np.float64).argmin()) if len(c) else 0
        # products of small integers are exact in float64, where numpy is faster
        self.small = len(c) == 0 or np.abs(c).max() < 1 << 20
        self.measured = 0

    def _distance(self, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        self.measured += len(rows)
        if self.small and rows.dtype == np.float64:
            gap = rows - self.floats[to]
            return np.einsum("ij,ij->i", gap, gap).astype(np.int64)
        gap = rows.astype(np.int64) - self.centroids[to]
        return (gap * gap).sum(1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of every row of integers."""
        k, n = len(self.centroids), len(rows)
        near, dist = np.full(n, self.start), np.zeros(n, np.int64)
        if not n:
            return near, dist
        small = self.small and np.abs(rows).max(initial=0) < 1 << 20
        self.floats = self.centroids.astype(np.float64)
        for lo in range(0, n, BLOCK):
            block = rows[lo:lo + BLOCK].astype(np.float64 if small else np.int64)
            m = len(block)
            cur, best = near[lo:lo + m], dist[lo:lo + m]
            best[:] = self._distance(block, cur)
            visited = np.zeros((m, k), bool)
            visited[:, self.start] = True
            place = np.zeros(m, np.int64)  # of the list of the current centroid
            going = np.arange(m)
            while len(going):
                at, c = place[going], cur[going]
                inside = at < k
                inside[inside] = self.reach[c[inside], at[inside]] <= 4 * best[going[inside]]
                going, at, c = going[inside], at[inside], c[inside]
                other = self.lists[c, at]
                place[going] += 1
                new = ~visited[going, other]
                row, other = going[new], other[new]
                visited[row, other] = True
                d = self._distance(block[row], other)
                closer = (d < best[row]) | ((d == best[row]) & (other < cur[row]))
                row, other = row[closer], other[closer]
                best[row], cur[row] = d[closer], other
                place[row] = 0
        return near, dist


def usable(vec: str, dim: int):
    """Exactly ``dim`` components, none null or non-finite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vec) == dim) & F.forall(vec, lambda x: good(x.cast("double"))), F.lit(False))


def _integers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(np.clip(flat * scale, -BOUND, BOUND)).astype(np.int64).reshape(-1, dim)


def seeds(rows: DataFrame, key: str, vec: str, k: int, seed: str, dim: int, scale: int) -> np.ndarray:
    """The vectors with the k smallest sha256 of ``seed:key``; k rows reach the driver."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    first = rows.select(digest.alias("h"), F.col(vec).alias("v")).orderBy("h", "v").limit(k).collect()
    flat = np.array([r.v for r in first], np.float64).reshape(len(first), dim)
    return np.floor(np.clip(flat * scale, -BOUND, BOUND)).astype(np.int64)


def moved(rows: DataFrame, vec: str, centroids: np.ndarray, scale: int) -> np.ndarray:
    """One round: the floor of the exact mean of each centroid's rows; one
    without rows stays.  Sums combine per task, then per centroid."""
    k, dim = centroids.shape
    shared = rows.sparkSession.sparkContext.broadcast(centroids)  # k * dim numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, sums, counts = Orchard(shared.value), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _integers(batch.column("v"), dim, scale)
            to, _ = search.nearest(x)
            order = np.argsort(to, kind="stable")
            some, first = np.unique(to[order], return_index=True)
            if len(some):
                sums[some] += np.add.reduceat(x[order], first, axis=0)
                counts += np.bincount(to, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(some)), pa.int32()),
                                          pa.array(sums[some].ravel(), pa.int64()), pa.array(np.repeat(counts[some], dim), pa.int64())], ["c", "i", "s", "n"])

    parts = rows.select(F.col(vec).alias("v")).mapInArrow(run, "c int, i int, s long, n long")
    total = parts.groupBy("c", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for r in total:
        out[r.c, r.i] = int(r.s) // r.n
    return out


def assigned(rows: DataFrame, key: str, vec: str, centroids: np.ndarray, scale: int) -> DataFrame:
    """(key, cluster, distance) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(shared.value)
        for batch in batches:
            to, d = search.nearest(_integers(batch.column("v"), dim, scale))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(to, pa.int32()), pa.array(d, pa.int64())], ["key", "cluster", "distance"])

    kind = rows.schema[key].dataType.simpleString()
    out = rows.select(F.col(key).alias("key"), F.col(vec).alias("v")).mapInArrow(run, f"key {kind}, cluster int, distance long")
    return out.withColumnRenamed("key", key)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", dim: int = 64, k: int = K, rounds: int = ROUNDS, scale: int = SCALE,
            seed: str = "2") -> tuple[DataFrame, np.ndarray]:
    """((key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of
    every usable vector, final centroids)."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(key, vec).filter(usable(vec, dim))
    centroids = seeds(rows, key, vec, k, seed, dim, scale)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(rows, vec, centroids, scale)
    last = cut(assigned(rows, key, vec, centroids, scale))
    per = {r.cluster: int(r.d) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    sums = spark.createDataFrame([(c, d, sum(per.values()), digest(centroids[c])) for c, d in sorted(per.items())],
                                 "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(sums), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
