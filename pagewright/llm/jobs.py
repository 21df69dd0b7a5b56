"""Helpers that the operators of this subpackage share: reliable lineage cuts,
grouped iteration over sorted partitions, connected components."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, read_table, reliable_checkpoint

BUCKETS = 1 << 18
PAUSE = 1.0  # seconds that the events of a finished plan take at most, usually
_MARK = "__bucket"  # a name that no column of a table has

__all__ = ["parted", "without", "cut", "sweep", "groups_of", "components", "text_table", "prepare", "partitions"]


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    return reliable_checkpoint(df)


def sweep(spark: SparkSession, *done: DataFrame) -> None:
    """Give disk back in the middle of a long job: the checkpoints ``done``,
    which nothing reads any more, are deleted, and the shuffle files of finished
    plans go as soon as the driver has collected their handles.  A plan is still
    held by the events of its end for a moment, hence the pause: collected too
    early it would only grow old and stay."""
    for df in done:
        path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if path.isDefined():
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.get())
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()
    time.sleep(PAUSE)
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prepare(spark: SparkSession) -> None:
    """Session settings of the library, and small Arrow batches: rows hold whole texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return read_table(spark, sf_dir, name)


def parted(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may have their ``key`` in ``ids``, rows that surely don't):
    by the ids' hash buckets, without a shuffle of the rows."""
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    some = ids.select(bucket.alias(_MARK)).distinct()
    marked = rows.withColumn(_MARK, bucket)
    return tuple(marked.join(F.broadcast(some), _MARK, how).drop(_MARK) for how in ("left_semi", "left_anti"))


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is not in ``ids``; only possible hits are shuffled."""
    near, far = parted(rows, ids, key)
    return far.unionByName(near.join(ids, key, "left_anti"))


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str], schema: pa.Schema | None = None) -> Iterator[pa.Table]:
    """Tables of whole groups from the batches of a partition that is sorted
    by ``keys``: the rows of the last key of a batch wait for the next batch,
    so no group is ever cut and at most a batch and a group are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.num_rows
        tail = n - 1
        last = [batch.column(k)[n - 1] for k in keys]
        cols = [batch.column(k) for k in keys]
        lo, hi = 0, n - 1  # first row of the last key, by halving: equal keys stand together
        while lo < hi:
            mid = (lo + hi) // 2
            if all(c[mid].equals(v) for c, v in zip(cols, last, strict=True)):
                hi = mid
            else:
                lo = mid + 1
        tail = lo
        if tail:
            yield pa.Table.from_batches([*held, batch.slice(0, tail)])
            held = [batch.slice(tail)]
        elif held and not all(held[0].column(k)[0].equals(v) for k, v in zip(keys, last, strict=True)):
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def components(links: DataFrame, cut_rows: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(id, component) of every id in the links (a, b): the smallest id it is
    connected with.  Large-star and small-star steps in turn (Kiveris et al.,
    2014): every step is a grouped minimum and an equi-join that makes one link
    of each, the links never leave the executors, and each round is cut into
    the checkpoint folder.  Ends when all links go straight to a root."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))))
        edges = cut_rows(small)
        ends = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v")))
        state = ends.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"), F.count("v").alias("k"))
        if state.filter("lo < hi or (k > 0 and k < n)").isEmpty():  # one root each, and no root has a root
            return state.select(F.col("u").alias("id"), F.coalesce("lo", "u").alias("component"))
