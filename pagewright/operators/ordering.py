"""Order-dependent primitives that stay distributed: global positions and
running sums without an un-partitioned window.

Both sort by a total order (range partitioning; the sampler balances the
ranges even when one key value is hot, because the order key is unique),
number rows inside each sorted partition, and fix each partition up with an
offset derived from one aggregate row per partition.  The offsets table has
one row per partition — bounded by the partition count, not by the data — and
is broadcast.  The sorted data is checkpointed to the shared checkpoint folder
so that recomputation after an executor loss sees the same partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

_LOW33 = (1 << 33) - 1


def _sorted_numbered(df: DataFrame, order_cols, checkpoint: bool) -> DataFrame:
    s = df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id())
    return reliable_checkpoint(s) if checkpoint else s


def _part():
    return F.shiftright(F.col("_mid"), 33)


def with_position(df: DataFrame, order_cols, name: str = "pos", start: int = 0,
                  checkpoint: bool = True, keys_only: bool = False) -> DataFrame:
    """Dense global positions (0-based unless ``start``) in ``order_cols`` order.

    ``order_cols`` must be unique: positions are part of the result.  With
    ``keys_only`` only these (non-null) columns are sorted and checkpointed and
    the other columns are joined back, so no text is moved to number rows.
    """
    if keys_only:
        keys = list(order_cols)
        numbered = with_position(df.select(*keys), keys, name, start, checkpoint)
        return df.join(numbered, keys).select(*df.columns, name)
    s = _sorted_numbered(df, order_cols, checkpoint)
    counts = s.groupBy(_part().alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = s.join(F.broadcast(offsets), _part() == F.col("_p"))
    return out.select(*df.columns,
                      (F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW33)) + F.lit(start))
                      .cast("bigint").alias(name))


def running_sum(df: DataFrame, order_cols, value: str, name: str = "running",
                checkpoint: bool = True) -> DataFrame:
    """Inclusive running sum of ``value`` over the whole frame in ``order_cols`` order.

    Inside a partition the sum is a window partitioned by the (sorted)
    partition id, so each window group is one balanced partition, never one
    hot key.
    """
    s = _sorted_numbered(df, order_cols, checkpoint).withColumn("_p", _part())
    totals = s.groupBy("_p").agg(F.sum(value).alias("_t"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_off"))
    inner = Window.partitionBy("_p").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    local = s.withColumn("_local", F.sum(value).over(inner))
    out = local.join(F.broadcast(offsets), F.col("_p") == F.col("_q"))
    return out.select(*df.columns, (F.col("_off") + F.col("_local")).alias(name))
