"""Reproducible shuffle and shards by a Feistel permutation, in DataFrame
functions only.

Rows get global numbers 0 .. N-1 without a global sort: a fixed hash deals
them into buckets, each bucket is ordered by (doc_id, checksum, size), and the
bucket's offset is the sum of the earlier buckets' counts.  The numbers depend on
the data alone, not on partitions.

A Feistel network over a grid of ``a * b >= N`` cells (``a`` and ``b`` about the
square root of N, so fewer than ``a`` cells lie outside) permutes the numbers;
a number that leaves 0 .. N-1 walks on along its cycle until it is back.  The
permuted number p gives shard ``p % shards`` and slot ``p div shards``: shard
sizes differ by one at most, slots have no gaps, and the inverse permutation
finds the row of any (shard, slot) without a lookup table.

Defined cases: a null text has no bytes and checksum 0; null doc_ids come first
in their bucket; repeated rows are numbered one after the other (they are equal,
so any order gives the same rows); extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
WALK = 64            # steps of a walk; beyond them the query fails rather than give a wrong slot
BUCKET_ROWS = 100_000
MIN_BUCKETS = 512
_PRIME = 2147483647


def grid(rows: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    return a, max(1, -(-rows // a))


def _round_keys(seed: int) -> list[tuple[int, int]]:
    keys, x = [], seed * 2 + 1
    for _ in range(ROUNDS):
        x = x * 48271 % _PRIME
        y = x * 48271 % _PRIME
        keys.append((x, y))
        x = y
    return keys


def _mixed(v: Column, key: Column) -> Column:
    """A function of a round: a squared linear form modulo 2**31 - 1."""
    line = (v * key["x"] + key["y"]) % _PRIME
    return (line * line + key["y"]) % _PRIME


def permuted(number: Column, rows: int, seed: int) -> Column:
    """The place of ``number`` (0 .. rows - 1) in the permutation."""
    a, b = grid(rows)
    keys = F.array(*(F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y"), F.lit(i % 2).alias("odd"))
                     for i, (x, y) in enumerate(_round_keys(seed))))

    def step(s: Column, k: Column) -> Column:
        left, right = s["l"], s["r"]
        return F.struct(F.when(k["odd"] == 0, (left + _mixed(right, k)) % a).otherwise(left).alias("l"),
                        F.when(k["odd"] == 1, (right + _mixed(left, k)) % b).otherwise(right).alias("r"))

    def network(x: Column) -> Column:
        whole = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))
        return F.aggregate(keys, whole, step, lambda s: s["l"] * b + s["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), network(number), lambda x, _: F.when(x < rows, x).otherwise(network(x)))
    return F.when(walked < rows, walked).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """((doc_id, size, text_crc32, number), N)."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    total = docs.count()
    buckets = max(MIN_BUCKETS, -(-total // BUCKET_ROWS))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)))
    counts = dealt.groupBy("bucket").agg(F.count("*").alias("n"))  # at most `buckets` rows
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size")
    return (dealt.withColumn("place", F.row_number().over(within)).join(offsets, "bucket")
            .select("doc_id", "size", "text_crc32", (F.col("offset") + F.col("place") - 1).alias("number"))), total


def shards(docs: DataFrame, count: int = 40, seed: int = 1) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    rows, total = numbered(docs)
    placed = rows.withColumn("p", permuted(F.col("number"), total, seed))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("p") % count).cast("int").alias("shard"),
                         F.floor(F.col("p") / count).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def row_number_at(shard: int, slot: int, rows: int, count: int = 40, seed: int = 1) -> int:
    """The global row number that lies at (shard, slot): the network backwards."""
    a, b = grid(rows)
    x = slot * count + shard
    while True:
        left, right = divmod(x, b)
        for i, (kx, ky) in reversed(list(enumerate(_round_keys(seed)))):
            v = right if i % 2 == 0 else left
            line = (v * kx + ky) % _PRIME
            f = (line * line + ky) % _PRIME
            if i % 2 == 0:
                left = (left - f) % a
            else:
                right = (right - f) % b
        x = left * b + right
        if x < rows:
            return x
