"""Quantiles of very many values (A13, T04): exact ones without a group's
values in one place, and sketches that merge.

* :func:`exact_quantiles` selects by histogram refinement.  A pass counts, per
  group and wanted rank, the values of ``BINS`` equal parts of the interval that
  still holds the rank, with each part's smallest and largest value; the part
  with the rank becomes the next interval.  Counting combines map-side, so a
  pass moves at most ``BINS`` rows per task, group and rank, however many values
  there are; a few passes narrow every interval to one value.
* :func:`window_sketches` keeps one mergeable sketch (KLL) per window, which
  :func:`merged` rolls up to hours, days or months without the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

BINS = 512


def _same(by):
    return [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]


def order_statistics(df: DataFrame, by, value: str, wanted: DataFrame) -> DataFrame:
    """(by, rank, value) of the wanted (by, rank, lo, hi): the value with so many
    smaller or equal ones before it, between the group's least and largest."""
    by = list(by)
    values = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    state = reliable_checkpoint(wanted.withColumn("_below", F.lit(0).cast("bigint")))
    done = state.where("lo = hi")
    state = state.where("lo < hi")
    while not state.isEmpty():
        l, r = values.alias("l"), state.alias("r")  # noqa: E741
        near = l.join(r, [*_same(by), F.col("l._v") >= F.col("r.lo"), F.col("l._v") <= F.col("r.hi")]).select(
            *[F.col(f"r.{c}").alias(c) for c in by], "rank", "lo", "hi", "_below", "_v")
        # halves first: the width of an interval of huge values may not be a double
        part = F.least(F.lit(BINS - 1), F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS))
        counted = near.groupBy(*by, "rank", "_below", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("_n").over(Window.partitionBy(*by, "rank").orderBy("_part")) + F.col("_below")  # BINS rows at most
        found = counted.withColumn("_upto", upto).where((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("_n") <= F.col("rank")))
        state = reliable_checkpoint(found.select(*by, "rank", "lo", "hi", (F.col("_upto") - F.col("_n")).alias("_below")))
        done = done.unionByName(state.where("lo = hi"))
        state = state.where("lo < hi")
    return done.select(*by, "rank", F.col("lo").alias("value"))


def exact_quantiles(df: DataFrame, by, value: str, shares) -> DataFrame:
    """(by, count, q0, q1, ...): exact percentiles by linear interpolation
    between order statistics; nulls don't count.  A group without values has a
    count of 0 and null quantiles."""
    one = "_all"
    groups = list(by) or [one]
    rows = df if by else df.withColumn(one, F.lit(1))
    stats = reliable_checkpoint(rows.groupBy(*groups).agg(F.count(value).alias("count"), F.min(F.col(value).cast("double")).alias("lo"), F.max(F.col(value).cast("double")).alias("hi")))
    place = [(F.col("count") - 1) * F.lit(float(s)) for s in shares]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in place])))
    wanted = stats.where("count > 0").select(*groups, F.explode(ranks).alias("rank"), "lo", "hi")
    found = order_statistics(rows, groups, value, wanted)
    by_rank = found.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))  # two per share
    l, r = stats.alias("l"), by_rank.alias("r")  # noqa: E741
    joined = l.join(r, _same(groups), "left").select(*[F.col(f"l.{c}").alias(c) for c in groups], "count", "_at")
    columns = []
    for i, p in enumerate(place):
        lower, upper = F.floor(p), F.ceil(p)
        a, b = F.try_element_at("_at", lower), F.try_element_at("_at", upper)
        columns.append(F.when(F.col("count") > 0, F.when(lower == upper, a).otherwise((upper - p) * a + (p - lower) * b)).alias(f"q{i}"))
    out = joined.select(*groups, "count", *columns)
    return out if by else out.drop(one)


def window_sketches(rows: DataFrame, value: str, by=(), ts: str = "ts", window: str = "5 minutes") -> DataFrame:
    """(window_start, by, requests, sketch): one mergeable sketch per window."""
    w = F.window(F.col(ts), window)
    return (rows.groupBy(w.alias("w"), *by).agg(F.count(value).alias("requests"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("sketch"))
            .select(F.col("w.start").alias("window_start"), *by, "requests", "sketch"))


def merged(sketches: DataFrame, unit: str, by=()) -> DataFrame:
    """Sketches of the same hour, day, month, ... as one; no row is read again."""
    return (sketches.groupBy(F.date_trunc(unit, "window_start").alias("window_start"), *by)
            .agg(F.sum("requests").alias("requests"), F.kll_merge_agg_double("sketch").alias("sketch")))


def estimated(sketches: DataFrame, shares=(0.5, 0.95, 0.99)) -> DataFrame:
    """The quantiles that the sketches estimate, as columns p50, p95, ..."""
    names = [f"p{round(s * 100)}" for s in shares]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"],
                           *[F.when(F.col("requests") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(s)))).alias(n) for s, n in zip(shares, names, strict=True)])
