"""Metric, health and alert operators.

Every aggregate here is a ``groupBy`` with partial (map-side) aggregation, so a
hot provider, metric or service costs one small partial row per task, not one
task.  Budget crossings (W06) are in ``budget.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .budget import budget_crossings  # noqa: F401
from .quantiles import exact_quantiles


def metric_summary(metrics: DataFrame, by=("provider", "metric"), value: str = "value",
                   order=("ts", "seq")) -> DataFrame:
    """Count, average, min, max and the latest value (append order)."""
    latest = F.max_by(F.col(value), F.struct(*[F.col(c) for c in order]))
    return metrics.groupBy(*by).agg(
        F.count(F.col(value)).cast("bigint").alias("count"),
        F.avg(value).alias("average"), F.min(value).alias("min"), F.max(value).alias("max"),
        latest.alias("latest"))


def latest_status(health: DataFrame, by=("provider", "service_name"), order=("ts", "event_id")) -> DataFrame:
    """Latest status per service (max_by on the append order)."""
    return health.groupBy(*by).agg(
        F.max_by("status", F.struct(*[F.col(c) for c in order])).alias("status"),
        F.max(order[0]).alias("last_seen"))


def health_rollup(status: DataFrame, by=("provider",), rule: str = "any", order=("ts",), failed: str = "raised") -> DataFrame:
    """Overall status from per-service status rows.

    ``rule='any'``: any service not healthy -> degraded, else healthy.
    ``rule='decisive'``: only the model service decides (-> unhealthy);
    other failures are recorded but do not change the overall status.
    ``rule='ordered'``: checks in ``order``; one that is not healthy makes the
    overall status degraded, one that failed itself (``failed`` is true) makes it
    unhealthy, and a later one overwrites an earlier one.  Each check is a table
    from state to state: a healthy one leaves every state, any other sends all
    states to one.  Composed, the last table that is not the identity decides,
    so the composition is a ``max_by`` that combines map-side, without a sort.
    """
    bad = F.coalesce(F.col("status") != K.HEALTHY, F.lit(True))
    if rule == "ordered":
        broken = F.coalesce(F.col(failed), F.lit(False))
        bad = bad | broken
        goes_to = F.when(broken, F.lit(K.UNHEALTHY)).otherwise(F.lit(K.DEGRADED))
        last = F.max_by(goes_to, F.when(bad, F.struct(*order)))  # identities have no place in the order
        overall = F.coalesce(last, F.lit(K.HEALTHY))
    elif rule == "decisive":
        bad = F.col("status") != K.HEALTHY
        flag = F.bool_or((F.col("service_name") == K.VERTEX_DECISIVE_SERVICE) & bad)
        overall = F.when(flag, F.lit(K.UNHEALTHY)).otherwise(F.lit(K.HEALTHY))
    else:
        bad = F.col("status") != K.HEALTHY
        overall = F.when(F.bool_or(bad), F.lit(K.DEGRADED)).otherwise(F.lit(K.HEALTHY))
    return status.groupBy(*by).agg(
        overall.alias("overall_status"),
        F.count(F.lit(1)).cast("bigint").alias("services"),
        F.count_if(bad).cast("bigint").alias("services_not_healthy"))


def provider_comparison(metrics: DataFrame, providers, by="metric", value: str = "value") -> DataFrame:
    """One row per metric, one average column per provider (values listed,
    so the pivot needs no extra pass to find them)."""
    return metrics.groupBy(by).pivot("provider", list(providers)).agg(F.avg(value))


def latency_kpis(calls: DataFrame, latency: str = "latency_ms", by=None, under_ms: float = 1000.0,
                 q: float = 0.95, exact: bool = True) -> DataFrame:
    """Calls, share under ``under_ms``, p50/p95.

    ``exact=True``: the percentiles come from ``quantiles.exact_quantiles`` (no
    buffer of values, whatever the value domain).  ``exact=False``:
    ``percentile_approx`` (bounded sketch), one pass.
    """
    by = list(by or [])
    counts = [F.count(F.lit(1)).cast("bigint").alias("calls"),
              (F.count_if(F.col(latency) < F.lit(float(under_ms))).cast("double") / F.count(F.lit(1))).alias("share_under_1s")]
    if exact:
        whole = calls.groupBy(*by).agg(*counts)
        found = exact_quantiles(calls, by, latency, (0.5, q)).select(*by, F.col("q0").alias("p50_ms"), F.col("q1").alias("p95_ms"))
        if not by:
            from .report import combine_rows

            return combine_rows(whole, found.drop("count"))
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
        return whole.alias("l").join(found.alias("r"), same).select(*[F.col(f"l.{c}").alias(c) for c in by], "calls", "share_under_1s", "p50_ms", "p95_ms")
    return calls.groupBy(*by).agg(
        *counts, F.percentile_approx(latency, 0.5).cast("double").alias("p50_ms"),
        F.percentile_approx(latency, q).cast("double").alias("p95_ms"))


def error_rate_windows(logs: DataFrame, ts: str = "ts", by="service_name", window_seconds: int = K.ERROR_RATE_WINDOW_SECONDS,
                       threshold_per_second: float = K.ERROR_RATE_THRESHOLD_PER_SECOND,
                       severities=K.ERROR_SEVERITIES) -> DataFrame:
    """T02 (batch form): ERROR-and-above rows, summed per tumbling window and
    label, as a per-second rate; ``firing`` when the rate exceeds the limit
    (one full window = "for 300 s")."""
    w = F.window(F.col(ts), f"{window_seconds} seconds")
    g = (logs.where(F.col("severity").isin(*severities))
         .groupBy(w.alias("w"), F.col(by))
         .agg(F.sum("error_count").cast("bigint").alias("errors")))
    rate = F.col("errors").cast("double") / F.lit(float(window_seconds))
    return g.select(F.col("w.start").alias("window_start"), by, "errors", rate.alias("rate_per_second"),
                    (rate > F.lit(float(threshold_per_second))).alias("firing"))


def consecutive_firing(windows: DataFrame, by="service_name", k: int = 2,
                       window_seconds: int = K.ERROR_RATE_WINDOW_SECONDS) -> DataFrame:
    """T02 with a duration of ``k`` windows: runs of consecutive firing
    windows (gap-and-island on the window index), kept when at least ``k``
    long.  Islands are found with a per-label window over *firing windows
    only*, which is already aggregated data (one row per window)."""
    f = windows.where("firing").withColumn("_i", (F.unix_seconds(F.col("window_start").cast("timestamp"))
                                                  / F.lit(window_seconds)).cast("bigint"))
    w = Window.partitionBy(by).orderBy("_i")
    isl = f.withColumn("_g", F.col("_i") - F.row_number().over(w))
    return isl.groupBy(by, "_g").agg(F.min("window_start").alias("first_window"),
                                     F.count(F.lit(1)).cast("bigint").alias("windows")) \
        .where(F.col("windows") >= k).drop("_g")


def percentile_series(calls: DataFrame, value: str, by=(), ts: str = "ts", window: str = "5 minutes", shares=(0.5, 0.95, 0.99)) -> DataFrame:
    """Per window and label the number of requests and exact percentiles
    of a value.  Equal values are counted first, map-side, so a group holds
    its distinct values with their counts, not its rows."""
    w = F.window(F.col(ts), window)
    counted = calls.groupBy(w.alias("w"), *by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    names = [f"p{round(s * 100)}" for s in shares]
    return (counted.groupBy("w", *by).agg(F.sum("_n").cast("bigint").alias("requests"), F.percentile("_v", F.array(*[F.lit(s) for s in shares]), F.col("_n")).alias("_p"))
            .select(F.col("w.start").alias("window_start"), *by, "requests", *[F.col("_p")[i].alias(n) for i, n in enumerate(names)]))


def resource_series(calls: DataFrame, values=("latency_ms", "memory_mb"), by=("service_name",), ts: str = "ts",
                    window_seconds: int = K.ERROR_RATE_WINDOW_SECONDS) -> DataFrame:
    """Per window and label the requests, the error rate, and mean and
    largest value of each series (latency, memory, ...), in one aggregation."""
    w = F.window(F.col(ts), f"{window_seconds} seconds")
    each = [a for v in values for a in (F.avg(v).alias(f"avg_{v}"), F.max(v).alias(f"max_{v}"))]
    g = calls.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).cast("bigint").alias("requests"), F.sum("error_count").cast("bigint").alias("errors"), *each)
    names = [n for v in values for n in (f"avg_{v}", f"max_{v}")]
    return g.select(F.col("w.start").alias("window_start"), *by, "requests", (F.col("errors").cast("double") / F.col("requests")).alias("error_rate"), *names)


def dashboard_series(calls: DataFrame, ts: str = "ts", window_seconds: int = K.ERROR_RATE_WINDOW_SECONDS,
                     latency: str = "cost", by=None) -> DataFrame:
    """Per tumbling window: request count, errors, error rate, mean and max of a value."""
    by = list(by or [])
    w = F.window(F.col(ts), f"{window_seconds} seconds")
    g = calls.groupBy(w.alias("w"), *by).agg(
        F.count(F.lit(1)).cast("bigint").alias("requests"),
        F.sum("error_count").cast("bigint").alias("errors"),
        F.avg(latency).alias("avg_value"), F.max(latency).alias("max_value"))
    return g.select(F.col("w.start").alias("window_start"), *by, "requests", "errors",
                    (F.col("errors").cast("double") / F.col("requests").cast("double")).alias("error_rate"),
                    "avg_value", "max_value")


def retain(df: DataFrame, as_of: str, days: int = K.RETENTION_DAYS, ts: str = "ts") -> DataFrame:
    """Keep rows not older than ``days`` before ``as_of`` (a literal, never
    ``now()``).  The cutoff is a literal of the column's own type, so the
    predicate reaches the Parquet scan as a pushed filter."""
    import datetime as _dt
    cutoff = _dt.datetime.fromisoformat(as_of) - _dt.timedelta(days=int(days))
    return df.where(F.col(ts) >= F.lit(cutoff.isoformat(sep=" ")).cast(df.schema[ts].dataType))


def ts_text(c: Column) -> Column:
    """Timestamps as text for result comparison (no client time-zone shifts)."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
