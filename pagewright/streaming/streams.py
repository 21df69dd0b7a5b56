"""Structured Streaming forms of the continuous operators.

Each function takes a *streaming* DataFrame and returns a streaming
DataFrame; the aggregate expressions are the same ones the batch operators
use, so a stream run in complete mode equals the batch result.

* T01 running metric summaries: ``groupBy(provider, metric)`` with count,
  avg, min, max and ``max_by(value, struct(ts, seq))`` kept as streaming
  state (bounded by the number of metric series, not by the rows).
* T02 error-rate alerts and T04 dashboard series: event-time tumbling
  windows behind a watermark, so state for closed windows is dropped and
  append mode emits each window once, when it is final.
* T03 budget alerts: month-to-date spend per month in update mode.
* T08 duplicates: ``dropDuplicatesWithinWatermark`` on the event key.
* T06 pacing: ``maxFilesPerTrigger`` plus a processing-time trigger.
* S08 document arrivals: a file-source stream (``binaryFile``/``json``/
  ``parquet``) run with ``availableNow`` for back-fills.

Checkpoints go to the shared folder the session names in
``spark.checkpoint.dir`` (see ``session.checkpoint_dir``), one sub-folder
per query, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as K
from ..operators import metrics as M
from ..session import checkpoint_dir


# sources -----------------------------------------------------------------------
def table_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                 files_per_trigger: int | None = None) -> DataFrame:
    """A file-source stream over a folder of ``fmt`` files (schema given, no
    inference).  ``files_per_trigger`` paces micro-batches (T06)."""
    r = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(files_per_trigger))
    return r.load(path)


def document_arrivals(spark: SparkSession, path: str, fmt: str = "binaryFile",
                      files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """Newly arrived documents under ``path``; with ``binaryFile`` the
    columns are path, modificationTime, length, content."""
    r = spark.readStream.format(fmt)
    if fmt == "binaryFile":
        r = r.schema("path string, modificationTime timestamp, length bigint, content binary")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(files_per_trigger))
    return r.load(path)


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ); the session zone is UTC,
    so the cast keeps wall-clock values."""
    if dict(df.dtypes).get(ts) == "timestamp_ntz":
        return df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df


# operators ---------------------------------------------------------------------
def metric_summary_stream(metrics: DataFrame, by=("provider", "metric")) -> DataFrame:
    """T01 (+A01/W07): running summaries; run in complete or update mode."""
    return M.metric_summary(metrics, by=by)


def deduplicate(events: DataFrame, key: str = "event_id", ts: str = "ts",
                watermark: str = K.STREAM_WATERMARK) -> DataFrame:
    """Drop re-delivered events; state kept only within the watermark."""
    return event_time(events, ts).withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def error_rate_stream(logs: DataFrame, ts: str = "ts", by: str = "service_name",
                      window_seconds: int = K.ERROR_RATE_WINDOW_SECONDS,
                      threshold_per_second: float = K.ERROR_RATE_THRESHOLD_PER_SECOND,
                      watermark: str = K.STREAM_WATERMARK, only_firing: bool = False) -> DataFrame:
    """Per window and label, ERROR-and-above count as a per-second rate."""
    s = event_time(logs, ts).withWatermark(ts, watermark)
    out = M.error_rate_windows(s, ts=ts, by=by, window_seconds=window_seconds,
                               threshold_per_second=threshold_per_second)
    return out.where("firing") if only_firing else out


def dashboard_stream(calls: DataFrame, ts: str = "ts", window_seconds: int = K.ERROR_RATE_WINDOW_SECONDS,
                     value: str = "cost", watermark: str = K.STREAM_WATERMARK, by=None) -> DataFrame:
    """Request count, errors, error rate, mean/max value per window."""
    s = event_time(calls, ts).withWatermark(ts, watermark)
    return M.dashboard_series(s, ts=ts, window_seconds=window_seconds, latency=value, by=by)


def budget_stream(costs: DataFrame, monthly_budget: float, ts: str = "ts", cost: str = "cost",
                  thresholds=K.BUDGET_GCP_THRESHOLDS) -> DataFrame:
    """Month-to-date spend per month (update mode) and which of the
    thresholds it has passed (strict ``>``)."""
    s = event_time(costs, ts)
    g = s.groupBy(F.date_trunc("month", F.col(ts)).alias("month")).agg(
        F.sum(cost).alias("month_to_date"), F.max(ts).alias("last_event"))
    cols = [(F.col("month_to_date") > F.lit(float(t) * float(monthly_budget))).alias(f"over_{int(round(t * 100))}pct")
            for t in thresholds]
    return g.select("month", "month_to_date", "last_event", *cols)


def health_stream(status: DataFrame, by=("provider", "service_name"), order=("ts", "event_id")) -> DataFrame:
    """J05 as running state: latest status per service."""
    return M.latest_status(status, by=by, order=order)


# running -----------------------------------------------------------------------
def start(df: DataFrame, name: str | None = None, mode: str = "complete", sink: str = "memory",
          path: str | None = None, available_now: bool = True, processing_time: str | None = None,
          checkpoint: str | None = None) -> StreamingQuery:
    """Start a query with a checkpoint in the shared folder.

    ``available_now``: process everything present, then stop (back-fills,
    tests).  ``processing_time`` (e.g. '1 second'): paced micro-batches (T06); a
    query that does not stop by itself has the usual pause between batches.
    """
    name = name or f"pw_{uuid.uuid4().hex[:8]}"
    ckpt = checkpoint or f"{checkpoint_dir(df.sparkSession).rstrip('/')}/streams/{name}"
    w = df.writeStream.outputMode(mode).option("checkpointLocation", ckpt)
    if sink == "memory":
        w = w.format("memory").queryName(name)
    else:
        w = w.format(sink)
        if path:
            w = w.option("path", path)
    if not processing_time and not available_now:
        processing_time = f"{round(K.BATCH_PAUSE_SECONDS * 1000)} milliseconds"
        # Spark's ticks are whole multiples of the pause: started between two, the second batch would come after less than one
        time.sleep(K.BATCH_PAUSE_SECONDS - time.time() % K.BATCH_PAUSE_SECONDS)
    if processing_time:
        w = w.trigger(processingTime=processing_time)
    elif available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def run_to_table(df: DataFrame, name: str | None = None, mode: str = "complete", timeout_s: int = 600) -> DataFrame:
    """Run a stream with ``availableNow`` into the memory sink and return the
    result table (for tests and small back-fills)."""
    name = name or f"pw_{uuid.uuid4().hex[:8]}"
    q = start(df, name=name, mode=mode)
    q.awaitTermination(timeout_s)
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return df.sparkSession.table(name)
