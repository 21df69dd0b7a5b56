"""Alerts as event streams: state machines over closed windows.

Both alerts are two chained stateful steps.  The first is a tumbling-window sum
behind a watermark (combined map-side, spread over all windows and labels); in
append mode a window leaves it once, when it is final.  The second is a
``transformWithStateInPandas`` machine per label or month that sees only those
final windows, a few rows each; its event-time timers fire when the watermark
passes the next window, and its state goes when the alert ends.

* T02: a run of consecutive windows over the limit is *pending* until it has
  ``k`` windows, then *firing*; when the watermark has passed the window after
  its last one, it is *resolved* (or *cleared*, if it never fired).
* T03: hourly sums per month tell which hours can hold a rule's first crossing
  (the bounds of ``operators.budget``); the sink opens only these hours of the
  stored costs and appends each crossing once.

Sinks write one folder per batch id and overwrite it when a batch is repeated,
so a restart from the checkpoint emits nothing twice.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as K
from ..operators import budget as B
from ..operators import metrics as M
from .streams import event_time

TRANSITIONS = "service_name string, state string, first_window timestamp, last_window timestamp, windows bigint"
OPENED = "month timestamp, hour timestamp, s decimal(38,10), before decimal(38,10)"


def use_rocksdb(spark: SparkSession) -> None:
    """``transformWithState`` needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# -- T02 ------------------------------------------------------------------------
class SustainedAlert(StatefulProcessor):
    """State of a label: the current run of windows (first, last, number), or none."""

    def __init__(self, k: int, window_seconds: int):
        self.k, self.width = k, window_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "first bigint, last bigint, windows bigint")

    def _row(self, key, state: str, first: int, last: int, n: int) -> dict:
        return {"service_name": key[0], "state": state, "first_window": pd.Timestamp(first, unit="s"), "last_window": pd.Timestamp(last, unit="s"), "windows": n}

    def _end(self, key, run) -> dict:
        return self._row(key, "resolved" if run[2] >= self.k else "cleared", *run)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        starts = sorted(int(s) for pdf in rows for s in pdf["start"])
        run, out = (tuple(self.run.get()) if self.run.exists() else None), []
        old = run
        for s in starts:  # windows reach this step when they are final, so in time order from batch to batch
            if run and s == run[1] + self.width:
                run = (run[0], s, run[2] + 1)
            else:
                if run:
                    out.append(self._end(key, run))
                run = (s, s, 1)
                if self.k > 1:
                    out.append(self._row(key, "pending", *run))
            if run[2] == self.k:
                out.append(self._row(key, "firing", *run))
        if starts:
            self.run.update(run)
            if old:
                self.handle.deleteTimer(self._expiry(old[1]))
            self.handle.registerTimer(self._expiry(run[1]))
        if out:
            yield pd.DataFrame(out)

    def _expiry(self, last: int) -> int:
        return (last + 2 * self.width) * 1000  # end of the window after the last one

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.run.exists():
            run = tuple(self.run.get())
            if self._expiry(run[1]) <= expiredTimerInfo.getExpiryTimeInMs():
                self.run.clear()
                yield pd.DataFrame([self._end(key, run)])

    def close(self) -> None:
        pass


def sustained_alerts(logs: DataFrame, k: int, ts: str = "ts", by: str = "service_name", window_seconds: int = K.ERROR_RATE_WINDOW_SECONDS,
                     threshold_per_second: float = K.ERROR_RATE_THRESHOLD_PER_SECOND, watermark: str = K.STREAM_WATERMARK) -> DataFrame:
    """T02 with a duration of ``k`` windows as a stream of state changes
    (append mode).  Settled runs equal ``consecutive_firing``."""
    use_rocksdb(logs.sparkSession)
    rows = event_time(logs, ts).withWatermark(ts, watermark)
    # no filter here: it would be pushed under the watermark, and quiet rows would not let time pass
    errors = F.sum(F.when(F.col("severity").isin(*K.ERROR_SEVERITIES), F.col("error_count")))
    w = rows.groupBy(F.window(F.col(ts), f"{window_seconds} seconds").alias("w"), F.col(by).alias("service_name")).agg(errors.alias("errors"))
    over = (w.where(F.col("errors") / F.lit(float(window_seconds)) > F.lit(float(threshold_per_second)))
            .select("service_name", F.unix_seconds("w.start").alias("start"), F.window_time("w").alias("closed_at")))
    return over.groupBy("service_name").transformWithStateInPandas(SustainedAlert(k, window_seconds), TRANSITIONS, "append", "EventTime")


def alert_transitions(windows: DataFrame, settled_before, k: int, window_seconds: int = K.ERROR_RATE_WINDOW_SECONDS) -> DataFrame:
    """The same state changes from a table of windows (batch form): windows
    that end by ``settled_before`` count, runs end once the next window has."""
    from pyspark.sql import Window

    width = F.make_dt_interval(secs=F.lit(window_seconds))
    start = F.col("window_start").cast("timestamp")
    f = windows.where("firing").select("service_name", start.alias("start")).where(F.col("start") + width <= settled_before)
    by = Window.partitionBy("service_name").orderBy("start")  # one row per window over the limit
    f = f.withColumn("i", (F.unix_seconds("start") / window_seconds).cast("bigint") - F.row_number().over(by))
    n = F.row_number().over(Window.partitionBy("service_name", "i").orderBy("start"))
    f = f.withColumn("n", n.cast("bigint"))
    runs = f.groupBy("service_name", "i").agg(F.min("start").alias("first_window"), F.max("start").alias("last_window"), F.max("n").alias("windows"),
                                              F.max(F.when(F.col("n") == k, F.col("start"))).alias("fired"))
    state = lambda s, last, n: F.struct(F.lit(s).alias("state"), "first_window", last.alias("last_window"), n.cast("bigint").alias("windows"))
    changes = [F.when(F.lit(k > 1), state("pending", F.col("first_window"), F.lit(1))), F.when(F.col("fired").isNotNull(), state("firing", F.col("fired"), F.lit(k)))]
    over = F.col("last_window") + width + width <= settled_before
    changes += [F.when(over & (F.col("windows") >= k), state("resolved", F.col("last_window"), F.col("windows"))),
                F.when(over & (F.col("windows") < k), state("cleared", F.col("last_window"), F.col("windows")))]
    return runs.select("service_name", F.explode(F.array_compact(F.array(*changes))).alias("x")).select("service_name", "x.*")


# -- T03 ------------------------------------------------------------------------
class MonthSpend(StatefulProcessor):
    """State of a month: spend of its final hours and which rules are surely past."""

    def __init__(self, rules):
        self.rules = list(rules)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "total string, done bigint, last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        hours = sorted((int(h), Decimal(s), Decimal(p)) for pdf in rows for h, s, p in zip(pdf["hour_s"], pdf["s"], pdf["p"]))
        total, done, last = self.spent.get() if self.spent.exists() else ("0", 0, -1)
        total, out = Decimal(total), []
        month = int(key[0])
        start = dt.datetime.fromtimestamp(month, dt.timezone.utc)
        whole = int((start.replace(year=start.year + start.month // 12, month=start.month % 12 + 1) - start).total_seconds())
        for hour, s, p in hours:
            if hour <= last:
                raise ValueError("an hour came twice")
            opened = False
            share = [max((x - month) / whole, B.LEAST_SHARE) for x in (hour, hour + 3600)]
            for i, (kind, _, limit) in enumerate(self.rules):
                if done >> i & 1:
                    continue
                upper, sure = float(total + p), float(total + s)
                if kind == "forecast":
                    upper, sure = upper / share[upper <= 0], sure / share[sure > 0]
                opened |= upper + B.SLACK * (abs(upper) + 1) > limit
                if sure - B.SLACK * (abs(sure) + 1) > limit:
                    done |= 1 << i
            if opened:
                out.append({"month": pd.Timestamp(month, unit="s"), "hour": pd.Timestamp(hour, unit="s"), "s": s, "before": total})
            total, last = total + s, hour
        self.spent.update((str(total), done, last))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def hours_to_open(costs: DataFrame, rules, ts: str = "ts", cost: str = "cost", watermark: str = K.STREAM_WATERMARK) -> DataFrame:
    """(month, hour, s, before) stream: final hours that can hold the first
    crossing of a rule, with the month's spend before them."""
    use_rocksdb(costs.sparkSession)
    base = event_time(costs, ts).withWatermark(ts, watermark).select(F.col(ts), F.col(cost).cast("decimal(28,10)").alias("cost"))
    h = B.hour_sums(base.withColumn("w", F.window(ts, "1 hour")), by=("w",))
    hours = h.select(F.unix_seconds(F.date_trunc("month", F.col("w.start"))).alias("month_s"), F.unix_seconds("w.start").alias("hour_s"),
                     F.col("s").cast("string").alias("s"), F.col("p").cast("string").alias("p"), F.window_time("w").alias("closed_at"))
    return hours.groupBy("month_s").transformWithStateInPandas(MonthSpend(rules), OPENED, "append", "EventTime")


CROSSINGS = "month timestamp, kind string, threshold double, crossed_at timestamp, event_id bigint, month_to_date double, compared_value double"


def crossing_sink(path: str, stored: Callable[[], DataFrame], rules, ts: str = "ts", cost: str = "cost", tiebreak: str = "event_id") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: opens the batch's hours in the stored costs,
    finds the exact first rows and writes those of rules that no earlier batch
    has told (a few rows per month) to ``path/batch=<id>``."""

    def write(opened: DataFrame, batch_id: int) -> None:
        spark = opened.sparkSession
        opened = opened.persist()
        try:
            if opened.isEmpty():
                return
            rows = B.prepared(stored(), ts, cost, tiebreak)
            found = B.first_rows(B.spend_in(rows, opened), rules)
            told = crossings(spark, path).where(F.col("batch") < batch_id).select("month", "kind", "threshold")
            new = found.join(told, ["month", "kind", "threshold"], "left_anti")
            new.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in CROSSINGS.split(", ")]).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            opened.unpersist()

    return write


def crossings(spark: SparkSession, path: str) -> DataFrame:
    """What the sink has written, with its batch ids."""
    from pyspark.errors import AnalysisException

    schema = f"{CROSSINGS}, batch bigint"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # no batch has written yet
        return spark.createDataFrame([], schema)


def batch_folder_sink(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that writes a batch once, however often it is repeated."""
    return lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def run_batches(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, timeout_s: int = 3600, state_partitions: int | None = None) -> None:
    """Run a stream over everything present, then stop; resumes from ``checkpoint``.
    ``state_partitions``: of the state, fixed by the first run; sums reach it
    combined, one row per task, window and label, so it need not grow with the rows."""
    conf, name = df.sparkSession.conf, "spark.sql.shuffle.partitions"
    usual = conf.get(name)
    try:
        if state_partitions:
            conf.set(name, str(state_partitions))
        q = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    finally:
        conf.set(name, usual)
    q.awaitTermination(timeout_s)
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
