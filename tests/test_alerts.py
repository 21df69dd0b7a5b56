"""Alert and budget state machines: replayed streams give the batch rows, a
restart emits nothing twice, budget hours are opened sparingly."""

import datetime as dt
import os
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import budget as B
from pagewright.operators import metrics as M
from pagewright.streaming import alerts as AL
from pagewright.streaming import streams as ST

T0 = dt.datetime(2025, 3, 1)
LOGS = "event_id long, ts timestamp, service_name string, severity string, error_count long"


def write_files(spark, rows, schema, folder, parts):
    """One file per part; modification times tell the file source their order."""
    for i, part in enumerate(parts):
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        spark.createDataFrame([rows[j] for j in part], schema).coalesce(1).write.mode("append").parquet(folder)
        for f in set(os.listdir(folder)) - before:
            os.utime(os.path.join(folder, f), (1.7e9 + i * 10, 1.7e9 + i * 10))


def log_rows(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for s, rate in (("api", 0.5), ("search", 0.8), ("store", 0.2)):
        for w in range(60):
            if rng.random() < rate:
                for _ in range(rng.integers(1, 4)):
                    rows.append((len(rows), T0 + dt.timedelta(seconds=int(w * 300 + rng.integers(0, 300))), s, "ERROR", int(rng.integers(1, 3))))
            rows.append((len(rows), T0 + dt.timedelta(seconds=int(w * 300 + rng.integers(0, 300))), s, "INFO", 5))
    return sorted(rows, key=lambda r: r[1])


def out_of_order(rows, parts, seconds=480):
    """Index parts: time order disturbed by less than the watermark's ten minutes."""
    rng = np.random.default_rng(9)
    late = sorted(range(len(rows)), key=lambda i: rows[i][1].timestamp() + rng.integers(0, seconds))
    return [late[i * len(rows) // parts:(i + 1) * len(rows) // parts] for i in range(parts)]


def key(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def batch_changes(spark, rows, k):
    logs = spark.createDataFrame(rows, LOGS)
    settled = max(r[1] for r in rows) - dt.timedelta(minutes=10)
    return AL.alert_transitions(M.error_rate_windows(logs, threshold_per_second=0.005), F.lit(settled), k)


@pytest.mark.parametrize("k", [1, 3])
def test_sustained_alert_stream_equals_batch_on_out_of_order_files(spark, tmp_path, k):
    rows = log_rows()
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    write_files(spark, rows, LOGS, src, out_of_order(rows, 7))
    stream = ST.table_stream(spark, src, LOGS, files_per_trigger=1)
    AL.run_batches(AL.sustained_alerts(stream, k, threshold_per_second=0.005), AL.batch_folder_sink(out), ckpt)
    got = spark.read.schema(AL.TRANSITIONS).parquet(out)
    assert key(got.select("service_name", "state", "first_window", "last_window", "windows")) == key(batch_changes(spark, rows, k))
    assert {r.state for r in got.collect()} >= {"firing", "resolved"} and len([f for f in os.listdir(out) if f.startswith("batch=")]) > 2
    # settled runs are those of the gap-and-island rule
    settled = max(r[1] for r in rows) - dt.timedelta(minutes=10)
    w = M.error_rate_windows(spark.createDataFrame(rows, LOGS), threshold_per_second=0.005).where(F.col("window_start") + F.expr("interval 5 minutes") <= F.lit(settled))
    islands = {(r.service_name, r.first_window, r.windows) for r in M.consecutive_firing(w, k=k).collect()}
    ended = {(r.service_name, r.first_window, r.windows) for r in got.where("state = 'resolved'").collect()}
    assert ended and ended <= islands and len(islands - ended) <= 3  # one open run per service at most


def test_restart_from_the_checkpoint_emits_nothing_twice(spark, tmp_path):
    rows = log_rows(2)
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    parts = out_of_order(rows, 6)
    write_files(spark, rows, LOGS, src, parts[:3])

    def stop_at_once(rows_, batch_id):  # the sink fails after it has written: the batch is repeated
        AL.batch_folder_sink(out)(rows_, batch_id)
        if batch_id == 2:
            raise RuntimeError("lost")

    run = lambda sink: AL.run_batches(AL.sustained_alerts(ST.table_stream(spark, src, LOGS, files_per_trigger=1), 2, threshold_per_second=0.005), sink, ckpt)
    with pytest.raises(Exception):
        run(stop_at_once)
    run(AL.batch_folder_sink(out))
    for part in parts[3:]:
        spark.createDataFrame([rows[j] for j in part], LOGS).coalesce(1).write.mode("append").parquet(src)
        run(AL.batch_folder_sink(out))
    got = spark.read.schema(AL.TRANSITIONS).parquet(out).select("service_name", "state", "first_window", "last_window", "windows")
    assert key(got) == key(batch_changes(spark, rows, 2))


COSTS = "event_id long, ts timestamp, cost double"
RULES = B.rules_of((0.8, 0.9, 1.0), (0.95,), 500.0)


def cost_rows(seed=3, negative=True):
    rng = np.random.default_rng(seed)
    rows = []
    for m in (3, 4):
        for _ in range(900):
            at = dt.datetime(2025, m, 1) + dt.timedelta(seconds=int(rng.integers(0, 28 * 86400)))
            rows.append((len(rows), at, round(float(rng.normal(0.7, 1.5 if negative else 0.1)), 6)))
    return sorted(rows, key=lambda r: r[1])


def brute_crossings(rows, budget, actual, forecast):
    out = []
    for month in sorted({r[1].replace(day=1, hour=0, minute=0, second=0) for r in rows}):
        nxt = month.replace(year=month.year + month.month // 12, month=month.month % 12 + 1)
        spent, told = Decimal(0), {}
        for i, ts, c in sorted((r for r in rows if r[1] >= month and r[1] < nxt), key=lambda r: (r[1], r[0])):
            spent += Decimal(str(c))
            m = float(spent)
            f = m / max((ts - month).total_seconds() / (nxt - month).total_seconds(), 1e-9)
            for kind, ts_, v in [("actual", t, m) for t in actual] + [("forecast", t, f) for t in forecast]:
                if v > ts_ * budget and (kind, ts_) not in told:
                    told[kind, ts_] = (month, kind, ts_, ts, i, round(m, 6), round(v, 6))
        out += told.values()
    return sorted(out, key=str)


def crossing_key(df):
    return sorted(((r.month, r.kind, r.threshold, r.crossed_at, r.event_id, round(r.month_to_date, 6), round(r.compared_value, 6)) for r in df.collect()), key=str)


@pytest.mark.parametrize("negative", [True, False])
def test_budget_tree_equals_brute_force_and_opens_few_hours(spark, negative):
    rows = cost_rows(5, negative)
    df = spark.createDataFrame(rows, COSTS).repartition(4)
    got = M.budget_crossings(df, 500.0, actual=(0.8, 0.9, 1.0), forecast=(0.95, 1.2))
    want = brute_crossings(rows, 500.0, (0.8, 0.9, 1.0), (0.95, 1.2))
    assert crossing_key(got) == want and len(want) >= 8
    sums = B.hour_sums(B.prepared(df, "ts", "cost", "event_id"))
    opened = B.open_hours(sums, RULES).count()
    assert 0 < opened < (0.2 if negative else 0.05) * sums.count()


def test_budget_edges(spark):
    none = spark.createDataFrame([], COSTS)
    assert M.budget_crossings(none, 10.0).count() == 0
    at = dt.datetime(2025, 3, 1)
    one = spark.createDataFrame([(1, at, 8.0), (2, at, 0.0), (3, at, 0.5), (4, None, 99.0), (5, at, None)], COSTS)
    got = M.budget_crossings(one, 10.0, actual=(0.8, 0.85), forecast=())
    assert [(r.threshold, r.event_id) for r in got.orderBy("threshold").collect()] == [(0.8, 3)]
    loose = M.budget_crossings(one, 10.0, actual=(0.8, 0.85), forecast=(), strict=False)
    assert [(r.threshold, r.event_id) for r in loose.orderBy("threshold").collect()] == [(0.8, 1), (0.85, 3)]


def test_budget_plan_sorts_opened_hours_only(spark):
    """The rows that are sorted for running sums are those of opened hours."""
    rows = cost_rows(8, False)
    df = spark.createDataFrame(rows, COSTS)
    base = B.prepared(df, "ts", "cost", "event_id")
    opened = B.open_hours(B.hour_sums(base), B.rules_of((0.8,), (), 500.0))
    assert B.spend_in(base, opened).count() < 0.02 * len(rows)


def test_budget_crossing_stream_equals_batch_and_tells_once(spark, tmp_path):
    rows = cost_rows()
    rows.append((len(rows), dt.datetime(2025, 6, 1), 0.0))  # a later event: the watermark passes all hours
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    write_files(spark, rows, COSTS, src, out_of_order(rows, 5))
    stored = lambda: spark.read.schema(COSTS).parquet(src)
    sink = AL.crossing_sink(out, stored, RULES)

    def once_more(opened, batch_id):  # every batch is delivered twice
        sink(opened, batch_id)
        sink(opened, batch_id)

    AL.run_batches(AL.hours_to_open(ST.table_stream(spark, src, COSTS, files_per_trigger=1), RULES), once_more, ckpt)
    got = AL.crossings(spark, out)
    want = brute_crossings(rows, 500.0, (0.8, 0.9, 1.0), (0.95,))
    assert crossing_key(got) == want
    AL.run_batches(AL.hours_to_open(ST.table_stream(spark, src, COSTS, files_per_trigger=1), RULES), once_more, ckpt)
    assert crossing_key(AL.crossings(spark, out)) == want
