"""Stream forms equal the batch forms (complete mode) on the driver tables."""

import os

import pytest
from pyspark.sql import functions as F

from pagewright.operators import metrics as M
from pagewright.plans import views as V
from pagewright.session import Tables
from pagewright.streaming import streams as ST

SF = "/root/testdata/sf0.001"


def rows(df, cols=None):
    cols = cols or sorted(df.columns)
    return sorted(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def event_folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("events"))
    Tables(spark, SF).events.repartition(4, "event_id").write.mode("overwrite").parquet(d)
    return d


def stream_of(spark, folder, view):
    schema = spark.read.parquet(folder).schema
    src = ST.table_stream(spark, folder, schema, files_per_trigger=1)

    class _T:
        events = src
    return view(_T)


def test_t01_metric_summary_stream_equals_batch(spark, event_folder):
    s = ST.run_to_table(ST.metric_summary_stream(stream_of(spark, event_folder, V.metrics)), mode="complete")
    b = M.metric_summary(V.metrics(Tables(spark, SF)))
    assert rows(s) == rows(b)


def test_t02_t04_windows_stream_equals_batch(spark, event_folder):
    calls = stream_of(spark, event_folder, V.calls)
    s = ST.run_to_table(ST.error_rate_stream(calls), mode="complete")
    b = M.error_rate_windows(V.calls(Tables(spark, SF)))
    assert rows(s) == rows(b)
    s2 = ST.run_to_table(ST.dashboard_stream(stream_of(spark, event_folder, V.calls)), mode="complete")
    b2 = M.dashboard_series(V.calls(Tables(spark, SF)))
    assert rows(s2) == rows(b2)


def test_t02_append_mode_emits_closed_windows_only(spark, event_folder):
    calls = stream_of(spark, event_folder, V.calls)
    s = ST.run_to_table(ST.error_rate_stream(calls), mode="append")
    b = M.error_rate_windows(V.calls(Tables(spark, SF)))
    assert 0 < s.count() <= b.count()
    assert set(rows(s)) <= set(rows(b))


def test_t03_budget_stream(spark, event_folder):
    calls = stream_of(spark, event_folder, V.calls)
    s = ST.run_to_table(ST.budget_stream(calls, monthly_budget=1000.0), mode="complete")
    b = V.calls(Tables(spark, SF)).groupBy(F.date_trunc("month", "ts").alias("month")).agg(
        F.sum("cost").alias("month_to_date"))
    got = {r["month"]: r["month_to_date"] for r in s.collect()}
    want = {r["month"]: r["month_to_date"] for r in b.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_t08_dedup_within_watermark(spark, tmp_path):
    d = str(tmp_path / "dups")
    ev = Tables(spark, SF).events.limit(50)
    ev.unionByName(ev).repartition(3).write.parquet(d)
    src = ST.table_stream(spark, d, spark.read.parquet(d).schema, files_per_trigger=1)
    out = ST.run_to_table(ST.deduplicate(src), mode="append")
    assert out.count() == 50


def test_s08_document_arrivals(spark, tmp_path):
    d = tmp_path / "inbox"
    d.mkdir()
    for i in range(3):
        (d / f"doc{i}.pdf").write_bytes(b"%PDF-" + bytes([i]))
    s = ST.document_arrivals(spark, str(d), files_per_trigger=1).select("path", "length")
    out = ST.run_to_table(s, mode="append")
    assert out.count() == 3


def test_t06_paced_batches_pause(spark, tmp_path):
    import time

    src = str(tmp_path / "in")
    for i in range(3):
        spark.range(5).selectExpr(f"id + {i * 5} as id").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src)
    t0 = time.time()
    q = ST.start(stream, name="paced", mode="append", available_now=False)
    while spark.table("paced").count() < 15 and time.time() - t0 < 60:
        time.sleep(0.2)
    q.stop()
    assert spark.table("paced").count() == 15 and time.time() - t0 >= 2  # three batches, a second apart


def test_t06_the_first_pause_is_a_whole_one(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    slept = []
    monkeypatch.setattr(ST, "time", SimpleNamespace(time=lambda: 100.4, sleep=slept.append))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    ST.start(stream, name="first_pause", mode="append", available_now=False).stop()
    assert slept == [pytest.approx(0.6)]  # to the next tick of the trigger
    ST.start(stream, name="own_pace", mode="append", processing_time="1 hour").stop()
    assert len(slept) == 1
