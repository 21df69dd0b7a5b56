"""Exact quantiles by refinement, mergeable sketches, retention as a rewrite,
the order-dependent health rule."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import metrics as M
from pagewright.operators import quantiles as Q
from pagewright.operators import retention as RE


@pytest.mark.parametrize("bins", [4, 512])
def test_exact_quantiles_equal_numpy(spark, monkeypatch, bins):
    monkeypatch.setattr(Q, "BINS", bins)
    rng = np.random.default_rng(1)
    groups = {"even": rng.random(700), "skewed": np.exp(rng.normal(0, 8, 500)), "ties": rng.integers(0, 4, 300).astype(float), "one": np.array([3.5]),
              "huge": np.concatenate([rng.normal(0, 1, 40), [1e300, -1e300]]), None: rng.normal(5, 1, 60), "same": np.full(50, 2.0)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = {r["g"]: r for r in Q.exact_quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(groups) | {"empty"} and got["empty"]["count"] == 0 and got["empty"]["q2"] is None
    for g, vs in groups.items():
        assert got[g]["count"] == len(vs)
        for i, s in enumerate(shares):
            assert got[g][f"q{i}"] == pytest.approx(float(np.quantile(vs, s)), rel=1e-12), (g, s)
    whole = Q.exact_quantiles(df, [], "v", (0.5,)).first()
    assert whole["q0"] == pytest.approx(float(np.quantile(np.concatenate(list(groups.values())), 0.5)))
    assert Q.exact_quantiles(df.where("v > 1e301"), ["g"], "v", (0.5,)).count() == 0


def test_latency_kpis_hold_no_value_buffer(spark):
    df = spark.createDataFrame([(i % 3, float(i % 977)) for i in range(3000)], "p int, latency_ms double")
    k = M.latency_kpis(df, by=["p"])
    assert "percentile" not in k._jdf.queryExecution().optimizedPlan().toString()
    got = {r["p"]: (r["p50_ms"], r["p95_ms"], r["calls"]) for r in k.collect()}
    for p in range(3):
        v = np.array([i % 977 for i in range(3000) if i % 3 == p], float)
        assert got[p] == (pytest.approx(np.quantile(v, 0.5)), pytest.approx(np.quantile(v, 0.95)), 1000)
    assert M.latency_kpis(df).first()["calls"] == 3000


def test_sketches_merge_to_hours_and_days_within_their_error(spark):
    rng = np.random.default_rng(2)
    start = dt.datetime(2025, 5, 1)
    rows = [(start + dt.timedelta(seconds=int(s)), "ab"[int(s) % 2], float(v)) for s, v in zip(rng.integers(0, 2 * 86400, 20000), rng.gamma(2, 300, 20000))]
    df = spark.createDataFrame(rows, "ts timestamp, service string, latency double")
    sketches = Q.window_sketches(df, "latency", by=("service",))
    day = {(r["window_start"], r["service"]): r for r in Q.estimated(Q.merged(Q.merged(sketches, "hour", ("service",)), "day", ("service",))).collect()}
    assert len(day) == 4
    for (at, service), r in day.items():
        v = np.sort([x for t, s, x in rows if s == service and t.date() == at.date()])
        assert r["requests"] == len(v)
        for share, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
            assert abs(np.searchsorted(v, r[name]) / len(v) - share) < 0.02


# -- T05 ------------------------------------------------------------------------
def part_files(path):
    return {os.path.relpath(os.path.join(r, f), path) for r, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_retention_rewrites_border_days_only_and_is_safe_to_repeat(spark, tmp_path):
    path = str(tmp_path / "logs")
    start = dt.datetime(2025, 3, 1)
    rows = [(i, ("object", "log", "kept")[i % 3], start + dt.timedelta(hours=i / 2)) for i in range(24 * 2 * 60)]
    rows += [(90001, "log", None), (90002, "odd/class", start)]
    RE.write_partitioned(spark.createDataFrame(rows, "event_id long, kind string, ts timestamp"), path, cls="kind")
    before = part_files(path)
    as_of = "2025-04-20 09:00:00"
    rules = [RE.Rule("object", RE.OBJECT_DAYS[False]), RE.Rule("log", 10), RE.Rule("odd/class", 1), RE.Rule("absent", 3)]
    done = RE.enforce(spark, path, rules, as_of, cls="kind")
    at = dt.datetime.fromisoformat(as_of)
    cut = {"object": at - dt.timedelta(days=30), "log": at - dt.timedelta(days=10), "odd/class": at - dt.timedelta(days=1)}
    want = sorted(i for i, k, t in rows if t is None or k not in cut or t >= cut[k])
    left = lambda: sorted(r["event_id"] for r in spark.read.parquet(path).collect())
    assert left() == want
    assert done == {"object": (20, 1), "log": (40, 1), "odd/class": (1, 0)}
    after = part_files(path)
    border = {f"kind={k}/day={cut[k].date()}" for k in ("object", "log")}
    untouched = {f for f in before if os.path.dirname(f) not in border and f in after}
    expected = {f for f in before if os.path.dirname(f) not in border and ("kind=kept" in f or "__HIVE" in f or os.path.dirname(f).split("day=")[1] > str(cut[os.path.dirname(f).split("=")[1].split("/")[0].replace("%2F", "/")].date()))}
    assert untouched == expected and len(untouched) > 60  # they keep their names
    assert RE.enforce(spark, path, rules, as_of, cls="kind") == {"object": (0, 0), "log": (0, 0), "odd/class": (0, 0)}
    assert part_files(path) == after and left() == want


def test_retention_of_a_table_without_classes(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(i, dt.datetime(2025, 1, 1) + dt.timedelta(hours=8 * i)) for i in range(30)], "event_id long, ts timestamp")
    RE.write_partitioned(df, path)
    assert RE.enforce(spark, path, [RE.Rule(None, 2)], "2025-01-08 00:00:00") == {"": (5, 0)}
    assert spark.read.parquet(path).count() == M.retain(df, "2025-01-08 00:00:00", 2).count()
    assert RE.enforce(spark, str(tmp_path / "none"), [RE.Rule(None, 2)], "2025-01-08 00:00:00") == {"": (0, 0)}


# -- A11 ------------------------------------------------------------------------
def test_ordered_health_equals_the_loop(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for run in range(300):
        state = "healthy"
        for place in range(int(rng.integers(1, 6))):
            status = str(rng.choice(["healthy", "unhealthy", "degraded", None], p=[0.55, 0.2, 0.2, 0.05]))
            status = None if status == "None" else status
            raised = bool(rng.random() < 0.2)
            rows.append((run, place, status, raised))
            if raised:
                state = "unhealthy"
            elif status != "healthy":
                state = "degraded"
        want[run] = state
    df = spark.createDataFrame(rows, "run long, place int, status string, raised boolean").repartition(6)
    got = M.health_rollup(df, by=("run",), rule="ordered", order=("place",))
    assert {r["run"]: r["overall_status"] for r in got.collect()} == want and set(want.values()) == {"healthy", "degraded", "unhealthy"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
