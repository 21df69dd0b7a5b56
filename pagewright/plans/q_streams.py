"""Registered queries that replay the ``events`` table as a stream.

Each runs its stream to the end of the present data (``availableNow``) with its
checkpoint and its result in the shared folder, and returns the result table.
The SQL states the same with the watermark written out: a window counts once it
ends ten minutes before the newest event.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import budget as B
from ..operators import metrics as M
from ..session import Tables, checkpoint_dir
from ..streaming import alerts as AL
from . import views as V
from .catalog import register

SUSTAINED_WINDOWS = 2
STATE_PARTITIONS = 4  # a few labels and months, and the windows that are still open
BUDGET = 10000.0
RULES = (0.8, 0.9, 1.0)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # as a pattern it may be a file or a folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


class _Streamed:
    def __init__(self, events: DataFrame):
        self.events = events


TRANSITIONS_SQL = f"""
WITH e AS (SELECT *, max(ts) OVER () - INTERVAL 10 MINUTE AS settled FROM v_calls),
w AS (SELECT time_bucket(INTERVAL '300 seconds', ts) AS ws, service_name, any_value(settled) AS settled FROM e
      WHERE severity IN ('ERROR', 'CRITICAL', 'ALERT', 'EMERGENCY') GROUP BY 1, 2 HAVING sum(error_count) > 0),
f AS (SELECT *, epoch(ws)::BIGINT // 300 - row_number() OVER (PARTITION BY service_name ORDER BY ws) AS i FROM w WHERE ws + INTERVAL 5 MINUTE <= settled),
r AS (SELECT service_name, min(ws) AS first_window, max(ws) AS last_window, count(*) AS n, any_value(settled) AS settled FROM f GROUP BY service_name, i),
t AS (SELECT service_name, 'pending' AS state, first_window, first_window AS last_window, 1 AS windows FROM r
  UNION ALL SELECT service_name, 'firing', first_window, first_window + INTERVAL 5 MINUTE * {SUSTAINED_WINDOWS - 1}, {SUSTAINED_WINDOWS} FROM r WHERE n >= {SUSTAINED_WINDOWS}
  UNION ALL SELECT service_name, CASE WHEN n >= {SUSTAINED_WINDOWS} THEN 'resolved' ELSE 'cleared' END, first_window, last_window, n FROM r
            WHERE last_window + INTERVAL 10 MINUTE <= settled)
SELECT service_name, state, strftime(first_window, '%Y-%m-%d %H:%M:%S.%f') AS first_window, strftime(last_window, '%Y-%m-%d %H:%M:%S.%f') AS last_window, windows::BIGINT AS windows FROM t
"""


@register("alert_transitions", V.with_views(TRANSITIONS_SQL, "v_calls"), "T02 (sustained rule as a stream: pending, firing, resolved)")
def q_alert_transitions(spark, sf_dir):
    out = _folder(spark, "alerts")
    calls = V.calls(_Streamed(_stream(spark, sf_dir)))
    AL.run_batches(AL.sustained_alerts(calls, SUSTAINED_WINDOWS, threshold_per_second=0.0), AL.batch_folder_sink(f"{out}/changes"), f"{out}/state", state_partitions=STATE_PARTITIONS)
    changes = spark.read.schema(AL.TRANSITIONS).parquet(f"{out}/changes")
    return changes.select("service_name", "state", M.ts_text(F.col("first_window")).alias("first_window"), M.ts_text(F.col("last_window")).alias("last_window"), "windows")


EVENTS_SQL = f"""
WITH e AS (SELECT event_id, ts + to_months(CAST(user_id % 3 AS INTEGER)) AS ts, value::DECIMAL(28, 10) AS cost FROM events),
r AS (SELECT *, date_trunc('month', ts) AS month, max(ts) OVER () - INTERVAL 10 MINUTE AS settled,
             sum(cost) OVER (PARTITION BY date_trunc('month', ts) ORDER BY ts, event_id) AS mtd FROM e),
x AS (SELECT r.*, t.thr FROM r, (VALUES {", ".join(f"({t}::DOUBLE)" for t in RULES)}) t(thr) WHERE mtd::DOUBLE > thr * {BUDGET!r}::DOUBLE),
y AS (SELECT month, thr, min(settled) AS settled, arg_min(struct_pack(ts := ts, id := event_id, m := mtd), {{'t': ts, 'e': event_id}}) AS c FROM x GROUP BY month, thr)
SELECT month::TIMESTAMP AS month, thr AS threshold, c.id AS event_id, strftime(c.ts, '%Y-%m-%d %H:%M:%S.%f') AS crossed_at, round(c.m::DOUBLE, 4) AS month_to_date
FROM y WHERE date_trunc('hour', c.ts) + INTERVAL 1 HOUR <= settled
"""


@register("budget_crossing_events", EVENTS_SQL, "T03 (each crossing once, as a stream)")
def q_budget_crossing_events(spark, sf_dir):
    out = _folder(spark, "budget")
    rules = B.rules_of(RULES, (), BUDGET)

    def costs(events: DataFrame) -> DataFrame:
        moved = F.col("ts").cast("timestamp") + F.make_interval(months=(F.col("user_id") % 3).cast("int"))
        return events.select("event_id", moved.alias("ts"), F.col("value").alias("cost"))

    sink = AL.crossing_sink(f"{out}/crossings", lambda: costs(Tables(spark, sf_dir).events), rules)
    AL.run_batches(AL.hours_to_open(costs(_stream(spark, sf_dir)), rules), sink, f"{out}/state", state_partitions=STATE_PARTITIONS)
    found = AL.crossings(spark, f"{out}/crossings")
    return found.select("month", "threshold", "event_id", M.ts_text(F.col("crossed_at")).alias("crossed_at"), F.round("month_to_date", 4).alias("month_to_date"))
