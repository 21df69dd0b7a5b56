"""Registered queries over derived rows that reach every branch of a rule:
S04, S05/W05, F05, F12-F15, F19, F21, F24, A11 (decisive and ordered rule), T02
(firing), T04 (percentiles), T05 (rewrite).  The oracle texts state their fixed values on their own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scoring as S
from ..functions import text as T
from ..operators import documents as D
from ..operators import metrics as M
from ..operators import retention as RE
from ..sources import files as SRC
from ..session import Tables, checkpoint_dir
from . import views as V
from .catalog import register

ADMIT_SQL = r"""
WITH f AS (SELECT page_id, CASE WHEN page_id % 17 <> 0 THEN '/in/' || page_id || ['.PDF', '.png', '.docx', '.jpeg', '', '.tiff'][page_id % 6 + 1] END AS path,
                  CAST(strlen(html) AS BIGINT) * (page_id % 5) * 20000 AS length FROM pages)
SELECT page_id, path, length,
       CASE WHEN path IS NULL THEN 'missing' WHEN length > 52428800 THEN 'too_large'
            WHEN NOT regexp_matches(lower(path), '\.(pdf|png|jpg|jpeg|tiff|bmp)$') THEN 'unsupported_format' END AS reject_reason
FROM f
"""


@register("file_admission", ADMIT_SQL, "S04 F22")
def q_file_admission(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in (".PDF", ".png", ".docx", ".jpeg", "", ".tiff")])
    i = F.col("page_id")
    path = F.when(i % 17 != 0, F.concat(F.lit("/in/"), i.cast("string"), F.get(ends, (i % 6).cast("int"))))
    files = Tables(spark, sf_dir).pages.select("page_id", path.alias("path"), (F.octet_length("html").cast("bigint") * (i % 5) * 20000).alias("length"))
    return SRC.admit_documents(files).select("page_id", "path", "length", "reject_reason")


BREAKS_SQL = """
WITH s AS (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(10), chr(12)), chr(12)) AS parts FROM documents),
x AS (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM s)
SELECT doc_id, CAST(i AS INTEGER) AS page_number, printf('page_%03d.png', i) AS image_name, CAST(length(parts[i]) AS BIGINT) AS page_chars FROM x
"""


@register("page_breaks", BREAKS_SQL, "S05 W05 F23")
def q_page_breaks(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\f")).alias("text"))
    return D.number_pages(docs).select("doc_id", "page_number", "image_name", F.length("text_content").cast("bigint").alias("page_chars"))


MIXED_SQL = r"""
WITH d AS (SELECT doc_id, 'Invoice of ' || CASE WHEN doc_id % 2 = 0 THEN (doc_id % 28 + 1) || '/11/2023' ELSE '2024-05-' || (doc_id % 28 + 1) END
             || ' for $' || (doc_id % 900 + 1) || '.50 and ' || (doc_id % 70) || ' USD, of which ' || (doc_id % 90) || '% x is due. Mail a' || doc_id
             || '@b.example.org. ' || CASE WHEN doc_id % 3 = 0 THEN 'It is unclear, maybe, I am not sure.' ELSE 'It is settled.' END AS text FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(text, '\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b|\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b')) AS BIGINT) AS dates,
       CAST(len(regexp_extract_all(text, '(?i)\$[\d,]+\.?\d*|\b\d+\.?\d*\s*(?:dollars?|USD|INR|₹)\b')) AS BIGINT) AS amounts,
       CAST(len(regexp_extract_all(text, '\b\d+\.?\d*\s*%\b')) AS BIGINT) AS percentages,
       CAST(len(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b')) AS BIGINT) AS emails,
       contains(lower(text), 'unclear') OR contains(lower(text), 'not sure') OR contains(lower(text), 'maybe') AS uncertain,
       array_to_string(string_split(text, '.')[1:3], '. ') || '.' || chr(10) || chr(10) || 'Document Statistics: 2 pages, '
         || len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) || ' words, '
         || printf('%.1f', (50 + doc_id % 50)::DOUBLE) || '% average confidence.' || CASE WHEN doc_id % 4 > 0 THEN ' Contains ' || (doc_id % 4) || ' tables.' ELSE '' END
         || CASE WHEN doc_id % 5 > 0 THEN ' Extracted ' || (doc_id % 5) || ' key-value pairs.' ELSE '' END AS summary
FROM d
"""


@register("mixed_entities", MIXED_SQL, "F12 F13 F14 F15 F16 F19")
def q_mixed_entities(spark, sf_dir):
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    day = F.when(i % 2 == 0, F.concat(s(i % 28 + 1), F.lit("/11/2023"))).otherwise(F.concat(F.lit("2024-05-"), s(i % 28 + 1)))
    text = F.concat(F.lit("Invoice of "), day, F.lit(" for $"), s(i % 900 + 1), F.lit(".50 and "), s(i % 70), F.lit(" USD, of which "), s(i % 90),
                    F.lit("% x is due. Mail a"), s(i), F.lit("@b.example.org. "), F.when(i % 3 == 0, "It is unclear, maybe, I am not sure.").otherwise("It is settled."))
    d = Tables(spark, sf_dir).documents.select("doc_id", text.alias("text"))
    n = lambda kind: F.size(T.entity_matches(F.col("text"), kind)).cast("bigint")
    return d.select("doc_id", n("date").alias("dates"), n("monetary_amount").alias("amounts"), n("percentage").alias("percentages"), n("email").alias("emails"),
                    S.has_uncertainty(F.col("text"), ("unclear", "not sure", "maybe")).alias("uncertain"),
                    T.document_summary(F.col("text"), F.lit(2), (50 + i % 50) / F.lit(100.0), i % 4, i % 5).alias("summary"))


TRAINING_SQL = """
SELECT event_id, (epoch_us(ended) - epoch_us(started))::DOUBLE / 1000000 AS seconds,
       (epoch_us(ended) - epoch_us(started))::DOUBLE / 1000000 / 3600::DOUBLE * 1.5::DOUBLE * 83::DOUBLE AS training_cost_inr,
       strftime(started, '%Y-%m-%dT%H:%M:%S.%f') AS started_at
FROM (SELECT event_id, ts AS started, ts + to_milliseconds((event_id * 7919) % 7200000) AS ended FROM events)
"""


@register("training_runs", TRAINING_SQL, "F05 F21 (two clock columns) F24")
def q_training_runs(spark, sf_dir):
    ms = (F.col("event_id") * 7919) % 7200000
    started = F.col("ts").cast("timestamp")
    e = Tables(spark, sf_dir).events.select("event_id", started.alias("started"), F.timestamp_add("MILLISECOND", ms.cast("bigint"), started).alias("ended"))
    seconds = S.elapsed_seconds("started", "ended")
    return e.select("event_id", seconds.alias("seconds"), S.training_cost_inr(seconds).alias("training_cost_inr"),
                    T.iso_timestamp("started").alias("started_at"))


VERTEX_SQL = """
WITH e AS (SELECT user_id % 7 AS site, ['storage', 'vertex_ai_models', 'vector_search'][event_id % 3 + 1] AS service_name, ts, event_id,
                  CASE WHEN event_type = 'error' THEN 'unhealthy' ELSE 'healthy' END AS status FROM events),
s AS (SELECT site, service_name, arg_max(status, {'t': ts, 'e': event_id}) AS status FROM e GROUP BY ALL)
SELECT site, CASE WHEN bool_or(service_name = 'vertex_ai_models' AND status <> 'healthy') THEN 'unhealthy' ELSE 'healthy' END AS overall_status,
       CAST(count(*) AS BIGINT) AS services, CAST(count(*) FILTER (WHERE status <> 'healthy') AS BIGINT) AS services_not_healthy
FROM s GROUP BY site
"""


@register("model_service_health", VERTEX_SQL, "A11 (decisive rule)")
def q_model_service_health(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("storage", "vertex_ai_models", "vector_search")])
    e = Tables(spark, sf_dir).events.select((F.col("user_id") % 7).alias("site"), F.get(names, (F.col("event_id") % 3).cast("int")).alias("service_name"),
                                            F.col("ts").cast("timestamp").alias("ts"), "event_id",
                                            F.when(F.col("event_type") == "error", "unhealthy").otherwise("healthy").alias("status"))
    return M.health_rollup(M.latest_status(e, by=("site", "service_name")), by=("site",), rule="decisive")


FIRING_SQL = """
WITH c AS (SELECT *, time_bucket(INTERVAL 300 SECONDS, ts, TIMESTAMP '1970-01-01') AS w FROM v_calls WHERE severity = 'ERROR')
SELECT w AS window_start, service_name, CAST(sum(error_count * 900) AS BIGINT) AS errors, round(sum(error_count * 900) / 300.0, 6) AS rate_per_second,
       sum(error_count * 900) / 300.0 > 5 AS firing
FROM c GROUP BY ALL
"""


@register("firing_alerts", V.with_views(FIRING_SQL, "v_calls"), "T02 (both outcomes)")
def q_firing_alerts(spark, sf_dir):
    busy = V.calls(Tables(spark, sf_dir)).withColumn("error_count", F.col("error_count") * 900)  # a log line that stands for 900 errors
    return M.error_rate_windows(busy).withColumn("rate_per_second", F.round("rate_per_second", 6))


P95_SQL = """
SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, service_name, CAST(count(*) AS BIGINT) AS requests,
       round(quantile_cont(cost, 0.5), 6) AS p50, round(quantile_cont(cost, 0.95), 6) AS p95, round(quantile_cont(cost, 0.99), 6) AS p99
FROM v_calls GROUP BY ALL
"""


@register("latency_percentiles", V.with_views(P95_SQL, "v_calls"), "T04 (percentiles)")
def q_latency_percentiles(spark, sf_dir):
    s = M.percentile_series(V.calls(Tables(spark, sf_dir)), "cost", by=("service_name",), window="1 day")
    return s.select("window_start", "service_name", "requests", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])



RULES_SQL = """
WITH e AS (SELECT event_id, ts + to_months(CAST(user_id % 3 AS INTEGER)) AS ts, value::DECIMAL(28, 10) AS cost FROM events),
r AS (SELECT *, date_trunc('month', ts) AS month, sum(cost) OVER (PARTITION BY date_trunc('month', ts) ORDER BY ts, event_id) AS mtd FROM e),
x AS (SELECT r.*, t.thr FROM r, (VALUES (0.8::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE)) t(thr) WHERE mtd::DOUBLE > thr * 10000)
SELECT month::TIMESTAMP AS month, thr AS threshold, arg_min(event_id, {'t': ts, 'e': event_id}) AS event_id, round(arg_min(mtd, {'t': ts, 'e': event_id})::DOUBLE, 4) AS month_to_date
FROM x GROUP BY month, thr
"""


@register("budget_alert_rules", RULES_SQL, "W06 (80/90/100 %, several months)")
def q_budget_alert_rules(spark, sf_dir):
    e = Tables(spark, sf_dir).events.select("event_id", "ts", F.col("value").alias("cost"), "user_id")
    moved = F.col("ts").cast("timestamp") + F.make_interval(months=(F.col("user_id") % 3).cast("int"))
    b = M.budget_crossings(e.select("event_id", moved.alias("ts"), "cost"), 10000.0, actual=(0.8, 0.9, 1.0), forecast=())
    return b.select("month", "threshold", "event_id", F.round("month_to_date", 4).alias("month_to_date"))


ORDERED_SQL = """
WITH c AS (SELECT event_id // 5 AS run, event_id % 5 AS place,
                  CASE WHEN event_type IN ('error', 'view') THEN 'unhealthy' ELSE 'healthy' END AS status, event_type = 'error' AND user_id % 2 = 0 AS raised FROM events),
b AS (SELECT *, status <> 'healthy' OR raised AS bad FROM c)
SELECT run, coalesce(arg_max(CASE WHEN raised THEN 'unhealthy' ELSE 'degraded' END, place) FILTER (WHERE bad), 'healthy') AS overall_status,
       count(*) AS services, count(*) FILTER (WHERE bad) AS services_not_healthy,
       coalesce(bool_or(raised), false) AND coalesce(arg_max(NOT raised, place) FILTER (WHERE bad), false) AS overwritten
FROM b GROUP BY run
"""


@register("ordered_health", ORDERED_SQL, "A11 (order-dependent rule: healthy, degraded, unhealthy, overwritten)")
def q_ordered_health(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    kind = F.col("event_type")
    checks = e.select((F.col("event_id") / 5).cast("bigint").alias("run"), (F.col("event_id") % 5).alias("place"),
                      F.when(kind.isin("error", "view"), K.UNHEALTHY).otherwise(K.HEALTHY).alias("status"),
                      ((kind == "error") & (F.col("user_id") % 2 == 0)).alias("raised"))
    overall = M.health_rollup(checks, by=("run",), rule="ordered", order=("place",))
    any_raised = checks.groupBy("run").agg(F.bool_or("raised").alias("any_raised"))
    return overall.join(any_raised, "run").select("run", "overall_status", "services", "services_not_healthy",
                                                  (F.col("any_raised") & (F.col("overall_status") == K.DEGRADED)).alias("overwritten"))


RETAIN_RULES = {"click": 1, "error": 30, "purchase": 10}
RETAIN_AS_OF = "2024-01-29 12:30:00"

REWRITE_SQL = f"""
SELECT event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events
WHERE ts >= CASE event_type {" ".join(f"WHEN '{t}' THEN TIMESTAMP '{RETAIN_AS_OF}' - INTERVAL {d} DAY" for t, d in RETAIN_RULES.items())} ELSE TIMESTAMP '0001-01-01' END
"""


@register("retention_rewrite", REWRITE_SQL, "T05 (rules per class, days dropped by metadata, border days rewritten)")
def q_retention_rewrite(spark, sf_dir):
    path = f"{checkpoint_dir(spark).rstrip('/')}/retention-{uuid.uuid4().hex}"
    RE.write_partitioned(Tables(spark, sf_dir).events.select("event_id", "event_type", "ts"), path, cls="event_type")
    RE.enforce(spark, path, [RE.Rule(t, d) for t, d in RETAIN_RULES.items()], RETAIN_AS_OF, cls="event_type")
    return spark.read.parquet(path).select("event_type", "event_id", M.ts_text(F.col("ts")).alias("ts"))
