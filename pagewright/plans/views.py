"""Operator inputs derived from the driver tables.

Each view exists twice, with the same meaning: a DataFrame builder (what the
Spark queries read) and a SQL text (what the DuckDB oracle reads as a CTE).
All of them are integer-derived from the tables, so they grow with them.

Design notes for scale:
* ``interactions`` pairs a user turn with the next assistant turn by an
  left equi-join on ``(conv_id, turn + 1)`` (an unanswered turn is kept as a
  failed call) instead of ``lead() over (partition by
  conv_id)``: turns have no gaps, and a join on the composite key spreads a
  conversation that holds a third of all rows over many tasks, where a window
  would put it in one.
* ``candidates`` multiplies pages by the three reading sources with a narrow
  ``explode`` of a literal array (no join, no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import Tables

PROVIDERS = ("azure_openai", "vertex_ai")
SERVICES = ("azure_openai", "azure_search", "computer_vision", "content_safety", "storage")


# ---------------------------------------------------------------------------
# DataFrame side
# ---------------------------------------------------------------------------
def _provider(conv_id: Column) -> Column:
    m = conv_id % 3
    return F.when(m == 0, F.lit("azure_openai")).otherwise(F.lit("vertex_ai"))


def _model(conv_id: Column) -> Column:
    m = conv_id % 3
    return F.when(m == 0, "chat").when(m == 1, "custom").otherwise("gemini")


def interactions(t: Tables, with_context: bool | str = True) -> DataFrame:
    """``with_context="length"`` joins the number of characters of the context
    (``context_chars``) instead of its text, for jobs that need no more.
    ``with_context=False`` leaves out the document join (and its shuffle of
    the full document text) for jobs that never read the context; Catalyst
    cannot drop a left join by itself unless the right side is provably
    unique."""
    c = t.conversations.select("conv_id", "turn", "role", "text")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    j = u.join(a, ["conv_id", "turn"], "left")  # a turn without an answer stays, as a failed call
    context = "context"
    if with_context == "length":
        context = "context_chars"
        d = t.documents.select(F.col("doc_id").alias("conv_id"), F.length("text").alias(context))
        j = j.join(d, "conv_id", "left")
    elif with_context:
        d = t.documents.select(F.col("doc_id").alias("conv_id"), F.col("text").alias("context"))
        j = j.join(d, "conv_id", "left")
    else:
        j = j.withColumn("context", F.lit(None).cast("string"))
    return (j
            .select("conv_id", "turn", "query", "response", context,
                    _provider(F.col("conv_id")).alias("provider"),
                    _model(F.col("conv_id")).alias("model"),
                    ((F.col("conv_id") * 37 + F.col("turn") * 101) % 3000).cast("double").alias("latency_ms"),
                    ((((F.col("conv_id") + F.col("turn")) % 11) == 0) | F.col("response").isNull()).alias("is_error")))


def pages(t: Tables) -> DataFrame:
    return t.conversations.select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).cast("int").alias("page_number"),
        F.col("text").alias("text_content"))


def candidates(t: Tables) -> DataFrame:
    src = F.array(*[F.struct(F.lit(i).alias("reading_pos"), F.lit(s).alias("source"))
                    for i, s in enumerate(K.SOURCE_ORDER)])
    p = pages(t)
    k = F.col("k.reading_pos")
    return (p.select("*", F.explode(src).alias("k"))
            .select("doc_id", "page_number", k.alias("reading_pos"), F.col("k.source").alias("source"),
                    F.col("text_content").alias("text"),
                    ((F.col("doc_id") * 31 + (F.col("page_number") - 1) * 17 + k * 13) % 101)
                    .cast("double").__truediv__(F.lit(100)).alias("confidence"),
                    F.when(((F.col("doc_id") + F.col("page_number") - 1 + k) % 7) == 0, F.lit("failed"))
                    .alias("error")))


def severity(t: Tables) -> DataFrame:
    lab = t.labels.select("doc_id", "quality", "toxic")
    return (t.documents.select("doc_id", "text").join(lab, "doc_id", "left")
            .select(F.col("doc_id").alias("text_id"), "text",
                    (F.col("toxic") * 6).cast("double").alias("hate"),
                    F.lit(None).cast("double").alias("self_harm"),
                    F.lit(None).cast("double").alias("sexual"),
                    ((1 - F.col("quality")) * 2).cast("double").alias("violence")))


def _event_provider(user_id: Column) -> Column:
    return F.when(user_id % 2 == 0, F.lit("azure_openai")).otherwise(F.lit("vertex_ai"))


def metrics(t: Tables) -> DataFrame:
    e = t.events
    return e.select(_event_provider(F.col("user_id")).alias("provider"),
                    F.col("event_type").alias("metric"), "value",
                    F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


def calls(t: Tables, *more: str) -> DataFrame:
    """``more``: columns of events to keep as they are."""
    e = t.events
    svc = F.element_at(F.array(*[F.lit(s) for s in SERVICES]), (F.col("user_id") % 5 + 1).cast("int"))
    err = F.col("event_type") == "error"
    return e.select(F.col("event_id"), *more, F.col("ts").cast("timestamp").alias("ts"),
                    _event_provider(F.col("user_id")).alias("provider"),
                    svc.alias("service_name"),
                    F.when(err, "ERROR").otherwise("INFO").alias("severity"),
                    F.when(err, 1).otherwise(0).cast("bigint").alias("error_count"),
                    F.col("value").alias("cost"),
                    F.when(err, K.UNHEALTHY).otherwise(K.HEALTHY).alias("status"))


# ---------------------------------------------------------------------------
# SQL side (DuckDB oracle); same definitions
# ---------------------------------------------------------------------------
SQL = {
    "v_interactions": """
SELECT u.conv_id, u.turn, u.text AS query, a.text AS response, d.text AS context,
       CASE WHEN u.conv_id % 3 = 0 THEN 'azure_openai' ELSE 'vertex_ai' END AS provider,
       CASE WHEN u.conv_id % 3 = 0 THEN 'chat' WHEN u.conv_id % 3 = 1 THEN 'custom' ELSE 'gemini' END AS model,
       CAST((u.conv_id * 37 + u.turn * 101) % 3000 AS DOUBLE) AS latency_ms,
       ((u.conv_id + u.turn) % 11 = 0 OR a.text IS NULL) AS is_error
FROM (SELECT * FROM conversations WHERE role = 'user') u
LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
LEFT JOIN documents d ON d.doc_id = u.conv_id""",
    "v_pages": """
SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_number, text AS text_content
FROM conversations""",
    "v_candidates": """
SELECT p.doc_id, p.page_number, k.reading_pos, k.source, p.text_content AS text,
       CAST((p.doc_id * 31 + (p.page_number - 1) * 17 + k.reading_pos * 13) % 101 AS DOUBLE) / 100 AS confidence,
       CASE WHEN (p.doc_id + p.page_number - 1 + k.reading_pos) % 7 = 0 THEN 'failed' END AS error
FROM v_pages p
CROSS JOIN (VALUES (0, 'azure_cv'), (1, 'tesseract'), (2, 'azure_form_recognizer')) AS k(reading_pos, source)""",
    "v_severity": """
SELECT d.doc_id AS text_id, d.text,
       CAST(l.toxic * 6 AS DOUBLE) AS hate, CAST(NULL AS DOUBLE) AS self_harm,
       CAST(NULL AS DOUBLE) AS sexual, CAST((1 - l.quality) * 2 AS DOUBLE) AS violence
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "v_metrics": """
SELECT CASE WHEN user_id % 2 = 0 THEN 'azure_openai' ELSE 'vertex_ai' END AS provider,
       event_type AS metric, value, ts, event_id AS seq
FROM events""",
    "v_calls": """
SELECT event_id, ts,
       CASE WHEN user_id % 2 = 0 THEN 'azure_openai' ELSE 'vertex_ai' END AS provider,
       ['azure_openai', 'azure_search', 'computer_vision', 'content_safety', 'storage'][user_id % 5 + 1] AS service_name,
       CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity,
       CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS error_count,
       value AS cost,
       CASE WHEN event_type = 'error' THEN 'unhealthy' ELSE 'healthy' END AS status
FROM events""",
}

# views a view depends on (so a query pulls in only what it needs, in order)
DEPENDS = {"v_candidates": ("v_pages",)}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs it needs."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, ()):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
