"""Question-answering operators: safety gate (P01/F11), context choice (P02),
scoring and pricing of calls (F01-F09, X02), error rows (P08), inference
records and the request summary (A02).

All narrow projections except the severity join (keyed, one row per text)
and the final global aggregates (partial per task, one final row).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scoring as S

SEVERITY_COLS = ("hate", "self_harm", "sexual", "violence")


def safety_scores(severities: DataFrame, key: str = "text_id", cols=SEVERITY_COLS,
                  block_below: float = K.SAFETY_BLOCK_BELOW) -> DataFrame:
    """F11 + P01 flag: one safety score per text; NULL severities do not count."""
    return severities.select(key, S.safety_score(*cols).alias("safety_score")).withColumn(
        "safety_violation", F.col("safety_score") < F.lit(float(block_below)))


CONTEXT_CHARS = "context_chars"  # calls may carry the length of their context instead of its text


def score_calls(calls: DataFrame, query: str = "query", response: str = "response",
                context: str = "context", model: str = "model") -> DataFrame:
    """Every per-call score and price as columns (no UDF).  Calls without a
    ``context`` column have its length in ``context_chars``."""
    chars = F.coalesce(F.col(CONTEXT_CHARS), F.lit(0)).cast("bigint") if context not in calls.columns else None
    return calls.select(
        "*",
        S.token_estimate(F.col(query)).alias("input_tokens"),
        S.token_estimate(F.col(response)).alias("output_tokens"),
        (S.text_length(F.col(context)) if chars is None else chars).alias("context_length"),
        S.chat_cost_inr(F.col(query), F.col(response)).alias("chat_cost_inr"),
        S.custom_model_cost_inr(S.text_length(F.col(query)), S.text_length(F.col(response))).alias("custom_cost_inr"),
        S.gemini_cost_inr(S.text_length(F.col(query)), S.text_length(F.col(response))).alias("gemini_cost_inr"),
        S.grounded_confidence(F.col(response), F.col(context) if chars is None else None, context_chars=chars).alias("grounded_confidence"),
        S.bare_confidence(F.col(query), F.col(response)).alias("bare_confidence"),
        S.dispatched_cost_inr(F.col(model), F.col(query), F.col(response)).alias("cost_estimate"),
        S.dispatched_confidence(F.col(model), F.col(query), F.col(response), F.col(context) if chars is None else None, chars).alias("confidence_score"),
        S.preview(F.col(query)).alias("query_preview"),
        S.preview(F.col(response)).alias("response_preview"))


def analyze(calls: DataFrame, safety: DataFrame | None = None, key: str = "conv_id",
            retrieved: DataFrame | None = None, use_rag: bool = True,
            include_safety_check: bool = True) -> DataFrame:
    """The chat path per query: safety gate, context choice, generation output
    scoring and pricing.  Blocked rows carry the refusal and zeros and skip
    the rest (they never reach pricing, and the metric rollups exclude them).

    ``safety``: key + safety_score (from :func:`safety_scores`); missing -> 1.0
    (fail-open).  ``retrieved``: key columns + contexts array (from retrieval);
    used only when RAG is on and no content is given.  A call without an answer
    carries the apology text, scored and priced like any other.  Without
    retrieval the calls may carry ``context_chars`` instead of the context.
    """
    lengths = "context" not in calls.columns
    if lengths and retrieved is not None and use_rag:
        raise ValueError("retrieved contexts need the calls' own context, not its length")
    df = calls.withColumn("response", F.coalesce("response", F.lit(K.GENERATION_APOLOGY)))  # no answer came: the apology is scored and priced
    if include_safety_check and safety is not None:
        df = df.join(safety.select(F.col(safety.columns[0]).alias(key), "safety_score"), key, "left")
        df = df.withColumn("safety_score", F.coalesce("safety_score", F.lit(1.0)))
    else:
        df = df.withColumn("safety_score", F.lit(1.0))
    blocked = F.col("safety_score") < F.lit(float(K.SAFETY_BLOCK_BELOW))
    given = F.lit(None) if lengths else F.coalesce(F.col("context"), F.lit(""))
    if retrieved is not None and use_rag:
        keys = [c for c in retrieved.columns if c != "contexts"]
        df = df.join(retrieved.select(*keys, F.col("contexts").alias("_ctx")), keys, "left")
        need = given == ""
        ctx_arr = F.when(need, F.coalesce("_ctx", F.array().cast("array<string>"))).otherwise(
            F.array().cast("array<string>"))
    else:
        ctx_arr = F.array().cast("array<string>")
    df = df.withColumn("retrieved_contexts", ctx_arr)
    if not lengths:
        df = df.withColumn("used_context", S.choose_context(F.col("context"), F.col("retrieved_contexts"), use_rag))
    scored = score_calls(df, context="used_context")
    zero = F.lit(0.0)
    return scored.select(
        *[c for c in calls.columns if c not in ("response",)],
        F.when(blocked, F.lit(K.SAFETY_REFUSAL)).otherwise(F.col("response")).alias("response"),
        F.when(blocked, zero).otherwise(F.col("confidence_score")).alias("confidence_score"),
        "safety_score",
        F.when(blocked, F.array().cast("array<string>")).otherwise(F.col("retrieved_contexts")).alias("retrieved_contexts"),
        F.when(blocked, zero).otherwise(F.col("latency_ms") / F.lit(1000.0)).alias("processing_time"),
        F.when(blocked, zero).otherwise(F.col("chat_cost_inr")).alias("cost_estimate"),
        blocked.alias("safety_violation"),
        F.when(blocked, F.lit(0).cast("bigint")).otherwise(F.col("context_length")).alias("context_length"))


def inference_records(calls: DataFrame) -> DataFrame:
    """X02 + P08: custom / hosted model results; error calls become error rows
    (message text, zeros, model 'error') instead of failing the batch."""
    s = score_calls(calls)
    err = F.col("is_error")
    zero = F.lit(0.0)
    return s.select(
        "conv_id", "turn", "query", "provider", "model",
        F.when(err, F.concat(F.lit(K.QUERY_ERROR_PREFIX), F.lit("inference failed"))).otherwise(F.col("response")).alias("response"),
        F.when(err, zero).otherwise(F.col("confidence_score")).alias("confidence_score"),
        F.when(err, zero).otherwise(F.col("latency_ms")).alias("latency_ms"),
        F.when(err, zero).otherwise(F.col("cost_estimate")).alias("cost_estimate"),
        F.when(err, F.lit("error")).otherwise(F.col("model")).alias("model_used"),
        err.alias("is_error"))


def request_summary(analyses: DataFrame, by=None) -> DataFrame:
    """Total requests, total cost, average cost per request, average
    response time, over tracked calls only (not blocked, not failed).
    No tracked call -> no row."""
    tracked = analyses.where(~F.col("safety_violation") & ~F.coalesce(F.col("is_error"), F.lit(False)))
    aggs = [F.count(F.lit(1)).cast("bigint").alias("total_requests"),
            F.sum("cost_estimate").alias("total_cost_inr"),
            F.avg("processing_time").alias("average_response_time")]
    g = tracked.groupBy(*by).agg(*aggs) if by else tracked.agg(*aggs)
    return g.where(F.col("total_requests") > 0).withColumn(
        "average_cost_per_request", F.col("total_cost_inr") / F.col("total_requests").cast("double"))


def transcript_chunks(turns_table: DataFrame, turns: int = K.TRANSCRIPT_CHUNK_TURNS, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """P07 in bounded pieces: (key, chunk, n_turns, transcript), one row per
    ``turns`` turn numbers of a conversation.  The chunks of a conversation in
    their order, joined by line feeds, are its transcript, and no task gathers a
    whole conversation, however long it is."""
    t = turns_table.select(key, turn, "role", "text", F.floor(F.col(turn) / F.lit(int(turns))).cast("bigint").alias("chunk"))
    g = t.groupBy(key, "chunk").agg(F.count(F.lit(1)).cast("bigint").alias("n_turns"), F.collect_list(F.struct(F.col(turn).alias("turn"), "role", "text")).alias("_t"))
    return g.select(key, "chunk", "n_turns", S.turns_transcript(F.col("_t")).alias("transcript"))
