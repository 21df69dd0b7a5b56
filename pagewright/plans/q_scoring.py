"""Registered question-answering and evaluation queries
(F01-F12, F25, P01, P02, P05-P08, X02, A02, A05, A06, J01, W04, D06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scoring as S
from ..operators import evaluate as E
from ..operators import qa as Q
from ..operators import retrieval as RT
from ..session import Tables
from . import sqlexpr as X
from . import views as V
from .catalog import register
from .q_retrieval import _dtok_sql

R6, R10 = 6, 10

SCORES_SQL = f"""
SELECT conv_id, turn, provider, model,
       {X.tokens('query')} AS input_tokens, {X.tokens('response')} AS output_tokens,
       {X.length('context')} AS context_length,
       round({X.chat_cost('query', 'response')}, {R10}) AS chat_cost_inr,
       round({X.custom_cost('query', 'response')}, {R10}) AS custom_cost_inr,
       round({X.gemini_cost('query', 'response')}, {R10}) AS gemini_cost_inr,
       round({X.grounded_conf('response', 'context')}, {R6}) AS grounded_confidence,
       round({X.bare_conf('query', 'response')}, {R6}) AS bare_confidence,
       round({X.dispatched_cost('model', 'query', 'response')}, {R10}) AS cost_estimate,
       round({X.dispatched_conf('model', 'query', 'response', 'context')}, {R6}) AS confidence_score,
       {X.preview('query')} AS query_preview, {X.preview('response')} AS response_preview
FROM v_interactions
"""


@register("interaction_scores", V.with_views(SCORES_SQL, "v_interactions"),
          "F01 F02 F03 F04 F07 F08 F09 F12 F25 X02 P05 Q1 Q2 Q22")
def q_interaction_scores(spark, sf_dir):
    s = Q.score_calls(V.interactions(Tables(spark, sf_dir), "length"))
    r = lambda c, n: F.round(c, n).alias(c)
    return s.select("conv_id", "turn", "provider", "model", "input_tokens", "output_tokens", "context_length",
                    r("chat_cost_inr", R10), r("custom_cost_inr", R10), r("gemini_cost_inr", R10),
                    r("grounded_confidence", R6), r("bare_confidence", R6),
                    r("cost_estimate", R10), r("confidence_score", R6), "query_preview", "response_preview")


SAFETY_SQL = f"""
SELECT text_id, round({X.safety('hate', 'self_harm', 'sexual', 'violence')}, {R6}) AS safety_score,
       ({X.safety('hate', 'self_harm', 'sexual', 'violence')} < {X.d(0.5)}) AS safety_violation
FROM v_severity
"""


@register("safety_gate", V.with_views(SAFETY_SQL, "v_severity"), "F11 P01 Q17")
def q_safety_gate(spark, sf_dir):
    s = Q.safety_scores(V.severity(Tables(spark, sf_dir)))
    return s.select("text_id", F.round("safety_score", R6).alias("safety_score"), "safety_violation")


ANALYSES_SQL = f"""
WITH s AS (SELECT text_id, {X.safety('hate', 'self_harm', 'sexual', 'violence')} AS safety_score FROM v_severity),
a AS (SELECT i.* REPLACE (coalesce(i.response, 'I apologize, but I encountered an error while processing your request.') AS response),
             coalesce(s.safety_score, {X.d(1.0)}) AS safety_score FROM v_interactions i
      LEFT JOIN s ON s.text_id = i.conv_id),
b AS (SELECT *, safety_score < {X.d(0.5)} AS blocked, coalesce(context, '') AS used_context FROM a)
SELECT conv_id, turn, provider,
       CASE WHEN blocked THEN '{K.SAFETY_REFUSAL}' ELSE response END AS response,
       CASE WHEN blocked THEN {X.d(0)} ELSE round({X.dispatched_conf('model', 'query', 'response', 'used_context')}, {R6}) END AS confidence_score,
       round(safety_score, {R6}) AS safety_score,
       CASE WHEN blocked THEN {X.d(0)} ELSE latency_ms / {X.d(1000)} END AS processing_time,
       CASE WHEN blocked THEN {X.d(0)} ELSE round({X.chat_cost('query', 'response')}, {R10}) END AS cost_estimate,
       blocked AS safety_violation,
       CASE WHEN blocked THEN CAST(0 AS BIGINT) ELSE {X.length('used_context')} END AS context_length
FROM b
"""


def _analyses(t: Tables):
    return Q.analyze(V.interactions(t, "length"), Q.safety_scores(V.severity(t)), key="conv_id", use_rag=False)


@register("qa_analyses", V.with_views(ANALYSES_SQL, "v_interactions", "v_severity"), "P01 P02 F02 F07 F11 F21 F25 Q8")
def q_qa_analyses(spark, sf_dir):
    a = _analyses(Tables(spark, sf_dir))
    return a.select("conv_id", "turn", "provider", "response",
                    F.round("confidence_score", R6).alias("confidence_score"),
                    F.round("safety_score", R6).alias("safety_score"), "processing_time",
                    F.round("cost_estimate", R10).alias("cost_estimate"), "safety_violation", "context_length")


RAG_SQL = f"""
WITH u AS (SELECT conv_id * 1000 + turn AS item_id, conv_id, turn, query AS text FROM v_interactions WHERE coalesce(context, '') = ''),
{_dtok_sql('u', 'item_id', 'text', 'qt')},
{_dtok_sql('benchmark', 'item_id', 'text', 'dt')},
m AS (SELECT qt.k AS item_id, dt.k AS doc_id, count(*) AS score FROM qt JOIN dt ON dt.t = qt.t GROUP BY 1, 2),
h AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM m),
c AS (SELECT h.item_id, string_agg(b.text, chr(10) ORDER BY h.rank) AS joined, count(*) AS n
      FROM h JOIN benchmark b ON b.item_id = h.doc_id WHERE h.rank <= 5 GROUP BY h.item_id),
s AS (SELECT text_id, {X.safety('hate', 'self_harm', 'sexual', 'violence')} AS safety_score FROM v_severity),
a AS (SELECT i.* REPLACE (coalesce(i.response, 'I apologize, but I encountered an error while processing your request.') AS response),
             coalesce(s.safety_score, {X.d(1.0)}) < {X.d(0.5)} AS blocked,
             CASE WHEN coalesce(i.context, '') <> '' THEN i.context ELSE coalesce(c.joined, '') END AS used_context, coalesce(c.n, 0) AS n
      FROM v_interactions i LEFT JOIN s ON s.text_id = i.conv_id LEFT JOIN c ON c.item_id = i.conv_id * 1000 + i.turn)
SELECT conv_id, turn, CASE WHEN blocked THEN 0 ELSE n END AS n_contexts,
       CASE WHEN blocked THEN CAST(0 AS BIGINT) ELSE {X.length('used_context')} END AS context_length,
       CASE WHEN blocked THEN {X.d(0)} ELSE round({X.dispatched_conf('model', 'query', 'response', 'used_context')}, {R6}) END AS confidence_score
FROM a
"""


@register("rag_analyses", V.with_views(RAG_SQL, "v_interactions", "v_severity"), "P02 J03 F07")
def q_rag_analyses(spark, sf_dir):
    """Calls without content get the five best keyword hits as context; calls
    with content keep theirs."""
    t = Tables(spark, sf_dir)
    calls = V.interactions(t)
    ask = calls.where(F.coalesce("context", F.lit("")) == "").select(F.concat_ws(":", "conv_id", "turn").alias("call"), F.col("query").alias("text"))
    hits = RT.keyword_top_k(ask, t.benchmark, "call", "item_id", "text", "text", k=5)
    contexts = RT.contexts_for(hits, t.benchmark, "call", "item_id", "text").select(
        F.split_part("call", F.lit(":"), F.lit(1)).cast("bigint").alias("conv_id"), F.split_part("call", F.lit(":"), F.lit(2)).cast("bigint").alias("turn"), "contexts")
    a = Q.analyze(calls, Q.safety_scores(V.severity(t)), key="conv_id", retrieved=contexts)
    return a.select("conv_id", "turn", F.size("retrieved_contexts").cast("bigint").alias("n_contexts"), "context_length",
                    F.round("confidence_score", R6).alias("confidence_score"))


REQUEST_SQL = f"""
WITH s AS (SELECT text_id, {X.safety('hate', 'self_harm', 'sexual', 'violence')} AS safety_score FROM v_severity),
a AS (SELECT i.*, coalesce(s.safety_score, {X.d(1.0)}) AS safety_score FROM v_interactions i
      LEFT JOIN s ON s.text_id = i.conv_id),
t AS (SELECT * FROM a WHERE safety_score >= {X.d(0.5)} AND NOT is_error)
SELECT provider, CAST(count(*) AS BIGINT) AS total_requests,
       round(sum({X.chat_cost('query', 'response')}), {R10}) AS total_cost_inr,
       round(sum({X.chat_cost('query', 'response')}) / count(*), {R10}) AS average_cost_per_request,
       round(avg(latency_ms / {X.d(1000)}), {R6}) AS average_response_time
FROM t GROUP BY provider HAVING count(*) > 0
"""


@register("request_summary", V.with_views(REQUEST_SQL, "v_interactions", "v_severity"), "A02 Q8")
def q_request_summary(spark, sf_dir):
    s = Q.request_summary(_analyses(Tables(spark, sf_dir)), by=["provider"])
    return s.select("provider", "total_requests", F.round("total_cost_inr", R10).alias("total_cost_inr"),
                    F.round("average_cost_per_request", R10).alias("average_cost_per_request"),
                    F.round("average_response_time", R6).alias("average_response_time"))


INFER_SQL = f"""
SELECT conv_id, turn,
       CASE WHEN is_error THEN 'error' ELSE model END AS model_used,
       CASE WHEN is_error THEN '{K.QUERY_ERROR_PREFIX}inference failed' ELSE response END AS response,
       CASE WHEN is_error THEN {X.d(0)} ELSE round({X.dispatched_conf('model', 'query', 'response', 'context')}, {R6}) END AS confidence_score,
       CASE WHEN is_error THEN {X.d(0)} ELSE latency_ms END AS latency_ms,
       CASE WHEN is_error THEN {X.d(0)} ELSE round({X.dispatched_cost('model', 'query', 'response')}, {R10}) END AS cost_estimate,
       is_error
FROM v_interactions
"""


def _inferences(t: Tables):
    return Q.inference_records(V.interactions(t, "length"))


@register("inference_records", V.with_views(INFER_SQL, "v_interactions"), "X02 P08 U01 A06")
def q_inference_records(spark, sf_dir):
    r = _inferences(Tables(spark, sf_dir))
    return r.select("conv_id", "turn", "model_used", "response",
                    F.round("confidence_score", R6).alias("confidence_score"), "latency_ms",
                    F.round("cost_estimate", R10).alias("cost_estimate"), "is_error")


PROMPT_SQL = f"""
SELECT conv_id, turn,
       printf('{K.USER_PROMPT_TEMPLATE}', coalesce(context, ''), query) AS prompt,
       CASE WHEN conv_id % 2 = 0 AND coalesce(response, '') <> '' THEN 'user: ' || response || chr(10) || 'model: {K.TRANSCRIPT_ACK.replace("'", "''")}' || chr(10) || 'user: ' || query
            ELSE query END AS transcript,
       CAST(2 AS BIGINT) AS n_messages, '{K.SYSTEM_PROMPT.replace("'", "''")}' AS system_part
FROM v_interactions
"""


@register("grounded_prompts", V.with_views(PROMPT_SQL, "v_interactions"), "P06 P07")
def q_grounded_prompts(spark, sf_dir):
    i = V.interactions(Tables(spark, sf_dir))
    sys_prompt = F.when(F.col("conv_id") % 2 == 0, F.col("response"))
    m = i.select("conv_id", "turn", "query", S.grounded_messages(F.col("context"), F.col("query")).alias("m"),
                 S.role_transcript(F.col("query"), sys_prompt).alias("transcript"))
    return m.select("conv_id", "turn", F.col("m")[1]["content"].alias("prompt"), "transcript", F.size("m").cast("bigint").alias("n_messages"),
                    F.col("m")[0]["content"].alias("system_part"))


TRANSCRIPT_SQL = """
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript
FROM conversations GROUP BY conv_id
"""


@register("conversation_transcripts", TRANSCRIPT_SQL, "P07 F18-style ordered join")
def q_conversation_transcripts(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations
    g = c.groupBy("conv_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_turns"),
                                 F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    return g.select("conv_id", "n_turns", S.turns_transcript(F.col("turns")).alias("transcript"))


CHUNK_SQL = """
WITH c AS (SELECT *, turn // 3 AS chunk FROM conversations)
SELECT conv_id, chunk, CAST(count(*) AS BIGINT) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript
FROM c GROUP BY conv_id, chunk
"""


@register("transcript_chunks", CHUNK_SQL, "P07 (transcript in chunks of a stated number of turns)")
def q_transcript_chunks(spark, sf_dir):
    return Q.transcript_chunks(Tables(spark, sf_dir).conversations, turns=3)


def _positions(t: Tables):
    res = E.with_position(_inferences(t), ["conv_id", "turn"], keys_only=True)
    truth = E.with_position(t.benchmark.select("item_id", F.col("text").alias("truth")), ["item_id"], keys_only=True)
    return res, truth


EVAL_ROWS_SQL = f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos FROM v_interactions),
b AS (SELECT item_id, text AS truth, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM benchmark)
SELECT CAST(r.pos AS BIGINT) AS pos, r.conv_id, r.turn, b.item_id,
       CAST(floor(r.pos / 10) AS BIGINT) AS batch,
       round({X.overlap('r.response', 'b.truth')}, {R6}) AS quality
FROM r JOIN b ON b.pos = r.pos
WHERE NOT r.is_error
"""


@register("evaluation_alignment", V.with_views(EVAL_ROWS_SQL, "v_interactions"), "J01 F10 U02 W04")
def q_evaluation_alignment(spark, sf_dir):
    res, truth = _positions(Tables(spark, sf_dir))
    a = E.quality_scores(E.align_by_position(res, truth.select("pos", "item_id", "truth")))
    a = E.batch_numbers(a)
    return a.select("pos", "conv_id", "turn", "item_id", "batch", F.round("quality", R6).alias("quality"))


EVAL_SQL = f"""
WITH i AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos FROM v_interactions),
r AS (SELECT pos, is_error,
             CASE WHEN is_error THEN 'x' ELSE response END AS response,
             CASE WHEN is_error THEN {X.d(0)} ELSE {X.dispatched_conf('model', 'query', 'response', 'context')} END AS confidence_score,
             CASE WHEN is_error THEN {X.d(0)} ELSE latency_ms END AS latency_ms,
             CASE WHEN is_error THEN {X.d(0)} ELSE {X.dispatched_cost('model', 'query', 'response')} END AS cost_estimate
      FROM i),
b AS (SELECT text AS truth, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM benchmark),
j AS (SELECT r.*, b.truth FROM r LEFT JOIN b ON b.pos = r.pos)
SELECT CAST(count(*) AS BIGINT) AS total_queries,
       CAST(count(*) FILTER (WHERE NOT is_error) AS BIGINT) AS successful_responses,
       round(avg(latency_ms), {R6}) AS average_latency_ms,
       round(avg(confidence_score), {R6}) AS average_confidence,
       round(sum(cost_estimate), 8) AS total_cost_inr,
       round(avg({X.overlap('response', 'truth')}) FILTER (WHERE truth IS NOT NULL AND NOT is_error), {R6}) AS average_quality_score,
       CAST(count(*) FILTER (WHERE truth IS NOT NULL AND NOT is_error) AS BIGINT) AS quality_scores_count
FROM j
"""


@register("evaluation_summary", V.with_views(EVAL_SQL, "v_interactions"), "A05 A06 J01 F10 Q10")
def q_evaluation_summary(spark, sf_dir):
    res, truth = _positions(Tables(spark, sf_dir))
    s = E.evaluation_summary(res, truth)
    return s.select("total_queries", "successful_responses",
                    F.round("average_latency_ms", R6).alias("average_latency_ms"),
                    F.round("average_confidence", R6).alias("average_confidence"),
                    F.round("total_cost_inr", 8).alias("total_cost_inr"),
                    F.round("average_quality_score", R6).alias("average_quality_score"),
                    "quality_scores_count")


ACCURACY_SQL = """
WITH j AS (SELECT l.quality AS y, CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS p
           FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS accuracy,
       CAST(count(*) FILTER (WHERE y = 1 AND p = 1) AS BIGINT) AS tp,
       CAST(count(*) FILTER (WHERE y = 0 AND p = 1) AS BIGINT) AS fp,
       CAST(count(*) FILTER (WHERE y = 0 AND p = 0) AS BIGINT) AS tn,
       CAST(count(*) FILTER (WHERE y = 1 AND p = 0) AS BIGINT) AS fn
FROM j
"""


@register("model_accuracy", ACCURACY_SQL, "D06")
def q_model_accuracy(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        F.col("quality").alias("y"), F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("p"))
    a = E.model_accuracy(j, "y", "p")
    return a.select("n", F.round("accuracy", 6).alias("accuracy"), "tp", "fp", "tn", "fn")
