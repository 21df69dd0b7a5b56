"""Column expressions for scoring and pricing model calls.

Every function takes and returns ``Column`` and is built from Spark's own
expressions, so it stays inside whole-stage code generation.  Floating point
is kept in double and the operation order follows the formulas, so values are
bit-for-bit what the plain arithmetic gives.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _d(v: float) -> Column:
    return F.lit(float(v))


# F01 / F25 -------------------------------------------------------------------
def text_length(s) -> Column:
    """Length in characters (code points); NULL counts as empty."""
    return F.length(F.coalesce(_c(s), F.lit(""))).cast("bigint")


def token_estimate(s) -> Column:
    """len(s) / 4 as a double, not rounded."""
    return text_length(s).cast("double") / _d(K.CHARS_PER_TOKEN)


# F02 -------------------------------------------------------------------------
def chat_cost_inr(query, response,
                  input_usd_per_token: float = K.CHAT_INPUT_USD_PER_TOKEN,
                  output_usd_per_token: float = K.CHAT_OUTPUT_USD_PER_TOKEN,
                  usd_to_inr: float = K.USD_TO_INR) -> Column:
    """Chat call price in INR; the context is not billed."""
    usd = (token_estimate(query) * _d(input_usd_per_token)
           + token_estimate(response) * _d(output_usd_per_token))
    return usd * _d(usd_to_inr)


# F03 -------------------------------------------------------------------------
def custom_model_cost_inr(input_len, output_len,
                          usd_per_1k: float = K.CUSTOM_USD_PER_1K_TOKENS,
                          usd_to_inr: float = K.USD_TO_INR) -> Column:
    """((in + out) / 4) / 1000 * 0.002 * 83, from two lengths."""
    tokens = _c(input_len).cast("double") / _d(K.CHARS_PER_TOKEN) + _c(output_len).cast("double") / _d(K.CHARS_PER_TOKEN)
    return tokens / _d(1000) * _d(usd_per_1k) * _d(usd_to_inr)


# F04 -------------------------------------------------------------------------
def gemini_cost_inr(input_len, output_len,
                    input_usd_per_1k: float = K.GEMINI_INPUT_USD_PER_1K,
                    output_usd_per_1k: float = K.GEMINI_OUTPUT_USD_PER_1K,
                    usd_to_inr: float = K.USD_TO_INR) -> Column:
    i = _c(input_len).cast("double") / _d(K.CHARS_PER_TOKEN)
    o = _c(output_len).cast("double") / _d(K.CHARS_PER_TOKEN)
    usd = i / _d(1000) * _d(input_usd_per_1k) + o / _d(1000) * _d(output_usd_per_1k)
    return usd * _d(usd_to_inr)


# F05 -------------------------------------------------------------------------
def training_cost_inr(seconds, usd_per_hour: float = K.TRAINING_USD_PER_HOUR,
                      usd_to_inr: float = K.USD_TO_INR) -> Column:
    return _c(seconds).cast("double") / _d(3600) * _d(usd_per_hour) * _d(usd_to_inr)


# F21 -------------------------------------------------------------------------
def elapsed_seconds(started, ended) -> Column:
    """Seconds between two clock columns, with their fraction."""
    return (F.unix_micros(_c(ended)) - F.unix_micros(_c(started))).cast("double") / _d(1_000_000)


# F06 -------------------------------------------------------------------------
def page_processing_cost_inr(n_pages, per_1000: float = K.PAGE_READ_INR_PER_1000,
                             per_page: float = K.PAGE_FORM_INR_PER_PAGE) -> Column:
    n = _c(n_pages).cast("double")
    return n / _d(1000) * _d(per_1000) + n * _d(per_page)


# F12 -------------------------------------------------------------------------
def has_uncertainty(response, phrases=K.GROUNDED_UNCERTAIN_PHRASES, strict: bool = False) -> Column:
    """Plain substring test of each phrase in the lower-cased response.

    Phrases are used as given (a capitalised phrase can then never match,
    which is the behaviour being matched); ``strict=True`` lower-cases them.
    """
    low = F.lower(F.coalesce(_c(response), F.lit("")))
    out = F.lit(False)
    for p in phrases:
        out = out | low.contains(p.lower() if strict else p)
    return out


# F07 -------------------------------------------------------------------------
def grounded_confidence(response, context, strict_phrases: bool = False, context_chars=None) -> Column:
    """Mean of context-length, response-length and uncertainty factors.  Of the
    context only its length counts: ``context_chars`` may stand for the text."""
    cl = text_length(context) if context_chars is None else F.coalesce(_c(context_chars), F.lit(0))
    rl = text_length(response)
    f1 = (F.when(cl > K.GROUNDED_CONTEXT_STEPS[0][0], _d(K.GROUNDED_CONTEXT_STEPS[0][1]))
          .when(cl > K.GROUNDED_CONTEXT_STEPS[1][0], _d(K.GROUNDED_CONTEXT_STEPS[1][1]))
          .otherwise(_d(K.GROUNDED_CONTEXT_ELSE)))
    f2 = (F.when(rl > K.GROUNDED_RESPONSE_STEPS[0][0], _d(K.GROUNDED_RESPONSE_STEPS[0][1]))
          .when(rl > K.GROUNDED_RESPONSE_STEPS[1][0], _d(K.GROUNDED_RESPONSE_STEPS[1][1]))
          .otherwise(_d(K.GROUNDED_RESPONSE_ELSE)))
    f3 = F.when(has_uncertainty(response, K.GROUNDED_UNCERTAIN_PHRASES, strict_phrases),
                _d(K.UNCERTAIN_YES)).otherwise(_d(K.UNCERTAIN_NO))
    return (f1 + f2 + f3) / _d(3)


# F20 (used by F08) -------------------------------------------------------------
def word_count(s) -> Column:
    """Whitespace-separated words, empty pieces dropped."""
    parts = F.split(F.coalesce(_c(s), F.lit("")), K.BLANKS)
    return F.size(F.filter(parts, lambda x: x != "")).cast("bigint")


# F08 -------------------------------------------------------------------------
def bare_confidence(query, response, enabled: bool = True, strict_phrases: bool = False) -> Column:
    if not enabled:
        return _d(K.CONFIDENCE_WHEN_OFF)
    f1 = F.when(text_length(response) > K.BARE_RESPONSE_OVER, _d(K.BARE_RESPONSE_YES)).otherwise(_d(K.BARE_RESPONSE_NO))
    f2 = F.when(word_count(query) > K.BARE_QUERY_WORDS_OVER, _d(K.BARE_QUERY_YES)).otherwise(_d(K.BARE_QUERY_NO))
    f3 = F.when(has_uncertainty(response, K.BARE_UNCERTAIN_PHRASES, strict_phrases),
                _d(K.UNCERTAIN_YES)).otherwise(_d(K.UNCERTAIN_NO))
    return (f1 + f2 + f3) / _d(3)


# F09 -------------------------------------------------------------------------
def gemini_confidence() -> Column:
    return _d(K.GEMINI_CONFIDENCE)


# Model dispatch as plain expressions ------------------------------------
def dispatched_cost_inr(model, query, response) -> Column:
    m = _c(model)
    ql, rl = text_length(query), text_length(response)
    return (F.when(m == "custom", custom_model_cost_inr(ql, rl))
            .when(m == "gemini", gemini_cost_inr(ql, rl))
            .otherwise(chat_cost_inr(query, response)))


def dispatched_confidence(model, query, response, context, context_chars=None) -> Column:
    m = _c(model)
    return (F.when(m == "custom", bare_confidence(query, response))
            .when(m == "gemini", gemini_confidence())
            .otherwise(grounded_confidence(response, context, context_chars=context_chars)))


# F10 / U02 -------------------------------------------------------------------
def word_set(s) -> Column:
    """Distinct lower-cased whitespace tokens."""
    parts = F.split(F.lower(F.coalesce(_c(s), F.lit(""))), K.BLANKS)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def word_overlap(response, truth) -> Column:
    """|R ∩ T| / |T| over distinct lower-cased tokens; 0 when T is empty; at most 1."""
    r, t = word_set(response), word_set(truth)
    n_t = F.size(t)
    ov = F.size(F.array_intersect(r, t)).cast("double") / n_t.cast("double")
    return F.when(n_t == 0, _d(0.0)).otherwise(F.least(ov, _d(1.0)))


# F11 -------------------------------------------------------------------------
def safety_score(*severities, scale: float = K.SAFETY_SEVERITY_SCALE) -> Column:
    """max(0, 1 - max(severity)/6) over the present categories; none present -> 1.0.

    ``greatest`` skips NULLs, so a missing category simply does not count; if
    all are missing the maximum is NULL and the text counts as safe.
    """
    cols = [_c(s).cast("double") for s in severities]
    mx = F.greatest(*cols) if len(cols) > 1 else cols[0]
    return F.when(mx.isNull(), _d(1.0)).otherwise(F.greatest(_d(0.0), _d(1.0) - mx / _d(scale)))


# P05 -------------------------------------------------------------------------
def preview(s, n: int = K.PREVIEW_CHARS) -> Column:
    c = _c(s)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


# P06 -------------------------------------------------------------------------
def grounded_prompt(context, query) -> Column:
    """The user part of the grounded prompt (the system part is a constant)."""
    return F.format_string(K.USER_PROMPT_TEMPLATE, F.coalesce(_c(context), F.lit("")), _c(query))


def grounded_messages(context, query) -> Column:
    """The whole grounded prompt as (role, content) turns: system, then user."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(K.SYSTEM_PROMPT).alias("content")),
                   F.struct(F.lit("user").alias("role"), grounded_prompt(context, query).alias("content")))


# P07 -------------------------------------------------------------------------
def role_transcript(query, system_prompt=None) -> Column:
    """Three fixed turns when a system prompt is given, else the bare query."""
    q = _c(query)
    if system_prompt is None:
        return q
    sp = F.lit(system_prompt) if isinstance(system_prompt, str) else system_prompt
    return F.when(sp.isNull() | (sp == ""), q).otherwise(
        F.concat_ws("\n", F.concat(F.lit("user: "), sp),
                    F.lit("model: " + K.TRANSCRIPT_ACK),
                    F.concat(F.lit("user: "), q)))


def turns_transcript(turns) -> Column:
    """``role: text`` lines joined by newlines, from an array of (turn, role, text) structs."""
    ordered = F.array_sort(_c(turns))
    return F.array_join(F.transform(ordered, lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")


# P02 -------------------------------------------------------------------------
def choose_context(given_content, retrieved_contexts, use_rag: bool = True) -> Column:
    """Retrieve only with RAG on and no content given; join contexts by newline."""
    given = F.coalesce(_c(given_content), F.lit(""))
    if not use_rag:
        return given
    joined = F.array_join(F.coalesce(_c(retrieved_contexts), F.array().cast("array<string>")), "\n")
    return F.when(given == "", joined).otherwise(given)
