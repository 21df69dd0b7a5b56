"""Registered data-job queries: admission (S04), plug-in inference (X01),
reading post-processing (P04, P10, N04), training data (D01), validation
(D03), PII detection and masking (D04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scoring as S
from ..functions import text as T
from ..operators import data as DJ
from ..operators import plugins as PL
from ..session import Tables
from ..sources import files as SRC
from . import sqlexpr as X
from . import views as V
from .catalog import register

R6, R10 = 6, 10


ADMISSION_SQL = f"""
SELECT page_id, lower(regexp_extract(url, '\\.([^./]+)$', 1)) AS extension,
       CAST(strlen(html) AS BIGINT) AS size_bytes,
       CASE WHEN url IS NULL THEN 'missing'
            WHEN strlen(html)::DOUBLE > {float(K.MAX_DOCUMENT_MB) * 1024 * 1024}::DOUBLE THEN 'too_large'
            WHEN lower(regexp_extract(url, '\\.([^./]+)$', 1)) NOT IN ({", ".join(f"'{f}'" for f in K.SUPPORTED_FORMATS)})
                 THEN 'unsupported_format' END AS reject_reason
FROM pages
"""


@register("document_admission", ADMISSION_SQL, "S04 F22")
def q_document_admission(spark, sf_dir):
    p = Tables(spark, sf_dir).pages.select("page_id", F.col("url").alias("path"),
                                           F.octet_length("html").cast("bigint").alias("size_bytes"))
    a = SRC.admit_documents(p, path="path", size="size_bytes")
    return a.select("page_id", "extension", "size_bytes", "reject_reason")


INFER_SQL = f"""
WITH r AS (SELECT conv_id, turn, query,
                  array_to_string(string_split(coalesce(query, ''), '.')[1:{K.SUMMARY_SENTENCES}], '. ') || '.' AS response
           FROM v_interactions)
SELECT conv_id, turn, response, false AS is_error, 'custom' AS model_used,
       round({X.bare_conf('query', 'response')}, {R6}) AS confidence_score,
       round({X.custom_cost('query', 'response')}, {R10}) AS cost_estimate
FROM r
"""


@register("batch_inference", V.with_views(INFER_SQL, "v_interactions"), "X01 X02 P08 W04 T06(batch)")
def q_batch_inference(spark, sf_dir):
    calls = V.interactions(Tables(spark, sf_dir), with_context=False)
    r = PL.batch_inference(calls, PL.extractive_model, model="custom")
    return r.select("conv_id", "turn", "response", "is_error", "model_used",
                    F.round("confidence_score", R6).alias("confidence_score"),
                    F.round("cost_estimate", R10).alias("cost_estimate"))


READINGS_SQL = """
WITH w AS (
  SELECT conv_id, turn,
         list_transform(string_split(text, ' '),
                        lambda x, i: {'text': x, 'conf': CAST(((conv_id * 7 + i * 13) % 102) - 1 AS INTEGER)}) AS words,
         list_transform(string_split(text, '. '),
                        lambda x, i: {'text': x, 'confidence': ((conv_id + i * 17) % 100)::DOUBLE / 100}) AS lines
  FROM conversations),
k AS (SELECT conv_id, turn, list_filter(words, lambda x: x.conf > 0) AS kept, lines FROM w)
SELECT conv_id, turn, CAST(len(kept) AS BIGINT) AS words_kept,
       array_to_string(list_transform(kept, lambda x: x.text), ' ') AS words_text,
       round(CASE WHEN len(kept) > 0 THEN list_sum(list_transform(kept, lambda x: x.conf::DOUBLE)) / len(kept) / 100.0
                  ELSE 0.0 END, 6) AS words_confidence,
       array_to_string(list_transform(lines, lambda x: x.text), chr(10)) AS lines_text,
       round(CASE WHEN len(lines) > 0 THEN list_sum(list_transform(lines, lambda x: x.confidence)) / len(lines)
                  ELSE 0.8 END, 6) AS lines_confidence
FROM k
"""


@register("ocr_readings", READINGS_SQL, "P04 P10 N04")
def q_ocr_readings(spark, sf_dir):
    r = DJ.synthetic_readings(Tables(spark, sf_dir).conversations)
    w, ln = F.col("words"), F.col("lines")
    return r.select("conv_id", "turn", F.size(PL.kept_words(w)).cast("bigint").alias("words_kept"),
                    PL.words_text(w).alias("words_text"),
                    F.round(PL.words_confidence(w), 6).alias("words_confidence"),
                    PL.lines_text(ln).alias("lines_text"),
                    F.round(PL.lines_confidence(ln), 6).alias("lines_confidence"))


TRAINING_SQL = """
WITH b AS (SELECT conv_id, turn, trim(query) AS prompt, trim(response) AS completion FROM v_interactions),
f AS (SELECT * FROM b WHERE prompt IS NOT NULL AND completion IS NOT NULL AND prompt <> '' AND completion <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(prompt) ORDER BY conv_id, turn) AS rn FROM f)
SELECT conv_id, turn, prompt, completion,
       CASE WHEN ('0x' || substr(md5(lower(prompt)), 1, 8))::BIGINT % 100 < 80 THEN 'train' ELSE 'validation' END AS split
FROM r WHERE rn = 1
"""


@register("training_data", V.with_views(TRAINING_SQL, "v_interactions"), "D01 S07(records)")
def q_training_data(spark, sf_dir):
    calls = V.interactions(Tables(spark, sf_dir), with_context=False)
    return DJ.prepare_training_data(calls, keys=("conv_id", "turn"))


def _validation_sql() -> str:
    cols = [("documents", "text"), ("documents", "lang"), ("documents", "source"), ("events", "event_type"),
            ("events", "props")]
    parts = []
    for t, c in cols:
        mal = (f"CAST(count(*) FILTER (WHERE {c} IS NOT NULL AND NOT json_valid({c})) AS BIGINT)"
               if c == "props" else "CAST(0 AS BIGINT)")
        parts.append(f"""SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(count(*) AS BIGINT) AS rows,
       CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS nulls,
       CAST(count(*) FILTER (WHERE {c} = '') AS BIGINT) AS empties,
       CAST(min(length({c})) AS BIGINT) AS min_length, CAST(max(length({c})) AS BIGINT) AS max_length,
       CAST(count({c}) - count(DISTINCT {c}) AS BIGINT) AS duplicates,
       {mal} AS malformed_json
FROM {t}""")
    return "\nUNION ALL\n".join(parts)


@register("data_validation", _validation_sql(), "D03")
def q_data_validation(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = DJ.validate_columns(t.documents, "documents", ["text", "lang", "source"])
    b = DJ.validate_columns(t.events, "events", ["event_type", "props"], json_columns=["props"])
    return a.unionByName(b)


def _pii_sql() -> str:
    pat = {t: p for t, _, p in K.ENTITY_PATTERNS}
    e, ph = pat["email"], pat["phone_number"]
    return f"""
SELECT doc_id,
       CAST(len(regexp_extract_all(coalesce(text, ''), '{e}')) AS BIGINT) AS emails,
       CAST(len(regexp_extract_all(coalesce(text, ''), '{ph}')) AS BIGINT) AS phones,
       md5(regexp_replace(regexp_replace(coalesce(text, ''), '{e}', '[EMAIL]', 'g'), '{ph}', '[PHONE_NUMBER]', 'g'))
         AS masked_md5
FROM documents
"""


@register("pii_report", _pii_sql(), "D04 F16 F17 Q6 Q7")
def q_pii_report(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return DJ.pii_report(d, "doc_id", "text").select("doc_id", "emails", "phones",
                                                     F.md5("masked_text").alias("masked_md5"))
