"""Registered document-pipeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..operators import documents as D
from ..operators import stitching as ST
from ..session import Tables
from . import sqlexpr as X
from . import views as V
from .catalog import register

# patterns as DuckDB (RE2) reads them: same text, '(?i)' for the amount pattern
_RE = {t: p for t, _, p in K.ENTITY_PATTERNS}


def _sql_entities(text_expr: str) -> str:
    parts = []
    for t, c, p in K.ENTITY_PATTERNS:
        flag = "(?i)" if t in K.CASE_INSENSITIVE_ENTITIES else ""
        parts.append(f"list_transform(regexp_extract_all({text_expr}, '{flag}{p}'), "
                     f"lambda v: {{'type': '{t}', 'value': v, 'confidence': {c}::DOUBLE}})")
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


FUSION_SQL = """
WITH v AS (
  SELECT *, CASE source WHEN 'azure_form_recognizer' THEN 3 WHEN 'azure_cv' THEN 2 WHEN 'tesseract' THEN 1 ELSE 0 END AS pref
  FROM v_candidates WHERE error IS NULL AND confidence > 0),
m AS (SELECT *, max(confidence) OVER (PARTITION BY doc_id, page_number) AS mx FROM v),
k AS (SELECT doc_id, page_number, source, text, confidence,
             row_number() OVER (PARTITION BY doc_id, page_number ORDER BY pref DESC, reading_pos) AS rn
      FROM m WHERE abs(confidence - mx) <= 0.1::DOUBLE)
SELECT p.doc_id, p.page_number, k.source,
       coalesce(k.text, 'No text could be extracted from this page.') AS text_content,
       coalesce(k.confidence, 0.0::DOUBLE) AS confidence_score
FROM v_pages p LEFT JOIN k ON k.doc_id = p.doc_id AND k.page_number = p.page_number AND k.rn = 1
"""


def _fused(t: Tables):
    return D.fuse_readings(V.candidates(t))


@register("ocr_fusion", V.with_views(FUSION_SQL, "v_candidates"), "P03 W01 J02 L04")
def q_ocr_fusion(spark, sf_dir):
    return _fused(Tables(spark, sf_dir))


ROLLUP_SQL = """
WITH f AS (""" + FUSION_SQL.strip().replace("\n", "\n  ") + """),
d AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS total_pages,
         coalesce(avg(confidence_score), 0.0) AS overall_confidence,
         coalesce(string_agg(text_content, chr(10) ORDER BY page_number) FILTER (WHERE text_content <> ''), '') AS full_text
  FROM f GROUP BY doc_id)
SELECT doc_id, total_pages, round(overall_confidence, 6) AS overall_confidence,
       round(total_pages::DOUBLE / 1000 * 0.83 + total_pages::DOUBLE * 0.004, 10) AS cost_estimate,
       CAST(length(full_text) AS BIGINT) AS full_text_chars,
       CAST(len(list_filter(string_split_regex(full_text, '""" + X.BLANKS + """'), lambda x: x <> '')) AS BIGINT) AS total_words,
       array_to_string(string_split(full_text, '.')[1:3], '. ') || '.' AS summary_head
FROM d
"""


@register("document_rollup", V.with_views(ROLLUP_SQL, "v_candidates"), "A04 F06 F18 F19 F20 L02 Q14 Q23")
def q_document_rollup(spark, sf_dir):
    docs = ST.rollup(_fused(Tables(spark, sf_dir)))
    return docs.select("doc_id", "total_pages",
                       F.round("overall_confidence", 6).alias("overall_confidence"),
                       F.round("cost_estimate", 10).alias("cost_estimate"),
                       "full_text_chars", "total_words", "summary_head")


ENTITIES_SQL = """
WITH e AS (SELECT doc_id, (""" + _sql_entities("coalesce(text, '')") + """) AS l FROM documents),
x AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM e)
SELECT doc_id, CAST(i AS BIGINT) AS entity_pos, l[i].type AS entity_type, l[i].value AS value,
       l[i].confidence AS confidence
FROM x
"""


@register("document_entities", ENTITIES_SQL, "F13 F14 F15 F16 F17 L01 Q4-Q7 Q15")
def q_document_entities(spark, sf_dir):
    t = Tables(spark, sf_dir)
    docs = t.documents.select(
        "doc_id", T.extract_entities(F.col("text")).alias("extracted_entities"))
    return D.explode_entities(docs)


COUNTS_SQL = """
WITH f AS (""" + FUSION_SQL.strip().replace("\n", "\n  ") + """),
d AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS total_pages,
         coalesce(string_agg(text_content, chr(10) ORDER BY page_number) FILTER (WHERE text_content <> ''), '') AS full_text
  FROM f GROUP BY doc_id)
SELECT doc_id, total_pages,
       CAST(len((""" + _sql_entities("full_text") + """)) AS BIGINT) AS entities_found,
       CAST(0 AS BIGINT) AS tables_found, CAST(0 AS BIGINT) AS key_value_pairs
FROM d
"""


@register("extraction_counts", V.with_views(COUNTS_SQL, "v_candidates"), "A09 L01 F18")
def q_extraction_counts(spark, sf_dir):
    return ST.extraction_counts(_fused(Tables(spark, sf_dir)))


PROCESSING_SQL = """
WITH f AS (""" + FUSION_SQL.strip().replace("\n", "\n  ") + """),
d AS (SELECT doc_id, count(*) AS total_pages, coalesce(avg(confidence_score), 0.0) AS overall_confidence, sum((doc_id + page_number) % 9 * 1.5) AS seconds
      FROM f GROUP BY doc_id)
SELECT CAST(count(*) AS BIGINT) AS documents_processed,
       CAST(sum(total_pages) AS BIGINT) AS pages_processed, round(avg(seconds), 6) AS average_processing_time,
       round(sum(total_pages::DOUBLE / 1000 * 0.83 + total_pages::DOUBLE * 0.004), 8) AS total_cost_inr,
       round(avg(overall_confidence), 6) AS average_confidence,
       round(sum(total_pages)::DOUBLE / count(*), 6) AS pages_per_document
FROM d HAVING count(*) > 0
"""


@register("processing_summary", V.with_views(PROCESSING_SQL, "v_candidates"), "A03")
def q_processing_summary(spark, sf_dir):
    read = _fused(Tables(spark, sf_dir)).withColumn("seconds", (F.col("doc_id") + F.col("page_number")) % 9 * F.lit(1.5))  # reading time of a page
    s = D.processing_summary(D.rollup_documents(read, with_text=False, sums=("seconds",)), "seconds")
    return s.select("documents_processed", "pages_processed", F.round("average_processing_time", 6).alias("average_processing_time"),
                    F.round("total_cost_inr", 8).alias("total_cost_inr"),
                    F.round("average_confidence", 6).alias("average_confidence"),
                    F.round("pages_per_document", 6).alias("pages_per_document"))


PAGES_SQL = """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(12)) AS parts FROM documents),
x AS (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM s)
SELECT doc_id, CAST(i AS INTEGER) AS page_number, printf('page_%03d.png', i) AS image_name,
       CAST(length(parts[i]) AS BIGINT) AS page_chars
FROM x
"""


@register("document_pages", PAGES_SQL, "S05 W05 F23")
def q_document_pages(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = D.number_pages(t.documents.select("doc_id", "text"))
    return p.select("doc_id", "page_number", "image_name",
                    F.length("text_content").cast("bigint").alias("page_chars"))
