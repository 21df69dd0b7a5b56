"""Registered form queries (N01-N03, A09, P08, P09): form-reader JSON per page,
built from the conversation turns, some of it broken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nested as N
from ..operators import documents as D
from ..session import Tables
from .catalog import register


def forms(t: Tables) -> DataFrame:
    """(doc_id, page_number, form_json): two-by-two tables, pairs with repeated
    and missing values, a page without a size now and then, and broken JSON."""
    c, i = F.col("conv_id"), F.col("turn")
    label = lambda *xs: F.concat_ws("-", *[x.cast("string") for x in xs])
    cells = lambda k: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.struct(
        label(c, i, k, j).alias("content"), F.floor(j / 2).cast("int").alias("row_index"), (j % 2).cast("int").alias("column_index"),
        F.when(j == 0, 2).cast("int").alias("row_span"), F.lit(None).cast("int").alias("column_span"), F.when(j < 2, "columnHeader").alias("kind")))
    counted = lambda n, f: F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: k < n), f)
    form = F.struct(
        F.when((c + i) % 5 != 0, F.array(F.struct((c % 100 + 8.5).alias("width"), F.lit(11.0).alias("height")))).alias("pages"),
        counted((c + i) % 4, lambda k: F.struct(label(c, i, k).alias("content"))).alias("paragraphs"),
        counted((c + i) % 3, lambda k: F.struct(F.lit(2).alias("row_count"), F.lit(2).alias("column_count"), cells(k).alias("cells"))).alias("tables"),
        counted((c * 3 + i) % 5, lambda k: F.struct(F.concat(F.lit("k"), (k % 2).cast("string")).alias("key"),
                                                    F.when((c + k) % 4 != 0, label(c, i, k)).alias("value"))).alias("key_value_pairs"))
    broken = (c * 7 + i) % 13 == 0
    return t.conversations.select(c.alias("doc_id"), (i + 1).cast("int").alias("page_number"),
                                  F.when(broken, F.lit('{"pages": [')).otherwise(F.to_json(form)).alias("form_json"))


FORMS = """
p AS (SELECT conv_id AS c, turn AS i, CAST(turn + 1 AS INTEGER) AS page_number, (conv_id * 7 + turn) % 13 = 0 AS broken FROM conversations),
kv AS (SELECT c, page_number, i, k, 'k' || (k % 2) AS key, c || '-' || i || '-' || k AS value
       FROM p, range(0, 4) r(k) WHERE NOT broken AND k < (c * 3 + i) % 5 AND (c + k) % 4 <> 0),
kl AS (SELECT c, page_number, key, arg_max(value, k) AS value FROM kv GROUP BY ALL)"""


LAYOUT_SQL = f"""
WITH {FORMS.strip()}
SELECT c AS doc_id, page_number,
       CASE WHEN broken OR (c + i) % 5 = 0 THEN 0.0 ELSE c % 100 + 8.5 END::DOUBLE AS page_width,
       CASE WHEN broken OR (c + i) % 5 = 0 THEN 0.0 ELSE 11.0 END::DOUBLE AS page_height,
       CAST(CASE WHEN broken THEN 0 ELSE (c + i) % 4 END AS BIGINT) AS paragraphs
FROM p
"""


def _read(spark, sf_dir) -> DataFrame:
    return N.extract_form(forms(Tables(spark, sf_dir)))


@register("form_layout", LAYOUT_SQL, "N01 P09")
def q_form_layout(spark, sf_dir):
    return _read(spark, sf_dir).select("doc_id", "page_number", "layout.page_width", "layout.page_height",
                                       F.size("layout.paragraphs").cast("bigint").alias("paragraphs"))


CELLS_SQL = f"""
WITH {FORMS.strip()}
SELECT c AS doc_id, page_number, CAST(t AS INTEGER) AS table_index, CAST(j // 2 AS INTEGER) AS row_index, CAST(j % 2 AS INTEGER) AS column_index,
       CAST(CASE WHEN j = 0 THEN 2 ELSE 1 END AS INTEGER) AS row_span, CAST(1 AS INTEGER) AS column_span,
       CASE WHEN j < 2 THEN 'columnHeader' ELSE 'content' END AS kind, c || '-' || i || '-' || t || '-' || j AS content
FROM p, range(0, 4) a(t), range(0, 4) b(j) WHERE NOT broken AND t < (c + i) % 3
"""


@register("table_cells", CELLS_SQL, "N02")
def q_table_cells(spark, sf_dir):
    return N.table_cells(_read(spark, sf_dir), ["doc_id", "page_number"])


KV_SQL = f"""
WITH {FORMS.strip()}
SELECT c AS doc_id, page_number, key, value FROM kl
"""


@register("key_value_rows", KV_SQL, "N03")
def q_key_value_rows(spark, sf_dir):
    return N.key_value_rows(_read(spark, sf_dir), ["doc_id", "page_number"])


PAGE_SQL = f"""
WITH {FORMS.strip()}, n AS (SELECT c, page_number, count(*) AS k FROM kl GROUP BY ALL)
SELECT p.c AS doc_id, p.page_number, CASE WHEN broken THEN 'Error processing page ' || p.page_number || ': form could not be read' END AS error_text,
       CASE WHEN broken THEN 0.0 ELSE 0.8 END::DOUBLE AS confidence_score,
       CAST(CASE WHEN broken THEN 0 ELSE (p.c + i) % 3 END AS BIGINT) AS tables_found, CAST(coalesce(n.k, 0) AS BIGINT) AS key_value_pairs
FROM p LEFT JOIN n ON n.c = p.c AND n.page_number = p.page_number
"""


@register("page_results", PAGE_SQL, "P08 (page rows) N02 N03")
def q_page_results(spark, sf_dir):
    r = D.form_page_results(_read(spark, sf_dir))
    return r.select("doc_id", "page_number", "error_text", "confidence_score", F.size("tables").cast("bigint").alias("tables_found"),
                    F.size("key_value_pairs").cast("bigint").alias("key_value_pairs"))


FORM_ROLLUP_SQL = f"""
WITH {FORMS.strip()}, n AS (SELECT c, count(*) AS k FROM kl GROUP BY c)
SELECT p.c AS doc_id, CAST(count(*) AS BIGINT) AS total_pages, round(avg(CASE WHEN broken THEN 0.0 ELSE 0.8 END::DOUBLE), 6) AS overall_confidence,
       CAST(sum(CASE WHEN broken THEN 0 ELSE (c + i) % 3 END) AS BIGINT) AS tables_found, CAST(coalesce(any_value(n.k), 0) AS BIGINT) AS key_value_pairs,
       CAST(count(*) FILTER (WHERE broken) AS BIGINT) AS failed_pages
FROM p LEFT JOIN n USING (c) GROUP BY p.c
"""


@register("form_rollup", FORM_ROLLUP_SQL, "A04 A09 P08")
def q_form_rollup(spark, sf_dir):
    pages = D.form_page_results(_read(spark, sf_dir))
    docs = D.rollup_documents(pages, with_text=False)
    failed = F.count(F.when(F.col("error_text").isNotNull(), 1)).cast("bigint").alias("failed_pages")
    return (docs.join(pages.groupBy("doc_id").agg(failed), "doc_id")
            .select("doc_id", "total_pages", F.round("overall_confidence", 6).alias("overall_confidence"), F.col("total_tables").alias("tables_found"),
                    F.col("total_kv_pairs").alias("key_value_pairs"), "failed_pages"))
