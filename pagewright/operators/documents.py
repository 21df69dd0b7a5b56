"""Document pipeline operators: reading fusion, page results, document rollups.

P03 valid-reading filter, W01 fusion, J02 candidate assembly, W05 page
numbering, A04 page -> document rollup with F06 pricing, F18 document text,
F19 summary, L01 entities, A09 extraction counts, A03 processing summary.

Partitioning: fusion groups on ``(doc_id, page_number)`` — at most one row
per reading source per group (three), so even a document holding a third of
all pages is spread over many tasks.  The document rollup then groups on
``doc_id`` with partial (map-side) aggregation for the counts and sums; only
the document text itself is assembled per document, because it *is* one value
per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scoring as S
from ..functions import text as T

PAGE_KEYS = ("doc_id", "page_number")


def _preference(source: Column) -> Column:
    out = F.lit(0)
    for name, p in sorted(K.SOURCE_PREFERENCE.items(), key=lambda kv: kv[1]):
        out = F.when(source == name, F.lit(p)).otherwise(out)
    return out


def _list_position(source: Column) -> Column:
    out = F.lit(len(K.SOURCE_ORDER))
    for i, name in reversed(list(enumerate(K.SOURCE_ORDER))):
        out = F.when(source == name, F.lit(i)).otherwise(out)
    return out


def valid_reading(error: Column | None = None, confidence: Column | None = None) -> Column:
    """No error and confidence > 0 (a clean zero-confidence reading is dropped too)."""
    error = F.col("error") if error is None else error
    confidence = F.col("confidence") if confidence is None else confidence
    return error.isNull() & (confidence > F.lit(0.0))


def fuse_readings(candidates: DataFrame, keys=PAGE_KEYS, pages: DataFrame | None = None,
                  close_within: float = K.CONFIDENCE_CLOSE_WITHIN) -> DataFrame:
    """Pick one reading per page.

    ``candidates``: keys + source, text, confidence, error [, reading_pos].
    Best = highest confidence among valid readings; readings within
    ``close_within`` of it compete on source preference (form > cv >
    tesseract > other), list position breaking ties.  A page with no valid
    reading gets the fallback text and confidence 0.0.  The chosen reading
    keeps its own confidence.

    One aggregation on the page key: each group holds at most one struct per
    source, the arrays are resolved with higher-order functions in the same
    stage.  Pass ``pages`` (keys only needed) to keep pages that have no
    candidate row at all.
    """
    keys = list(keys)
    pos = F.col("reading_pos") if "reading_pos" in candidates.columns else _list_position(F.col("source"))
    r = F.struct(F.col("confidence").cast("double").alias("confidence"),
                 _preference(F.col("source")).alias("pref"),
                 (-pos).alias("neg_pos"),
                 F.col("text").alias("text"),
                 F.col("source").alias("source"))
    g = candidates.groupBy(*keys).agg(
        F.collect_list(F.when(valid_reading(), r)).alias("r"))
    best = F.array_max(F.transform("r", lambda x: x["confidence"]))
    close = F.filter("r", lambda x: F.abs(x["confidence"] - best) <= F.lit(float(close_within)))
    pick = F.array_max(F.transform(close, lambda x: F.struct(
        x["pref"].alias("pref"), x["neg_pos"].alias("neg_pos"), x["text"].alias("text"),
        x["source"].alias("source"), x["confidence"].alias("confidence"))))
    out = g.select(*keys, pick.alias("p")).select(
        *keys,
        F.col("p.source").alias("source"),
        F.coalesce(F.col("p.text"), F.lit(K.NO_TEXT_FALLBACK)).alias("text_content"),
        F.coalesce(F.col("p.confidence"), F.lit(0.0)).alias("confidence_score"))
    if pages is not None:
        out = (pages.select(*keys).join(out, keys, "left")
               .select(*keys, "source",
                       F.coalesce("text_content", F.lit(K.NO_TEXT_FALLBACK)).alias("text_content"),
                       F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score")))
    return out


def number_pages(docs: DataFrame, text_col: str = "text", page_break: str = K.PAGE_BREAK) -> DataFrame:
    """One row per page, numbered from 1 in text order (narrow)."""
    others = [c for c in docs.columns if c != text_col]
    return docs.select(*others, F.posexplode(T.split_pages(F.col(text_col), page_break)).alias("pos", "text_content")) \
        .select(*others, (F.col("pos") + 1).cast("int").alias("page_number"), "text_content",
                T.page_image_name(F.col("pos") + 1).alias("image_name"))


def form_page_results(forms: DataFrame, json_col: str = "form_json", confidence: float = K.DEFAULT_LINE_CONFIDENCE) -> DataFrame:
    """Pages whose form could not be read become error rows (message,
    confidence 0, nothing found) instead of failing the document.  Input: the
    result of ``nested.extract_form``."""
    failed = ~_is_json(F.col(json_col))
    text = F.format_string(K.PAGE_ERROR_TEMPLATE, F.col("page_number"), F.lit("form could not be read"))
    return forms.withColumns({"error_text": F.when(failed, text), "confidence_score": F.when(failed, F.lit(0.0)).otherwise(F.lit(float(confidence)))})


def _is_json(text: Column) -> Column:
    """Whether a text is a JSON object."""
    return F.json_object_keys(text).isNotNull()


def _page_struct() -> Column:
    return F.struct(F.col("page_number").alias("page_number"), F.col("text_content").alias("text"))


def rollup_documents(page_results: DataFrame, doc_key: str = "doc_id", with_text: bool = True, sums=()) -> DataFrame:
    """A04 (+F06, F18): per document page count, mean page confidence, cost.

    Counts and sums aggregate map-side before the shuffle.  ``with_text``
    additionally assembles the document text (non-empty pages, page order),
    which is needed by the summary and the entity extraction.
    """
    extra = [F.sum(c).alias(c) for c in sums]
    if "tables" in page_results.columns:
        extra.append(F.sum(F.size("tables")).cast("bigint").alias("total_tables"))
    if "key_value_pairs" in page_results.columns:
        extra.append(F.sum(F.size("key_value_pairs")).cast("bigint").alias("total_kv_pairs"))
    aggs = [F.count(F.lit(1)).cast("bigint").alias("total_pages"),
            F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("overall_confidence")] + extra
    if with_text:
        aggs.append(T.join_page_texts(F.collect_list(_page_struct())).alias("full_text"))
    g = page_results.groupBy(doc_key).agg(*aggs)
    return g.withColumn("cost_estimate", S.page_processing_cost_inr(F.col("total_pages")))


def summarize_documents(docs: DataFrame, limit: int | None = None,
                        advanced: bool = True) -> DataFrame:
    """F19 + L01 over a rollup: summary text, entity list (capped), word count."""
    n_tables = F.col("total_tables") if "total_tables" in docs.columns else None
    n_kv = F.col("total_kv_pairs") if "total_kv_pairs" in docs.columns else None
    ents = T.extract_entities(F.col("full_text"), limit) if advanced else \
        F.array().cast(f"array<{T.ENTITY_STRUCT}>")
    return docs.select(
        "*",
        T.word_count(F.col("full_text")).alias("total_words"),
        T.document_summary(F.col("full_text"), F.col("total_pages"), F.col("overall_confidence"),
                           n_tables, n_kv).alias("document_summary"),
        ents.alias("extracted_entities"))


def explode_entities(df: DataFrame, keys=("doc_id",), col: str = "extracted_entities") -> DataFrame:
    keys = list(keys)
    # posexplode_outer + a null filter keeps Catalyst from inferring a
    # ``size(<extraction>) > 0`` filter that would run the regexes twice
    return df.select(*keys, F.posexplode_outer(col).alias("entity_pos", "e")).where(F.col("e").isNotNull()).select(
        *keys, (F.col("entity_pos") + 1).cast("bigint").alias("entity_pos"),
        F.col("e.type").alias("entity_type"), F.col("e.value").alias("value"),
        F.col("e.confidence").alias("confidence"))


def extraction_counts(summaries: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """Pages, entities, tables, key-value pairs per document."""
    tables = F.col("total_tables") if "total_tables" in summaries.columns else F.lit(0).cast("bigint")
    kv = F.col("total_kv_pairs") if "total_kv_pairs" in summaries.columns else F.lit(0).cast("bigint")
    return summaries.select(doc_key, "total_pages",
                            F.size("extracted_entities").cast("bigint").alias("entities_found"),
                            tables.alias("tables_found"), kv.alias("key_value_pairs"))


def processing_summary(docs: DataFrame, time_col: str | None = None) -> DataFrame:
    """Documents, pages, average time, total cost, average confidence, pages/document.

    One global aggregate (partial per task, one final row); empty input
    gives no row.
    """
    t = F.avg(time_col) if time_col else F.lit(None).cast("double")
    g = docs.agg(F.count(F.lit(1)).cast("bigint").alias("documents_processed"),
                 F.sum("total_pages").cast("bigint").alias("pages_processed"),
                 t.alias("average_processing_time"),
                 F.sum("cost_estimate").alias("total_cost_inr"),
                 F.avg("overall_confidence").alias("average_confidence"))
    return g.where(F.col("documents_processed") > 0).withColumn(
        "pages_per_document", F.col("pages_processed").cast("double") / F.col("documents_processed").cast("double"))


def process_documents(candidates: DataFrame, pages: DataFrame | None = None,
                      advanced: bool = True, limit: int | None = None) -> DataFrame:
    """The whole document job: fuse -> roll up -> summarise -> entities."""
    fused = fuse_readings(candidates, pages=pages)
    return summarize_documents(rollup_documents(fused), limit=limit, advanced=advanced)
