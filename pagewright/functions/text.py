"""Column expressions over document text (F13-F24, L01, L02, D04 masks).

Regular expressions run on the JVM (``regexp_extract_all`` / ``rlike`` /
``regexp_replace``).  The patterns are compiled with ``(?U)`` so that ``\\d``,
``\\w``, ``\\s`` and ``\\b`` are Unicode-aware, as in Python's ``re`` on
``str``; the case-insensitive pattern uses Unicode case folding too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def jvm_pattern(entity_type: str, pattern: str) -> str:
    flags = "iU" if entity_type in K.CASE_INSENSITIVE_ENTITIES else "U"
    return f"(?{flags}){pattern}"


ENTITY_STRUCT = "struct<type:string,value:string,confidence:double>"


# F13-F17 -----------------------------------------------------------------------
def entity_matches(text, entity_type: str) -> Column:
    """All matches of one entity pattern, in text order."""
    for t, _, p in K.ENTITY_PATTERNS:
        if t == entity_type:
            return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(jvm_pattern(t, p)), 0)
    raise KeyError(entity_type)


def _entity_builder(t: str, conf: float):
    def build(v: Column) -> Column:
        return F.struct(F.lit(t).alias("type"), v.alias("value"), F.lit(float(conf)).alias("confidence"))
    return build


# L01 -------------------------------------------------------------------------
def extract_entities(text, limit: int | None = None, patterns=K.ENTITY_PATTERNS) -> Column:
    """array<struct<type, value, confidence>>: every date, then amounts,
    percentages, emails and phones, each in text order.  All of them: a cut is
    made only where a caller gives a ``limit`` (``K.ENTITY_LIMIT`` is the usual one).

    All five patterns run in one projection; arrays keep their order, so no
    sort is needed.
    """
    parts = []
    for t, conf, p in patterns:
        m = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(jvm_pattern(t, p)), 0)
        parts.append(F.transform(m, _entity_builder(t, conf)))
    allm = F.concat(*parts) if len(parts) > 1 else parts[0]
    return F.slice(allm, 1, limit) if limit is not None else allm


# F18 -------------------------------------------------------------------------
def join_page_texts(pages_struct_array) -> Column:
    """Non-empty page texts joined by newlines in page order.

    Input: array<struct<page_number, text>> (any order; sorted here).
    """
    ordered = F.array_sort(_c(pages_struct_array))
    texts = F.transform(F.filter(ordered, lambda p: p["text"].isNotNull() & (p["text"] != "")),
                        lambda p: p["text"])
    return F.array_join(texts, "\n")


# F20 -------------------------------------------------------------------------
def word_count(s) -> Column:
    parts = F.split(F.coalesce(_c(s), F.lit("")), K.BLANKS)
    return F.size(F.filter(parts, lambda x: x != "")).cast("bigint")


# L02 / F19 -------------------------------------------------------------------
def first_sentences(full_text, n: int = K.SUMMARY_SENTENCES) -> Column:
    """First ``n`` dot-separated pieces joined by '. ' plus a final '.'."""
    pieces = F.slice(F.split(F.coalesce(_c(full_text), F.lit("")), r"\.", -1), 1, n)
    return F.concat(F.array_join(pieces, ". "), F.lit("."))


def document_summary(full_text, n_pages, avg_confidence, n_tables=None, n_kv=None) -> Column:
    """Extractive summary plus the statistics sentence.

    The percentage is formatted by Java (half-up on the decimal form); the
    numeric ``avg_confidence`` is always carried beside it for exact use.
    """
    stats = F.format_string("\n\nDocument Statistics: %d pages, %d words, %.1f%% average confidence.",
                            _c(n_pages).cast("bigint"), word_count(full_text),
                            _c(avg_confidence).cast("double") * F.lit(100.0))
    parts = [first_sentences(full_text), stats]
    if n_tables is not None:
        parts.append(F.when(_c(n_tables) > 0, F.format_string(" Contains %d tables.", _c(n_tables).cast("bigint")))
                     .otherwise(F.lit("")))
    if n_kv is not None:
        parts.append(F.when(_c(n_kv) > 0, F.format_string(" Extracted %d key-value pairs.", _c(n_kv).cast("bigint")))
                     .otherwise(F.lit("")))
    return F.concat(*parts)


# D04 -------------------------------------------------------------------------
def mask_entities(text, types=("email", "phone_number"), token: str = "[{type}]") -> Column:
    """Replace every match of the given entity patterns by a type token."""
    out = F.coalesce(_c(text), F.lit(""))
    for t, _, p in K.ENTITY_PATTERNS:
        if t in types:
            out = F.regexp_replace(out, jvm_pattern(t, p), token.format(type=t.upper()))
    return out


# F22 / F23 / F24 -------------------------------------------------------------
def file_extension(path) -> Column:
    """Lower-cased extension without the dot ('' when there is none)."""
    return F.lower(F.regexp_extract(_c(path), r"\.([^./]+)$", 1))


def page_image_name(page_number) -> Column:
    return F.format_string(K.PAGE_IMAGE_NAME, _c(page_number).cast("int"))


def iso_timestamp(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


# S05 -------------------------------------------------------------------------
def split_pages(text, page_break: str = K.PAGE_BREAK) -> Column:
    """Split a document text at page breaks; use with ``posexplode``."""
    return F.split(F.coalesce(_c(text), F.lit("")), "\\Q" + page_break + "\\E", -1)
