"""Document values from pages without a document's text in one place (F18, F19,
F20, L01, A09).

A document's text is its non-empty pages joined by line feeds.  Its length and
word count are sums over pages.  Its head needs the pages up to the third full
stop only, which counts of full stops tell.

An entity may stand across a page border.  No pattern crosses a blank but
between tokens with a digit, or from such a token to the next one.  So a page
takes part in its borders with its *head* (tokens with a digit from its start,
and one token more) and its *tail* (tokens with a digit up to its end); a page
of such tokens only takes part whole.  The pieces between two other pages are a
*seam*.  With M the number of matches,

    M(document) = sum of M(page) + sum over seams of (M(seam) - sum of M(piece)),

which is exact, however many pages a seam spans, and moves heads and tails only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scoring as S
from ..functions import text as T

#: A token without a digit; up to the first one; up to the last one.
_PLAIN = r"(?:^|\s)[^\s\d]+(?=\s|$)"
_TO_FIRST = rf"(?U)^[\s\S]*?{_PLAIN}"
_TO_LAST = rf"(?U)^[\s\S]*{_PLAIN}"


def _texts(pages: DataFrame, doc_key: str) -> DataFrame:
    return pages.where(F.coalesce(F.col("text_content"), F.lit("")) != "").select(F.col(doc_key).alias("_d"), F.col("page_number").alias("_p"), F.col("text_content").alias("_t"))


def matches(text: Column, patterns=K.ENTITY_PATTERNS) -> Column:
    """Number of entities in a text."""
    total = F.lit(0)
    for name, _, p in patterns:
        total = total + F.regexp_count(text, F.lit(T.jvm_pattern(name, p)))
    return total.cast("bigint")


def seams(pages: DataFrame, doc_key: str = "doc_id", patterns=K.ENTITY_PATTERNS) -> DataFrame:
    """(_d, extra): entities that stand in a seam less those in its pieces."""
    p = _texts(pages, doc_key).select("_d", "_p", (~F.rlike("_t", F.lit(f"(?U){_PLAIN}"))).alias("_whole"), "_t")
    # pieces only from here on: (page, side, text); a whole page is one piece
    pieces = F.when(F.col("_whole"), F.array(F.struct(F.lit(0).alias("side"), F.col("_t").alias("x")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.regexp_extract("_t", _TO_FIRST, 0).alias("x")), F.struct(F.lit(1).alias("side"), F.regexp_replace("_t", _TO_LAST, "").alias("x"))))
    x = p.select("_d", "_p", "_whole", F.explode(pieces).alias("c")).select("_d", "_p", F.col("c.side").alias("_side"), F.col("c.x").alias("_x"), (~F.col("_whole") & (F.col("c.side") == 1)).cast("int").alias("_ends"))
    upto = Window.partitionBy("_d").orderBy("_p", "_side").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_seam", F.sum("_ends").over(upto))  # a tail opens the next seam
    joined = x.groupBy("_d", "_seam").agg(F.sort_array(F.collect_list(F.struct("_p", "_side", "_x"))).alias("_c"), F.sum(matches(F.col("_x"), patterns)).alias("_own"))
    seam = F.array_join(F.transform("_c", lambda c: c["_x"]), "\n")
    return joined.groupBy("_d").agg(F.sum(matches(seam, patterns) - F.col("_own")).alias("extra"))


def page_sums(pages: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """Per document: pages, mean confidence, cost, characters and words of its text."""
    t = F.coalesce(F.col("text_content"), F.lit(""))
    full = (t != "").cast("int")
    g = pages.groupBy(doc_key).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_pages"), F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("overall_confidence"),
        (F.sum(F.length(t)) + F.greatest(F.sum(full) - 1, F.lit(0))).cast("bigint").alias("full_text_chars"), F.sum(T.word_count(t)).cast("bigint").alias("total_words"))
    return g.withColumn("cost_estimate", S.page_processing_cost_inr(F.col("total_pages")))


def heads(pages: DataFrame, doc_key: str = "doc_id", n: int = K.SUMMARY_SENTENCES) -> DataFrame:
    """(doc_key, summary_head): the first ``n`` dot-separated pieces of each
    document's text, joined by '. ' plus a final '.'.  Pages behind the n-th full
    stop are not gathered, and of the last one only what stands before it."""
    p = _texts(pages, doc_key)
    stops = F.length("_t") - F.length(F.replace("_t", F.lit("."), F.lit("")))
    before = F.sum("_s").over(Window.partitionBy("_d").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    first = (p.withColumn("_s", stops).withColumn("_b", F.coalesce(before, F.lit(0))).where(F.col("_b") < n)
             .withColumn("_t", F.expr(f"substring_index(_t, '.', cast({int(n)} - _b as int))")))
    piece = F.struct("_p", "_t")
    cut = first.groupBy("_d").agg(F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda c: c["_t"]), "\n").alias("_h"))
    ids = pages.select(doc_key).distinct()
    return ids.join(cut, ids[doc_key].eqNullSafe(cut["_d"]), "left").select(doc_key, T.first_sentences(F.coalesce("_h", F.lit("")), n).alias("summary_head"))


def rollup(pages: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """A04 with text values: page sums and the head of the text."""
    a, b = page_sums(pages, doc_key).alias("a"), heads(pages, doc_key).alias("b")
    return a.join(b, F.col(f"a.{doc_key}").eqNullSafe(F.col(f"b.{doc_key}"))).select("a.*", "b.summary_head")


def extraction_counts(pages: DataFrame, doc_key: str = "doc_id", patterns=K.ENTITY_PATTERNS) -> DataFrame:
    """Pages and entities per document (no tables or pairs: those come with forms)."""
    own = pages.groupBy(doc_key).agg(F.count(F.lit(1)).cast("bigint").alias("total_pages"), F.sum(matches(F.coalesce("text_content", F.lit("")), patterns)).alias("_own"))
    extra = seams(pages, doc_key, patterns)
    zero = F.lit(0).cast("bigint")
    return (own.join(extra, own[doc_key].eqNullSafe(extra["_d"]), "left")
            .select(doc_key, "total_pages", (F.col("_own") + F.coalesce("extra", zero)).cast("bigint").alias("entities_found"), zero.alias("tables_found"), zero.alias("key_value_pairs")))
