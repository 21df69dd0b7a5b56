"""User plug-in points: batch inference (X01) and page readers.

These are the only places where Python runs per row, because a model or an
OCR engine has to be supplied by the user.  Both use ``mapInPandas`` (Arrow
batches, one Python worker per task) and keep failures as rows:

* X01: the user callable takes a list of query strings and returns as many
  answers, each a text or an exception (that query's own error).  Usually each
  query is sent by itself, once.  With ``whole_slices`` the callable gets
  ``batch_size`` queries at a time; if such a call itself fails, the slice is
  halved until the failing queries are alone.  A failed query becomes an error
  row (``Error processing query: ...``, zeros, model ``error``) and never fails
  the task.  Cost and confidence are computed by JVM column expressions (X02).
* X03: the user callable takes one page's bytes and returns a reading
  ``{text, confidence, words, lines, error}``; exceptions become a reading
  with ``error`` set.  P04, P10 and N04 post-process the readings natively.

Callers should select only the columns the callable needs *before* calling
these (Catalyst cannot push projections or filters through Python).
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import scoring as S

WORD = "struct<text:string,conf:int>"
LINE = "struct<text:string,confidence:double>"
READING_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("words", T.ArrayType(T.StructType([T.StructField("text", T.StringType()),
                                                     T.StructField("conf", T.IntegerType())]))),
    T.StructField("lines", T.ArrayType(T.StructType([T.StructField("text", T.StringType()),
                                                     T.StructField("confidence", T.DoubleType())]))),
    T.StructField("error", T.StringType()),
])


# X01 -------------------------------------------------------------------------
def extractive_model(queries: list[str]) -> list[str]:
    """A stand-in model for tests and demonstrations, no trained one: the first
    three dot-pieces of the input, as in the document summary head."""
    out = []
    for q in queries:
        pieces = (q or "").split(".")[:K.SUMMARY_SENTENCES]
        out.append(". ".join(pieces) + ".")
    return out


def _answers(model_fn, queries: list, clock) -> list[tuple[str | None, str | None, float]]:
    """(response, error, milliseconds) of each query of a slice."""
    t0 = clock()
    try:
        got = list(model_fn(list(queries)))
        if len(got) != len(queries):
            raise ValueError(f"model returned {len(got)} results for {len(queries)} queries")
    except Exception as e:  # noqa: BLE001 - an error row, not a failed job
        if len(queries) == 1:
            return [(None, str(e), 0.0)]
        half = len(queries) // 2
        return _answers(model_fn, queries[:half], clock) + _answers(model_fn, queries[half:], clock)
    each = (clock() - t0) * 1000.0 / len(queries)
    return [(None, str(x), 0.0) if isinstance(x, Exception) else (x, None, each) for x in got]


def batch_inference(df: DataFrame, model_fn: Callable[[list[str]], list] = extractive_model,
                    query: str = "query", keys=("conv_id", "turn"), model: str = "custom",
                    batch_size: int = K.BATCH_SIZE, position: str | None = None, whole_slices: bool = False) -> DataFrame:
    """X01 + X02 + P08 + W04: one result row per input row, order kept.

    Output: keys, query, response, latency_ms (a call's time shared by its
    queries), batch, is_error, model_used, confidence_score, cost_estimate.
    ``batch`` is the row's position div ``batch_size``: the global one, if the
    rows have a ``position`` column (``ordering.with_position``), else its place
    in the task's input.
    """
    keys = list(keys)
    place = [position] if position else []
    src = df.select(*keys, query, *place)
    fields = [src.schema[k] for k in keys] + [T.StructField(query, T.StringType())] + [src.schema[p] for p in place] + [
        T.StructField("response", T.StringType()), T.StructField("latency_ms", T.DoubleType()),
        T.StructField("batch", T.LongType()), T.StructField("is_error", T.BooleanType())]
    schema = T.StructType(fields)
    step = batch_size if whole_slices else 1

    def run(batches):
        seen = 0
        for pdf in batches:
            qs = pdf[query].where(pdf[query].notna(), None).tolist()
            found = [x for lo in range(0, len(qs), step) for x in _answers(model_fn, qs[lo:lo + step], time.perf_counter)]
            out = pdf[keys + [query] + place].copy()
            out["response"] = [r if e is None else K.QUERY_ERROR_PREFIX + e for r, e, _ in found]
            out["latency_ms"] = [ms for _, _, ms in found]
            out["batch"] = [(seen + i) // batch_size for i in range(len(qs))]
            out["is_error"] = [e is not None for _, e, _ in found]
            seen += len(qs)
            yield out

    res = src.mapInPandas(run, schema)
    err = F.col("is_error")
    zero = F.lit(0.0)
    return res.select(
        *keys, query, "response", F.when(err, zero).otherwise(F.col("latency_ms")).alias("latency_ms"),
        (F.floor(F.col(position) / F.lit(batch_size)).cast("bigint").alias("batch") if position else F.col("batch")), err.alias("is_error"),
        F.when(err, F.lit("error")).otherwise(F.lit(model)).alias("model_used"),
        F.when(err, zero).otherwise(S.dispatched_confidence(F.lit(model), F.col(query), F.col("response"),
                                                            F.lit(None).cast("string"))).alias("confidence_score"),
        F.when(err, zero).otherwise(S.dispatched_cost_inr(F.lit(model), F.col(query), F.col("response")))
        .alias("cost_estimate"))


# X03 -------------------------------------------------------------------------
def read_pages(pages: DataFrame, reader_fn: Callable[[bytes], dict], source: str,
               keys=("doc_id", "page_number"), content: str = "content") -> DataFrame:
    """Run a page reader over page bytes -> ``ocr_candidates`` rows
    (keys, source, text, confidence, words, lines, error)."""
    keys = list(keys)
    src = pages.select(*keys, content)
    schema = T.StructType([src.schema[k] for k in keys] + list(READING_SCHEMA.fields))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for b in pdf[content].tolist():
                try:
                    r = dict(reader_fn(b))
                    rows.append({"text": r.get("text"), "confidence": float(r.get("confidence") or 0.0),
                                 "words": r.get("words"), "lines": r.get("lines"), "error": r.get("error")})
                except Exception as e:  # noqa: BLE001 - a failed page is a reading with an error
                    rows.append({"text": "", "confidence": 0.0, "words": None, "lines": None, "error": str(e)})
            out = pdf[keys].reset_index(drop=True)
            out = pd.concat([out, pd.DataFrame(rows, columns=[f.name for f in READING_SCHEMA.fields])], axis=1)
            yield out

    return src.mapInPandas(run, schema).select(*keys, F.lit(source).alias("source"),
                                               *[f.name for f in READING_SCHEMA.fields])


# Native post-processing of readings ---------------------------
def kept_words(words: Column) -> Column:
    """Words whose integer confidence is > 0."""
    return F.filter(words, lambda w: w["conf"].cast("int") > 0)


def words_text(words: Column) -> Column:
    """Kept word texts joined by a blank."""
    return F.array_join(F.transform(kept_words(words), lambda w: w["text"]), " ")


def words_confidence(words: Column) -> Column:
    """P10: mean kept-word confidence / 100; 0.0 when no word is kept."""
    k = kept_words(words)
    total = F.aggregate(k, F.lit(0.0), lambda acc, w: acc + w["conf"].cast("double"))
    return F.when(F.size(k) > 0, total / F.size(k).cast("double") / F.lit(100.0)).otherwise(F.lit(0.0))


def lines_text(lines: Column, trailing_newline: bool = False) -> Column:
    """Line texts joined by newlines (one reader variant appends one more)."""
    j = F.array_join(F.transform(lines, lambda x: x["text"]), "\n")
    return F.concat(j, F.lit("\n")) if trailing_newline else j


def lines_confidence(lines: Column, default: float = K.DEFAULT_LINE_CONFIDENCE) -> Column:
    """P10: mean line confidence; ``default`` (0.8) when there are no lines."""
    total = F.aggregate(lines, F.lit(0.0), lambda acc, x: acc + x["confidence"].cast("double"))
    n = F.size(F.coalesce(lines, F.array().cast(f"array<{LINE}>")))
    return F.when(n > 0, total / n.cast("double")).otherwise(F.lit(float(default)))


def finish_readings(readings: DataFrame) -> DataFrame:
    """Fill text/confidence from words or lines where the reader left them
    empty (P04/P10/N04); error readings keep confidence 0."""
    cols = readings.columns
    text = F.col("text")
    conf = F.col("confidence")
    if "words" in cols:
        text = F.when(F.col("words").isNotNull(), words_text(F.col("words"))).otherwise(text)
        conf = F.when(F.col("words").isNotNull(), words_confidence(F.col("words"))).otherwise(conf)
    if "lines" in cols:
        text = F.when(F.col("lines").isNotNull(), lines_text(F.col("lines"))).otherwise(text)
        conf = F.when(F.col("lines").isNotNull(), lines_confidence(F.col("lines"))).otherwise(conf)
    err = F.col("error").isNotNull()
    return readings.withColumn("text", F.when(err, F.lit("")).otherwise(text)) \
        .withColumn("confidence", F.when(err, F.lit(0.0)).otherwise(conf))
