"""Declared data jobs: training data (D01), data validation (D03), PII
detection and masking (D04), cost report with alert mode (D05).

All are single passes with map-side partial aggregation; deduplication keeps
the first record per key with ``min_by`` in a ``groupBy`` (partial per task),
not a window, so a prompt repeated a billion times costs one partial row per
task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from . import profiles as PR


# D01 -------------------------------------------------------------------------
def split_label(key, train_percent: int = K.TRAIN_FRACTION_PERCENT):
    """Deterministic split: first 32 bits of md5(key) mod 100 < train_percent."""
    bucket = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % F.lit(100)
    return F.when(bucket < F.lit(int(train_percent)), F.lit("train")).otherwise(F.lit("validation"))


def prepare_training_data(records: DataFrame, prompt: str = "query", completion: str = "response",
                          keys=("conv_id", "turn"), train_percent: int = K.TRAIN_FRACTION_PERCENT) -> DataFrame:
    """Trim, drop empty prompt/completion, exact dedup on the
    lower-cased prompt keeping the first record (by ``keys``), split
    train/validation by a hash of the normalised prompt."""
    keys = list(keys)
    b = records.select(*keys, F.trim(F.col(prompt)).alias("prompt"), F.trim(F.col(completion)).alias("completion"))
    b = b.where(F.col("prompt").isNotNull() & F.col("completion").isNotNull()
                & (F.col("prompt") != "") & (F.col("completion") != ""))
    first = b.groupBy(F.lower("prompt").alias("_norm")).agg(
        F.min_by(F.struct(*keys, "prompt", "completion"), F.struct(*keys)).alias("r"))
    return first.select(*[F.col("r." + k).alias(k) for k in keys], "r.prompt", "r.completion",
                        split_label(F.col("_norm"), train_percent).alias("split"))


# D03 -------------------------------------------------------------------------
def validate_columns(df: DataFrame, table: str, columns, json_columns=()) -> DataFrame:
    """One row per column -- rows, nulls, empties, length bounds,
    duplicate values, malformed JSON.  The plain numbers come from one
    aggregation without a distinct count; duplicates from one grouped pass over
    (column, digest), which combines map-side and has no row expanded for other
    aggregates."""
    plain = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{n}").alias(n) for n in PR.PLAIN]) for c in columns])
    one = df.agg(*PR.plain_aggregates(columns, json_columns)).select(F.explode(plain).alias("r")).select("r.*")
    dups = PR.duplicates(df, columns)
    return (one.join(dups, "column_name", "left")
            .select(F.lit(table).alias("table_name"), "column_name", "rows", "nulls", "empties", "min_length", "max_length",
                    F.coalesce("duplicates", F.lit(0).cast("bigint")).alias("duplicates"), "malformed_json"))


# D04 -------------------------------------------------------------------------
def pii_report(df: DataFrame, key: str, text: str, types=("email", "phone_number")) -> DataFrame:
    """Per text the number of emails and phone numbers found and the
    text with every match replaced by a type token."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(key,
                     F.size(T.entity_matches(t, "email")).cast("bigint").alias("emails"),
                     F.size(T.entity_matches(t, "phone_number")).cast("bigint").alias("phones"),
                     T.mask_entities(t, types).alias("masked_text"))


# D05 -------------------------------------------------------------------------
def write_cost_report(kpis: DataFrame, breakdown: DataFrame, uri: str, alerts: DataFrame | None = None,
                      fmt: str = "csv") -> dict[str, str]:
    """Cost breakdown and KPIs written as CSV (or JSON); with ``alerts``
    (budget crossings, W06) also the alert rows -- the ``--alert`` mode."""
    out = {}
    for name, df in (("breakdown", breakdown), ("kpis", kpis)) + ((("alerts", alerts),) if alerts is not None else ()):
        path = f"{uri.rstrip('/')}/{name}"
        w = df.coalesce(1).write.mode("overwrite")  # report tables: a handful of rows
        (w.option("header", True).csv(path) if fmt == "csv" else w.json(path))
        out[name] = path
    return out


def synthetic_readings(conversations: DataFrame) -> DataFrame:
    """Reader-shaped rows derived from conversation turns (for the P04/P10/N04
    query): words with integer confidences -1..100, lines split at '. '."""
    cid = F.col("conv_id")
    words = F.transform(F.split(F.col("text"), " ", -1),
                        lambda x, i: F.struct(x.alias("text"),
                                              (((cid * 7 + (i + 1) * 13) % 102) - 1).cast("int").alias("conf")))
    lines = F.transform(F.split(F.col("text"), r"\. ", -1),
                        lambda x, i: F.struct(x.alias("text"),
                                              (((cid + (i + 1) * 17) % 100).cast("double") / F.lit(100.0))
                                              .alias("confidence")))
    return conversations.select("conv_id", "turn", words.alias("words"), lines.alias("lines"))
