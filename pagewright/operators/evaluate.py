"""Evaluation operators: positions (J01, W04), alignment with ground truth,
quality by word overlap (F10), evaluation summary (A05/A06), model accuracy
on labelled data (D06).

Positions without a single-task window: ``with_position`` sorts by the order
key (range partitioning, distributed), numbers rows inside each partition,
and adds a per-partition offset computed from one count per partition.  The
offsets table has one row per partition — a proven size bound — so it is
broadcast.  The sorted, numbered data is checkpointed to the shared
checkpoint folder first, so both uses see identical partitions even if an
executor is lost and tasks are recomputed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scoring as S
from .ordering import with_position  # noqa: F401  (re-exported)

def batch_numbers(df: DataFrame, pos: str = "pos", batch_size: int = K.BATCH_SIZE) -> DataFrame:
    """batch = position div batch_size (reporting only)."""
    return df.withColumn("batch", F.floor(F.col(pos) / F.lit(batch_size)).cast("bigint"))


def align_by_position(results: DataFrame, truth: DataFrame, pos: str = "pos",
                      how: str = "inner") -> DataFrame:
    """Result i with truth i (an equi-join on the position); results past
    the end of the truth list get nothing.  Error rows are kept here (they
    consumed their position)."""
    return results.join(truth, pos, how)


def quality_scores(aligned: DataFrame, response: str = "response", truth: str = "truth") -> DataFrame:
    """F10 on aligned, non-error rows."""
    return aligned.where(~F.col("is_error")).withColumn(
        "quality", S.word_overlap(F.col(response), F.col(truth)))


def evaluation_summary(results: DataFrame, truth: DataFrame | None = None, pos: str = "pos") -> DataFrame:
    """Totals and averages over all results (error rows count as zeros),
    quality average and count over aligned, non-error rows only.

    One left join on the position and one global aggregate; no cross join.
    Empty input gives NULL averages (the behaviour being matched divides by
    zero).
    """
    df = results
    if truth is not None:
        df = df.join(truth.select(pos, F.col("truth").alias("_truth")), pos, "left")
        q = F.when(F.col("_truth").isNotNull() & ~F.col("is_error"),
                   S.word_overlap(F.col("response"), F.col("_truth")))
    else:
        q = F.lit(None).cast("double")
    aggs = [F.count(F.lit(1)).cast("bigint").alias("total_queries"),
            F.count_if(~F.col("is_error")).cast("bigint").alias("successful_responses"),
            F.avg("latency_ms").alias("average_latency_ms"),
            F.avg("confidence_score").alias("average_confidence"),
            F.sum("cost_estimate").alias("total_cost_inr"),
            F.avg(q).alias("average_quality_score"),
            F.count(q).cast("bigint").alias("quality_scores_count")]
    return df.agg(*aggs)


def model_accuracy(labelled: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy and confusion counts in one pass."""
    y, p = F.col(label), F.col(prediction)
    return labelled.agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.avg((y == p).cast("double")).alias("accuracy"),
        F.count_if((y == 1) & (p == 1)).cast("bigint").alias("tp"),
        F.count_if((y == 0) & (p == 1)).cast("bigint").alias("fp"),
        F.count_if((y == 0) & (p == 0)).cast("bigint").alias("tn"),
        F.count_if((y == 1) & (p == 0)).cast("bigint").alias("fn"))
