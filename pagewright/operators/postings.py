"""Stored inverted index for the keyword leg (J03) with exact early stopping.

* :func:`build` writes postings (token, key) sorted by token, so that a token's
  list stands together on disk and row-group bounds skip the others; the number
  of texts per token; and each text's distinct tokens by key.
* :func:`search` ranks texts by the number of distinct query tokens they
  contain, and stops early without losing a hit.  The lists of a query's rarest
  tokens give some texts, whose true scores give a lower bound ``t`` on the
  k-th score.  A text that has none of the query's tokens but its ``t - 1`` most
  frequent ones scores under ``t``, so the lists of these are never read; of
  the texts in the other lists only those that can still reach ``t`` are scored
  from their stored tokens.

All steps are DataFrame joins and groupings on (query, token) or (query, key):
no task holds a side, nothing passes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..session import reliable_checkpoint
from .retrieval import _tokened, _top_k

FIRST_LISTS = 0.4 # share of a query's lists, the rarest, that give the first candidates
FIRST_KEPT = 10   # of them, per wanted hit, whose scores set the bound


@dataclass
class Postings:
    """``lists`` (token, key), ``tokens`` (token, texts), ``texts`` (key, tokens array)."""

    key: str
    lists: DataFrame
    tokens: DataFrame
    texts: DataFrame


def build(corpus: DataFrame, key: str, text: str, path: str) -> Postings:
    """Index every text of ``corpus`` under ``path``."""
    spark = corpus.sparkSession
    own = _tokened(corpus.where(F.col(key).isNotNull()), key, text, "tokens").where(F.size("tokens") > 0)
    own.write.mode("overwrite").parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    lists = texts.select(F.explode("tokens").alias("token"), key)
    # equal tokens may fill several range partitions: the key splits a hot one
    lists.repartitionByRange("token", key).sortWithinPartitions("token", key).write.mode("overwrite").parquet(f"{path}/lists")
    spark.read.parquet(f"{path}/lists").groupBy("token").agg(F.count(F.lit(1)).alias("texts")).write.mode("overwrite").parquet(f"{path}/tokens")
    return load(spark, key, path)


def load(spark: SparkSession, key: str, path: str) -> Postings:
    return Postings(key, *(spark.read.parquet(f"{path}/{part}") for part in ("lists", "tokens", "texts")))


def _asked(index: Postings, queries: DataFrame, qkey: str, qtext: str) -> DataFrame:
    """(query, token, texts, place, n): tokens that the index knows, rarest first."""
    t = _tokened(queries, qkey, qtext, "_q").select(qkey, F.explode("_q").alias("token")).join(index.tokens, "token")
    rare = Window.partitionBy(qkey).orderBy("texts", "token")  # the tokens of one query
    whole = Window.partitionBy(qkey)
    return t.withColumn("place", F.row_number().over(rare)).withColumn("n", F.count(F.lit(1)).over(whole))


def _scores(index: Postings, pairs: DataFrame, queries: DataFrame, qkey: str, qtext: str) -> DataFrame:
    """(query, key, score): distinct tokens that both have, from the stored tokens."""
    own = _tokened(queries, qkey, qtext, "_q")
    return (pairs.join(index.texts, index.key).join(own, qkey)
            .select(qkey, index.key, F.size(F.array_intersect("tokens", "_q")).cast("double").alias("score")))


def plan(index: Postings, queries: DataFrame, qkey: str, qtext: str, k: int) -> DataFrame:
    """(query, token, texts, place, n, bound, read): which lists a search reads;
    ``bound`` is a score that k texts reach."""
    asked = _asked(index, queries, qkey, qtext)
    some = asked.where(F.col("place") <= F.ceil(F.col("n") * FIRST_LISTS)).join(index.lists, "token").groupBy(qkey, index.key).agg(F.count(F.lit(1)).cast("double").alias("part"))
    first = _top_k(some, qkey, index.key, "part", FIRST_KEPT * k, "_place").select(qkey, index.key)
    best = _top_k(_scores(index, first, queries, qkey, qtext), qkey, index.key, "score", k, "_place")
    bound = best.groupBy(qkey).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(1.0).alias("bound"))
    return (asked.join(bound, qkey, "left").withColumn("bound", F.coalesce("bound", F.lit(1.0)))
            .withColumn("read", F.col("place") <= F.col("n") - (F.col("bound") - 1)))


def search(index: Postings, queries: DataFrame, qkey: str, qtext: str, k: int = K.RETRIEVAL_TOP_K) -> DataFrame:
    """(query, key, score, rank): equal to ``retrieval.keyword_top_k``."""
    asked = reliable_checkpoint(plan(index, queries, qkey, qtext, k))  # one row per query token
    read = asked.where("read").select(qkey, "token", "n", "bound")
    skipped = asked.groupBy(qkey).agg(F.count_if(~F.col("read")).alias("skipped"))
    found = read.join(index.lists, "token").groupBy(qkey, index.key).agg(F.count(F.lit(1)).alias("part"), F.first("bound").alias("bound"))
    able = found.join(skipped, qkey).where(F.col("part") + F.col("skipped") >= F.col("bound")).select(qkey, index.key)
    return _top_k(_scores(index, able, queries, qkey, qtext), qkey, index.key, "score", k)
