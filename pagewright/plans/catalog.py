"""Registered queries: each is a Spark job over the driver tables plus, where
SQL can say the same thing, the DuckDB oracle text.

``QUERIES[name] = fn(spark, sf_dir) -> DataFrame`` and ``ORACLE[name] = sql``.
Every query reads whole tables (or views derived from them by Spark); none
caps, samples or filters rows to stay cheap.  Doubles are rounded after the
last aggregation so that summation order cannot change the value hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DOC: dict[str, str] = {}


def register(name: str, sql: str | None = None, ops: str = ""):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        DOC[name] = ops
        return fn
    return deco


def _load_all() -> None:
    # importing the modules fills the registry
    from . import q_branches, q_data, q_documents, q_forms, q_metrics, q_retrieval, q_scoring, q_streams  # noqa: F401


_load_all()
