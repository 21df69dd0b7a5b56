"""Retention (T05) as a rewrite of a partitioned table.

A table is partitioned by a class (what a rule names) and by day.  Days wholly
before a rule's cutoff go by metadata: their folders are deleted, no row is
read.  Of the one day in which the cutoff lies, the rows that stay are written
again, and dynamic overwrite replaces that partition only.  All other files
keep their names.  Doing it again changes nothing.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reliable_checkpoint


@dataclass(frozen=True)
class Rule:
    """Rows of class ``name`` (all classes: None) stay for ``days``."""

    name: str | None
    days: int


#: Stored objects 30 days (1 in demo mode); logs 90 days (30 in demo mode).
OBJECT_DAYS, LOG_DAYS = {False: 30, True: 1}, {False: 90, True: 30}


def write_partitioned(df: DataFrame, path: str, ts: str = "ts", cls: str | None = None) -> None:
    """``df`` as Parquet by (class and) day."""
    keys = [*([cls] if cls else []), "day"]
    df.withColumn("day", F.to_date(ts)).repartition(*keys).write.partitionBy(*keys).mode("overwrite").parquet(path)


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _folders(spark: SparkSession, path: str, column: str) -> dict[str, str]:
    """Value -> folder of a partition column: one listing, no data."""
    p, fs = _files(spark, path)
    if not fs.exists(p):
        return {}
    names = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(p) if s.isDirectory()]
    return {unquote(name.split("=", 1)[1]): folder for name, folder in names if name.startswith(f"{column}=")}


def _apply(spark: SparkSession, folder: str, cutoff: dt.datetime, ts: str) -> tuple[int, int]:
    dropped = rewritten = 0
    for day, where in _folders(spark, folder, "day").items():
        try:
            date = dt.date.fromisoformat(day)
        except ValueError:  # rows without a time: no rule reaches them
            continue
        p, fs = _files(spark, where)
        if date < cutoff.date():
            fs.delete(p, True)
            dropped += 1
        elif date == cutoff.date() and cutoff.time() != dt.time():
            rows = spark.read.parquet(where)
            late = F.col(ts) >= F.lit(cutoff.isoformat(sep=" ")).cast(rows.schema[ts].dataType)
            if rows.where(~late).isEmpty():
                continue
            left = reliable_checkpoint(rows.where(late))  # read before the partition is replaced
            if left.isEmpty():
                fs.delete(p, True)
                dropped += 1
            else:
                left.withColumn("day", F.lit(date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)
                rewritten += 1
    return dropped, rewritten


def enforce(spark: SparkSession, path: str, rules, as_of: str, ts: str = "ts", cls: str | None = None) -> dict[str, tuple[int, int]]:
    """Apply the rules to a table of :func:`write_partitioned` as of a stated
    time (never ``now()``).  Returns (days dropped, days rewritten) per class;
    a class without a rule is left alone."""
    at = dt.datetime.fromisoformat(as_of)
    folders = _folders(spark, path, cls) if cls else {"": path}
    days = {r.name: r.days for r in rules}
    done = {}
    for name, folder in folders.items():
        keep = days.get(name, days.get(None))
        if keep is not None:
            done[name] = _apply(spark, folder, at - dt.timedelta(days=keep), ts)
    return done
