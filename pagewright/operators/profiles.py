"""Column profiles that merge.

A profile is one row per file and column: rows, nulls, empties, length bounds,
malformed JSON and a distinct-count sketch.  Profiles are stored beside the
data; a run reads the files that have no profile yet, and the table's profile
is the merge of the stored rows, without the data.  A file counts as the same
while its path, size and modification time do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLAIN = ("rows", "nulls", "empties", "min_length", "max_length", "malformed_json")
_FILE = ("_file", "_size", "_changed")


def _plain(c: str, is_json: bool) -> list[Column]:
    col = F.col(c).cast("string")
    malformed = F.count_if(col.isNotNull() & F.try_parse_json(col).isNull()) if is_json else F.sum(F.lit(0))
    return [F.count(F.lit(1)), F.count_if(col.isNull()), F.count_if(col == ""), F.min(F.length(col)), F.max(F.length(col)), F.coalesce(malformed, F.lit(0))]


def plain_aggregates(columns, json_columns=()) -> list[Column]:
    """Aggregates ``<column>__<name>`` for the names of PLAIN."""
    return [a.cast("bigint").alias(f"{c}__{n}") for c in columns for n, a in zip(PLAIN, _plain(c, c in json_columns), strict=True)]


def duplicates(df: DataFrame, columns) -> DataFrame:
    """(column_name, duplicates): values beyond the first of each distinct one,
    exact, by one grouped pass over digests of all columns."""
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.sha2(F.col(c).cast("string"), 256).alias("d")) for c in columns])
    values = df.select(F.explode(each).alias("v")).select("v.*").where(F.col("d").isNotNull())
    counted = values.groupBy("column_name", "d").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("column_name").agg(F.sum(F.col("n") - 1).cast("bigint").alias("duplicates"))


def of_files(df: DataFrame, columns, json_columns=()) -> DataFrame:
    """One profile row per file and column of a file-based table."""
    named = df.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_modification_time").alias("_changed"))
    sketches = [F.hll_sketch_agg(F.col(c).cast("string")).alias(f"{c}__sketch") for c in columns]
    g = named.groupBy(*_FILE).agg(*plain_aggregates(columns, json_columns), *sketches)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{n}").alias(n) for n in (*PLAIN, "sketch")]) for c in columns])
    return g.select(*_FILE, F.explode(rows).alias("r")).select(*_FILE, "r.*")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def update(spark: SparkSession, table_path: str, profile_path: str, columns, json_columns=(), fmt: str = "parquet") -> int:
    """Profile the files of a table that have no profile yet; returns how many
    were read.  Finding them reads file names only."""
    table = spark.read.format(fmt).load(table_path)
    meta = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_modification_time").alias("_changed")
    files = table.select(*meta).distinct()
    if _exists(spark, profile_path):
        files = files.join(spark.read.parquet(profile_path).select(*_FILE).distinct(), list(_FILE), "left_anti")
    new = [r._file for r in files.collect()]  # names of new files
    if new:
        of_files(spark.read.format(fmt).schema(table.schema).load(new), columns, json_columns).coalesce(1).write.mode("append").parquet(profile_path)
    return len(new)


def merged(profiles: DataFrame, by=("column_name",)) -> DataFrame:
    """The profile of all files together: sums, bounds and merged sketches."""
    return profiles.groupBy(*by).agg(
        *[F.sum(n).alias(n) for n in ("rows", "nulls", "empties")], F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"),
        F.sum("malformed_json").alias("malformed_json"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"), F.count(F.lit(1)).alias("files"))


def current(spark: SparkSession, table_path: str, profile_path: str, fmt: str = "parquet") -> DataFrame:
    """Stored profile rows of the files that the table has now."""
    meta = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_modification_time").alias("_changed")
    files = spark.read.format(fmt).load(table_path).select(*meta).distinct()
    return spark.read.parquet(profile_path).join(files, list(_FILE), "left_semi")
