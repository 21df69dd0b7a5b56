"""Scans and sinks.

Every reader returns a DataFrame with a fixed schema; every writer takes a
DataFrame and a Hadoop-FS URI (local path, HDFS, object store) and writes with
Spark's own writers, so nothing passes through the driver.

* S01/S02 read JSON-lines records with an explicit schema (no inference
  pass over the data).  ``mode='FAILFAST'`` gives the all-or-nothing rule
  (one malformed line fails the load); the default ``PERMISSIVE`` keeps the
  good lines and reports the bad ones in ``_corrupt_record``.
* S03 discovers files with the ``binaryFile`` source; only path, size and
  modification time are selected, so file contents are never read.
* S04 turns the admission checks into a ``reject_reason`` column instead of
  raising, so one bad file never fails a job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T2

from .. import constants as K
from ..functions import text as T
from ..operators import plugins as PL
from ..operators.ordering import with_position
from ..session import reliable_checkpoint

PROMPT_SCHEMA = "prompt string, completion string, _corrupt_record string"


# S01 / S02 -------------------------------------------------------------------
def read_records(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Prompt/completion JSON lines with their line order as ``pos``.

    ``pos`` follows (file name, position within the file): a dense global
    numbering computed without a single-task window (see ``with_position``).
    """
    df = (spark.read.schema(PROMPT_SCHEMA).option("mode", mode)
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    if mode.upper() == "FAILFAST":
        df = df.drop("_corrupt_record")
    base = df.select("*", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_line"))
    # only the two keys are sorted and checkpointed; the texts are joined back by them
    return with_position(base, ["_file", "_line"], keys_only=True).drop("_file", "_line")


def read_prompts(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """The ``prompt`` of every line that has one (pos kept for J01)."""
    return read_records(spark, path, mode).where(F.col("prompt").isNotNull()).select("pos", "prompt")


def read_ground_truth(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """The ``completion`` of every line that has one (pos kept for J01)."""
    return (read_records(spark, path, mode).where(F.col("completion").isNotNull())
            .select("pos", F.col("completion").alias("truth")))


# S03 -------------------------------------------------------------------------
def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files under ``root`` (recursive): path, directory, name, size, mtime.
    File contents are pruned away by the ``binaryFile`` source."""
    f = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
         .select("path", "length", "modificationTime"))
    return f.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"),
                    F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length", "modificationTime")


def discover_documents(files: DataFrame, per_directory: int | None = None,
                       suffix: str = ".pdf") -> DataFrame:
    """The files ending in ``suffix`` (case-sensitive).  With
    ``per_directory`` (``K.FILES_PER_DIRECTORY`` is the usual one) only of the first
    so many files of any type, by name, of each directory; without it all.

    ``row_number() <= n`` per directory is planned with a partial
    ``WindowGroupLimit`` before the shuffle, so a directory holding most of
    the files sends only n rows per task.
    """
    if per_directory is None:
        return files.where(F.col("name").endswith(suffix))
    w = Window.partitionBy("directory").orderBy("name", "path")
    first = files.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_directory)
    return first.where(F.col("name").endswith(suffix)).drop("_rn")


# S04 -------------------------------------------------------------------------
def reject_reason(path: Column, size_bytes: Column, max_mb: float = K.MAX_DOCUMENT_MB,
                  formats=K.SUPPORTED_FORMATS) -> Column:
    """NULL when admitted, else the first failing check."""
    ext = T.file_extension(path)
    return (F.when(path.isNull(), F.lit("missing"))
            .when(size_bytes.cast("double") > F.lit(float(max_mb) * 1024 * 1024), F.lit("too_large"))
            .when(~ext.isin(*formats), F.lit("unsupported_format")))


def admit_documents(files: DataFrame, path: str = "path", size: str = "length",
                    max_mb: float = K.MAX_DOCUMENT_MB, formats=K.SUPPORTED_FORMATS) -> DataFrame:
    return files.withColumn("extension", T.file_extension(F.col(path))).withColumn(
        "reject_reason", reject_reason(F.col(path), F.col(size), max_mb, formats))


# S06 -------------------------------------------------------------------------
# The report sink lives with the report operators: ``report_document``
# builds one nested JSON document, ``write_report`` writes it.
from ..operators.report import report_document, write_report  # noqa: E402,F401


# S07 -------------------------------------------------------------------------
def publish_training_set(records: DataFrame, target_uri: str) -> str:
    """Validated prompt/completion records written as JSON lines to any
    Hadoop-FS URI; returns the URI."""
    ok = records.where(F.col("prompt").isNotNull() & F.col("completion").isNotNull())
    ok.select("prompt", "completion").write.mode("overwrite").json(target_uri)
    return target_uri


# J02 / S09 -------------------------------------------------------------------
def text_pages(content: bytes) -> list[bytes]:
    """The usual page splitter: a text file whose pages end at form feeds."""
    return (content or b"").split(K.PAGE_BREAK.encode())


def text_reader(page: bytes) -> dict:
    """The usual page reader: the page's bytes are its text, one line a line."""
    text = page.decode("utf-8")
    return {"text": text, "confidence": K.DEFAULT_LINE_CONFIDENCE if text else 0.0}


def split_contents(contents: DataFrame, key: str, splitter: Callable[[bytes], list[bytes]] = text_pages) -> DataFrame:
    """S05 for any file format: (key, page_number, content, error), one row per
    page that the plug-in finds; a file it fails on is one page with the error."""
    schema = T2.StructType([contents.schema[key], T2.StructField("page_number", T2.IntegerType()), T2.StructField("content", T2.BinaryType()), T2.StructField("error", T2.StringType())])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for k, content in zip(pdf[key], pdf["content"]):  # one file's pages at a time
                try:
                    pages, error = list(splitter(content)), None
                except Exception as e:  # noqa: BLE001 - a failed file is a row, not a failed job
                    pages, error = [None], str(e)
                yield pd.DataFrame({key: [k] * len(pages), "page_number": range(1, len(pages) + 1), "content": pages, "error": [error] * len(pages)})

    return contents.select(key, "content").mapInPandas(run, schema)


def assemble_readings(pages: DataFrame, readers: dict[str, Callable[[bytes], dict]], forms: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Every source's reading of every page in one table (key, page_number,
    source, text, confidence, error).  ``readers``: source -> X03 plug-in.
    ``forms``: an optional form source with the same columns (any subset of the
    pages); a page without a form reading simply has one reading less."""
    keys = (key, "page_number")
    out = None
    for source, reader in readers.items():
        read = PL.finish_readings(PL.read_pages(pages.where(F.col("error").isNull()), reader, source, keys=keys)).select(*keys, "source", "text", "confidence", "error")
        out = read if out is None else out.unionByName(read)
    failed = pages.where(F.col("error").isNotNull()).select(*keys, F.lit(next(iter(readers))).alias("source"), F.lit("").alias("text"), F.lit(0.0).alias("confidence"), "error")
    out = out.unionByName(failed)
    if forms is not None:
        form = forms.join(pages.select(*keys), list(keys), "left_semi")
        out = out.unionByName(form.select(*keys, F.lit(K.SOURCE_FORM).alias("source"), "text", F.col("confidence").cast("double").alias("confidence"),
                                          F.col("error").cast("string").alias("error") if "error" in form.columns else F.lit(None).cast("string").alias("error")))
    return out


def process_folder(spark: SparkSession, input_uri: str, output_uri: str, readers: dict[str, Callable[[bytes], dict]] | None = None,
                   splitter: Callable[[bytes], list[bytes]] = text_pages, forms: Callable[[DataFrame], DataFrame] | None = None, suffix: str = "",
                   per_directory: int | None = None, max_mb: float = K.MAX_DOCUMENT_MB, formats=K.SUPPORTED_FORMATS) -> str:
    """The folder job as one chain -- discover (S03), admit (S04), split
    (S05), read by every source (X03, J02), fuse (W01), roll up (A04) -- from a
    folder of files to ``output_uri/documents`` and ``output_uri/rejected``.

    ``forms`` turns the pages (doc_id, page_number, content, error) into a form
    source for some of them.  Discovery and admission read names and sizes only;
    a rejected file's content is never read.
    """
    from ..operators import documents as D

    found = discover_documents(list_files(spark, input_uri), per_directory, suffix)
    admitted = admit_documents(found, max_mb=max_mb, formats=formats)
    admitted.where(F.col("reject_reason").isNotNull()).select("path", "length", "reject_reason").write.mode("overwrite").parquet(f"{output_uri}/rejected")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(input_uri).select("path", "length", "content")
    # the checks are pushed to the file list: (path, length) decide before contents are opened
    files = files.where(F.element_at(F.split("path", "/"), -1).endswith(suffix) & reject_reason(F.col("path"), F.col("length"), max_mb, formats).isNull())
    if per_directory is not None:
        files = files.join(admitted.where(F.col("reject_reason").isNull()).select("path"), "path", "left_semi")
    pages = reliable_checkpoint(split_contents(files.withColumnRenamed("path", "doc_id"), "doc_id", splitter))  # several sources read the pages
    cand = assemble_readings(pages, readers or {K.SOURCE_TESSERACT: text_reader}, forms(pages) if forms else None)
    D.process_documents(cand, pages=pages.select("doc_id", "page_number")).write.mode("overwrite").parquet(f"{output_uri}/documents")
    return output_uri


# S09 -------------------------------------------------------------------------
def process_document_folder(spark: SparkSession, input_uri: str, output_uri: str,
                            fmt: str = "parquet", text_col: str = "text", key: str = "doc_id") -> str:
    """Documents under ``input_uri`` (one row per document, pages
    separated by form feeds) -> page split -> one reading per page -> page
    rollup, written to ``output_uri``."""
    from ..operators import documents as D

    docs = spark.read.format(fmt).load(input_uri).select(key, text_col)
    pages = D.number_pages(docs, text_col)
    cand = pages.select(key, "page_number", F.lit(K.SOURCE_TESSERACT).alias("source"),
                        F.col("text_content").alias("text"),
                        F.when(F.length("text_content") > 0, F.lit(K.DEFAULT_LINE_CONFIDENCE))
                        .otherwise(F.lit(0.0)).alias("confidence"),
                        F.lit(None).cast("string").alias("error"))
    out = D.process_documents(cand, pages=pages.select(key, "page_number"))
    out.write.mode("overwrite").parquet(output_uri)
    return output_uri
