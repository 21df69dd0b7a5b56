"""Declared data jobs on small hand-made frames (D01, D03, D04, D05) and
the small column helpers (F22, F24, L03)."""

import datetime as dt
import os

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import data as DJ
from pagewright.operators import report as R


def test_d01_dedup_keeps_first_and_splits(spark):
    df = spark.createDataFrame([(1, 0, "  Hello ", "a"), (0, 5, "hello", "b"), (2, 0, "", "c"), (3, 0, "x", "  ")],
                               "conv_id long, turn long, query string, response string")
    out = DJ.prepare_training_data(df).collect()
    assert len(out) == 1
    assert (out[0]["conv_id"], out[0]["prompt"], out[0]["completion"]) == (0, "hello", "b")
    assert out[0]["split"] in ("train", "validation")


def test_d03_validation_counts(spark):
    df = spark.createDataFrame([("a", '{"k": 1}'), ("a", "{bad"), ("", None), (None, "[]")], "t string, j string")
    rows = {r["column_name"]: r for r in DJ.validate_columns(df, "x", ["t", "j"], json_columns=["j"]).collect()}
    assert (rows["t"]["nulls"], rows["t"]["empties"], rows["t"]["duplicates"]) == (1, 1, 1)
    assert rows["j"]["malformed_json"] == 1 and rows["j"]["max_length"] == 8


def test_d04_masking(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.org or 555-123-4567 now")], "id long, text string")
    r = DJ.pii_report(df, "id", "text").first()
    assert (r["emails"], r["phones"]) == (1, 1)
    assert r["masked_text"] == "mail [EMAIL] or [PHONE_NUMBER] now"


def test_d05_cost_report_alert_mode(spark, tmp_uri):
    costs = spark.createDataFrame([("p", 1.0)], "provider string, cost double")
    bd = R.cost_breakdown(costs)
    kp = R.cost_kpis(bd, spark.createDataFrame([(2,)], "total_queries long"))
    alerts = spark.createDataFrame([("actual", 0.8)], "kind string, threshold double")
    out = DJ.write_cost_report(kp, bd, os.path.join(tmp_uri, "cost"), alerts=alerts)
    assert set(out) == {"breakdown", "kpis", "alerts"}
    assert spark.read.option("header", True).csv(out["breakdown"]).count() == 3


def test_f22_f24_l03(spark):
    df = spark.createDataFrame([("/a/B.PDF", dt.datetime(2024, 5, 12, 1, 2, 3))], "p string, ts timestamp")
    r = df.select(T.file_extension(F.col("p")).alias("e"), T.iso_timestamp(F.col("ts")).alias("s")).first()
    assert r["e"] == "pdf" and r["s"] == "2024-05-12T01:02:03.000000"
    top = spark.range(10).orderBy(F.col("id").desc()).limit(3).collect()
    assert [x["id"] for x in top] == [9, 8, 7]
