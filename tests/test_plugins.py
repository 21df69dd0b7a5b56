"""Plug-in surfaces (X01, X03), reading post-processing (P04, P10, N04) and
nested form extraction (N01-N03, P09)."""

import json

import pytest
from pyspark.sql import functions as F

from pagewright import constants as K
from pagewright.functions import nested as N
from pagewright.operators import plugins as PL


def test_x01_error_isolation_and_order(spark):
    df = spark.createDataFrame([(i, 0, f"q{i}. rest") for i in range(25)], "conv_id long, turn long, query string")

    def model(qs):
        if any(q.startswith("q13.") for q in qs):
            raise RuntimeError("model down")
        return [q.upper() for q in qs]

    out = {r["conv_id"]: r for r in PL.batch_inference(df.repartition(1), model).collect()}
    assert len(out) == 25
    assert out[13]["is_error"] and out[13]["response"].startswith(K.QUERY_ERROR_PREFIX)
    assert out[13]["model_used"] == "error" and out[13]["cost_estimate"] == 0.0
    assert out[12]["response"] == "Q12. REST" and not out[12]["is_error"]
    assert out[12]["cost_estimate"] > 0
    assert sorted({r["batch"] for r in out.values()}) == [0, 1, 2]


def test_x03_reader_and_postprocessing(spark):
    pages = spark.createDataFrame([(1, 1, b"good"), (1, 2, b"bad"), (1, 3, b"lines"), (1, 4, b"none")],
                                  "doc_id long, page_number int, content binary")

    def reader(b):
        if b == b"bad":
            raise IOError("unreadable")
        if b == b"lines":
            return {"lines": [{"text": "l1", "confidence": 0.5}, {"text": "l2", "confidence": 1.0}]}
        if b == b"none":
            return {"lines": []}
        return {"words": [{"text": "a", "conf": 90}, {"text": "b", "conf": -1}, {"text": "c", "conf": 70}]}

    r = PL.finish_readings(PL.read_pages(pages, reader, K.SOURCE_TESSERACT))
    out = {x["page_number"]: x for x in r.collect()}
    assert out[1]["text"] == "a c" and out[1]["confidence"] == pytest.approx(0.8)
    assert out[2]["error"] == "unreadable" and out[2]["confidence"] == 0.0
    assert out[3]["text"] == "l1\nl2" and out[3]["confidence"] == pytest.approx(0.75)
    assert out[4]["text"] == "" and out[4]["confidence"] == pytest.approx(K.DEFAULT_LINE_CONFIDENCE)


FORM = {
    "pages": [{"width": 8.5, "height": 11.0}, {"width": 1.0, "height": 1.0}],
    "paragraphs": [{"content": "Hello", "bounding_regions": [{"page_number": 1, "polygon": [{"x": 0.1, "y": 0.2}]}]}],
    "tables": [{"row_count": 1, "column_count": 2, "cells": [
        {"content": "k", "row_index": 0, "column_index": 0},
        {"content": "v", "row_index": 0, "column_index": 1, "row_span": 2, "kind": "columnHeader"}]}],
    "key_value_pairs": [{"key": "Name", "value": "A"}, {"key": "Name", "value": "B"}, {"key": "Lonely"}],
}


def test_n01_n03_form_extraction(spark):
    df = spark.createDataFrame([(1, json.dumps(FORM)), (2, "{}")], "doc_id long, form_json string")
    out = {r["doc_id"]: r for r in N.extract_form(df).collect()}
    lay = out[1]["layout"]
    assert (lay["page_width"], lay["page_height"]) == (8.5, 11.0)
    assert lay["paragraphs"][0]["bounding_regions"][0]["polygon"][0]["y"] == 0.2
    cells = out[1]["tables"][0]["cells"]
    assert (cells[0]["row_span"], cells[0]["column_span"], cells[0]["kind"]) == (1, 1, "content")
    assert (cells[1]["row_span"], cells[1]["kind"]) == (2, "columnHeader")
    assert out[1]["key_value_pairs"] == {"Name": "B"}
    assert out[2]["layout"]["page_width"] == 0.0 and out[2]["tables"] == [] and out[2]["key_value_pairs"] == {}
    long = N.table_cells(N.extract_form(df), ["doc_id"]).collect()
    assert len(long) == 2


def test_p09_feature_flags(spark):
    df = spark.createDataFrame([(1, json.dumps(FORM))], "doc_id long, form_json string")
    r = N.extract_form(df, table_extraction=False, key_value_extraction=False).first()
    assert r["tables"] == [] and r["key_value_pairs"] == {} and r["layout"]["page_width"] == 8.5
    r = N.extract_form(df, advanced=False).first()
    assert r["layout"]["page_width"] == 0.0 and r["tables"] == []


def test_x01_calls_the_model_once_per_query(spark, tmp_path):
    from pagewright.operators import plugins as PL

    log = str(tmp_path / "calls")

    def model(queries):
        with open(log, "a") as f:
            f.write("".join(f"{q}\n" for q in queries))
        if queries[0] == "q3":
            raise ValueError("refused")
        return [q.upper() for q in queries]
    df = spark.createDataFrame([(i, 0, f"q{i}") for i in range(20)], "conv_id long, turn long, query string").repartition(1)
    rows = {r.query: r for r in PL.batch_inference(df, model).collect()}
    assert sorted(open(log).read().split()) == sorted(f"q{i}" for i in range(20))
    assert rows["q3"].is_error and rows["q3"].response == "Error processing query: refused" and rows["q4"].response == "Q4"
    assert sorted(r.batch for r in rows.values()) == [0] * 10 + [1] * 10
