"""Scans and sinks on files the tests write themselves."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pagewright.sources import files as SRC


def write_lines(path, lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_s01_s02_prompts_and_truth(spark, tmp_uri):
    p = os.path.join(tmp_uri, "train.jsonl")
    write_lines(p, [json.dumps({"prompt": f"q{i}", "completion": f"a{i}"}) for i in range(5)]
                + [json.dumps({"completion": "only"})])
    pr = SRC.read_prompts(spark, p).orderBy("pos").collect()
    assert [r["prompt"] for r in pr] == [f"q{i}" for i in range(5)]
    assert [r["pos"] for r in pr] == list(range(5))
    gt = SRC.read_ground_truth(spark, p).orderBy("pos").collect()
    assert [r["truth"] for r in gt] == [f"a{i}" for i in range(5)] + ["only"]


def test_s01_failfast_all_or_nothing(spark, tmp_uri):
    p = os.path.join(tmp_uri, "bad.jsonl")
    write_lines(p, [json.dumps({"prompt": "ok"}), "{not json"])
    assert SRC.read_prompts(spark, p).count() == 1  # permissive keeps the good line
    with pytest.raises(Exception):
        SRC.read_prompts(spark, p, mode="FAILFAST").collect()


def test_s03_discovery_cap_before_suffix(spark, tmp_uri):
    for d, names in {"a": ["1.pdf", "2.txt", "3.pdf", "4.pdf"], "b/c": ["x.PDF", "y.pdf"]}.items():
        os.makedirs(os.path.join(tmp_uri, d), exist_ok=True)
        for n in names:
            with open(os.path.join(tmp_uri, d, n), "wb") as f:
                f.write(b"%PDF")
    files = SRC.list_files(spark, tmp_uri)
    got = sorted(r["name"] for r in SRC.discover_documents(files).collect())
    assert got == ["1.pdf", "3.pdf", "4.pdf", "y.pdf"]
    got = sorted(r["name"] for r in SRC.discover_documents(files, per_directory=3).collect())
    assert got == ["1.pdf", "3.pdf", "y.pdf"]


def test_s04_admission(spark):
    df = spark.createDataFrame([("/x/a.PDF", 10), ("/x/b.docx", 10), ("/x/c.png", 60 * 1024 * 1024), (None, 1)],
                               "path string, length long")
    out = {r["path"]: r["reject_reason"] for r in SRC.admit_documents(df).collect()}
    assert out == {"/x/a.PDF": None, "/x/b.docx": "unsupported_format", "/x/c.png": "too_large", None: "missing"}


def test_s06_s07_writers(spark, tmp_uri):
    rec = spark.createDataFrame([("p", "c"), (None, "c2")], "prompt string, completion string")
    uri = SRC.publish_training_set(rec, os.path.join(tmp_uri, "training-data"))
    assert spark.read.json(uri).count() == 1
    import json

    from pagewright.operators import report as R

    sec = lambda: R.section_rows(spark.createDataFrame([(1.5, "x")], "v double, t string"), "s")

    def broken():
        raise ValueError("no such service")
    rows = R.run_phases({"bad": broken, "s": sec, "late": lambda: spark.range(1).selectExpr("raise_error('at run time') as x")}, spark)
    assert [(r.section, r.metric) for r in rows.collect()] == [("bad", "error"), ("s", "v"), ("s", "t"), ("late", "error")]
    out = SRC.write_report(SRC.report_document(rows), os.path.join(tmp_uri, "report"))
    doc = json.loads(spark.read.json(out).first()["report"])
    assert doc["s"] == {"v": "1.5", "t": "x"} and doc["bad"]["error"] == "no such service" and set(doc) == {"bad", "s", "late"}


def test_s09_folder_job(spark, tmp_uri):
    src = os.path.join(tmp_uri, "in")
    spark.createDataFrame([(1, "Page one. More.\fPage two."), (2, "")], "doc_id long, text string") \
        .write.parquet(src)
    out = SRC.process_document_folder(spark, src, os.path.join(tmp_uri, "out"))
    rows = {r["doc_id"]: r for r in spark.read.parquet(out).collect()}
    assert rows[1]["total_pages"] == 2 and rows[2]["total_pages"] == 1
    assert rows[2]["overall_confidence"] == 0.0
