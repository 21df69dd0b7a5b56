"""Values of a document from its pages equal those of its joined text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import documents as D
from pagewright.operators import stitching as ST


def joined(pages):
    return D.rollup_documents(pages)


PIECES = ["12", "12.", "3.50", "dollars", "USD", "%", "%x", "50%a", "word", "and", "$1,200", "$,", "555-123-4567", "5551234567", "2024-01-05", "01/02/2024", "a@b.com",
          "x12", "+1-555-123456789", "₹a", " ", "  ", "\n", " ", "\t", ".", "7", "INR.", "end. Next", "12 USD", "9 %q"]


def random_pages(spark, seed, n=150):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(n):
        for p in range(int(rng.integers(1, 7))):
            kind = rng.random()
            text = None if kind < 0.05 else "" if kind < 0.1 else " ".join(rng.choice(PIECES, int(rng.integers(1, 8)))) if kind < 0.9 else "".join(rng.choice(["1", "2 ", " ", "3\n"], 4))
            rows.append((d, p + 1, text, float(rng.random())))
    return spark.createDataFrame(rows, "doc_id long, page_number int, text_content string, confidence_score double").repartition(4)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_counts_and_heads_equal_the_joined_text(spark, seed):
    pages = random_pages(spark, seed)
    whole = joined(pages)
    want = {r["doc_id"]: r for r in whole.select("doc_id", "total_pages", F.length("full_text").alias("c"), T.word_count("full_text").alias("w"), T.first_sentences(F.col("full_text")).alias("h"),
                                                 F.size(T.extract_entities(F.col("full_text"))).alias("e")).collect()}
    got = {r["doc_id"]: r for r in ST.rollup(pages).collect()}
    counts = {r["doc_id"]: r for r in ST.extraction_counts(pages).collect()}
    assert set(got) == set(want) == set(counts)
    for d, r in want.items():
        assert (got[d]["total_pages"], got[d]["full_text_chars"], got[d]["total_words"], got[d]["summary_head"]) == (r["total_pages"], r["c"], r["w"], r["h"]), d
        assert counts[d]["entities_found"] == r["e"], d
    assert any(r["extra"] for r in ST.seams(pages).collect())  # some entity does stand across a border


def test_an_entity_over_several_pages(spark):
    rows = [(1, 1, "pay 12", 1.0), (1, 2, "  \n", 1.0), (1, 3, " ", 1.0), (1, 4, "dollars now", 1.0), (2, 1, "12", 1.0), (2, 2, "5", 1.0), (2, 3, "%x 7", 1.0), (2, 4, "USD", 1.0), (None, 1, "3 USD", 1.0)]
    pages = spark.createDataFrame(rows, "doc_id long, page_number int, text_content string, confidence_score double")
    assert {r["doc_id"]: r["entities_found"] for r in ST.extraction_counts(pages).collect()} == {1: 1, 2: 2, None: 1}


def test_long_pages_of_numbers(spark):
    pages = spark.createDataFrame([(1, 1, "word " + "12 " * 60000, 1.0), (1, 2, "13 " * 50000, 1.0), (1, 3, "USD " + "a " * 50000, 1.0)], "doc_id long, page_number int, text_content string, confidence_score double")
    assert ST.extraction_counts(pages).first()["entities_found"] == 1
    assert ST.rollup(pages).first()["total_words"] == 1 + 60000 + 50000 + 50001


def test_no_page_text_is_gathered(spark):
    """What is collected per document are pieces at seams and the head."""
    pages = random_pages(spark, 4, 5)
    plan = ST.page_sums(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    long = spark.createDataFrame([(1, i, "a. b. c. d. " + "filler " * 2000, 1.0) for i in range(1, 200)], "doc_id long, page_number int, text_content string, confidence_score double")
    assert ST.heads(long).first()["summary_head"] == "a.  b.  c."
