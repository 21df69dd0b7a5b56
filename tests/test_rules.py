"""Hand-worked expectations (FIXTURES.md section 3) for the column rules."""

import pytest
from pyspark.sql import functions as F

from pagewright import constants as K
from pagewright.functions import scoring as S
from pagewright.functions import text as T
from pagewright.operators import documents as D
from pagewright.operators import report as R


def one(spark, col, **lits):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in lits.items()]) if lits else spark.range(1)
    return df.select(col.alias("v")).first()["v"]


def fuse(spark, readings):
    rows = [(1, 1, i, s, f"text-{s}", c, e) for i, (s, c, e) in enumerate(readings)]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, reading_pos int, source string, "
                                     "text string, confidence double, error string")
    r = D.fuse_readings(df).first()
    return r["source"], r["text_content"], r["confidence_score"]


CV, TS, FORM = K.SOURCE_CV, K.SOURCE_TESSERACT, K.SOURCE_FORM


@pytest.mark.parametrize("readings,source,conf", [
    ([(CV, .90, None), (TS, .95, None), (FORM, .86, None)], FORM, .86),
    ([(CV, .95, None), (TS, .60, None), (FORM, .70, None)], CV, .95),
    ([(CV, .70, None), (FORM, .80, None)], FORM, .80),
    ([(FORM, .70, None), (CV, .80, None)], CV, .80),
    ([(FORM, .80, None), (CV, .90, None)], FORM, .80),
])
def test_w01_fusion(spark, readings, source, conf):
    s, _, c = fuse(spark, readings)
    assert s == source and c == pytest.approx(conf)


def test_w01_no_valid_reading(spark):
    s, text, c = fuse(spark, [(CV, .9, "boom"), (TS, 0.0, None)])
    assert s is None and text == K.NO_TEXT_FALLBACK and c == 0.0


def test_w01_page_without_candidates(spark):
    cand = spark.createDataFrame([(1, 1, 0, CV, "a", .5, None)],
                                 "doc_id long, page_number int, reading_pos int, source string, text string, "
                                 "confidence double, error string")
    pages = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, page_number int")
    out = {r["page_number"]: r for r in D.fuse_readings(cand, pages=pages).collect()}
    assert out[2]["text_content"] == K.NO_TEXT_FALLBACK and out[2]["confidence_score"] == 0.0


def test_f07_grounded_confidence(spark):
    v = one(spark, S.grounded_confidence(F.col("r"), F.col("c")), r="x" * 250, c="y" * 120)
    assert v == pytest.approx(0.833333, abs=1e-6)
    v = one(spark, S.grounded_confidence(F.col("r"), F.col("c")), r="x" * 180 + " not specified", c="y" * 100)
    assert v == pytest.approx(0.566667, abs=1e-6)


def test_f08_bare_confidence(spark):
    v = one(spark, S.bare_confidence(F.col("q"), F.col("r")), q="a b c d e f", r="x" * 51)
    assert v == pytest.approx(0.766667, abs=1e-6)


def test_f12_capitalised_phrase_never_matches(spark):
    assert one(spark, S.has_uncertainty(F.col("r")), r="I don't know") is False
    assert one(spark, S.has_uncertainty(F.col("r"), strict=True), r="I don't know") is True


@pytest.mark.parametrize("sev,score", [((None, None, None, None), 1.0), ((3.0, None, 1.0, None), 0.5),
                                       ((4.0, None, None, None), 1 / 3), ((7.0, None, None, None), 0.0)])
def test_f11_safety(spark, sev, score):
    df = spark.createDataFrame([sev], "h double, s double, x double, v double")
    v = df.select(S.safety_score("h", "s", "x", "v").alias("v")).first()["v"]
    assert v == pytest.approx(score, abs=1e-6)
    assert (v < K.SAFETY_BLOCK_BELOW) == (score < 0.5)


def test_costs(spark):
    q, r = "q" * 400, "r" * 800
    assert one(spark, S.chat_cost_inr(F.col("q"), F.col("r")), q=q, r=r) == pytest.approx(0.0100845, rel=1e-6)
    assert one(spark, S.custom_model_cost_inr(F.lit(400), F.lit(800))) == pytest.approx(0.0498, rel=1e-9)
    assert one(spark, S.gemini_cost_inr(F.lit(400), F.lit(800))) == pytest.approx(0.014525, rel=1e-9)
    assert one(spark, S.training_cost_inr(F.lit(3600))) == pytest.approx(124.5)
    assert one(spark, S.page_processing_cost_inr(F.lit(10))) == pytest.approx(0.0483)


def test_f10_overlap(spark):
    assert one(spark, S.word_overlap(F.col("r"), F.col("t")), r="a b c", t="A c D") == pytest.approx(2 / 3)
    assert one(spark, S.word_overlap(F.col("r"), F.col("t")), r="a b c", t="") == 0.0


def ents(spark, text):
    return [(e["type"], e["value"]) for e in one(spark, T.extract_entities(F.col("t")), t=text)]


def test_entities(spark):
    assert ents(spark, "12/05/2024 2024-05-12") == [("date", "12/05/2024"), ("date", "2024-05-12")]
    assert ents(spark, "200 USD, $1,234.50") == [("monetary_amount", "200 USD"), ("monetary_amount", "$1,234.50")]
    assert ents(spark, "18.5% year, 5%x") == [("percentage", "5%")]
    assert [v for t, v in ents(spark, "call +91-9876-543210 or 555-123-4567") if t == "phone_number"] == \
        ["91-9876-543210", "555-123-4567"]


def test_entity_cap_starves_late_types(spark):
    text = " ".join(["01/01/2024"] * 60) + " a@b.com"
    assert [t for t, _ in ents(spark, text)] == ["date"] * 60 + ["email"]
    e = one(spark, T.extract_entities(F.col("t"), limit=K.ENTITY_LIMIT), t=text)
    assert len(e) == 50 and all(x["type"] == "date" for x in e)


# worked by hand from str.split(): no-break, ideographic, line-separator and unit-separator blanks
BLANK_TEXTS = {"a\u00a0b": 2, "a\u3000b c": 3, "\u2028a": 1, "a\x1fb": 2, "a\x1c \u2003b": 2, "a\u200bb": 1, "\u00a0": 0, "": 0}


def test_words_split_at_unicode_blanks(spark):
    for text, n in BLANK_TEXTS.items():
        assert one(spark, S.word_count(F.col("t")), t=text) == n == one(spark, T.word_count(F.col("t")), t=text)
    assert one(spark, S.word_overlap(F.col("t"), F.lit("B\u3000a")), t="a\u00a0b") == 1.0


def test_unanswered_turns_stay_as_failed_calls(spark):
    from pagewright.plans import views as V

    class T0:
        conversations = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "r"), (1, 2, "user", "lost"), (2, 0, "user", "x"), (2, 1, "user", "y"), (2, 2, "assistant", "z")],
                                              "conv_id long, turn long, role string, text string")
        documents = spark.createDataFrame([(1, "ctx")], "doc_id long, text string")
    got = {(r.conv_id, r.turn): (r.response, r.is_error) for r in V.interactions(T0()).collect()}
    assert got == {(1, 0): ("r", False), (1, 2): (None, True), (2, 0): (None, True), (2, 1): ("z", False)}


def test_f19_summary_pieces(spark):
    head = one(spark, T.first_sentences(F.col("t")), t="A. B. C. D")
    assert head.startswith("A.  B.  C.")
    assert one(spark, T.first_sentences(F.col("t")), t="A.") == "A. ."


def test_p05_preview(spark):
    assert one(spark, S.preview(F.col("t"), 3), t="abcd") == "abc..."
    assert one(spark, S.preview(F.col("t"), 3), t="abc") == "abc"


def test_a08_kpis_and_x04_rules(spark):
    bd = spark.createDataFrame([("TOTAL", 2.5, 1)], "provider string, total_cost_inr double, items long")
    q = spark.createDataFrame([(0,)], "total_queries long")
    k = R.cost_kpis(bd, q).first()
    assert k["cost_per_query"] == 0.0 and k["budget_utilization"] == pytest.approx(0.5)
    assert k["cost_efficiency"] == "Excellent"
    kp = spark.createDataFrame([(2.5, None, None)],
                               "total_cost_inr double, avg_chat_confidence double, avg_processing_time double")
    recs = [r["category"] for r in R.recommendations(kp).orderBy("ord").collect()]
    assert recs == ["model_performance", "scalability", "monitoring", "security"]


def test_a07_breakdown_total(spark):
    c = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "provider string, cost double")
    out = {r["provider"]: r["total_cost_inr"] for r in R.cost_breakdown(c).collect()}
    assert out == {"a": 3.0, "b": 3.0, "infrastructure": 2.5, "TOTAL": 8.5}


def test_budget_crossings_over_months_stay_exact(spark):
    from pagewright.operators import metrics as M

    rows = [(i, f"2023-{1 + i // 1000:02d}-{1 + i % 28:02d} 10:00:00", 1e9 if i < 1000 else 0.1) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, ts string, value double").selectExpr("event_id", "cast(ts as timestamp) as ts", "value as cost")
    got = M.budget_crossings(df, 100.0, actual=(0.8, 0.9, 1.0), forecast=()).collect()
    # 1,000 events of 0.1 make exactly 100.0 in the later months: over 80 and 90, never over 100
    later = sorted((r.month.month, r.threshold) for r in got if r.month.month > 1)
    assert later == [(2, 0.8), (2, 0.9), (3, 0.8), (3, 0.9)]
    assert {r.threshold for r in got if r.month.month == 1} == {0.8, 0.9, 1.0}
