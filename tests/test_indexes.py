"""Vector index: recall, exactness, how much is met.  Postings: equal to the
scan, how much is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import postings as PX
from pagewright.operators import retrieval as RT
from pagewright.operators import vector_index as VX
from pagewright.session import Tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    return Tables(spark, SF).embeddings.select("vec_id", "embedding")


@pytest.fixture(scope="module")
def index(vectors):
    return VX.build(vectors, "vec_id", "embedding")


@pytest.fixture(scope="module")
def asked(vectors):
    return vectors.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "q")


def hits(df):
    return {(r["q"], r["rank"]): (r["vec_id"], round(r["similarity"], 6)) for r in df.collect()}


def test_index_holds_every_row_and_recall_is_high(vectors, index, asked):
    assert index.codes.count() == vectors.count() == index.lists.agg(F.sum("n")).first()[0]
    got = VX.search(index, asked, vectors, "q", "vec_id", "embedding", k=10, score_digits=9)
    want = hits(RT.knn(asked, vectors, "q", "vec_id", "embedding", k=10, score_digits=9))
    found = {(q, v) for (q, _), (v, _) in hits(got).items()}
    recall = np.mean([(q, v) in found for (q, _), (v, _) in want.items()])
    assert recall >= 0.9, recall
    met = VX._probes(asked.withColumnRenamed("embedding", "_q"), index.quantiser, "q", index.quantiser.probes).join(index.lists, "list").groupBy("q").agg(F.sum("n").alias("n"))
    assert met.agg(F.max("n")).first()[0] < vectors.count()  # no query meets all


def test_exact_search_equals_the_scan(vectors, index, asked):
    got = VX.search(index, asked, vectors, "q", "vec_id", "embedding", k=7, probes=2, rerank=2, exact=True, score_digits=9)
    assert hits(got) == hits(RT.knn(asked, vectors, "q", "vec_id", "embedding", k=7, score_digits=9))


def test_index_of_clustered_vectors_prunes_and_survives_saving(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (40, 32))
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.05, (4000, 32))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9001, [0.0] * 32), (9002, None), (9003, [None] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    VX.build(df, "vec_id", "embedding").save(str(tmp_path / "ix"))
    index = VX.VectorIndex.load(spark, str(tmp_path / "ix"))
    assert index.codes.count() == 4000
    assert index.quantiser.probes <= 0.2 * len(index.quantiser.centres)  # clusters: few lists are enough
    asked = df.where("vec_id % 100 = 0 or vec_id > 9000").withColumnRenamed("vec_id", "q")
    want = hits(RT.knn(asked.where("q < 9000"), df.where("vec_id < 9000"), "q", "vec_id", "embedding", k=5, score_digits=9))
    near = VX.search(index, asked, df, "q", "vec_id", "embedding", k=5, score_digits=9)
    got = hits(near)
    assert np.mean([got.get(k) == v for k, v in want.items()]) >= 0.9
    assert hits(VX.search(index, asked, df, "q", "vec_id", "embedding", k=5, probes=3, exact=True, score_digits=9)) == want


def test_blocks_do_not_change_the_result(vectors, index, asked, monkeypatch):
    whole = hits(VX.search(index, asked, vectors, "q", "vec_id", "embedding", k=5, score_digits=9))
    monkeypatch.setattr(VX, "BLOCK_ROWS", 7)
    assert hits(VX.search(index, asked, vectors, "q", "vec_id", "embedding", k=5, score_digits=9)) == whole


def test_an_index_without_vectors_is_an_error(spark):
    with pytest.raises(ValueError):
        VX.fit(spark.createDataFrame([(1, [0.0, 0.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding")


# -- postings -------------------------------------------------------------------
def ranked(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_postings_equal_the_scan_and_read_few(spark, tmp_path):
    t = Tables(spark, SF)
    index = PX.build(t.documents, "doc_id", "text", str(tmp_path / "px"))
    for k in (1, 5):
        assert ranked(PX.search(index, t.benchmark, "item_id", "text", k=k)) == ranked(RT.keyword_top_k(t.benchmark, t.documents, "item_id", "doc_id", "text", "text", k=k))
    p = PX.plan(index, t.benchmark, "item_id", "text", 5).agg(F.sum(F.when(F.col("read"), F.col("texts"))).alias("read"), F.sum("texts").alias("all")).first()
    assert p["read"] < 0.5 * p["all"], p


def test_postings_edges(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a a b"), (3, None), (4, ""), (5, "A x"), (None, "a b c"), (6, "zz"), (7, "b c d e f")], "doc_id long, text string")
    ask = spark.createDataFrame([(1, "a b c"), (2, "none of these"), (3, None), (4, "zz zz"), (5, "a B c D e")], "item_id long, text string")
    index = PX.build(docs, "doc_id", "text", str(tmp_path / "px"))
    for k in (1, 2, 10):
        assert ranked(PX.search(index, ask, "item_id", "text", k=k)) == ranked(RT.keyword_top_k(ask, docs.where("doc_id is not null"), "item_id", "doc_id", "text", "text", k=k))


def test_postings_of_random_texts_equal_the_scan(spark, tmp_path):
    rng = np.random.default_rng(8)
    word = lambda: f"t{min(int(rng.zipf(1.3)), 400)}"
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(int(rng.integers(1, 40))))) for i in range(600)], "doc_id long, text string")
    ask = spark.createDataFrame([(i, " ".join(word() for _ in range(int(rng.integers(1, 25))))) for i in range(40)], "item_id long, text string")
    index = PX.build(docs, "doc_id", "text", str(tmp_path / "px"))
    assert ranked(PX.search(index, ask, "item_id", "text", k=4)) == ranked(RT.keyword_top_k(ask, docs, "item_id", "doc_id", "text", "text", k=4))


# -- containment --------------------------------------------------------------
def best(df):
    return {r["doc_id"]: (r["item_id"], round(r["overlap"], 9)) for r in df.collect()}


@pytest.mark.parametrize("bound", [0.3, 0.5, 0.8, 1.0])
def test_containment_finds_all_above_the_bound_and_the_rest_exactly(spark, bound):
    rng = np.random.default_rng(12)
    word = lambda: f"t{min(int(rng.zipf(1.2)), 300)}"
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(int(rng.integers(1, 60))))) for i in range(400)] + [(900, None), (901, "")], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(word() for _ in range(int(rng.integers(1, 12))))) for i in range(60)] + [(80, None), (81, " ")], "item_id long, text string")
    whole = best(RT.best_truth_match(docs, items, "doc_id", "item_id", "text", "text"))
    above = {d: v for d, v in whole.items() if v[1] >= bound}
    assert best(RT.containment_match(docs, items, "doc_id", "item_id", "text", "text", at_least=bound)) == above and above
    assert best(RT.containment_match(docs, items, "doc_id", "item_id", "text", "text", at_least=bound, exact=True)) == whole


def test_containment_reads_texts_once_and_carries_only_words_that_truths_have(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"own{i}x{j}" for j in range(50)) + " a b c d") for i in range(20)] + [(None, "a b c d"), (30, "own a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e"), (2, "x y z"), (None, "a b c d")], "item_id long, text string")
    kept, stored = {}, RT._stored
    monkeypatch.setattr(RT, "_stored", lambda df, folder, name: kept.setdefault(name, stored(df, folder, name)))
    got = RT.containment_match(docs, items, "doc_id", "item_id", "text", "text", at_least=0.5)
    assert best(got) == {i: (1, 0.8) for i in range(20)}
    assert kept["responses"].agg(F.max(F.size("_r")), F.count(F.lit(1))).first() == (4, 21)
    assert "split(" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("shared", [1, 2, 3, 50])
def test_containment_keeps_rows_with_equal_keys_apart(spark, monkeypatch, shared):
    monkeypatch.setattr(RT, "SHARED_KEYS", shared)
    # half of truth 7's second text is in document 1, but no word of its first one; two halves of document 2 make no whole
    items = spark.createDataFrame([(7, "r1 r2 r3 r4 r5 r6 r7 r8"), (7, "f1 f2 f3 f4 f5 f6"), (8, "p q r s"), (8, "p q r s"), (9, "one")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "f4 f5 f6 u"), (2, "p u"), (2, "q u"), (3, "p q"), (3, "p q r s"), (3, "p q r s"), (4, "ONE p")]
                                 + [(i, "f1 f2") for i in range(10, 30)], "doc_id long, text string")
    got = RT.containment_match(docs, items, "doc_id", "item_id", "text", "text", at_least=0.5)
    assert best(got) == {1: (7, 0.5), 3: (8, 1.0), 4: (9, 1.0)} and got.count() == 3
