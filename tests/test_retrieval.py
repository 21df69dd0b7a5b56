"""Vector and keyword retrieval against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import retrieval as RT
from pagewright.operators.ordering import running_sum, with_position


def brute_knn(Q, C, k, thr=None):
    out = {}
    for qi, q in Q.items():
        s = []
        for ci, c in C.items():
            sim = float(np.dot(q, c) / np.linalg.norm(q) / np.linalg.norm(c))
            sim = round(sim, 9)
            if thr is None or sim >= thr:
                s.append((-sim, ci))
        out[qi] = [ci for _, ci in sorted(s)[:k]]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    C = {i: rng.normal(size=8) for i in range(300)}
    C[300] = C[5] * 3.0  # proportional -> exact tie with 5, broken by id
    Q = {i: rng.normal(size=8) for i in range(7)}
    Q[7] = C[5].copy()
    cdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in C.items()], "id long, v array<double>")
    qdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in Q.items()], "qid long, v array<double>")
    return Q, C, qdf, cdf


@pytest.mark.parametrize("blocks", [(1, None), (3, 2), (2, 40)])  # of queries and of the corpus
def test_knn_matches_brute_force(spark, vectors, blocks):
    Q, C, qdf, cdf = vectors
    got = RT.knn(qdf, cdf.repartition(5), "qid", "id", "v", k=4, score_digits=9,
                 query_blocks=blocks[0], corpus_blocks=blocks[1])
    res = {}
    for r in got.orderBy("qid", "rank").collect():
        res.setdefault(r["qid"], []).append(r["id"])
    assert res == brute_knn(Q, C, 4)
    assert res[7][:2] == [5, 300]


def test_w03_threshold_before_ranking(spark, vectors):
    Q, C, qdf, cdf = vectors
    got = RT.knn(qdf, cdf, "qid", "id", "v", k=10, threshold=0.8, score_digits=9)
    res = {}
    for r in got.orderBy("qid", "rank").collect():
        res.setdefault(r["qid"], []).append(r["id"])
    want = {q: v for q, v in brute_knn(Q, C, 10, thr=0.8).items() if v}
    assert res == want


def test_keyword_and_best_match(spark):
    q = spark.createDataFrame([(1, "red apple"), (2, "blue sky")], "qid long, text string")
    c = spark.createDataFrame([(10, "Red apple pie"), (11, "apple"), (12, "the blue sky is red")],
                              "cid long, text string")
    k = {(r["qid"], r["rank"]): r["cid"] for r in RT.keyword_top_k(q, c, "qid", "cid", "text", "text", k=2).collect()}
    assert k[(1, 1)] == 10 and k[(1, 2)] == 11 and k[(2, 1)] == 12
    b = {r["cid"]: (r["qid"], r["overlap"]) for r in RT.best_truth_match(c, q, "cid", "qid", "text", "text").collect()}
    assert b[12] == (2, 1.0) and b[11] == (1, 0.5)


def test_blocks_do_not_change_the_result_and_common_words_make_no_pairs(spark):
    c = spark.createDataFrame([(i, "all " + " ".join(f"w{j}" for j in range(i % 7 + 1))) for i in range(300)], "cid long, text string")
    q = spark.createDataFrame([(i, f"all w{i} w{i + 1}") for i in range(20)], "qid long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(RT.keyword_top_k(q, c, "qid", "cid", "text", "text", k=4, corpus_blocks=1))
    assert want == rows(RT.keyword_top_k(q, c, "qid", "cid", "text", "text", k=4, query_blocks=3, corpus_blocks=5))
    assert len(want) == 80
    plan = RT.keyword_top_k(q, c, "qid", "cid", "text", "text", k=4)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # a word in every text gives each task's k rows a query, not 6,000 joined pairs


def test_positions_and_running_sum(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(1.5).alias("v")).repartition(6)
    pos = {r["k"]: r["pos"] for r in with_position(df, ["k"]).collect()}
    assert pos == {k: k for k in range(1000)}
    rs = {r["k"]: r["running"] for r in running_sum(df, ["k"], "v").collect()}
    assert rs[0] == 1.5 and rs[999] == pytest.approx(1500.0)


def test_hashed_embeddings_shuffle_no_tokens(spark):
    """Tokens are counted into their buckets where they are: one exchange, of (key, bucket)."""
    import re

    from pagewright.operators import retrieval as RT

    docs = spark.createDataFrame([(1, "a b a c"), (1, "c d"), (2, ""), (3, None)], "id long, text string")
    made = RT.hashed_embeddings(docs, "id", "text", 8)
    plan = made._jdf.queryExecution().sparkPlan().toString() + made._jdf.queryExecution().executedPlan().toString()
    assert "_t" not in " ".join(re.findall(r"hashpartitioning\(([^)]*)\)", plan))
    (row,) = made.collect()
    assert row.id == 1 and abs(sum(x * x for x in row.embedding) - 1) < 1e-9
