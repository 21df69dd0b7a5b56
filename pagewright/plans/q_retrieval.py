"""Registered retrieval queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import postings as PX
from ..operators import retrieval as RT
from ..operators import vector_index as VX
from ..session import Tables, checkpoint_dir
from . import sqlexpr as X
from .catalog import register

DIM = 64
SEARCH_THRESHOLD_ON_DATA = 0.3
SCORE_DIGITS = 9


def _centroid_sql() -> str:
    return """
x AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS a FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i),
c AS (SELECT label, list(a ORDER BY i) AS v FROM x GROUP BY label),
s AS (SELECT c.label, e.vec_id, round(list_cosine_similarity(c.v, e.embedding::DOUBLE[]), 9) AS similarity
      FROM c, embeddings e WHERE list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) > 0)"""


KNN_SQL = f"""
WITH {_centroid_sql().strip()},
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM s)
SELECT label, CAST(rank AS INTEGER) AS rank, vec_id, round(similarity, 6) AS similarity FROM r WHERE rank <= 5
"""


def _centroids(t: Tables):
    e = t.embeddings
    return RT.centroids(e, "label", "embedding")


@register("vector_knn", KNN_SQL, "W02 L05")
def q_vector_knn(spark, sf_dir):
    t = Tables(spark, sf_dir)
    k = RT.knn(_centroids(t), t.embeddings, "label", "vec_id", "embedding", k=5, score_digits=SCORE_DIGITS)
    return k.select("label", F.col("rank").cast("int").alias("rank"), "vec_id",
                    F.round("similarity", 6).alias("similarity"))


SEARCH_SQL = f"""
WITH {_centroid_sql().strip()},
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank
      FROM s WHERE similarity >= {SEARCH_THRESHOLD_ON_DATA}::DOUBLE)
SELECT label, CAST(rank AS INTEGER) AS rank, vec_id, round(similarity, 6) AS similarity FROM r WHERE rank <= 10
"""


@register("similarity_search", SEARCH_SQL, "W03")
def q_similarity_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    k = RT.knn(_centroids(t), t.embeddings, "label", "vec_id", "embedding", k=10,
               threshold=SEARCH_THRESHOLD_ON_DATA, score_digits=SCORE_DIGITS)
    return k.select("label", F.col("rank").cast("int").alias("rank"), "vec_id",
                    F.round("similarity", 6).alias("similarity"))


def _tok_sql(table: str, key: str, text: str, alias: str) -> str:
    return (f"{alias} AS (SELECT {key} AS k, unnest(list_filter(string_split_regex(lower(coalesce({text}, '')), '{X.BLANKS}'), "
            f"lambda x: x <> '')) AS t FROM {table})")


def _emb_sql(table: str, key: str, text: str, p: str) -> str:
    return f"""{_tok_sql(table, key, text, p + '_t')},
{p}_b AS (SELECT k, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS INTEGER) AS b,
          SUM(CASE WHEN substr(md5(t), 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS v FROM {p}_t GROUP BY 1, 2),
{p}_keys AS (SELECT DISTINCT k FROM {p}_b),
{p}_g AS (SELECT g.k, r.i, coalesce(b.v, 0.0) AS v FROM {p}_keys g CROSS JOIN range(0, 64) r(i)
          LEFT JOIN {p}_b b ON b.k = g.k AND b.b = r.i),
{p}_e AS (SELECT k, list(v ORDER BY i) AS e FROM {p}_g GROUP BY k HAVING sum(v * v) > 0)"""


EMB_SQL = f"""
WITH {_emb_sql('documents', 'doc_id', 'text', 'd')}
SELECT k AS doc_id, list_transform(e, lambda x: round(x / sqrt(list_dot_product(e, e)), 6)) AS embedding FROM d_e
"""


@register("hashed_embeddings", EMB_SQL, "D02")
def q_hashed_embeddings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    e = RT.hashed_embeddings(t.documents, "doc_id", "text", DIM)
    return e.select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


def _dtok_sql(table: str, key: str, text: str, alias: str) -> str:
    return (f"{alias} AS (SELECT {key} AS k, len(l) AS n, unnest(l) AS t FROM (SELECT {key}, "
            f"list_distinct(list_filter(string_split_regex(lower(coalesce({text}, '')), '{X.BLANKS}'), lambda x: x <> '')) AS l "
            f"FROM {table}))")


KEYWORD_SQL = f"""
WITH {_dtok_sql('benchmark', 'item_id', 'text', 'qt')},
{_dtok_sql('documents', 'doc_id', 'text', 'dt')},
m AS (SELECT qt.k AS item_id, dt.k AS doc_id, count(*)::DOUBLE AS score FROM qt JOIN dt ON dt.t = qt.t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM m)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 5
"""


@register("keyword_search", KEYWORD_SQL, "J03 keyword leg (token equi-join)")
def q_keyword_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    k = RT.keyword_top_k(t.benchmark, t.documents, "item_id", "doc_id", "text", "text", k=5)
    return k.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


HYBRID_SQL = f"""
WITH {_dtok_sql('benchmark', 'item_id', 'text', 'qt')},
{_dtok_sql('documents', 'doc_id', 'text', 'dt')},
m AS (SELECT qt.k AS item_id, dt.k AS doc_id, count(*)::DOUBLE AS score FROM qt JOIN dt ON dt.t = qt.t GROUP BY 1, 2),
kw AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS kw_rank FROM m),
{_emb_sql('benchmark', 'item_id', 'text', 'q')},
{_emb_sql('documents', 'doc_id', 'text', 'd')},
vs AS (SELECT q.k AS item_id, d.k AS doc_id, round(list_cosine_similarity(q.e, d.e), 9) AS sim FROM q_e q, d_e d),
vr AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, doc_id) AS vec_rank FROM vs),
legs AS (SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.kw_rank, b.vec_rank
         FROM (SELECT * FROM kw WHERE kw_rank <= 5) a FULL JOIN (SELECT * FROM vr WHERE vec_rank <= 5) b
         ON a.item_id = b.item_id AND a.doc_id = b.doc_id),
f AS (SELECT *, coalesce(1.0::DOUBLE / (60.0::DOUBLE + kw_rank), 0.0::DOUBLE)
              + coalesce(1.0::DOUBLE / (60.0::DOUBLE + vec_rank), 0.0::DOUBLE) AS rrf_score FROM legs),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf_score DESC, doc_id) AS rank FROM f)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(kw_rank AS INTEGER) AS kw_rank,
       CAST(vec_rank AS INTEGER) AS vec_rank, round(rrf_score, 9) AS rrf_score
FROM r WHERE rank <= 5
"""


@register("hybrid_retrieval", HYBRID_SQL, "J03 W02 D02 L05")
def q_hybrid_retrieval(spark, sf_dir):
    t = Tables(spark, sf_dir)
    h = RT.hybrid_retrieve(t.benchmark, t.documents, "item_id", "doc_id", "text", "text", k=5, dim=DIM)
    return h.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id",
                    F.col("kw_rank").cast("int").alias("kw_rank"), F.col("vec_rank").cast("int").alias("vec_rank"),
                    F.round("rrf_score", 9).alias("rrf_score"))


BEST_SQL = f"""
WITH {_dtok_sql('documents', 'doc_id', 'text', 'rt')},
{_dtok_sql('benchmark', 'item_id', 'text', 'tt')},
m AS (SELECT rt.k AS doc_id, tt.k AS item_id, least(count(*)::DOUBLE / any_value(tt.n)::DOUBLE, 1.0::DOUBLE) AS overlap
      FROM rt JOIN tt ON tt.t = rt.t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, item_id) AS rn FROM m)
SELECT doc_id, item_id, round(overlap, 6) AS overlap FROM r WHERE rn = 1
"""


@register("best_truth_match", BEST_SQL, "J04 F10 U02")
def q_best_truth_match(spark, sf_dir):
    t = Tables(spark, sf_dir)
    b = RT.best_truth_match(t.documents, t.benchmark, "doc_id", "item_id", "text", "text")
    return b.select("doc_id", "item_id", F.round("overlap", 6).alias("overlap"))


INDEXED_VECTOR_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS similarity FROM v q, v WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(similarity, 6) AS similarity FROM r WHERE rank <= 10
"""


@register("indexed_vector_search", INDEXED_VECTOR_SQL, "W02 (index: coarse lists, product codes, exact re-ranking)")
def q_indexed_vector_search(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings.select("vec_id", "embedding")
    index = VX.build(e, "vec_id", "embedding")
    asked = e.where(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id")
    found = VX.search(index, asked, e, "query_id", "vec_id", "embedding", k=10, exact=True, score_digits=SCORE_DIGITS)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.round("similarity", 6).alias("similarity"))


@register("indexed_keyword_search", KEYWORD_SQL, "J03 (keyword leg on stored postings, stopped by bounds)")
def q_indexed_keyword_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    index = PX.build(t.documents.select("doc_id", "text"), "doc_id", "text", f"{checkpoint_dir(spark).rstrip('/')}/postings-{uuid.uuid4().hex}")
    found = PX.search(index, t.benchmark, "item_id", "text", k=5)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


CONTAINED_SQL = f"""
WITH {_dtok_sql('documents', 'doc_id', 'text', 'rt')},
{_dtok_sql('benchmark', 'item_id', 'text', 'tt')},
m AS (SELECT rt.k AS doc_id, tt.k AS item_id, least(count(*)::DOUBLE / any_value(tt.n)::DOUBLE, 1.0::DOUBLE) AS overlap
      FROM rt JOIN tt ON tt.t = rt.t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, item_id) AS rn FROM m WHERE overlap >= 0.5::DOUBLE)
SELECT doc_id, item_id, round(overlap, 6) AS overlap FROM r WHERE rn = 1
"""


@register("containment_match", CONTAINED_SQL, "J04 (truths of which a response contains half, found by their rarest tokens)")
def q_containment_match(spark, sf_dir):
    t = Tables(spark, sf_dir)
    b = RT.containment_match(t.documents, t.benchmark, "doc_id", "item_id", "text", "text", at_least=0.5)
    return b.select("doc_id", "item_id", F.round("overlap", 6).alias("overlap"))
