"""Retrieval operators: hashed embeddings (D02), vector k-NN (W02), threshold
search (W03), keyword matching (J03), hybrid retrieval with reciprocal-rank
fusion (J03), best ground-truth match (J04).

Scale notes
* Searches are a query set against all rows, in blocks: both sides are dealt
  into blocks by a hash of their key, as many as their counted bytes need
  (``blocks_of``), every query block meets every corpus block once (a cogroup),
  and a task keeps only its own top k of each query.  Queries stay a DataFrame:
  nothing passes through the driver, nothing is broadcast, no job runs while a
  plan is built, and no query x row pair is made as a row.  Memory of a task is
  one block of either side.
* Keyword scores come from an inverted index of the block, so a word that is in
  every text costs a numpy count, not joined rows.
* Top-k per query is ``row_number() <= k`` over ``partitionBy(query)``: Spark
  plans a partial ``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..session import checkpoint_dir, reliable_checkpoint

RRF_K = 60
BLOCK_BYTES = 64 << 20  # of texts or vectors of one side in a task
SHARED_KEYS = 3         # rare tokens of a truth that a response must have before the pair is verified


# ---------------------------------------------------------------------------
# tokens
# ---------------------------------------------------------------------------
def tokens(text: Column) -> Column:
    """Lower-cased whitespace tokens (all occurrences, empties dropped)."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), K.BLANKS), lambda x: x != "")


def blocks_of(df: DataFrame, bytes_of: Column, least: int = 1) -> Column:
    """How many blocks of about ``BLOCK_BYTES`` the rows make: a scalar subquery,
    so the number is counted when the plan runs, not while it is built."""
    total = df.agg(F.coalesce(F.sum(bytes_of.cast("bigint")), F.lit(0)).alias("_bytes")).scalar()
    return F.greatest(F.lit(int(least)), F.ceil(total / F.lit(BLOCK_BYTES))).cast("int")


def block_cogroup(left: DataFrame, right: DataFrame, lkey: str, rkey: str, fn, schema, left_blocks: int | Column = 1, right_blocks: int | Column | None = None) -> DataFrame:
    """Every block of ``left`` with every block of ``right``: ``fn(left_pdf,
    right_pdf)`` per pair of blocks.  Left rows are sent to each right block and
    the other way round; ``right_blocks`` defaults to the shuffle partitions.
    Both numbers may be columns (:func:`blocks_of`), so that neither side of a
    task grows with its table."""
    number = lambda n: F.lit(n) if isinstance(n, int) else n
    nl, nr = number(left_blocks), number(_partitions(left) if right_blocks is None else right_blocks)
    place = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    l = left.withColumn("_lb", place(lkey, nl)).withColumn("_rb", each(nr))  # noqa: E741
    r = right.withColumn("_rb", place(rkey, nr)).withColumn("_lb", each(nl))
    return l.groupBy("_lb", "_rb").cogroup(r.groupBy("_lb", "_rb")).applyInPandas(fn, schema)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _shared_counts(queries, rows):
    """(queries x rows) numbers of shared distinct tokens, query by query, from
    an inverted index of the rows' token lists."""
    import numpy as np

    lengths = np.array([len(t) for t in rows], np.int64)
    ids: dict[str, int] = {}
    flat = np.fromiter((ids.setdefault(t, len(ids)) for ts in rows for t in ts), np.int64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(rows)), lengths)
    order = np.argsort(flat, kind="stable")
    owner, start = owner[order], np.searchsorted(flat[order], np.arange(len(ids) + 1))
    for tokens_ in queries:
        found = [owner[start[i]:start[i + 1]] for i in (ids.get(t) for t in tokens_) if i is not None]
        yield np.bincount(np.concatenate(found), minlength=len(rows)) if found else np.zeros(len(rows), np.int64)


def _tokened(df: DataFrame, key: str, text: str, out: str) -> DataFrame:
    return df.select(key, F.array_distinct(tokens(F.col(text))).alias(out))


# ---------------------------------------------------------------------------
# vectors
# ---------------------------------------------------------------------------
def hashed_embeddings(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """Signed hashed bag of words, L2-normalised, as ``array<double>``.

    bucket = first 32 bits of md5(token) mod dim; sign from the next hex
    digit.  Counted per (key, bucket) straight from the tokens: the aggregation
    combines map-side, so a text of any size costs at most ``dim`` small rows in
    the only shuffle; the last step gathers those ``dim`` values (never the
    text) into one vector.
    """
    t = df.select(F.col(key).alias("_k"), F.explode(tokens(F.col(text))).alias("_t")).select("_k", F.md5(F.col("_t")).alias("_h"))
    h = F.col("_h")
    bucket = (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % F.lit(dim)).cast("int")
    sign = F.when(F.substring(h, 9, 1) < F.lit("8"), F.lit(1)).otherwise(F.lit(-1))
    bk = t.groupBy("_k", bucket.alias("_b")).agg(F.sum(sign).cast("double").alias("_v"))
    m = bk.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("_b", "_v"))).alias("_m"),
                             F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_norm"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                      lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0)) / F.col("_norm"))
    return m.where(F.col("_norm") > 0).select(F.col("_k").alias(key), vec.alias("embedding"))


def centroids(vectors: DataFrame, by: str, vec: str) -> DataFrame:
    """Mean vector per group over all components, whatever their number: one
    partial aggregation of (group, component).  Vectors of different lengths in
    one group are an error."""
    parts = vectors.select(by, F.size(vec).alias("_n"), F.posexplode(vec).alias("_i", "_x"))
    g = parts.groupBy(by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_a"), F.min("_n").alias("_lo"), F.max("_n").alias("_hi"))
    mixed = F.raise_error(F.lit("vectors of different lengths")).cast("double")
    g = g.withColumn("_a", F.when(F.col("_lo") == F.col("_hi"), F.col("_a")).otherwise(mixed))
    return g.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_a"))), lambda x: x["_a"]).alias(vec))


def _top_k(scored: DataFrame, qkey: str, ckey: str, score: str, k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(qkey).orderBy(F.col(score).desc(), F.col(ckey).asc())
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def knn(queries: DataFrame, corpus: DataFrame, qkey: str, ckey: str, vec: str, k: int = K.RETRIEVAL_TOP_K,
        threshold: float | None = None, exclude_self: bool = False, score_digits: int | None = None,
        query_blocks: int | None = None, corpus_blocks: int | None = None) -> DataFrame:
    """Exact k nearest corpus vectors per query by cosine similarity.

    Each pair of blocks is one matrix product; a task emits its own top k per
    query, and ``row_number() <= k`` per query merges them.  ``threshold`` filters
    *before* ranking (W03); ties rank by corpus key; ``score_digits`` rounds
    scores before ranking, so mathematically equal scores (proportional vectors)
    tie exactly.  Zero vectors have no direction and are never a result; vectors
    of different lengths are an error.
    """
    schema = T.StructType([queries.schema[qkey], corpus.schema[ckey], T.StructField("similarity", T.DoubleType())])
    limit = None if threshold is None else float(threshold)

    def units(pdf, key, col):
        import numpy as np

        m = np.stack(pdf[col].to_numpy()).astype(np.float64)
        size = np.sqrt((m * m).sum(axis=1))
        ok = size > 0
        return pdf[key].to_numpy()[ok], m[ok] / size[ok][:, None]

    def run(left, right):
        import numpy as np
        import pandas as pd

        out = {qkey: [], ckey: [], "similarity": []}
        if len(left) and len(right):
            qs, qm = units(left, qkey, "_q")
            cs, cm = units(right, ckey, "_c")
            order = np.argsort(cs, kind="stable")
            cs, cm = cs[order], cm[order]
            for q, v in zip(qs, qm):
                score = cm @ v
                if score_digits is not None:
                    score = np.round(score, score_digits)
                keep = np.ones(len(cs), bool) if limit is None else score >= limit
                if exclude_self:
                    keep &= cs != q
                at = np.flatnonzero(keep)
                at = at[np.argsort(-score[at], kind="stable")[:k]]  # rows are in key order: ties go to the smaller key
                out[qkey] += [q] * len(at)
                out[ckey] += cs[at].tolist()
                out["similarity"] += score[at].tolist()
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in out.items()})

    size = F.size(vec) * 8
    scored = block_cogroup(queries.select(qkey, F.col(vec).alias("_q")), corpus.select(ckey, F.col(vec).alias("_c")), qkey, ckey, run, schema,
                           query_blocks or blocks_of(queries, size), corpus_blocks or blocks_of(corpus, size, _partitions(corpus)))
    return _top_k(scored, qkey, ckey, "similarity", k)


def similarity_search(queries, corpus, qkey, ckey, vec, top_k: int = K.SEARCH_TOP_K,
                      threshold: float = K.SEARCH_THRESHOLD) -> DataFrame:
    """top_k by cosine among corpus vectors scoring at least ``threshold``."""
    return knn(queries, corpus, qkey, ckey, vec, k=top_k, threshold=threshold)


# ---------------------------------------------------------------------------
# keyword leg, hybrid fusion, best match
# ---------------------------------------------------------------------------
def keyword_top_k(queries: DataFrame, corpus: DataFrame, qkey: str, ckey: str, qtext: str, ctext: str,
                  k: int = K.RETRIEVAL_TOP_K, query_blocks: int | None = None, corpus_blocks: int | None = None) -> DataFrame:
    """Keyword leg: corpus texts ranked by the number of distinct query
    tokens they contain (ties by corpus key)."""
    schema = T.StructType([queries.schema[qkey], corpus.schema[ckey], T.StructField("score", T.DoubleType())])

    def run(left, right):
        import numpy as np
        import pandas as pd

        out = {qkey: [], ckey: [], "score": []}
        if len(left) and len(right):
            right = right.sort_values(ckey, kind="stable")
            keys = right[ckey].to_numpy()
            for q, counts in zip(left[qkey], _shared_counts(left["_q"], right["_c"])):
                at = np.flatnonzero(counts)
                at = at[np.argsort(-counts[at], kind="stable")[:k]]
                out[qkey] += [q] * len(at)
                out[ckey] += keys[at].tolist()
                out["score"] += counts[at].astype(float).tolist()
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in out.items()})

    scored = block_cogroup(_tokened(queries, qkey, qtext, "_q"), _tokened(corpus, ckey, ctext, "_c"), qkey, ckey, run, schema,
                           query_blocks or blocks_of(queries, F.octet_length(qtext)), corpus_blocks or blocks_of(corpus, F.octet_length(ctext), _partitions(corpus)))
    return _top_k(scored, qkey, ckey, "score", k)


def hybrid_retrieve(queries: DataFrame, corpus: DataFrame, qkey: str, ckey: str, qtext: str, ctext: str,
                    k: int = K.RETRIEVAL_TOP_K, dim: int = 64, rrf_k: int = RRF_K,
                    score_digits: int | None = 9) -> DataFrame:
    """Keyword leg top-k and vector leg top-k (hashed embeddings), fused
    by reciprocal rank ``sum(1 / (rrf_k + rank))``; final top-k per query."""
    kw = keyword_top_k(queries, corpus, qkey, ckey, qtext, ctext, k).select(
        qkey, ckey, F.col("rank").alias("kw_rank"))
    qv = hashed_embeddings(queries, qkey, qtext, dim)
    cv = hashed_embeddings(corpus, ckey, ctext, dim)
    vec = knn(qv, cv, qkey, ckey, "embedding", k=k, score_digits=score_digits).select(qkey, ckey, F.col("rank").alias("vec_rank"))
    legs = kw.join(vec, [qkey, ckey], "full")
    rrf = (F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("kw_rank")), F.lit(0.0))
           + F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("vec_rank")), F.lit(0.0)))
    return _top_k(legs.withColumn("rrf_score", rrf), qkey, ckey, "rrf_score", k)


def contexts_for(hits: DataFrame, corpus: DataFrame, qkey, ckey: str, ctext: str) -> DataFrame:
    """Retrieved contexts per query, in rank order (feeds P02): at most the
    hits' k texts of one query meet in a row."""
    keys = [qkey] if isinstance(qkey, str) else list(qkey)
    j = hits.join(corpus.select(ckey, F.col(ctext).alias("_content")), ckey)
    g = j.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "_content"))).alias("_r"))
    return g.select(*keys, F.transform("_r", lambda x: x["_content"]).alias("contexts"))


def best_truth_match(responses: DataFrame, truths: DataFrame, rkey: str, tkey: str, rtext: str, ttext: str,
                     truth_blocks: int | None = None, response_blocks: int | None = None) -> DataFrame:
    """For each response, the ground truth with the highest word overlap
    |R ∩ T| / |T| (ties: smallest truth key).  Responses sharing no token
    with any truth have no row."""
    schema = T.StructType([responses.schema[rkey], truths.schema[tkey], T.StructField("overlap", T.DoubleType())])

    def run(left, right):
        import numpy as np
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({rkey: [], tkey: [], "overlap": []})
        left = left.sort_values(tkey, kind="stable")
        best, which = np.zeros(len(right)), np.full(len(right), -1)
        for i, (n, counts) in enumerate(zip(left["_t"].map(len), _shared_counts(left["_t"], right["_r"]))):
            overlap = np.minimum(counts / max(n, 1), 1.0)
            better = overlap > best
            best[better], which[better] = overlap[better], i
        some = which >= 0
        return pd.DataFrame({rkey: right[rkey].to_numpy()[some], tkey: left[tkey].to_numpy()[which[some]], "overlap": best[some]})

    found = block_cogroup(_tokened(truths, tkey, ttext, "_t"), _tokened(responses, rkey, rtext, "_r"), tkey, rkey, run, schema,
                          truth_blocks or blocks_of(truths, F.octet_length(ttext)), response_blocks or blocks_of(responses, F.octet_length(rtext), _partitions(responses)))
    best = found.groupBy(rkey).agg(F.max_by(F.struct("overlap", tkey), F.struct(F.col("overlap"), -F.col(tkey))).alias("b"))
    return best.select(rkey, F.col("b." + tkey).alias(tkey), F.col("b.overlap").alias("overlap"))


def _stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Written once to the shared folder and read back: what several steps read is
    made once, and joins are planned by its real size."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def _known_ids(df: DataFrame, key: str, text: str, known: DataFrame, row: str, out: str) -> DataFrame:
    """(row, key, ids of the text's distinct tokens that ``known`` has).  Rows stay
    apart where keys repeat; rows without a key or a known token are left out."""
    own = _tokened(df.where(F.col(key).isNotNull()), key, text, "_tokens").select(F.monotonically_increasing_id().alias(row), key, "_tokens")
    return own.select(row, key, F.explode("_tokens").alias("_w")).join(known, "_w").groupBy(row, key).agg(F.collect_list("_id").alias(out))


def containment_match(responses: DataFrame, truths: DataFrame, rkey: str, tkey: str, rtext: str, ttext: str, at_least: float = 0.5, exact: bool = False) -> DataFrame:
    """J04 as a search: the best ground truth of each response among those of
    which it contains a share of ``at_least`` or more; all of these are found.

    A response with ``h = ceil(at_least * m)`` of a truth's ``m`` tokens lacks at
    most ``m - h``, so it has ``l`` of the ``m - h + l`` rarest (rare by the number
    of responses; ``l`` is ``SHARED_KEYS``, or ``h`` if that is less).  So only
    these tokens of a truth are keys of the join, its most frequent words never
    are, and pairs that meet at ``l`` of them are verified on their whole token
    sets.  Texts are read once: a response goes on as the ids of those of its
    tokens that some truth has, which are all that any truth can share with it.
    ``exact`` finds the best truth below the bound too, by the block search for
    the responses that are left.
    """
    folder = f"{checkpoint_dir(responses.sparkSession).rstrip('/')}/containment-{uuid.uuid4().hex}"
    known = _stored(_tokened(truths, tkey, ttext, "_t").select(F.explode("_t").alias("_w")).distinct()
                    .withColumn("_id", F.monotonically_increasing_id()), folder, "known")
    t = _stored(_known_ids(truths, tkey, ttext, known, "_truth", "_t"), folder, "truths")
    r = _stored(_known_ids(responses, rkey, rtext, known, "_row", "_r"), folder, "responses")
    words = r.select("_row", F.explode("_r").alias("_id"))
    often = words.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
    least = F.ceil(F.size("_t") * F.lit(float(at_least) - 1e-9))  # a little slack: the share is compared as a double
    needed = F.greatest(F.lit(1), F.least(F.lit(SHARED_KEYS), least))
    asked = t.select("_truth", needed.alias("_needed"), (F.size("_t") - least + needed).alias("_places"), F.explode("_t").alias("_id"))
    rare = Window.partitionBy("_truth").orderBy(F.coalesce("_n", F.lit(0)), "_id")  # the tokens of one truth
    keys = _stored(asked.join(often, "_id", "left").withColumn("_place", F.row_number().over(rare))
                   .where(F.col("_place") <= F.col("_places")).select("_truth", "_needed", "_id"), folder, "keys")
    pairs = (words.join(keys, "_id").repartition("_row").groupBy("_row", "_truth").agg(F.count(F.lit(1)).alias("_n"), F.first("_needed").alias("_needed"))
             .where(F.col("_n") >= F.col("_needed")).select("_row", "_truth"))
    shared = F.size(F.array_intersect("_r", "_t")) / F.size("_t")
    # merge: responses are never broadcast, however well their files pack
    scored = pairs.join(t, "_truth").join(r.hint("merge"), "_row").select(rkey, tkey, F.least(shared, F.lit(1.0)).alias("overlap")).where(F.col("overlap") >= float(at_least))
    best = scored.groupBy(rkey).agg(F.max_by(F.struct("overlap", tkey), F.struct(F.col("overlap"), -F.col(tkey))).alias("b"))
    found = best.select(rkey, F.col("b." + tkey).alias(tkey), F.col("b.overlap").alias("overlap"))
    if not exact:
        return found
    found = reliable_checkpoint(found)
    rest = responses.join(found.select(rkey), rkey, "left_anti")
    return found.unionByName(best_truth_match(rest, truths, rkey, tkey, rtext, ttext))
