"""The registered queries of this subpackage and their DuckDB SQL.

``QUERIES[name] = fn(spark, sf_dir)``; a query applies its operator with
production parameters to its whole table.  ``ORACLE`` has the SQL where SQL
can express the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, infill, langid, linerules, neardup, orchard, packing, pages, quality, sharding, substring, toxicity
from .jobs import text_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return add


_WORDS = r"""list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""
_LOWER_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""


@query("op1_nnpu_quality")
def op1_nnpu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text of ``documents``."""
    docs = text_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = text_table(spark, sf_dir, "labels").select("doc_id", "quality")
    scores = quality.score(docs, quality.fit(docs, labels))
    return scores.select("doc_id", quality.is_held_out().alias("held_out"), "score",
                         (F.col("score") >= quality.KEEP_SCORE).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    """Vocabulary file of the public byte-level BPE; read where the tokens are made."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op3_sum_of_squares_packing")
def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 tokens, one row per piece."""
    return packing.pack(text_table(spark, sf_dir, "documents"), tokenizer_path())


@query("op4_minhash_near_dedup", f"""
WITH RECURSIVE w AS (SELECT doc_id, {_LOWER_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, u.b FROM r JOIN u ON r.reach = u.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.reach) AS component_id, n.doc_id = min(r.reach) AS kept
FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n
""")
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of ``documents``: 3-word shingles, Jaccard >= .85."""
    return neardup.near_duplicates(text_table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


@query("op10_crf_language_id")
def op10_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, labelled word by word."""
    docs = text_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    return (langid.identify(docs.select("doc_id", "text"), model)
            .select("doc_id", langid.is_held_out().alias("held_out"), "lang_pred", "score"))


_SEPARATORS = ", ".join(f"'{x}'" for x in linerules.SEPARATORS)
_BOILERPLATE = "|".join(linerules.BOILERPLATE)


@query("op6_line_first_rules", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
w AS (SELECT doc_id, line, i, {_WORDS.replace("coalesce(text, '')", "line")} AS ws FROM l),
f AS (SELECT doc_id, line, i, len(ws) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS is_copy,
      len(list_filter(ws, lambda x: x IN ({_SEPARATORS}))) AS seps,
      len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&|<>]$'))) AS noise,
      len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z][A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS shout,
      len(list_distinct(ws)) AS uniq,
      regexp_matches(line, '[.!?]') AS ended, regexp_matches(line, '(?i){_BOILERPLATE}') AS boiler
      FROM w WHERE len(ws) > 0),
v AS (SELECT doc_id, n, is_copy, (seps >= 2 AND 4 * seps >= n) OR 2 * noise > n OR (n >= 5 AND 2 * shout > n) OR (n >= 8 AND 4 * uniq < n)
      OR (n >= 30 AND NOT ended) OR (n <= 30 AND boiler) OR is_copy AS fails FROM f),
s AS (SELECT doc_id, sum(n) AS n_words, count(*) FILTER (is_copy) AS n_dup_lines, coalesce(sum(n) FILTER (fails), 0) AS lost FROM v GROUP BY doc_id),
t AS (SELECT doc_id, {_WORDS} AS ws FROM d),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: {{'i': i, 'x': ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]}})) AS g FROM t WHERE len(ws) > 2),
r AS (SELECT doc_id, g.i AS i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g.x) > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n_words, 0)::BIGINT AS n_words, coalesce(list_sum(list_transform(t.ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(s.n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  coalesce(s.n_words, 0) < 50 OR 100 * coalesce(c.n, 0) > 50 * coalesce(s.n_words, 0) AS base_failed,
  coalesce(s.lost, 0)::BIGINT AS lost_words,
  NOT (coalesce(s.n_words, 0) < 50 OR 100 * coalesce(c.n, 0) > 50 * coalesce(s.n_words, 0)) AND 100 * coalesce(s.lost, 0) <= 30 * coalesce(s.n_words, 0) AS kept
FROM d JOIN t USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)
""")
def op6_line_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line rules and verdict of every whole text of ``documents``."""
    return linerules.evaluate(text_table(spark, sf_dir, "documents"))


_SAFE = r"regexp_replace({x}, '<(\\*)\|', '<\\\1|', 'g')"
_ROLE = _SAFE.format(x=r"replace(replace(role, '\', '\\'), chr(10), '\n')")


@query("op2_prefix_target_chat", f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length({_ROLE}) + length({_SAFE.format(x="text")}))::BIGINT AS formatted_chars, (count(*) FILTER (role = 'assistant'))::BIGINT AS n_examples
FROM t GROUP BY conv_id
""")
def op2_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -1, formatted and read back."""
    turns = text_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.segments(turns.unionByName(extra)))


@query("op8_feistel_shards")
def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 40 shards whose row counts differ by one at most."""
    return sharding.shards(text_table(spark, sf_dir, "documents"), count=40)


@query("op5_collinear_substring_dedup")
def op5_collinear_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of ``documents`` that repeat, whole or edited, an earlier document's."""
    return substring.passages(text_table(spark, sf_dir, "documents"))


@query("op7_template_decontamination")
def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a ``benchmark`` item, as it is or re-parameterised."""
    return decontam.findings(text_table(spark, sf_dir, "documents"), text_table(spark, sf_dir, "benchmark"))


@query("op9_host_suffix_array")
def op9_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    return pages.extract(text_table(spark, sf_dir, "pages"))


def _round_sql(r: int) -> str:
    """Assignment of every vector to the nearest of the centroids of round ``r``
    and, from it, the centroids of round ``r + 1``."""
    return f"""a{r} AS MATERIALIZED (SELECT rid, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM (
    SELECT v.rid, k.c, sum((v.x - k.x) * (v.x - k.x))::BIGINT AS d FROM x v JOIN c{r} k ON v.i = k.i GROUP BY v.rid, k.c) GROUP BY rid),
c{r + 1} AS MATERIALIZED (SELECT k.c, k.i, coalesce(m.x, k.x) AS x FROM c{r} k LEFT JOIN (
    SELECT a.c, v.i, floor(sum(v.x)::DOUBLE / count(*))::BIGINT AS x FROM a{r} a JOIN x v USING (rid) GROUP BY a.c, v.i) m USING (c, i))"""


@query("op11_orchard_clusters", f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
x AS MATERIALIZED (SELECT rid, unnest(q) AS x, unnest(range(1, 65)) AS i FROM v),
s AS (SELECT rid, row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS c FROM v QUALIFY c < {orchard.K}),
c0 AS MATERIALIZED (SELECT s.c, x.i, x.x FROM s JOIN x USING (rid)),
{", ".join(_round_sql(r) for r in range(orchard.ROUNDS))},
{_round_sql(orchard.ROUNDS).split("," + chr(10) + "c")[0]},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM c{orchard.ROUNDS} GROUP BY c)
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, h.sha AS centroid_sha256
FROM a{orchard.ROUNDS} a JOIN v USING (rid) JOIN h ON h.c = a.c
""")
def op11_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of every usable vector of ``embeddings`` after five rounds."""
    return orchard.cluster(text_table(spark, sf_dir, "embeddings"))[0]


_UNITS = "regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]')"
_GROUP = "('0x' || substr(sha256('1:' || doc_id), {at}, 8))::BIGINT"


@query("op12_skip_list_infill", f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_UNITS} AS u, {", ".join(f"{_GROUP.format(at=8 * i + 1)} AS h{i + 1}" for i in range(4))} FROM documents),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
""")
def op12_skip_list_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` cut for infilling, and read back."""
    out = infill.transform(text_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(infill.restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


@query("op13_boosted_toxicity")
def op13_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text of ``documents``."""
    docs = text_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = text_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scores = toxicity.score(docs, toxicity.fit(docs, labels))
    return scores.select("doc_id", toxicity.is_held_out().alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC_SCORE).cast("int").alias("predicted"))
