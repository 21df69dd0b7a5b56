"""The pipeline's stages against brute force, and the registered queries."""

import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from pagewright.llm import jobs, langid

from .test_operators import brute_classes, word_list

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, through Parquet as in a run."""
    docs = jobs.text_table(spark, SF, "documents")
    folder, out = tmp_path_factory.mktemp("stages"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, after))
        docs = after
    return {name: (before.collect(), after.collect(), before.columns, after.columns) for name, before, after in out}


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "substring", "decontaminate", "pack"]
    for name in list(stages)[:-1]:
        assert stages[name][2] == stages[name][3]


def test_language_stage_keeps_texts_with_letters(stages):
    before, after, _, _ = stages["language"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if re.search(r"[^\W\d_]", r.text or "")}


def test_near_dedup_stage(stages):
    before, after, _, _ = stages["near_dedup"]
    want = {d for d, (_, c) in brute_classes([(r.doc_id, r.text) for r in before], 5, 80, 100).items() if c == d}
    assert {r.doc_id for r in after} == want


def test_substring_stage_leaves_no_repeated_passage(stages):
    before, after, _, _ = stages["substring"]
    texts = {r.doc_id: r.text for r in before}
    seen, runs = defaultdict(set), 0
    for r in after:
        assert r.n_chars == len(r.text) and set(word_list(r.text)) <= set(word_list(texts[r.doc_id]))
        w = word_list(r.text)
        for i in range(len(w) - 54):
            seen[tuple(w[i:i + 55])].add(r.doc_id)
    runs = sum(len(v) > 1 for v in seen.values())
    assert runs == 0
    unchanged = sum(r.text == texts[r.doc_id] for r in after)
    assert unchanged > 0.8 * len(after)


def test_decontaminate_stage(spark, stages):
    before, after, _, _ = stages["decontaminate"]
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in before if any(f" {b} " in f" {plain(r.text)} " for b in items)}
    kept = {r.doc_id for r in after}
    assert not kept & dirty and len(kept) >= len(before) - len(dirty) - 1


def test_pack_stage_covers_every_document(stages):
    before, after, _, _ = stages["pack"]
    tokens = defaultdict(int)
    for p in after:
        tokens[p.doc_id] += p.length
        assert p.start + p.length <= p.doc_tokens
    assert set(tokens) == {r.doc_id for r in before}
    assert all(tokens[p.doc_id] == p.doc_tokens for p in after)


def test_run_equals_the_stages(spark, stages):
    got = sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in stages["pack"][1])


def test_stages_on_odd_and_empty_tables(spark):
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 2), (3, "words of a text " * 40, "en", "s", 600, 3), (3, "words of a text " * 40, "en", "s", 600, 3), (4, "x", "de", "s", 1, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long")
    for table in (docs, docs.filter("doc_id < 0")):
        d = table
        for name, stage in corpus_pipeline.STAGES:
            d = jobs.cut(stage(spark, d, SF))
            if name != "pack":
                assert d.columns == docs.columns
        assert {r.doc_id for r in d.collect()} == ({3, 4} if table is docs else set())


def test_registered_queries():
    names = [n for n in queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in queries()
    assert {"op2_prefix_target_chat", "op4_minhash_near_dedup", "op6_line_first_rules", "op11_orchard_clusters", "op12_skip_list_infill"} <= set(oracle_sql())


@pytest.mark.parametrize("name", ["op2_prefix_target_chat", "op4_minhash_near_dedup", "op6_line_first_rules"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries()[name](spark, SF)
    rel = con.sql(oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = sorted(map(repr, rel.select(*df.columns).fetchall()))
    assert sorted(repr(tuple(int(v) if isinstance(v, np.integer) else v for v in r)) for r in df.collect()) == want


def test_held_out_rule(spark):
    import zlib

    got = {r.id: r.h for r in spark.range(300).select("id", langid.is_held_out("id").alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in got.items())
