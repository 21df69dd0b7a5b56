"""Folder job over several sources, batch callables, profiles that merge."""

import os

import pytest
from pyspark.sql import functions as F

from pagewright import constants as K
from pagewright.operators import data as DJ
from pagewright.operators import ordering as O
from pagewright.operators import plugins as PL
from pagewright.operators import profiles as PR
from pagewright.operators import qa as Q
from pagewright.operators import report as R
from pagewright.plans import q_metrics as QM
from pagewright.plans import views as V
from pagewright.session import Tables
from pagewright.sources import files as SRC

SF = "/root/testdata/sf0.001"


def test_folder_job_is_one_chain_over_several_sources(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    (src / "a").mkdir(parents=True)
    (src / "a" / "one.pdf").write_bytes(b"First page. Short.\fSecond page costs 12 USD\f")
    (src / "a" / "two.PDF").write_bytes(b"bad page\fgood page")
    (src / "broken.png").write_bytes(b"BROKEN")
    (src / "notes.docx").write_bytes(b"not read")

    def splitter(content):
        if content == b"BROKEN":
            raise ValueError("unreadable file")
        assert content != b"not read"  # a rejected file's content never arrives
        return SRC.text_pages(content)

    def careful(page):
        if page.startswith(b"bad"):
            raise IOError("no text")
        return {"lines": [{"text": page.decode().upper(), "confidence": 0.95}]}

    def forms(pages):
        return pages.where("page_number = 2").select("doc_id", "page_number", F.lit("form text").alias("text"), F.lit(0.99).alias("confidence"))

    SRC.process_folder(spark, str(src), out, {K.SOURCE_TESSERACT: SRC.text_reader, K.SOURCE_CV: careful}, splitter, forms)
    docs = {os.path.basename(r["doc_id"]): r for r in spark.read.parquet(f"{out}/documents").collect()}
    assert set(docs) == {"one.pdf", "two.PDF", "broken.png"}
    assert docs["one.pdf"]["total_pages"] == 3 and docs["two.PDF"]["total_pages"] == 2 and docs["broken.png"]["total_pages"] == 1
    assert "FIRST PAGE. SHORT." in docs["one.pdf"]["full_text"] and "form text" in docs["one.pdf"]["full_text"]
    assert "bad page" in docs["two.PDF"]["full_text"] and "form text" in docs["two.PDF"]["full_text"]  # the other source read it
    assert docs["broken.png"]["overall_confidence"] == 0.0
    rejected = [(os.path.basename(r["path"]), r["reject_reason"]) for r in spark.read.parquet(f"{out}/rejected").collect()]
    assert rejected == [("notes.docx", "unsupported_format")]


def test_batches_return_their_own_errors_and_true_positions(spark):
    df = O.with_position(spark.createDataFrame([(i, 0, f"q{i}") for i in range(23)], "conv_id long, turn long, query string").repartition(3), ["conv_id"], keys_only=True)
    sizes = spark.sparkContext.accumulator(0)

    def model(qs):
        sizes.add(1)
        return [ValueError("refused") if q == "q7" else q + "!" for q in qs]

    out = {r["conv_id"]: r for r in PL.batch_inference(df.coalesce(1), model, batch_size=5, position="pos", whole_slices=True).collect()}
    assert len(out) == 23 and out[7]["is_error"] and out[7]["response"] == K.QUERY_ERROR_PREFIX + "refused" and out[7]["latency_ms"] == 0.0
    assert all(out[i]["response"] == f"q{i}!" for i in out if i != 7)
    assert {i: r["batch"] for i, r in out.items()} == {i: i // 5 for i in range(23)}
    assert sizes.value == 5  # one call per slice: an answer's own error costs no further call

    def short(qs):
        if len(qs) > 1:
            return qs[:1]  # not as many answers as queries: the slice is halved
        return [qs[0]]
    assert PL.batch_inference(df, short, batch_size=4, whole_slices=True).where("not is_error").count() == 23


def test_profiles_read_new_files_only_and_merge(spark, tmp_path):
    table, profiles = str(tmp_path / "t"), str(tmp_path / "p")
    rows = [(i, None if i % 7 == 0 else f"v{i % 40}", '{"a": 1}' if i % 5 else "{bad") for i in range(200)]
    write = lambda part: spark.createDataFrame(part, "id long, name string, props string").coalesce(1).write.mode("append").parquet(table)
    write(rows[:80])
    write(rows[80:120])
    assert PR.update(spark, table, profiles, ["name", "props"], ["props"]) == 2
    assert PR.update(spark, table, profiles, ["name", "props"], ["props"]) == 0
    write(rows[120:])
    assert PR.update(spark, table, profiles, ["name", "props"], ["props"]) == 1
    got = {r["column_name"]: r for r in PR.merged(PR.current(spark, table, profiles)).collect()}
    want = {r["column_name"]: r for r in DJ.validate_columns(spark.read.parquet(table), "t", ["name", "props"], ["props"]).collect()}
    for c in ("name", "props"):
        assert all(got[c][n] == want[c][n] for n in PR.PLAIN) and got[c]["files"] == 3
    assert abs(got["name"]["distinct_estimate"] - 40) <= 2 and got["props"]["malformed_json"] == 40
    assert want["name"]["duplicates"] == 200 - len([1 for i in range(200) if i % 7 == 0]) - 40
    gone = [f for f in os.listdir(table) if f.endswith(".parquet")][0]
    os.remove(os.path.join(table, gone))
    assert {r["files"] for r in PR.merged(PR.current(spark, table, profiles)).collect()} == {2}


def test_lengths_stand_for_contexts(spark):
    t = Tables(spark, SF)
    full, short = (Q.inference_records(V.interactions(t, how)).orderBy("conv_id", "turn").collect() for how in (True, "length"))
    assert full == short
    plan = Q.analyze(V.interactions(t, "length"), Q.safety_scores(V.severity(t)), use_rag=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "length(text" in plan and "context#" not in plan.replace("context_chars#", "").replace("context_length#", "").replace("used_context#", "")
    with pytest.raises(ValueError):
        Q.analyze(V.interactions(t, "length"), retrieved=spark.createDataFrame([], "conv_id long, contexts array<string>"))


def test_transcript_chunks_join_to_the_transcript(spark):
    from pagewright.plans.q_scoring import q_conversation_transcripts

    whole = {r["conv_id"]: (r["n_turns"], r["transcript"]) for r in q_conversation_transcripts(spark, SF).collect()}
    parts = {}
    for r in Q.transcript_chunks(Tables(spark, SF).conversations, turns=2).orderBy("conv_id", "chunk").collect():
        n, text = parts.get(r["conv_id"], (0, None))
        parts[r["conv_id"]] = (n + r["n_turns"], r["transcript"] if text is None else text + "\n" + r["transcript"])
        assert r["n_turns"] <= 2
    assert parts == whole


def test_report_inputs_are_evaluated_once(spark, monkeypatch):
    seen = []
    real = QM.reliable_checkpoint
    monkeypatch.setattr(QM, "reliable_checkpoint", lambda df: seen.append(df) or real(df))
    rows = R.run_phases(QM.report_phases(Tables(spark, SF)), spark).collect()
    assert len(seen) == 2 and not [r for r in rows if r["metric"] == "error"]
    assert len({r["section"] for r in rows}) == 6


def test_costs_are_scanned_once_for_the_kpis(spark):
    t = Tables(spark, SF)
    plan = QM._kpis(t)._jdf.queryExecution().executedPlan().toString()
    once = R.cost_breakdown(QM._costs(t))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == once.count("FileScan")


def test_samples_need_a_stated_number(spark):
    df = spark.range(10).selectExpr("id", "cast(id as string) as sample")
    assert [r["sample"] for r in R.samples(df, "queries", ("id",)).collect()] == ["0", "1"]
    with pytest.raises(ValueError):
        R.samples(df, "other", ("id",))
