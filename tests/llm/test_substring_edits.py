"""op5 on edited passages, fragments, crowded seeds, and its parts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import jobs, substring
from pagewright.llm import words as W


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    jobs.prepare(spark)


def fill(rng, n):
    return [f"w{rng.integers(1 << 40)}" for _ in range(n)]


def edited(rng, words, every):
    return [f"e{rng.integers(1 << 40)}" if i % every == every - 1 else w for i, w in enumerate(words)]


def covered(spark, rows):
    out = {}
    for r in substring.passages(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(3)).collect():
        assert r.owner_id < r.doc_id and r.end_word - r.start_word >= 50 and r.similarity >= 0.8
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def test_edited_repeats_are_found(spark):
    """Passages of 60 and 100 words with every 10th, 8th and 6th word changed
    (90, 88, 83 % equal), 60 of each, unique words around them."""
    rng = np.random.default_rng(11)
    rows, cases, n = [], [], 0
    for size in (60, 100):
        for every in (10, 8, 6):
            for _ in range(60):
                a = fill(rng, size)
                before = int(rng.integers(5, 60))
                rows += [(n, fill(rng, 40) + a + fill(rng, 40)), (n + 1, fill(rng, before) + edited(rng, a, every) + fill(rng, 50))]
                cases.append((size, every, n + 1, before))
                n += 2
    found = covered(spark, rows)
    recall = {}
    for size, every, doc, before in cases:
        hit = len(found.get(doc, set()) & set(range(before, before + size))) >= 0.8 * size
        recall.setdefault((size, every), []).append(hit)
        assert not found.get(doc, set()) - set(range(before - 4, before + size + 4))  # nothing but the passage
    rates = {k: float(np.mean(v)) for k, v in recall.items()}
    assert min(rates.values()) >= 0.9 and np.mean(list(rates.values())) >= 0.95, rates


def test_fragments_do_not_hide_an_edited_passage(spark):
    """80 words, 5 changed, whose halves stand in two smaller documents."""
    rng = np.random.default_rng(12)
    rows, wanted = [], []
    for case in range(40):
        a = fill(rng, 80)
        new = list(a)
        for i in rng.choice(80, 5, replace=False):
            new[i] = f"e{rng.integers(1 << 40)}"
        base = case * 10
        rows += [(base, fill(rng, 20) + a[:40] + fill(rng, 30)), (base + 1, fill(rng, 30) + a[40:] + fill(rng, 9)),
                 (base + 2, fill(rng, 25) + a + fill(rng, 25)), (base + 3, fill(rng, 10) + new + fill(rng, 40))]
        wanted.append(base + 3)
    found = covered(spark, rows)
    assert np.mean([len(found.get(d, set()) & set(range(10, 90))) >= 64 for d in wanted]) >= 0.9


def test_equal_runs_behind_many_fragments(spark):
    """Nine smaller documents own every seed of a 50-word run with fragments of
    49 words; the run itself stands in two documents among them."""
    rng = np.random.default_rng(13)
    a = fill(rng, 50)
    cut = lambda i: a[:49] if i % 2 else a[1:]
    rows = [(i, fill(rng, 30) + cut(i) + fill(rng, 20)) for i in range(9)]
    rows += [(50, fill(rng, 12) + a + fill(rng, 9))] + [(60 + i, fill(rng, 7) + cut(i) + fill(rng, 7)) for i in range(6)] + [(99, fill(rng, 33) + a + fill(rng, 3))]
    rows += [(200 + i, fill(rng, 60)) for i in range(20)]
    assert covered(spark, rows) == {99: set(range(33, 83))}


def test_insertions_deletions_and_moved_parts(spark):
    rng = np.random.default_rng(14)
    hits = []
    rows, n = [], 0
    for _ in range(30):
        a = fill(rng, 90)
        b = list(a)
        for i in sorted(rng.choice(np.arange(5, 85), 4, replace=False), reverse=True):
            if rng.random() < 0.5:
                del b[i]
            else:
                b.insert(i, f"n{rng.integers(1 << 40)}")
        rows += [(n, fill(rng, 20) + a + fill(rng, 20)), (n + 1, fill(rng, 15) + b + fill(rng, 20))]
        hits.append((n + 1, len(b)))
        n += 2
    found = covered(spark, rows)
    assert np.mean([len(found.get(d, set()) & set(range(15, 15 + size))) >= 0.85 * size for d, size in hits]) >= 0.9


def test_matches_grow_with_occurrences_not_pairs(spark):
    rng = np.random.default_rng(15)
    passage = fill(rng, 70)
    docs = lambda n: spark.createDataFrame([(i, " ".join(fill(rng, 10) + passage + fill(rng, 10))) for i in range(n)], "doc_id long, text string").repartition(5)
    few, many = (substring.matches(docs(n)).count() for n in (200, 800))
    assert few <= 200 * 30 * 9 and many <= 4.6 * few


def test_seeds_stand_in_every_row_of_kmers_and_depend_on_their_kmer():
    rng = np.random.default_rng(16)
    texts = [" ".join(fill(rng, n)) for n in (400, 39, 41, 1000)] + ["", None, "x " * 300, " ".join(["a b c d e"] * 60)]
    for w in W.words_of(pa.array(texts)):
        row, pos, h, sides = substring._seed_rows(w)
        for i, t in enumerate(texts):
            n = len((t or "").split())
            at = pos[row == i]
            if n < substring.LEAST_TEXT:
                assert not len(at)
            elif i != 6:
                gaps = np.diff(np.concatenate([[-1], np.sort(at), [n - substring.K + 1]]))
                assert gaps.max() <= substring.FILL
        assert len(pos[row == 6]) <= 2  # one word over and over: its first and last place
    a = fill(rng, 60)
    one, two = (next(W.words_of(pa.array([" ".join(x)]))) for x in (fill(rng, 30) + a, a + fill(rng, 30)))
    (_, p1, h1, s1), (_, p2, h2, s2) = substring._seed_rows(one), substring._seed_rows(two)
    right = lambda s: s.view(np.uint32) & np.uint32(0xFFFF)
    first = {(int(p) - 30, int(h), int(r)) for p, h, r in zip(p1, h1, right(s1)) if 30 <= p < 60}
    second = {(int(p), int(h), int(r)) for p, h, r in zip(p2, h2, right(s2)) if p < 30}
    assert first == second and len(first) > 2


def test_parts_and_held_rows_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(17)
    shared = [fill(rng, 70) for _ in range(6)]
    rows = [(i, " ".join(fill(rng, 20) + shared[i % 6] + fill(rng, 20) + (edited(rng, shared[(i + 1) % 6], 9) if i % 3 == 0 else []))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def spans():
        out = {}
        for r in substring.passages(df.repartition(7)).collect():
            out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        return out
    whole = spans()
    assert len(whole) >= 110
    w = next(W.words_of(pa.array([t for _, t in rows])))
    row, pos, h, sides = substring._seed_rows(w)
    doc = row.astype(np.int64)
    full, _ = substring._matched(h, sides, doc, pos.copy(), False)
    # matched in parts first: every document that the whole has an earlier one for still has one
    kept, met = [], set()
    for lo in range(0, 120, 40):
        part = (doc >= lo) & (doc < lo + 40)
        found, send = substring._matched(h[part], sides[part], doc[part], p := pos[part].copy(), True)
        met |= set(zip(found[1].tolist(), found[2].tolist()))
        kept.append((h[part][send], sides[part][send], doc[part][send], p[send]))
    joined, _ = substring._matched(*(np.concatenate(x) for x in zip(*kept)), False)
    met |= set(zip(joined[1].tolist(), joined[2].tolist()))
    assert met == set(zip(full[1].tolist(), full[2].tolist()))


def test_very_long_and_odd_texts(spark):
    rng = np.random.default_rng(18)
    long = fill(rng, 60000)
    passage = long[31000:31200]
    rows = [(1, " ".join(long)), (2, " ".join(fill(rng, 30) + passage)), (3, None), (4, ""), (2, " ".join(fill(rng, 500))), (None, " ".join(passage)), (5, " ".join(long[:20000]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("owner", F.lit("x")).withColumn("words", F.lit(1)).withColumn("pos", F.lit(2)).withColumn("__key", F.lit(0))
    got = {(r.doc_id, r.owner_id): (r.start_word, r.end_word, r.owner_start) for r in substring.passages(df).collect()}
    assert got[5, 1] == (0, 20000, 0) and set(got) <= {(5, 1), (2, 1)}
    assert substring.passages(df.filter("doc_id = 4")).count() == 0


def test_an_equal_run_at_a_later_place_of_its_owner_is_found(spark):
    """The owner has 45 words of a passage of 50, and further on all of it:
    seeds of equal left side meet its first place only."""
    rng = np.random.default_rng(31)
    rows, wanted = [], []
    for case in range(40):
        p = fill(rng, 50)
        rows += [(2 * case, fill(rng, 20) + p[:45] + fill(rng, 30) + p + fill(rng, 20)), (2 * case + 1, fill(rng, 25) + p + fill(rng, 25))]
        wanted.append(2 * case + 1)
    found = covered(spark, rows)
    missed = [d for d in wanted if not set(range(25, 75)) <= found.get(d, set())]
    assert not missed


def test_an_equal_run_at_a_late_place_among_several_is_found(spark):
    """Five fragments of a passage stand in the owner before all of it."""
    rng = np.random.default_rng(32)
    rows, wanted = [], []
    for case in range(20):
        p = fill(rng, 54)
        parts = [w for lo, hi in ((0, 45), (9, 54), (4, 50), (5, 49), (2, 47)) for w in p[lo:hi] + fill(rng, 20)]
        rows += [(2 * case, parts + p + fill(rng, 20)), (2 * case + 1, fill(rng, 25) + p + fill(rng, 25))]
        wanted.append(2 * case + 1)
    found = covered(spark, rows)
    missed = [d for d in wanted if not set(range(25, 79)) <= found.get(d, set())]
    assert not missed


def test_passages_of_one_pair_inside_another_leave_once(spark):
    """Rows of the same pair inside another one go before they travel; those of other pairs stay."""
    rows = [(7, 0, 100, 1, 0, 100, 0.9), (7, 10, 90, 1, 10, 90, 1.0), (7, 10, 90, 2, 10, 90, 1.0), (8, 10, 90, 1, 10, 90, 1.0), (7, 0, 100, 1, 0, 100, 0.9)]
    got = substring._outermost(substring._batch(rows), ["doc_id", "owner_id"]).to_pylist()
    assert [(r["doc_id"], r["owner_id"], r["start_word"], r["end_word"]) for r in got] == [(7, 1, 0, 100), (7, 2, 10, 90), (8, 1, 10, 90)]


def test_text_of_a_short_period_gives_few_passages_of_all_its_words(spark):
    rng = np.random.default_rng(21)
    line = ["go", "on."] * 300
    rows = [(1, fill(rng, 40) + line + fill(rng, 40)), (2, fill(rng, 61) + line + fill(rng, 40)), (3, fill(rng, 90) + line[:150])]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    found = substring._chain_passages(docs, substring.matches(docs)).collect()
    for doc, owner, lo, hi in ((2, 1, 61, 661), (3, 1, 90, 240)):
        mine = [r for r in found if (r.doc_id, r.owner_id) == (doc, owner)]
        assert set(range(lo, hi)) <= {w for r in mine for w in range(r.start_word, r.end_word)}
        assert len(mine) <= 2 * (hi - lo) // 50, len(mine)


def test_needed_passages_keep_every_word_of_both_texts():
    rng = np.random.default_rng(22)
    rows = []
    for _ in range(400):
        a, b, n = (int(rng.integers(x, y)) for x, y in ((0, 300), (0, 60), (50, 130)))
        rows.append((int(rng.integers(0, 9)), a, a + n, int(rng.integers(0, 3)), b, b + n, 1.0 - int(rng.integers(0, 3)) / 10))
    whole = substring._batch(rows)
    kept = substring._needed(whole).to_pylist()
    words = lambda rs: {(side, r["doc_id"], r["owner_id"], w) for r in rs for side, lo, hi in ((0, "start_word", "end_word"), (1, "owner_start", "owner_end")) for w in range(r[lo], r[hi])}
    assert words(kept) == words(whole.to_pylist()) and len(kept) < 350
    apart = substring._batch([(1, 0, 100, 0, 0, 100, 1.0), (1, 50, 150, 0, 200, 300, 1.0), (1, 100, 200, 0, 400, 500, 1.0)])
    assert substring._needed(apart).num_rows == 3  # its own words of the owner
