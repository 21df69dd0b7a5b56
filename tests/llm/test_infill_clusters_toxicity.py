"""op11 to op13 against brute force, exact round trips and held-out accuracy."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import infill, jobs, orchard, toxicity
from pagewright.llm import words as W
from pagewright.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


# -- op11 --------------------------------------------------------------------
def brute_nearest(x, c):
    d = ((x[:, None, :].astype(object) - c[None, :, :].astype(object)) ** 2).sum(2)
    at = np.array([min(range(len(c)), key=lambda j: (row[j], j)) for row in d])
    return at, np.array([int(row[j]) for row, j in zip(d, at)])


@pytest.mark.parametrize("spread,bound", [(40, 300), (1, 4), (3, 1 << 26)])
def test_orchard_search_equals_brute_force(spread, bound):
    rng = np.random.default_rng(spread)
    c = rng.integers(-bound, bound, (37, 6))
    c[5], c[9] = c[3], c[3]  # equal centroids: the smaller number wins
    x = np.concatenate([c[rng.integers(0, 37, 1500)] + rng.integers(-spread, spread + 1, (1500, 6)), rng.integers(-bound, bound, (900, 6)), c])
    x = np.clip(x, -bound, bound)
    search = orchard.Orchard(c)
    at, d = search.nearest(x)
    want_at, want_d = brute_nearest(x, c)
    assert (at == want_at).all() and (d == want_d).all()


def test_orchard_lists_spare_distances():
    rng = np.random.default_rng(1)
    c = rng.integers(-100000, 100000, (200, 8))
    x = c[rng.integers(0, 200, 5000)] + rng.integers(-200, 200, (5000, 8))
    search = orchard.Orchard(c)
    search.nearest(x)
    assert search.measured < 0.5 * len(x) * len(c)


def brute_clusters(rows, k, rounds, dim):
    good = [(i, [int(np.floor(256 * float(v))) for v in e]) for i, e in rows if e is not None and len(e) == dim and all(v is not None and np.isfinite(v) for v in e)]
    by = sorted(good, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in by[:k]]
    for r in range(rounds + 1):
        to = [min(range(len(c)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, c[j])), j)) for _, v in good]
        if r < rounds:
            for j in range(len(c)):
                own = [v for (_, v), t in zip(good, to) if t == j]
                if own:
                    c[j] = [sum(col) // len(own) for col in zip(*own)]
    d = [sum((a - b) ** 2 for a, b in zip(v, c[t])) for (_, v), t in zip(good, to)]
    return sorted((i if i is not None else -1, t, x, sum(y for y, u in zip(d, to) if u == t), sum(d), hashlib.sha256(",".join(map(str, c[t])).encode()).hexdigest())
                  for (i, _), t, x in zip(good, to, d))


def test_clusters_equal_brute_force_and_defined_cases(spark):
    jobs.prepare(spark)
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 4)]) for i in range(90)]
    rows += [(200, None), (201, [1.0]), (202, [1.0, None, 0.0, 0.0]), (203, [1.0, float("nan"), 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0, 0.0]),
             (None, [0.5, 0.5, -0.5, 0.25]), (7, rows[7][1]), (7, rows[7][1]), (205, [-0.001, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("key", F.lit(1)).repartition(5)
    got, centroids = orchard.cluster(df, dim=4, k=9, rounds=3)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect()) == brute_clusters(rows, 9, 3, 4)
    few, c = orchard.cluster(df.filter("vec_id < 3"), dim=4, k=9, rounds=2)
    assert few.count() == 3 and len(c) == 3 and few.agg(F.sum("distance")).first()[0] == 0
    none, c = orchard.cluster(df.filter("vec_id = 200"), dim=4, k=9)
    assert none.count() == 0 and len(c) == 0
    far, _ = orchard.cluster(spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>"), dim=2, k=1, rounds=1)
    assert far.count() == 2 and far.agg(F.min("distance")).first()[0] > 0


def test_cluster_results_do_not_depend_on_partitions(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    a, b = (sorted(map(tuple, orchard.cluster(e.repartition(n))[0].collect())) for n in (1, 7))
    assert a == b and len(a) == e.filter(orchard.usable("embedding", 64)).count()


# -- op12 --------------------------------------------------------------------
HARD = ["", None, "a", "ab cd", "é", "日本語 text 12", "x" * 3000, "a1" * 700, "tail <P> here", "<S>", "<", "<P", "a<M", "\n\n \t", "á́b", "😀😀 ok", "<p> no mark",
        " ".join(f"word{i} é{i}," for i in range(4000)), "\x00 null byte", "plain words and, marks! 12"]


def test_skip_list_reaches_every_rank():
    texts = [t or "" for t in HARD] + ["", ""]
    for w_raw, at in [W.text_buffers(pa.array(texts))]:
        lists = infill.SkipList(w_raw, at)
    for i, t in enumerate(texts):
        units = UNIT.findall(t)
        assert lists.counts[i] == len(units)
        ranks = np.arange(len(units) + 1) if len(units) < 400 else np.unique(np.random.default_rng(i).integers(0, len(units) + 1, 300))
        chars, size, steps = lists.descend(np.full(len(ranks), i), ranks)
        want = np.concatenate([[0], np.cumsum([len(u) for u in units])])[ranks]
        assert (chars == want).all()
        assert (size == [len("".join(units[:r]).encode()) for r in ranks]).all()
        assert steps.max(initial=0) <= 12 * (np.log2(len(units) + 2) + 1)  # lanes, not a walk over the units
    with pytest.raises(ValueError):
        lists.descend(np.array([2]), np.array([2]))


def brute_infill(doc_id, text, seed="1"):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_brute_force_and_restores(spark):
    jobs.prepare(spark)
    rows = [(i * 17 + j, t) for j in range(6) for i, t in enumerate(HARD)] + [(None, "no id at all"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(0)).withColumn("form", F.lit("x")).withColumn("n", F.lit("y")).repartition(3)
    got = infill.transform(df).withColumn("back", infill.restored(F.col("form"), F.col("output"))).collect()
    want = sorted((repr((d, *brute_infill(d, t), t or "")) for d, t in rows))
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back)) for r in got) == want
    assert {"plain", "psm", "spm"} == {r.form for r in got}
    assert infill.transform(df.filter("doc_id < 0")).count() == 0


def test_infill_of_a_long_text_in_one_slice(spark):
    text = " ".join(f"w{i} ü{i}" for i in range(200000))
    assert len(text.encode()) > W.SLICE_BYTES
    r = infill.transform(spark.createDataFrame([(4, text), (5, "short one")], "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()
    assert [tuple(x)[1:] for x in r] == [brute_infill(4, text), brute_infill(5, "short one")]


def test_infill_parts_join_to_the_text(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    c = infill.cuts(d, seed="other", plain_share=0, spm_share=50)
    assert c.filter("form <> 'plain' and concat(prefix, middle, suffix) <> text").count() == 0
    assert c.filter("form = 'plain'").count() == d.filter("coalesce(text, '') = ''").count() and {r.form for r in c.select("form").distinct().collect()} >= {"psm", "spm"}


# -- op13 --------------------------------------------------------------------
def lexicon_of(text, learned=None):
    w = next(W.words_of(pa.array([text]), lower=False))
    x = learned or toxicity.Lexicon()
    return dict(zip(toxicity.FEATURES, toxicity.features_of(w, x)[0]))


def test_toxicity_features_read_words_and_disguises():
    f = lexicon_of("You are an IDIOT, truly; id1ot! st*pid w0rthless, m o r o n and stuuuupid. fine words here")
    n = len("You are an IDIOT, truly; id1ot! st*pid w0rthless, m o r o n and stuuuupid. fine words here".split())
    assert f["insults"] == pytest.approx(1 / n) and f["disguised"] == pytest.approx(4 / n)  # id1ot, w0rthless, m o r o n, stuuuupid
    assert f["second"] == pytest.approx(1 / n) and f["near_second"] == pytest.approx(2 / n)  # IDIOT and id1ot stand within five words of You
    assert f["capital_words"] == pytest.approx(1 / n) and f["capital_hits"] > 0
    calm = lexicon_of("the report has 12 pages, 3 tables and a summary of costs.")
    assert calm["insults"] == calm["disguised"] == calm["threats"] == calm["near_second"] == 0
    blank = lexicon_of("")
    assert blank["blank"] == 1 and np.isfinite(list(blank.values())).all()


def test_word_keys_are_beginnings_of_the_core():
    w = next(W.words_of(pa.array(["«Große!» grossen -- ... 12"]), lower=False))
    c = toxicity.cores_of(w)
    assert [c.data[a:b].tobytes().decode() for a, b in zip(c.starts, c.ends)][1:] == ["grossen", "--", "...", "12"]
    k = toxicity.word_keys(c)
    assert c.keys[1] == toxicity.key_of("grossen") and (k[1, 1:] != 0).sum() == 3  # 4, 5 and 6 of its 7 bytes


def test_trees_learn_and_isotonic_rises():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (3000, 5)).astype(np.float32)
    p = 1 / (1 + np.exp(-(3 * ((x[:, 0] > 0.2) & (x[:, 1] < 0.5)) - 2 + x[:, 2])))
    y = (rng.random(3000) < p).astype(float)
    t, knots = toxicity.fit_rows(x[:2000], y[:2000], np.arange(2000) % 3, np.ones(2000))
    raw = t.raw(x[2000:])
    q = np.interp(raw, *knots)
    assert (np.diff(knots[1]) >= 0).all() and abs(q.mean() - p[2000:].mean()) < 0.05 and np.corrcoef(q, p[2000:])[0, 1] > 0.85


def test_isotonic_is_the_nearest_rising_fit():
    rng = np.random.default_rng(3)
    for _ in range(20):
        s, y, w = rng.integers(0, 8, 30).astype(float), rng.integers(0, 2, 30).astype(float), rng.random(30) + 0.1
        at, fit = toxicity.isotonic(s, y, w)
        got = np.interp(s, at, fit)
        # max-min formula of isotonic regression
        u = np.unique(s)
        mean = lambda a, b: np.average(y[(s >= a) & (s <= b)], weights=w[(s >= a) & (s <= b)])
        want = {v: max(min(mean(a, b) for b in u if b >= v) for a in u if a <= v) for v in u}
        assert np.allclose(got, [want[v] for v in s])


def test_toxicity_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    s = QUERIES["op13_boosted_toxicity"](spark, "/root/testdata/sf0.01")
    assert s.count() == docs.count() and s.filter("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    r = s.join(labels, "doc_id").filter("held_out").collect()
    y, z = np.array([x.toxic for x in r]), np.array([x.score for x in r])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in z[y == 1] for b in z[y == 0]])
    assert ((z >= 0.5) == y).mean() > 0.93 and auc > 0.97


def test_toxicity_learns_words_of_the_labels_and_defined_cases(spark):
    jobs.prepare(spark)
    rng = np.random.default_rng(5)
    vocabulary = [f"neutral{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(600):
        text = list(rng.choice(vocabulary, 60))
        bad = i % 4 == 0
        if bad:
            for j in rng.integers(0, 60, 4):
                text[j] = f"zorgul{rng.integers(0, 500)}"  # one beginning, ever new words
        rows.append((i, " ".join(text)))
        marks.append((i, int(bad)))
    odd = [(9001, None), (9002, ""), (9003, " \n"), (None, "zorgul1 zorgul2 zorgul3"), (9004, "zorgul7 " * 40000), (1, rows[1][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("y", F.lit("a")).withColumn("fold", F.lit(None).cast("int")).withColumn("toxic", F.lit(1)).repartition(4)
    labels = spark.createDataFrame(marks + [(None, 1), (5, None), (1, 0), (77777, 1)], "doc_id long, toxic int").withColumn("text", F.lit("idiot"))
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    held = [(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 600 and toxicity_held(r.doc_id)]
    assert len(held) > 80 and np.mean(held) > 0.97
    by = {r.doc_id: r.score for r in got if r.doc_id is None or r.doc_id > 9000}
    assert by[9004] > 0.5 and by[9001] == by[9002] and by[None] > 0.5 and by[9001] < 0.5
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.filter("toxic = 0"))).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.filter("toxic = 9"))).collect()} == {0.0}
    assert toxicity.score(docs.filter("doc_id < 0"), model).count() == 0
    assert toxicity.fit(docs.filter("doc_id < 0"), labels).trees is None


def toxicity_held(doc_id):
    import zlib
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_scores_do_not_use_other_columns(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    a = sorted(map(tuple, toxicity.score(docs, toxicity.fit(docs, labels)).collect()))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.reverse("source")).repartition(3)
    b = sorted(map(tuple, toxicity.score(other, toxicity.fit(other, labels)).collect()))
    assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1] for x in a], [x[1] for x in b], atol=1e-6)


@pytest.mark.parametrize("name", ["op11_orchard_clusters", "op12_skip_list_infill"])
def test_new_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


# -- op10 and op2: what changed this round ---------------------------------------
def test_every_labelled_language_is_learned(spark):
    """70 languages of invented syllables, with fewer rows for the later ones."""
    from pagewright.llm import langid

    rng = np.random.default_rng(21)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rows = []
    for k in range(70):
        syllables = ["".join(rng.choice(letters, 3)) for _ in range(12)]
        word = lambda: "".join(rng.choice(syllables, int(rng.integers(1, 4))))  # noqa: B023, E731
        for _ in range(24 - k // 5):
            rows.append((len(rows), " ".join(word() for _ in range(40)), f"l{k:02d}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(df)
    assert len(model.langs) == 70
    got = langid.identify(df, model).filter(langid.is_held_out()).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95 and len({r.lang_pred for r in got}) >= 65


def test_buckets_shrink_with_the_languages():
    from pagewright.llm import langid

    assert langid.buckets_for(4) == langid.buckets_for(70) == langid.BUCKETS
    for n in (200, 1000, 8000):
        assert langid.buckets_for(n) * n <= max(langid.WEIGHTS, n << 12) and langid.buckets_for(n) & (langid.buckets_for(n) - 1) == 0


def test_parts_of_a_slice_do_not_change_the_labels(spark, monkeypatch):
    from pagewright.llm import langid

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    w = next(W.words_of(pa.array([r.text for r in docs.limit(60).collect()])))
    whole = langid.Labeller(model).words(w)
    monkeypatch.setattr(langid, "CELLS", len(model.langs) ** 2)
    assert np.allclose(langid.Labeller(model).words(w), whole, atol=1e-5)


def test_loss_text_comes_from_the_example_spans(spark):
    from pagewright.llm import chat

    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b <| c"), (1, 2, "assistant", "d"), (2, 0, "user", "only")]
    parts = chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(parts).collect()}
    assert (got[1].n_examples, got[2].n_examples) == (2, 0) and got[2].loss_chars == 0
    targets = [r.target for r in chat.examples(parts).orderBy("prompt_end").collect()]
    assert targets == ["b <\\| c", "d"] and got[1].loss_sha256 == hashlib.sha256(b"b <| cd").hexdigest()


# -- op9: markup that misled it ---------------------------------------------------
def test_teasers_are_no_article_and_an_article_keeps_its_header():
    from pagewright.llm import pages

    teaser = '<p>The real text of the page stands here in the body.</p><article class="related-post"><p>Read also this one</p></article>'
    assert pages.main_texts([teaser], [0]) == ["The real text of the page stands here in the body."]
    own = ('<header><p>Site name</p></header><article><header><h1>Title</h1><p>The lead of the article.</p><nav><p>menu</p></nav></header><p>Its body.</p>'
           '<footer><p>Tags</p></footer></article><header>again</header>')
    assert pages.main_texts([own], [0]) == ["Title\n\nThe lead of the article.\n\nIts body."]
    both = '<div class="sidebar"><article><p>teaser text</p></article></div><article class="post"><p>Body text.</p><section class="comments"><article><p>A reader says</p></article></section></article>'
    assert pages.main_texts([both], [0]) == ["Body text."]
    assert pages.main_texts(['<article class="post has-sidebar comments-open"><p>Kept.</p></article>'], [0]) == ["Kept."]
