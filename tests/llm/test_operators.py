"""Each operator against a brute-force version, and its defined cases."""

import hashlib
import html
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import chat, decontam, jobs, langid, linerules, neardup, packing, pages, quality, sharding, substring
from pagewright.llm import words as W
from pagewright.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
CLASH = ("h string, n int, v int, rep int, component int, bucket int, score string, kept int, block int, place int, group int, number int, size int, "
         "pos int, owner int, id int, slots int, host int, chunk int, x int, kind int, cut_spans int")


def with_clashes(df):
    """The same rows with extra columns of names that operators use inside."""
    out = df
    for c in CLASH.split(","):
        name, kind = c.split()
        if name not in df.columns:
            out = out.selectExpr("*", f"cast(null as {kind}) as `{name}`")
    return out


@pytest.fixture(scope="module")
def odd_docs(spark):
    jobs.prepare(spark)
    long_text = " ".join(f"word{i % 977} other{i % 13}" for i in range(30000))
    words = [f"w{i}" for i in range(120)]
    rows = [(1, None, None, "s", None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "one", "en", None, 3), (5, "Two words", "de", "s", 9),
            (6, long_text, "en", "s", len(long_text)), (7, long_text, "en", "s", len(long_text)), (8, " ".join(words), "fr", "s", 1),
            (9, " ".join(["x"] * 5 + words), "fr", "s", 1), (10, "two WORDS", "de", "s", 9), (11, "12 34 !!", "en", "s", 8),
            (8, " ".join(words), "fr", "s", 1), (None, "a row without an id " * 12, "en", "s", 1)]
    return with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.fixture(scope="module")
def no_docs(odd_docs):
    return odd_docs.filter("doc_id < 0")


@pytest.fixture(scope="module")
def docs(spark):
    jobs.prepare(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


def word_list(text):
    return (text or "").encode().lower().split()


def test_word_arrays_are_the_words():
    texts = ["", None, "a b", "  lead", "trail \n", "é\tÉ x", "x" * 5000, "a", "b", " ", "no blank"]
    got = [w for w in W.words_of(pa.array(texts), lower=False)]
    flat = [[w.data[a:b].tobytes() for a, b in zip(w.starts[w.bounds[i]:w.bounds[i + 1]], w.ends[w.bounds[i]:w.bounds[i + 1]])] for w in got for i in range(w.n_texts)]
    assert flat == [(t or "").encode().split() for t in texts]
    h = {}
    for w in W.words_of(pa.array([" ".join(map(str, range(20000)))])):
        for a, b, x in zip(w.starts, w.ends, w.hashes):
            h[w.data[a:b].tobytes()] = x
    assert len(set(h.values())) == 20000


# -- op4 ---------------------------------------------------------------------

def brute_classes(rows, k, num, den):
    sets = []
    for _, t in rows:
        b = word_list(t)
        sets.append({tuple(b[i:i + k]) for i in range(len(b) - k + 1)} if len(b) >= k else ({tuple(b)} if b else set()))
    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inverted[x].append(i)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in inverted[x] if j < i).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(docs, k, num):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, k, num, 100).collect()}
    assert got == brute_classes(rows, k, num, 100)


def test_near_duplicates_of_edited_families(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for family in range(4):  # edited copies around the threshold: chains, bridges, a common line
        base = [f"f{family}w{i}" for i in range(150)]
        for _ in range(40):
            t = list(base)
            for at in rng.choice(150, rng.integers(0, 7), replace=False):
                t[at] = f"e{rng.integers(1 << 30)}"
            rows.append((n, " ".join(t + ["one", "very", "common", "line"])))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 3, 85, 100).collect()}
    assert got == brute_classes(rows, 3, 85, 100)


def test_near_duplicates_cases(odd_docs, no_docs):
    got = defaultdict(set)
    rows = neardup.near_duplicates(odd_docs, 3, 85, 100).collect()
    for r in rows:
        got[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert len(rows) == odd_docs.count()
    assert got[1] == {(0, 1, True)} and got[2] == {(0, 2, True)} and got[4] == {(1, 4, True)}
    assert got[5] == {(1, 5, True)} and got[10] == {(1, 5, False)} and {x[1] for x in got[7]} == {6}
    assert {x[1] for x in got[9]} == {8}
    assert neardup.near_duplicates(no_docs).count() == 0


def test_keep_one_keeps_one_of_each_class(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {d for d, (_, c) in brute_classes(rows, 5, 80, 100).items() if d == c}
    kept = neardup.keep_one(docs)
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    got = {r.id: r.component for r in jobs.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 500 for i in range(500, 540)}}


# -- op5 ---------------------------------------------------------------------

def test_every_repeated_run_of_over_fifty_words_is_found(docs):
    rows = sorted((r.doc_id, word_list(r.text)) for r in docs.collect())
    found = defaultdict(set)
    for r in substring.passages(docs).collect():
        assert r.owner_id < r.doc_id and r.similarity >= 0.8 and r.end_word - r.start_word >= 50
        found[r.doc_id].update(range(r.start_word, r.end_word))
    earlier = set()
    for d, w in rows:
        runs = {tuple(w[i:i + 51]): i for i in range(len(w) - 50)}
        for run, i in runs.items():
            if run in earlier:
                assert set(range(i + 2, i + 49)) <= found[d], (d, i)
        earlier |= set(runs)


def test_fuzzy_passage_with_gaps_and_a_far_second_one(spark):
    rng = np.random.default_rng(1)
    word = lambda: f"w{rng.integers(1 << 40)}"
    a, b = [word() for _ in range(90)], [word() for _ in range(70)]
    fill = lambda n: [word() for _ in range(n)]
    edited = a[:30] + ["new"] + a[30:60] + a[62:]
    rows = [(1, " ".join(fill(40) + a + fill(400) + b + fill(10))), (2, " ".join(fill(5) + edited + fill(30) + b + fill(60))), (3, " ".join(fill(300)))]
    got = substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = sorted((r.doc_id, r.start_word, r.end_word) for r in got)
    assert {d for d, _, _ in spans} == {2}
    covered = set(itertools.chain.from_iterable(range(x, y) for _, x, y in spans))
    assert set(range(5, 5 + len(edited))) <= covered and set(range(5 + len(edited) + 30, 5 + len(edited) + 100)) <= covered
    assert len(covered) <= len(edited) + 70 + 12


def test_equal_passage_whose_seeds_smaller_fragments_own(spark):
    rng = np.random.default_rng(3)
    fill = lambda n: [f"w{rng.integers(1 << 40)}" for _ in range(n)]
    a, b = fill(55), fill(50)
    rows = [(5, fill(9) + a[:45] + fill(20)), (6, fill(30) + b[:30] + fill(9)), (7, fill(3) + b[25:] + fill(30)), (100, fill(20) + a + fill(40) + b),
            (200, a + fill(70) + b + fill(5)), (300, fill(4) + a[8:] + fill(60))]
    got = substring.passages(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect()
    spans = {(r.doc_id, r.start_word, r.end_word, r.owner_id, r.owner_start) for r in got}
    assert spans == {(200, 0, 55, 100, 20), (200, 125, 175, 100, 115)}


def test_chains_are_optimal_on_small_inputs():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 7))
        a, b, size = (rng.integers(0, 60, n).tolist(), rng.integers(0, 60, n).tolist(), rng.integers(3, 30, n).tolist())
        order = sorted(range(n), key=lambda i: a[i])
        a, b, size = ([x[i] for i in order] for x in (a, b, size))

        def worth(path):
            total = size[path[0]]
            for i, j in zip(path, path[1:]):
                if a[i] + size[i] > a[j] or b[i] + size[i] > b[j]:
                    return None
                total += size[j] - substring.GAP_COST * (a[j] - a[i] - size[i] + b[j] - b[i] - size[i])
            return total
        best = max(w for r in range(1, n + 1) for p in itertools.combinations(range(n), r) if (w := worth(p)) is not None)
        assert max(worth(p) for p in substring.chains(a, b, size)) == pytest.approx(best)


def test_passages_cases_and_cutting(odd_docs, no_docs):
    found = substring.passages(odd_docs).collect()
    assert {(r.doc_id, r.owner_id) for r in found} == {(7, 6), (9, 8)}
    left = substring.without_passages(odd_docs, substring.passages(odd_docs))
    texts = defaultdict(set)
    for r in left.collect():
        texts[r.doc_id].add(r.text)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count()
    assert texts[1] == {None} and texts[2] == {""} and texts[7] == {""} and texts[9] == {"x x x x x"}
    assert substring.passages(no_docs).count() == 0


# -- op3 ---------------------------------------------------------------------

def test_packing_round_trip(docs, odd_docs, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    for table in (docs, odd_docs):
        texts = defaultdict(list)
        for r in table.collect():
            texts[r.doc_id].append(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1])
        pieces = packing.pack(table, tokenizer_path()).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for p in pieces:
            by_doc[p.doc_id].append(p)
            by_sequence[p.sequence_id].append(p)
        assert set(by_doc) == set(texts)
        for d, ps in by_doc.items():
            ids = texts[d][0]
            assert sum(p.length for p in ps) == len(ids) * len(texts[d])
            for p in ps:
                part = np.array(ids[p.start:p.start + p.length], "<u4").tobytes()
                assert p.ids_crc32 == zlib.crc32(part) and p.doc_tokens == len(ids)
        for ps in by_sequence.values():
            at = 0
            for p in sorted(ps, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= 2048
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


def test_chunk_tokens_equal_the_tokenizer():
    tokens = packing.ChunkTokens(tokenizer_path())
    rng = np.random.default_rng(1)
    letters = [" ", "\n", "a", "bc", ".", "'s", "1", " ", "　", "\x1c", "é", "  ", "\t", "!", " ", "\x85", "<|endoftext|>"]
    texts = ["", None, *("".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(5000))]
    for text, ids in zip(texts, tokens.ids(pa.array(texts))):
        assert ids.tolist() == tokens.tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_sum_of_squares_takes_the_least_sum():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes = rng.integers(1, 16, 40).tolist()
        numbers, offsets = packing.sum_of_squares(sizes, 16)
        fill, open_at = {}, Counter()
        for s, n, o in zip(sizes, numbers, offsets):
            assert fill.get(n, 0) == o and o + s <= 16
            cost = {}
            for level in [0, *open_at]:
                if level + s <= 16 and (level == 0 or open_at[level]):
                    c = Counter(open_at)
                    c[level] -= level > 0
                    c[level + s] += level + s < 16
                    cost[level] = sum(v * v for v in c.values())
            assert cost[o] == min(cost.values())
            if o:
                open_at[o] -= 1
            if o + s < 16:
                open_at[o + s] += 1
            fill[n] = o + s


# -- op7 ---------------------------------------------------------------------

def test_decontamination_finds_exact_and_reparameterised_items(spark, no_docs):
    items = [(1, "Every morning at the old market Anna buys 12 apples and sells them for 30 dollars each to people who pass by the bridge."),
             (2, "too short"), (3, None), (4, "alpha beta gamma delta epsilon zeta")]
    pad = "some other words that are not of the item stand here "
    docs = [(10, pad + items[0][1] + " " + pad), (11, pad + items[0][1].replace("Anna", "Peter").replace("12", "7").replace("30", "55").replace("dollars", "euros")),
            (12, pad * 5), (13, None), (14, "so ALPHA, beta GAMMA delta epsilon zeta!"), (15, "Every morning at the old market people meet."),
            (16, items[0][1].upper())]
    cols = "doc_id long, text string"
    found = decontam.findings(spark.createDataFrame(docs, cols), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.kind, r.changed_slots) for r in found.collect()}
    assert got[10, 1] == ("exact", 0) and got[11, 1] == ("reparameterised", 4) and got[14, 4] == ("exact", 0)
    assert set(got) <= {(10, 1), (11, 1), (14, 4), (16, 1)}
    shuffled = decontam.findings(spark.createDataFrame(docs, cols), spark.createDataFrame(items, "item_id long, text string"), most_sent=0)
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, found.collect()))
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.findings(no_docs, empty).count() == 0 and decontam.findings(spark.createDataFrame(docs, cols), empty).count() == 0


def test_inconsistent_slots_are_no_copy(spark):
    item = "the price of 5 pens is 5 coins and the price of 5 books is 5 coins in this shop today"
    same, other = item.replace("5", "8"), item.replace("5", "8", 2)
    docs = spark.createDataFrame([(1, same), (2, other)], "doc_id long, text string")
    got = {r.doc_id for r in decontam.findings(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1}


def test_values_with_another_number_of_words(spark):
    item = "Every morning at the old market Anna buys 30 apples and sells them to people near the bridge when Peter has 12 pears left"
    pieces = "we know that blue house stands near the wide river so they often walk along its quiet bank and talk about old days"
    other = pieces.replace("house", "garden house").replace("walk along", "walk slowly along")
    docs = [(1, "so " + item.replace("Anna", "Mary Ann").replace("30", "thirty five").replace("Peter", "John Paul Smith")), (2, "so " + other), (3, "so " + " ".join(item.split()[:7]))]
    found = decontam.findings(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, pieces)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.kind) for r in found.collect()} == {(1, 1, "reparameterised"), (2, 2, "exact")}


def test_copies_that_templates_miss(spark):
    items = [(1, "What is 12 times 7 plus 3 minus 4?"), (2, "3 plus 4 is what?"), (3, "Where does our neighbour Anna Miller from Paris meet Peter Brown from London at noon"),
             (4, "she had 12 apples and 30 dollars before they all went to the big market in town")]
    docs = [(1, "Tell me. What is 12 times 7 plus 3 minus 4? Well."), (2, "so 3 plus 4 is what, please"), (3, "so " + items[2][1].lower()), (4, items[3][1].replace("12", "7").replace("30", "7")),
            (5, "What is 12 times 7 plus 3 minus 5?")]
    found = decontam.findings(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.kind) for r in found.collect()} == {(1, 1, "exact"), (2, 2, "exact"), (3, 3, "exact"), (4, 4, "reparameterised")}


def test_every_benchmark_item_in_a_document_is_found(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    bodies = [(r.item_id, plain(r.text)) for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, b in bodies if f" {b} " in f" {plain(r.text)} "}
    got = {(r.doc_id, r.item_id) for r in decontam.findings(docs, items).collect()}
    assert want <= got
    left = {r.doc_id for r in decontam.without_contaminated(docs, items).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


# -- op6, op1, op10 ------------------------------------------------------------

def test_line_rules_cases(odd_docs, no_docs):
    got = {r.doc_id: r for r in linerules.evaluate(odd_docs).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[8].n_words == 120 and not got[8].base_failed
    assert got[11].n_words == 3 and got[6].n_words == 60000
    assert linerules.evaluate(no_docs).count() == 0


def test_line_rules_remove_failing_lines(spark):
    good = "A line of prose with some words in it ends here.\n" * 1 + "\n".join(f"Line{i} says{i} something{i} of{i} its{i} own{i} here{i}." for i in range(16))
    text = good + "\nHome | News | Sport | Contact\nWIN BIG CASH PRIZES NOW!!\nnoise### more$$$ of%%% it***\nPlease read our privacy policy first.\nLine3 says3 something3 of3 its3 own3 here3."
    got = linerules.clean(spark.createDataFrame([(1, text), (2, "a | b | c\n" * 30)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].text.rstrip("\n") == good and got[0].kept and not got[1].kept


def test_quality_scores_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.filter(quality.is_held_out()).collect()}
    got = [(truth[r.doc_id], r.score >= 0.3) for r in quality.score(docs, model).collect() if r.doc_id in truth]
    assert np.mean([y == p for y, p in got]) > 0.93


def test_quality_cases(odd_docs, no_docs):
    labels = odd_docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "0 as toxic")
    scores = quality.score(odd_docs, quality.fit(odd_docs, labels)).collect()
    assert len(scores) == odd_docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert quality.score(no_docs, quality.fit(no_docs, labels.filter("doc_id < 0"))).count() == 0


def test_non_negative_risk_separates_shifted_features():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (3000, 4)), rng.normal(-1.5, 1, (3000, 4))
    unlabelled = np.concatenate([good[:1400], bad[:600]])
    model = quality.train(good[1400:], unlabelled, 0.7)
    assert (model.scores(good) >= 0.5).mean() > 0.93 and (model.scores(bad) < 0.5).mean() > 0.93


def test_forward_backward_equals_enumeration(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 3)
    rng = np.random.default_rng(0)
    sizes = [0, 1, 5, 7, 0, 3, 4]
    bounds, n = np.concatenate([[0], np.cumsum(sizes)]), 3
    scores, moves, start = (rng.normal(size=s).astype(np.float32) for s in ((bounds[-1], n), (n, n), n))
    pairs = np.zeros((n, n))
    got = langid.marginals(scores, bounds, moves, start, pairs)
    want, want_pairs = np.zeros_like(got), np.zeros((n, n))
    for i, size in enumerate(sizes):
        total, own, own_pairs = 0, np.zeros((size, n)), np.zeros((n, n))
        for path in itertools.product(range(n), repeat=size) if size else ():
            p = np.exp(start[path[0]] + sum(scores[bounds[i] + t, y] for t, y in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:])))
            total += p
            for t, y in enumerate(path):
                own[t, y] += p
            for x, y in zip(path, path[1:]):
                own_pairs[x, y] += p
        if size:
            want[bounds[i]:bounds[i + 1]] = own / total
            want_pairs += own_pairs / total
    assert np.abs(got - want).max() < 1e-5 and np.abs(pairs - want_pairs).max() < 1e-4


def test_language_accuracy_on_held_out_rows_and_in_code_switched_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    rows = langid.identify(docs, model).filter(langid.is_held_out()).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    by_lang = {lang: next(r.text for r in rows if r.lang == lang and len(r.text) > 600) for lang in ("en", "fr")}
    english, french = by_lang["en"].split()[:60], by_lang["fr"].split()[:60]
    w = next(iter(W.words_of(pa.array([" ".join(english + french)]))))
    labels = [model.langs[i] for i in langid.Labeller(model).words(w).argmax(1)]
    assert labels[:60].count("en") > 50 and labels[60:].count("fr") > 50


def test_language_cases(odd_docs, no_docs):
    named = langid.identify(odd_docs, langid.fit(odd_docs))
    got = {r.doc_id: r for r in named.collect()}
    assert [got[d].lang_pred for d in (1, 2, 3, 11)] == ["und"] * 4 and got[4].lang_pred != "und"
    assert named.count() == odd_docs.count() and set(named.columns) == {*odd_docs.columns, "lang_pred"}
    assert langid.identify(no_docs, langid.fit(no_docs)).count() == 0


# -- op2, op8, op9 -------------------------------------------------------------

def test_chat_reads_back_hard_texts(spark):
    rows = [(1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (1, 1, "assistant", "<\\|im_end|> <\\\\| <| |> \\n"), (1, 2, None, None), (1, 2, None, None),
            (2, None, "assi\\nstant\n", "x"), (2, 5, "assistant", ""), (3, 700, "assistant", "late"), (3, 1, "assistant", "early <|"), (None, 1, "assistant", "no id"), (4, 1, "user", "only")]
    df = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(chat.segments(df)).collect()}
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        said = "".join(f"{r}\n{x}\n" for r, x in turns)
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.segments(df.filter("conv_id < 0"))).count() == 0


def test_chat_examples_are_prefixes_with_one_reply_each(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b <|"), (1, 2, "user", "c"), (1, 3, "assistant", "d")]
    parts = chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted((r.text[:r.prompt_end], r.text[r.prompt_end:r.target_end]) for r in chat.texts(parts).collect())
    first = "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\n"
    assert got == sorted([(first, "b <\\|"), (first + "b <\\|<|im_end|>\n<|im_start|>user\nc<|im_end|>\n<|im_start|>assistant\n", "d")])


def test_chat_plan_is_native(spark):
    plan = QUERIES["op2_prefix_target_chat"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert not re.search("Python|Arrow|Pandas", QUERIES["op8_feistel_shards"](spark, SF)._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 40, 1000, 4097])
def test_feistel_is_a_permutation_with_an_inverse(spark, rows):
    got = [r.p for r in spark.range(rows).withColumn("p", sharding.permuted(__import__("pyspark").sql.functions.col("id"), rows, 1)).orderBy("id").collect()]
    assert sorted(got) == list(range(rows))
    assert all(sharding.row_number_at(p % 40, p // 40, rows) == i for i, p in enumerate(got))
    if rows >= 1000:
        assert abs(np.corrcoef(range(rows), got)[0, 1]) < 0.1


def test_shards_are_even_gapless_and_reproducible(spark, docs, odd_docs, no_docs):
    for table in (docs, odd_docs):
        rows = sharding.shards(table).collect()
        texts = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in table.collect())
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        sizes = [len(slots[s]) for s in range(40)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
        again = sharding.shards(table.repartition(3)).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert sharding.shards(no_docs).count() == 0


def test_pages_article_text(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r.text for r in QUERIES["op9_host_suffix_array"](spark, SF).collect()}
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)
        parts = re.split(r"</?(?:p|h1)>", body[1].replace("<br>", " ") if body else "")
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
        assert got[r.page_id] == "\n\n".join(x for x in want if x)


def test_pages_without_an_article_lose_what_their_host_repeats():
    shell = "<html><head><title>t</title></head><body><div>Welcome to the site of all good things in town</div>{}<div>All rights of this site are kept by its owners since then</div></body>"
    made = [shell.format(f"<p>Own text {i} with the words a{i} b{i} c{i} d{i} e{i} &amp; f{i}</p>") for i in range(9)]
    got = pages.main_texts([*made, None, ""], list(range(11)))
    assert got[:9] == [f"Own text {i} with the words a{i} b{i} c{i} d{i} e{i} & f{i}" for i in range(9)] and got[9:] == ["", ""]


def test_pages_of_a_host_of_several_chunks_are_counted_as_a_whole(spark, monkeypatch):
    rng = np.random.default_rng(5)
    said = [" ".join(f"n{k}w{j}" for j in range(12)) for k in range(6)]
    rows = []
    for i in range(90):
        notices = [said[k] for k, share in enumerate((0.5, 0.3, 0.15, 0.11, 0.07, 0.02)) if rng.random() < share]
        own = " ".join(f"o{i}w{j}" for j in range(int(rng.integers(8, 60))))
        kind = "<article>{}</article>" if i % 3 == 0 else "<body>{}</body>"
        always = "<p>a sentence that every page of this host repeats word by word</p>" if i % 10 else ""
        rows.append((i, f"https://big.example.org/{i}", kind.format(f"<p>{own}</p>" + "".join(f"<div>{x}</div>" for x in notices) + always)))
    rows += [rows[1], rows[2], (1, rows[1][1], f"<p>{said[5]}</p>"), (None, rows[3][1], rows[3][2]), (91, "https://big.example.org/empty", None), (92, "http://small.example.org/", rows[4][2])]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")

    def texts():
        return sorted(((r.page_id is None, r.page_id or 0, r.url, r.text, r.n_chars) for r in pages.extract(df).collect()))

    whole = texts()
    assert any(said[0] not in r[3] and said[5] in r[3] for r in whole) and not any("every page" in r[3] for r in whole if r[1] < 91)
    for size in (6000, 1500, 300):  # chunks of many pages, some and about one
        monkeypatch.setattr(pages, "CHUNK_BYTES", size)
        assert texts() == whole


def test_pages_markup_that_is_no_article():
    page = ("<article><header>h</header><h1>Title</h1><p>One<br>two &lt;b&gt;&nbsp;x<p>Three <script>var t='</p>';</script>four<div class='comments'>c</div>"
            "<div class=\"share-bar\">s</div><aside>a</aside><ul><li>i<li>j</ul><form>f</form></article><footer>z</footer><p>cut <a href='")
    assert pages.main_texts([page], [0]) == ["Title\n\nOne two <b> x\n\nThree four\n\ni\n\nj"]


def test_suffix_array_and_runs_equal_brute_force():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 7, 50, 200):
        t = rng.integers(0, 3, n)
        t = np.concatenate([t, t, t[:n // 2], [-9]]).astype(np.int64)
        size = len(t)
        order, common = pages.suffix_array(t)
        assert sorted(order) == list(range(size))
        for a, b, c in zip(order, order[1:], common[1:]):
            same = next((k for k in range(size) if a + k >= size or b + k >= size or t[a + k] != t[b + k]), size)
            assert c == same // pages.RUN * pages.RUN
        page = np.sort(rng.integers(0, 4, size))
        on = defaultdict(set)
        for i in range(size - pages.RUN + 1):
            on[tuple(t[i:i + pages.RUN])].add(page[i])
        want = np.zeros(size, int)
        for i in range(size - pages.RUN + 1):
            k = len(on[tuple(t[i:i + pages.RUN])])
            if k > 1:
                want[i:i + pages.RUN] = np.maximum(want[i:i + pages.RUN], k)
        assert (pages.repeated(t, page) == want).all()


def test_pages_cases(spark):
    df = with_clashes(spark.createDataFrame([(1, None, None), (2, "odd", "<p>x"), (2, "odd", "<p>x"), (3, "http://a/b", "")], "page_id long, url string, html string"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in pages.extract(df).collect())
    assert got == [(1, "", 0), (2, "x", 1), (2, "x", 1), (3, "", 0)]
    assert pages.extract(df.filter("page_id < 0")).count() == 0


def test_near_dedup_gives_the_full_sets_back_before_the_pairs(spark, monkeypatch):
    """The texts and members of the prefix filter are deleted where it ends, and
    the sketches' shuffles are swept before the first pairs."""
    from pagewright.llm import neardup

    jobs.prepare(spark)
    swept = []
    monkeypatch.setattr(neardup, "sweep", lambda spark, *done: swept.append(len(done)))
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(60) if j != i)) for i in range(6)], "doc_id long, text string")
    assert {r.component_id for r in neardup.near_duplicates(docs, 3, 85, 100).collect()} == {0}
    assert swept[0] == 0 and 2 in swept
