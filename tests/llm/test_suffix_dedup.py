import random

import numpy as np

from lamella.llm import suffix_dedup as sd
from lamella.llm.words import gram_hashes, minimisers, word_hashes


def brute(docs, least=50):
    """Maximal spans of each document whose words all lie in runs of ``least`` words found elsewhere."""
    seen = {}
    split = {d: (t or "").encode().lower().split() for d, t in docs}
    for d, w in split.items():
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), []).append((d, i))
    spans = {}
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                spans.setdefault(d, []).append((i, i + least))
    out = set()
    for d, s in spans.items():
        low, high = None, None
        for a, b in sorted(s):
            if high is not None and a <= high:
                high = max(high, b)
            else:
                if high is not None:
                    out.add((d, low, high))
                low, high = a, b
        out.add((d, low, high))
    return out


def make_docs():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    fresh = lambda n: [word() for _ in range(n)]
    shared = [fresh(n) for n in (50, 51, 60, 120, 400, 49)]
    docs = []
    for i in range(60):
        parts = fresh(rng.randrange(5, 80))
        for p in rng.sample(shared, rng.randrange(0, 3)):
            parts += p + fresh(rng.randrange(5, 60))
        docs.append((i, " ".join(parts).capitalize()))
    longest = max(docs, key=lambda d: len(d[1].split()))[1]
    docs += [(100, longest), (101, longest), (102, None), (103, ""), (104, "x " * 20), (105, " ".join(shared[3]) + " mid " + " ".join(shared[3]))]
    return docs


def test_against_brute_force(spark):
    docs = make_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS uid", "2 AS pos").repartition(7)
    got = {(r.doc_id, r.start_word, r.end_word): r.other_docs for r in sd.repeated_passages(df).collect()}
    want = brute(docs)
    covered = lambda spans: {(d, i) for d, a, b in spans for i in range(a, b)}
    assert set(got) == want and covered(want) == covered(got)
    texts = {d: (t or "").lower().split() for d, t in docs}
    assert got[100, 0, len(texts[100])]
    assert any(d == 105 for d, _, _ in got)
    clean = {d for d, _ in docs} - {d for d, _, _ in want}
    assert clean and not clean & {d for d, _, _ in got}


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(70))
    rows = [(1, text), (1, text), (None, text), (7, "other " + text + " tail"), (8, "q " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.start_word, r.end_word) for r in sd.repeated_passages(df).collect()))
    assert got == [(-1, 0, 70), (1, 0, 70), (7, 1, 71), (8, 0, 300)]
    assert sd.repeated_passages(df.limit(0)).count() == 0
    assert sd.repeated_passages(spark.createDataFrame(rows[:2], "doc_id long, text string")).count() == 0


def test_words():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 1 << 62, 500).astype(np.uint64)
    g = gram_hashes(w, 25)
    assert (gram_hashes(w[100:200], 25) == g[100:176]).all() and len(np.unique(g)) == 476
    m = minimisers(g, 25)
    assert np.diff(m).max() <= 25 and m[0] < 25 and len(word_hashes(None)) == 0
    assert set(minimisers(g[40:300], 25) + 40) <= set(m)


def test_covers_the_tables_repeats(spark):
    from lamella.llm.common import table

    path = "/root/testdata/sf0.01"
    want = brute([(r.doc_id, r.text) for r in table(spark, path, "documents").collect()])
    got = {(r.doc_id, i) for r in sd.op10_suffix_dedup(spark, path).collect() for i in range(r.start_word, r.end_word)}
    missing = {(d, i) for d, a, b in want for i in range(a, b)} - got
    assert len(missing) <= 0.001 * len(got) and {d for d, _, _ in want} <= {d for d, _ in got}


def test_large_group_of_edited_copies(spark):
    """2,000 copies of one text, 6 % of the words changed in each: the order keys must reach MIN_WORDS."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    docs = [(i, " ".join(word() if rng.random() < 0.06 else w for w in base)) for i in range(2000)]
    got = {(r.doc_id, i) for r in sd.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect() for i in range(r.start_word, r.end_word)}
    want = {(d, i) for d, a, b in brute(docs) for i in range(a, b)}
    assert {d for d, _ in want} <= {d for d, _ in got} and len(want - got) <= 0.001 * len(want), (len(want - got), len(want))
    assert got == want


def test_shorter_matches_with_several_texts_are_no_passage(spark):
    """100 words that stand in three other texts, 49 at a time and overlapping, hold no repeat of 50 words."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    fresh = lambda n: [word() for _ in range(n)]
    base = fresh(100)
    docs = [(1, " ".join(base))] + [(2 + k, " ".join(fresh(40) + base[a : a + 49] + fresh(40))) for k, a in enumerate((0, 30, 51))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sd.repeated_passages(df).count() == 0
    more = df.union(spark.createDataFrame([(9, " ".join(fresh(3) + base[20:70] + fresh(3)))], "doc_id long, text string"))
    assert sorted((r.doc_id, r.start_word, r.end_word, r.other_docs) for r in sd.repeated_passages(more).collect()) == [(1, 20, 70, [9]), (9, 3, 53, [1])]


def test_other_lengths(spark):
    docs = make_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for least in (55, 110):
        assert {(r.doc_id, r.start_word, r.end_word) for r in sd.repeated_passages(df, min_words=least).collect()} == brute(docs, least)
