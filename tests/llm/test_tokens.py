import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lamella.llm import language_id as li
from lamella.llm import near_dedup as nd
from lamella.llm import pattern_packing as pp
from lamella.llm import token_output as to
from lamella.llm import tokens
from lamella.llm.common import table
from lamella.llm.tokens import WordTokenizer, tokenizer_path

ODD = [
    "don't <|endoftext|> x", "<|startoftext|>abc", "é́a éb ΑΒΣ ΣΑΣ", "a1b2 it's 'S they'll İI ŉ ß ẞ", "\x1c\x1d a b  c\u0085d",
    "...Hello!!! \"quoted\" (x)y z_w ﬁ, a., b.. c,", "日本語 テキスト 한국어 emoji😀x", "ABC\x0bd\x0ce\x00f", "ÀÈ×÷Ø ªº µ", "", " \n", "Word, word.\nWord's.",
]


def ids(text):
    tok = WordTokenizer(tokenizer_path())
    return np.frombuffer(tok.packed(text.encode()), tok.kind).tolist(), tok.whole.encode(text, add_special_tokens=False).ids


def test_odd_texts():
    for text in ODD:
        got, want = ids(text)
        assert got == want, text


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBcé É'.,<|>1 \n\tß-"), max_size=40))
def test_any_text(text):
    got, want = ids(text)
    assert got == want


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=40))
def test_plan_holds_histogram(h):
    plan = pp.plan_sequences(h, 64)
    seen = Counter()
    for n, sizes in plan:
        assert n > 0 and sum(sizes) <= 64
        for s in sizes:
            seen[s] += n
    assert seen == Counter(h)
    bins = to.best_fit_decreasing([s for s, n in h.items() for _ in range(n)], 64)
    assert sum(n for n, _ in plan) <= 1.1 * len(bins) + 1


def test_patterns_place_most_pieces():
    """Most pieces come to their place through a fitted pattern, in no more sequences than plain best fit needs."""
    for seed, mean, sigma in ((1, 6.0, 0.9), (2, 6.5, 0.7), (3, 5.5, 1.1)):
        lengths = np.clip(np.random.default_rng(seed).lognormal(mean, sigma, 30_000).astype(int), 1, 2048)
        h = Counter(lengths.tolist())
        plan = pp.plan_sequences(dict(h))
        plain = pp.best_fit([(h[2048], [2048])] if h[2048] else [], {s: n for s, n in h.items() if s < 2048}, 2048)
        used, least = sum(n for n, _ in plan), sum(n for n, _ in plain)
        share = pp.pattern_share(dict(h))
        print(seed, "share by patterns", round(share, 3), "sequences", used, "plain best fit", least, "bound", -(-sum(lengths) // 2048))
        assert share > 0.5 and used <= least * 1.002 + 1


def expected(docs):
    tok = WordTokenizer(tokenizer_path())
    return {d: [*tok.whole.encode(t or "", add_special_tokens=False).ids, 0] for d, t in docs}


def check_pattern_packing(rows, docs):
    want, by_sequence, pieces = expected(docs), defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert pieces.keys() == want.keys()
    for d, ps in pieces.items():
        full = np.array(want[d], dtype="<u4")
        assert len(ps) == -(-len(full) // 2048)
        for piece, start, length, crc in ps:
            assert start == 2048 * piece and length == min(2048, len(full) - start)
            assert crc == zlib.crc32(full[start : start + length].tobytes())
    for segments in by_sequence.values():
        at = 0
        for offset, length in sorted(segments):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(map(len, want.values()))
    assert len(by_sequence) <= total / 2048 * 1.02 + 2


def test_pattern_packing(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    check_pattern_packing(pp.op6_pattern_packing(spark, sf).collect(), docs)


def test_pattern_packing_edges(spark):
    docs = [(1, None), (2, ""), (3, "a b c " * 3000), (4, "x"), *((i, "same words here") for i in range(5, 60))]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS length", "'x' AS sequence_id", "0 AS chunk")
    check_pattern_packing(pp.pack_documents(df.repartition(5)).collect(), docs)
    assert pp.pack_documents(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(7, "hi there"), (7, "hi there"), (None, "hi")], "doc_id long, text string")
    got = pp.pack_documents(twice).collect()
    assert len(got) == 3 and len({r.sequence_id for r in got}) == 1 and len({r.offset for r in got}) == 3


def check_matrices(rows, docs):
    want, got = expected(docs), defaultdict(dict)
    for r in rows:
        m = np.frombuffer(r.ids, "<u4")
        assert len(m) == 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 2048 and r.position_resets == r.cu_seqlens[:-1]
        positions = to.position_ids(r.cu_seqlens)
        for d, p, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            got[d][p] = m[a:b].tolist()
            assert positions[a:b].tolist() == list(range(b - a))
    assert {d: [x for p in sorted(ps) for x in ps[p]] for d, ps in got.items()} == want


def test_token_output(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    check_matrices(to.op8_token_output(spark, sf).collect(), docs)
    check_matrices(to.packed_rows(table(spark, sf, "documents"), shard_tokens=5000).collect(), docs)


def test_token_output_edges(spark):
    docs = [(1, None), (2, ""), (3, "a b c " * 3000), (4, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS row")
    check_matrices(to.packed_rows(df).collect(), docs)
    assert to.packed_rows(df.limit(0)).count() == 0


def test_matrix_files(spark, sf, tmp_path):
    """Raw ids and index read back give every document's ids; a second run leaves the same files."""
    from functools import reduce

    docs = table(spark, sf, "documents").union(spark.createDataFrame([(None, "a null id", "en", "s", 9)], table(spark, sf, "documents").schema))
    rows = to.packed_rows(docs, shard_tokens=20_000)
    files = to.write_matrices(rows, str(tmp_path)).collect()
    assert len(files) > 3 and sorted(f.ids_sha256 for f in to.write_matrices(rows, str(tmp_path)).collect()) == sorted(f.ids_sha256 for f in files)
    got = defaultdict(dict)
    for f in files:
        matrix, index = to.read_matrix(f.ids_file, f.index_file)
        assert len(matrix) == len(index) == f.rows and sum(r["cu_seqlens"][-1] for r in index) == f.n_tokens
        for ids, r in zip(matrix, index):
            assert r["position_resets"] == r["cu_seqlens"][:-1]
            for d, p, a, b in zip(r["doc_ids"], r["pieces"], r["cu_seqlens"], r["cu_seqlens"][1:]):
                got[d][p] = ids[a:b].tolist()
    assert {d: reduce(list.__add__, [x[p] for p in sorted(x)]) for d, x in got.items()} == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert len(list(tmp_path.iterdir())) == 2 * len(files) and not to.write_matrices(to.packed_rows(docs.limit(0)), str(tmp_path)).collect()


def test_shards_lose_little(spark):
    """Packing by shards against one best fit over everything."""
    rows = to.op8_token_output(spark, "/root/testdata/sf0.01").collect()
    lengths = [b - a for r in rows for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:])]
    whole = len(to.best_fit_decreasing(lengths, to.CAPACITY))
    print("rows", len(rows), "one best fit", whole, "bound", -(-sum(lengths) // to.CAPACITY))
    assert len(rows) <= 1.02 * whole + 1


class Caught:
    """Stands for a DataFrame; gives the function that its tasks would run."""

    sparkSession = property(lambda self: self)
    sparkContext = conf = sparkSession
    value, schema = None, li.RESULT
    get = lambda self, key: "8"
    select = repartition = sortWithinPartitions = broadcast = lambda self, *a: self
    mapInArrow = lambda self, run, schema: run


def test_other_stages_release_tokenizers(spark):
    """A worker that packed keeps its tokenizer and words for its next tasks, but not beside the work of other stages."""
    import weakref

    tasks = [nd.signatures(Caught(), "doc_id", "text"), nd.by_group(Caught(), ["node"], nd._leaf, "a long, b long"), li.predict(Caught(), None)]
    for run in tasks:
        tok = tokens.held_tokenizer(tokenizer_path())
        assert tok is tokens.held_tokenizer(tokenizer_path()) and tok.packed(b"some words")
        gone = weakref.ref(tok)
        del tok
        assert list(run(iter(()))) == [] and not tokens._HELD and gone() is None
    tokens.release_tokenizers()  # nothing held
