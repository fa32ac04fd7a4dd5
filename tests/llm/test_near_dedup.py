import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import near_dedup as nd
from lamella.llm.common import table
from lamella.llm.components import components


def brute(docs, skip=()):
    """(n, component) by id, all sets against all that share a shingle."""
    sets = {}
    for d, t in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    done = set()
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if root(a) != root(b) and (a, b) not in done:
                    done.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: (len(s), root(d)) for d, s in sets.items()}


def got(rows):
    out = {}
    for r in rows:
        assert r.kept == (r.doc_id == r.component_id)
        out[r.doc_id] = (r.n_shingles, r.component_id)
    return out


def test_table(spark):
    path = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, path, "documents").collect()]
    want = brute(docs)
    assert sum(d != c for d, (_, c) in want.items()) > 10
    assert got(nd.op4_minhash_dedup(spark, path).collect()) == want


@pytest.fixture()
def small_limits(monkeypatch):
    for name, value in (("LEAF", 8), ("BLOCK", 8), ("DEPTH", 2)):
        monkeypatch.setattr(nd, name, value)


def test_large_groups(spark, small_limits):
    """Groups far over a leaf and a block, one of them held together by its first text alone."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(120)]
    docs = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for p in rng.sample(range(5, 115), 2):
            w[p] = word()
        docs.append((i, " ".join(w)))
    chain = [word() for _ in range(200)]
    for i in range(40):
        docs.append((200 + i, " ".join(chain[3 * i : 3 * i + 80])))
    docs += [(300 + i, " ".join(word() for _ in range(50))) for i in range(40)]
    want = brute(docs)
    assert len({c for _, c in want.values()}) == 42
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(nd.near_duplicate_groups(df).collect()) == want


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "A b  c"), (6, "a b d"), (7, "x " * 60000), (8, "x " * 50000), (9, "one two three four five"), (9, "one two three four five")]
    df = spark.createDataFrame([*rows, (None, "zz yy")], "doc_id long, text string").selectExpr("*", "1 AS sid", "2 AS tokens", "'q' AS uid")
    out = nd.near_duplicate_groups(df).collect()
    assert len(out) == 11
    want = {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9, None: None}
    assert {r.doc_id: r.component_id for r in out} == want
    assert not any(r.kept for r in out if r.doc_id is None)
    kept = nd.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "7", "9", "9", "None"]
    assert nd.near_duplicate_groups(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 5), (5, 6), (9, 9), (-3, 7)] + [(1000, x) for x in range(1001, 1050)]
    random.Random(1).shuffle(edges)
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 100 for i in range(100, 161)) and all(out[i] == -3 for i in (5, 6, 7, -3)) and all(out[i] == 1000 for i in range(1000, 1050))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_linked_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 30, rng.integers(1, 40)).astype(np.uint64)) for _ in range(2))
        both = len(np.intersect1d(a, b))
        assert nd.linked(a, b) == (100 * both >= 75 * (len(a) + len(b) - both))


def test_classes_are_joined_once(spark):
    """A class in many nodes is one row of the join with its values, not one for each node."""
    rows = spark.range(4000).select((F.col("id") % 50).alias("node"), F.floor(F.col("id") / 50).alias("sid"))
    values = spark.range(80).select(F.col("id").alias("sid"), F.lit(b"x").alias("sketch"))
    held = nd.gathered(rows, values, "node")
    assert held.count() == 80 and sorted(r.node for r in held.where("sid = 7").first()["at"]) == list(range(50))


def sketched(n, seed, odd):
    """Rows (node, sid, sketch) of n members: some match no other, the rest two bases or members that match one."""
    rng = np.random.default_rng(seed)
    bases = rng.integers(0, 256, (2, nd.SIZE), dtype=np.uint8)
    rows = []
    for i in range(n):
        x = rng.integers(0, 256, nd.SIZE, dtype=np.uint8) if i % odd == 0 else bases[i % 2].copy()
        x[rng.choice(nd.SIZE, int(rng.integers(0, 60)), replace=False)] = rng.integers(0, 256)
        rows.append((1, i, x.tobytes()))
    return rows


def test_leaf_walk_is_exhaustive(monkeypatch):
    """The walk gives the parts that all pairs give, without comparing members that are linked already."""
    for seed, odd in ((1, 2), (2, 5), (3, 50)):
        rows = sketched(150, seed, odd)
        sketch = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, nd.SIZE)
        parts = [list(range(len(rows))) for _ in range(2)]
        for group, edges in zip(parts, (np.argwhere(np.triu(nd.similar(sketch, sketch) >= nd.SKETCH_CUT, 1)).tolist(), nd._leaf(rows))):
            for i, j in edges:
                group[nd._root(group, i)] = nd._root(group, j)
        same = [{frozenset(i for i in range(len(rows)) if nd._root(g, i) == r) for r in {nd._root(g, i) for i in range(len(rows))}} for g in parts]
        assert same[0] == same[1] and len(nd._leaf(rows)) == len(rows) - len(same[0])
    compared, similar = [], nd.similar
    monkeypatch.setattr(nd, "similar", lambda x, y: compared.append(len(x) * len(y)) or similar(x, y))
    rows = [(1, i, bytes(nd.SIZE)) for i in range(1000)]
    assert len(nd._leaf(rows)) == 999 and sum(compared) <= 1000
    assert nd._leaf(rows[:1]) == [] and nd._leaf([]) == []


def test_large_group_is_not_branched(spark, monkeypatch):
    """Some hundred near copies are compared in their first nodes; no rows of further levels are made for them."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 32, nd.SIZE, dtype=np.uint32)
    rows = []
    for sid in range(400):
        tokens = base.copy()
        tokens[rng.choice(nd.SIZE, 12, replace=False)] = rng.integers(0, 1 << 32, 12, dtype=np.uint32)
        rows.append((sid, bytearray(tokens.tobytes()), bytearray((tokens & 0xFF).astype(np.uint8).tobytes())))
    classes = spark.createDataFrame(rows, "sid long, tokens binary, sketch binary")
    monkeypatch.setattr(nd, "branch_again", lambda *_: pytest.fail("branched"))
    roots = {r.root for r in components(nd.candidate_edges(classes)).collect()}
    assert roots == {0}
