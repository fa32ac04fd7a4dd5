import hashlib
import re

from lamella.llm import decontaminate as d
from lamella.llm.common import table


def brute_force(documents: list[tuple], items: list[tuple], n: int = d.WINDOW) -> list[tuple]:
    """The contract by plain loops, for tests on small tables."""

    def words(text):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    windows: dict[tuple, set[str]] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - n, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in documents:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven"),
    (2, "short Item"),
    (3, None),
    (4, ""),
    (10, "two three four five six seven eight nine ten eleven twelve"),
    (1, "One two three four five six seven eight nine ten eleven"),
]
DOCS = [
    (1, "x one, TWO three-four five six seven eight nine ten eleven y"),
    (2, None),
    (3, ""),
    (4, "a short item and a SHORT ITEM"),
    (5, "one two three four five six seven eight nine"),
    (5, "one two three four five six seven eight nine"),
    (None, "été short item " * 5000),
    (7, "one two three four five six seven eight nine ten eleven twelve"),
]


def test_small(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (d.BLOCK_BYTES, 40):
        assert rows(d.contamination_report(docs, items, block_bytes=block)) == sorted(brute_force(DOCS, [i for i in ITEMS if i[1]]), key=str)


def test_window_set_is_compact():
    """The set takes a bounded multiple of the item text, also where no word repeats."""
    items = [(str(i), b" ".join(b"w%d" % (100 * i + j) for j in range(100))) for i in range(2000)]
    text = sum(len(t) for _, t in items)
    assert d.WindowSet(items, 10).nbytes() < 30 * text
    common = [(str(i), b" ".join(b"w%d" % (j * 7919 % 1000) for j in range(i, i + 100))) for i in range(2000)]
    assert d.WindowSet(common, 10).nbytes() < 12 * sum(len(t) for _, t in common)


def test_blocks_come_one_at_a_time(spark):
    items = spark.createDataFrame([(i, f"item {i} " * 10) for i in range(50)], "item_id long, text string")
    blocks = d.item_blocks(items, "item_id", "text", 500)
    assert iter(blocks) is blocks and sorted(n for b in blocks for n, _ in b) == sorted(str(i) for i in range(50))


def test_table(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = brute_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(x[5] for x in want)
    assert rows(d.op9_decontaminate(spark, sf)) == sorted(want, key=str)


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.contamination_report(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in d.contamination_report(docs, items.limit(0)).collect())
    odd = docs.selectExpr("*", "1 AS hit_spans", "array(1) AS item_id")
    kept = d.remove_documents(odd.drop("hit_spans"), items)
    assert kept.columns == ["doc_id", "text", "item_id"] and kept.count() == 4
    assert "short" not in d.remove_spans(docs, items).where("doc_id = 4").first().text.lower()
