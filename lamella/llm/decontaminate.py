"""Benchmark decontamination by a broadcast hash set of normalised word n-grams.

Words: A-Z are lower-cased, then maximal runs of characters that are neither
ASCII control, punctuation nor space. An item is cut into windows of
``n`` consecutive words; an item with fewer words, but at least one, is one
window. The windows of a block of items are broadcast as a hash set, every
document is scanned once per block, each hash hit is verified word by word,
and the words inside verified windows are marked. The set is a sorted array of
hashes with the place of each window, next to the item texts as word ids and
the words behind the ids. One block at a time is on the driver and in the
workers; with several, the hits of a block are written before the next one.

Defined results: a null text has no words and is never contaminated; an item
with null text has no windows; repeated items or documents are each reported;
an item id that is null counts as the string "null". Extra columns pass
through; columns named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.llm.common import add_columns, materialize, table, texts_of

WINDOW = 10
#: Bytes of item text in one broadcast block, about a tenth of the memory its set takes. More items are scanned in further blocks.
BLOCK_BYTES = 8 << 20

#: ASCII bytes to lower case, those outside words to a space.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WindowSet:
    """Windows of a block of items. By window size: sorted hashes, and the item and place of each window."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.vocab: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        ids = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], dtype=np.uint32) for _, text in items]
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[int]] = {}
        for at, x in enumerate(ids):
            if len(x):
                by_size.setdefault(min(n, len(x)), []).append(at)
        for size, members in by_size.items():
            hashes = [_rolling(ids[at], size) for at in members]
            owner = np.repeat(np.array(members, np.int32), [len(h) for h in hashes])
            place = np.concatenate([self.start[at] + np.arange(len(h)) for at, h in zip(members, hashes)])
            flat = np.concatenate(hashes)
            order = np.argsort(flat, kind="stable")
            self.windows[size] = flat[order], owner[order], place[order]

    def nbytes(self) -> int:
        """Bytes of the arrays, and of the words with 120 for each entry of the dict."""
        arrays = sum(x.nbytes for parts in self.windows.values() for x in parts) + self.ids.nbytes + self.start.nbytes
        return arrays + sum(len(w) + 120 for w in self.vocab)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[int]]:
        """Mask of hit words (None: no hit) and the items found."""
        get = self.vocab.get
        ids = np.fromiter([get(w, 0) for w in words], dtype=np.uint32, count=len(words))
        gaps = np.flatnonzero(ids == 0)
        mask, owners = None, set()
        runs = np.diff(gaps, prepend=-1, append=len(ids)) - 1
        longest = int(runs.max()) if len(runs) else len(ids)
        for size, (hashes, owner, place) in self.windows.items():
            if longest < size:
                continue
            rolled = _rolling(ids, size)
            low, high = np.searchsorted(hashes, rolled, side="left"), np.searchsorted(hashes, rolled, side="right")
            for i in np.flatnonzero(high > low).tolist():
                window = ids[i : i + size]
                for j in range(low[i], high[i]):
                    if (self.ids[place[j] : place[j] + size] == window).all():
                        mask = np.zeros(len(ids), dtype=bool) if mask is None else mask
                        mask[i : i + size] = True
                        owners.add(int(owner[j]))
        return mask, owners


def _rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit polynomial hash of each window of ``size`` ids."""
    wide = ids.astype(np.uint64)
    count = len(wide) - size + 1
    out = np.zeros(max(0, count), dtype=np.uint64)
    if count <= 0:
        return out
    for j in range(size):
        out *= _P
        out += wide[j : j + count]
    return out


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks whose text is bounded: the size is measured first, and one block at a time collected."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text")
    ).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    count = int(total // block_bytes) + 1
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(count)))
    for b in range(count):
        yield [(r["item"], r["text"].encode()) for r in (numbered.where(F.col("block") == b) if count > 1 else items).collect()]


SCAN = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.LongType())),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
)


def spans_of(mask: np.ndarray) -> list[int]:
    """[start, end, start, end, ...] of the runs of True."""
    edges = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges).tolist()


def find_hits(
    documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    n: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """documents with n_words, hit_spans (word offsets start, end, ...) and hit_items.

    No shuffle: one scan of the documents a block, whose hits are united row
    by row. The broadcast is bounded by ``block_bytes`` of item text.
    """
    sc = documents.sparkSession.sparkContext
    out, shared = documents, None
    for k, items in enumerate(item_blocks(benchmark, item_col, item_text_col, block_bytes)):
        if shared is not None:
            out = materialize(out, "hits")
            shared.unpersist()
        shared = sc.broadcast(WindowSet(items, n))

        def make(shared=shared, later=bool(k)):
            block = shared.value

            def work(texts, spans=None, found=None):
                rows = []
                olds = zip(spans.to_pylist(), found.to_pylist()) if later else ((None, None) for _ in range(len(texts)))
                for text, (old_spans, old_items) in zip(texts_of(texts), olds):
                    words = words_of(text) if text else []
                    mask, owners = block.scan(words) if words else (None, set())
                    names = {block.names[i] for i in owners}
                    if later:
                        old = [int(x) for x in old_spans.split(",")] if old_spans else []
                        if old:
                            mask = np.zeros(len(words), dtype=bool) if mask is None else mask
                            for a, b in zip(old[::2], old[1::2]):
                                mask[a:b] = True
                        names |= set(old_items.split("\x1f")) if old_items else set()
                    rows.append((len(words), spans_of(mask) if mask is not None else [], sorted(names)))
                return rows

            return work

        if k:
            out = out.withColumns({"__spans": F.array_join(F.col("hit_spans").cast("array<string>"), ","), "__items": F.array_join("hit_items", "\x1f")})
            out = add_columns(out, [text_col, "__spans", "__items"], SCAN, make).drop("__spans", "__items")
        else:
            out = add_columns(out, [text_col], SCAN, make)
    return out


def contamination_report(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_hits(documents.select(F.col(id_col).alias("doc_id"), F.col(options.pop("text_col", "text")).alias("text")), benchmark, **options)
    return found.select(
        "doc_id",
        "n_words",
        hit_words(F.col("hit_spans")).alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def hit_words(spans):
    """Words in [start, end, ...]: ends minus starts."""
    odd = F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(odd, F.lit(0).cast("long"), lambda a, x: a + x)


def remove_documents(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of documents without a hit, columns as they were."""
    found = find_hits(documents, benchmark, **options)
    return found.where(F.size("hit_spans") == 0).select(*[F.col(f"`{c}`") for c in documents.columns])


def remove_spans(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """documents with hit words, and what stands between them, cut out of the text."""
    found = find_hits(documents, benchmark, text_col=text_col, **options)
    schema = T.StructType([T.StructField(text_col, T.StringType())])

    def make():
        def work(texts, spans):
            return [(cut(t, s),) for t, s in zip(texts.to_pylist(), spans.to_pylist())]

        return work

    found = found.withColumn("__spans", F.array_join(F.col("hit_spans").cast("array<string>"), ","))
    return add_columns(found, [text_col, "__spans"], schema, make).select(*[F.col(f"`{c}`") for c in documents.columns])


def cut(text: str | None, spans: str) -> str | None:
    if not text or not spans:
        return text
    words = [m.span() for m in WORD.finditer(text)]
    out, at, edges = [], 0, [int(x) for x in spans.split(",")]
    for a, b in zip(edges[::2], edges[1::2]):
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return "".join(out) + text[at:]


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
