"""Exact repeated passages by a sparse suffix array.

A suffix of a document's words is retained where its first ``PREFIX`` words
are a minimiser, the least hash of ``WINDOW`` such prefixes in a row. Every
passage of PREFIX + WINDOW - 1 words holds such a position, chosen by its
content alone, so a repeat of ``MIN_WORDS`` words or more shares at least one
retained suffix with its other places.

1. Suffixes are sorted by their prefix and the ``SPAN`` words behind it; each
   is compared with its neighbour. How far the order keys agree bounds from
   above how many words any other place has in common behind the prefix.
2. Those with a neighbour of the same prefix are sorted by their prefix and
   the words before it, last one first, and compared again. Places whose two
   bounds and the prefix come to fewer than ``min_words`` hold no passage.
3. Neighbours have the longest common words on one side. The place with the
   most on both sides together may be neither of the two, so in prefixes
   with three or more different surroundings the ``min_words``-word windows
   that belong to a place are hashed and compared, one place of each sort of
   surroundings. That makes the search exact.
4. Matches on one diagonal of two documents are joined, then extended left and
   right, word by word.

Only matches of ``min_words`` words and more count; those of a document that
touch or overlap are united. One row a maximal run of words that all lie in
such matches: doc_id, start_word, end_word (words between ASCII white space,
A-Z lower-cased), n_words, other_docs (documents next to it in the order, each
of which holds ``min_words`` of the words), and identity, 1 here. Groups are
walked as chains of neighbours: m places of a passage give at most m - 1
matches in an order, and no group is gathered.

Defined results: null, empty and texts of fewer than ``MIN_WORDS`` words have
no passage; repeats within a document count and name the document itself; rows
that repeat id and text are one document; a null doc_id is kept; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import discard, materialize, table, texts_of
from lamella.llm.passages import identified, keyed_places, merged_spans, neighbours, with_words
from lamella.llm.words import gram_hashes, least_positions, minimisers, occurrence, word_hashes_of

MIN_WORDS = 50
PREFIX = 25
WINDOW = 25
#: Words read on either side of a run; a maximal match reaches at most WINDOW words beyond its outer suffixes.
MARGIN = 64
#: Words in the order keys of one side: 16 in the first key and 9 in the second, four bits of each word's hash.
SPAN = 25
PACKED = 16
#: Rows of a sorted partition that are held at once.
CHUNK = 1 << 16

SIDES = (["behind0", "behind1"], ["before0", "before1"])
PLACE = ["first", *SIDES[0], *SIDES[1], "nth", "uid", "pos"]


def suffix_places(words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the retained suffixes: hash of the first PREFIX words, order keys of the words behind and before those, position.

    The low 28 bits of a side's second key are a hash of all its words, so that equal keys mean equal words.
    """
    grams = gram_hashes(words, PREFIX)
    at = minimisers(grams, WINDOW)
    fill = np.zeros(SPAN, np.uint64)
    padded = np.concatenate([fill, words, fill])
    near = padded >> np.uint64(60)
    whole = gram_hashes(padded, SPAN) & np.uint64((1 << 28) - 1)

    def keys(start: np.ndarray, step: int, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = np.zeros(len(at), np.uint64)
        low = np.zeros(len(at), np.uint64)
        for i in range(SPAN):
            word = near[start + step * i]
            if i < PACKED:
                high = high << np.uint64(4) | word
            else:
                low = low << np.uint64(4) | word
        return high, low << np.uint64(28) | hashed

    behind, before = at + SPAN + PREFIX, at + SPAN
    return grams[at], *keys(behind, 1, whole[behind]), *keys(before - 1, -1, whole[before - SPAN]), at


def agreeing(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Words, up to SPAN, whose codes agree before the first that differs; a, b: the two keys of one side, as signed 64 bits."""
    x, y = ((p.view(np.uint64) ^ q.view(np.uint64)) for p, q in zip(a, b))
    first = _leading_zeros(x) // 4
    rest = np.minimum(_leading_zeros(y) // 4, SPAN - PACKED)
    return np.where(x != 0, first, PACKED + rest).astype(np.int32)


def _leading_zeros(x: np.ndarray) -> np.ndarray:
    """Leading zero bits of 64; 64 for zero."""
    out = np.zeros(len(x), np.int64)
    for bits in (32, 16, 8, 4, 2, 1):
        top = x < (np.uint64(1) << np.uint64(64 - bits))
        out += np.where(top, bits, 0)
        x = np.where(top, x << np.uint64(bits), x)
    return np.where(x == 0, 64, out)


def chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[np.ndarray], int, bool, bool]]:
    """(columns, rows of the chunk before, whether the partition starts, whether it ends) of a sorted partition.

    Each chunk begins with the last two rows of the one before, of which the last is still to be put out.
    """
    held, size, tail = [], 0, None

    def joined():
        cols = [np.concatenate(c) for c in zip(*([tail] if tail else []), *held)]
        return cols, (len(tail[0]) if tail else 0)

    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(i).to_numpy() for i in range(width)])
            size += batch.num_rows
        if size >= CHUNK:
            cols, old = joined()
            yield cols, old, tail is None, False
            tail, held, size = [c[-2:] for c in cols], [], 0
    if held or tail:
        cols, old = joined()
        yield cols, old, tail is None, True


def sorted_chunks(rows: DataFrame, order: list[str], carry: list[str], schema: str, work: Callable) -> DataFrame:
    """``work`` on the chunks of rows in the order of ``order``, whose first column is the prefix; range partitions split a hot prefix."""
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(count, *order).sortWithinPartitions(*order).select(*PLACE, *carry)
    width = len(PLACE) + len(carry)

    def run(batches):
        part, edges = TaskContext.get().partitionId(), []
        for cols, old, starts, ends in chunks(batches, width):
            if starts:
                edges.append([2 * part, *(c[0] for c in cols)])
            yield from work(cols, old, starts, ends)
            if ends:
                edges.append([2 * part + 1, *(c[-1] for c in cols)])
        if edges:
            yield from work(edges, -1, False, False)

    return dealt.mapInArrow(run, schema)


def _compared(cols: list[np.ndarray], side: list[int], old: int, starts: bool, ends: bool):
    """Of a chunk's rows to put out (indices): prefix shared with the row before, agreement with the better neighbour, all keys equal to the row before."""
    n = len(cols[0])
    same = np.concatenate([[False], cols[0][1:] == cols[0][:-1]])
    keys = [cols[i] for i in side]
    agree = np.concatenate([[0], np.where(same[1:], agreeing([k[1:] for k in keys], [k[:-1] for k in keys]), 0)])
    equal = same & np.concatenate([[False], np.logical_and.reduce([c[1:] == c[:-1] for c in cols[1:5]])])
    after = np.concatenate([agree[1:], [0]])
    best = np.maximum(agree, after)
    if starts:
        best[0] = SPAN  # the row before is in another partition
    if ends:
        best[-1] = SPAN
    low = max(0, old - 1)
    return np.arange(low, n if ends else n - 1), same, best, equal


def _many_surroundings(same: np.ndarray, twin: np.ndarray) -> np.ndarray:
    """Rows of prefixes with three or more different surroundings; of prefixes that a chunk cuts, all."""
    group = np.cumsum(~same) - 1
    sorts = np.bincount(group, weights=~twin)
    sorts[[0, -1]] = 3
    return sorts[group] >= 3


def forward_places(suffixes: DataFrame, min_words: int) -> DataFrame:
    """Places with a neighbour of the same prefix in the order of the words behind: its keys, ``reach`` (words behind that another place can
    have in common), ``single`` (one place of each sort of surroundings, where there are three or more), and the place before it (other_pos -1: none).

    ``edge`` is -1, or on the first and last row of a partition its number."""
    names = [*PLACE, "reach", "single", "other_uid", "other_pos", "edge"]
    kinds = [*[np.int64] * 5, np.int32, np.int64, np.int32, np.int32, np.int32, np.int64, np.int32, np.int64]
    schema = ", ".join(f"{c} long" for c in PLACE[:5]) + ", nth int, uid long, pos int, reach int, single int, other_uid long, other_pos int, edge long"

    def work(cols, old, starts, ends):
        if old < 0:
            yield _batch([*([r[1 + i] for r in cols] for i in range(len(PLACE))), [0] * len(cols), [0] * len(cols), [0] * len(cols), [-1] * len(cols), [r[0] for r in cols]], names, kinds)
            return
        at, same, best, equal = _compared(cols, [1, 2], old, starts, ends)
        twin = equal & (min_words <= PREFIX + SPAN)  # equal keys tell of SPAN words before a place and PREFIX + SPAN from it on
        single = _many_surroundings(same, twin) & ~twin
        next_same = np.concatenate([same[1:], [ends]])
        at = at[same[at] | next_same[at] | (starts & (at == 0))]
        if not len(at):
            return
        uid, pos = cols[6], cols[7]
        before = np.maximum(at - 1, 0)
        other = same[at] & ((uid[at] != uid[before]) | (pos[at] != pos[before]))  # a repeated row is no neighbour
        yield _batch([*(c[at] for c in cols[:8]), best[at], single[at], uid[before], np.where(other, pos[before], -1), np.full(len(at), -1)], names, kinds)

    return sorted_chunks(suffixes, ["first", *SIDES[0], *SIDES[1], "nth", "uid", "pos"], [], schema, work)


def backward_pairs(places: DataFrame, min_words: int) -> DataFrame:
    """Pairs (uid, pos, other_uid, other_pos) of places that may hold a passage, neighbours in either order; with other_pos -1 a single place.

    ``edge`` as in forward_places, with the prefix of the row."""
    names = ["uid", "pos", "other_uid", "other_pos", "edge", "edge_key"]
    kinds = [np.int64, np.int32, np.int64, np.int32, np.int64, np.int64]

    def work(cols, old, starts, ends):
        if old < 0:
            yield _batch([[r[7] for r in cols], [r[8] for r in cols], [0] * len(cols), [0] * len(cols), [r[0] for r in cols], [r[1] for r in cols]], names, kinds)
            return
        at, same, best, equal = _compared(cols, [3, 4], old, starts, ends)
        reach, single, uid, pos = cols[8], cols[9], cols[6], cols[7]
        possible = (best == SPAN) | (reach == SPAN) | (best + PREFIX + reach >= min_words) if min_words > 2 * SPAN else best + PREFIX + reach >= min_words
        at = at[possible[at]]
        if not len(at):
            return
        before = np.maximum(at - 1, 0)
        back = same[at] & ~equal[at] & possible[before]
        fore = cols[11][at] >= 0
        alone = single[at] > 0
        out = [
            np.concatenate([uid[at][back], uid[at][fore], uid[at][alone]]), np.concatenate([pos[at][back], pos[at][fore], pos[at][alone]]),
            np.concatenate([uid[before][back], cols[10][at][fore], np.zeros(int(alone.sum()), np.int64)]),
            np.concatenate([pos[before][back], cols[11][at][fore], np.full(int(alone.sum()), -1)]),
        ]
        if len(out[0]):
            yield _batch([*out, np.full(len(out[0]), -1), np.zeros(len(out[0]))], names, kinds)

    schema = "uid long, pos int, other_uid long, other_pos int, edge long, edge_key long"
    return sorted_chunks(places, ["first", *SIDES[1], *SIDES[0], "nth", "uid", "pos"], ["reach", "single", "other_uid", "other_pos"], schema, work)


def _batch(cols, names, kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(k)) for c, k in zip(cols, kinds)], names=names)


def across(edges: DataFrame, key: str) -> list[tuple]:
    """Pairs of the last row of a partition and the first of the next, two rows a partition."""
    rows = edges.where("edge >= 0").select("edge", F.col(key).alias("key"), "uid", "pos").orderBy("edge").collect()
    return [(b.uid, b.pos, a.uid, a.pos) for a, b in zip(rows[1::2], rows[2::2]) if a.key == b.key and (a.uid, a.pos) != (b.uid, b.pos)]


def owned_windows(singles: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """(hash, nth, uid, pos) of the ``min_words``-word windows whose retained suffix is one of the places (uid, pos)."""
    asked = singles.groupBy("uid").agg(F.collect_set("pos").alias("asked"))

    def run(batches):
        for batch in batches:
            for uid, words, places in zip(batch.column(0).to_pylist(), word_hashes_of(texts_of(batch.column(1))), batch.column(2).to_pylist()):
                hashes = gram_hashes(words, min_words)
                owner = least_positions(gram_hashes(words, PREFIX), WINDOW)[: len(hashes)]
                at = np.flatnonzero(np.isin(owner, np.array(places)))
                if len(at):
                    found = hashes[at].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found), pa.array(occurrence(found).astype(np.int32)), pa.array(np.full(len(at), uid, np.int64)), pa.array(at.astype(np.int32))], names=["hash", "nth", "uid", "pos"]
                    )

    return docs.join(asked, "uid").dropDuplicates(["uid"]).select("uid", "text", "asked").mapInArrow(run, "hash long, nth int, uid long, pos int")


def matches(docs: DataFrame, min_words: int) -> DataFrame:
    """Matches (uid, pos, other_uid, other_pos, size) of two places with ``size`` equal words."""
    spark = docs.sparkSession
    kind = "uid long, pos int, other_uid long, other_pos int"
    suffixes = materialize(keyed_places(docs, suffix_places, PLACE[:5]), "suffixes")
    forward = materialize(forward_places(suffixes, min_words), "suffixes-behind")
    discard(suffixes)
    found = materialize(backward_pairs(forward.where("edge < 0"), min_words), "suffixes-before")
    edges = across(forward, "first") + across(found, "edge_key")
    discard(forward)
    places = found.where("edge < 0")
    pairs = places.where("other_pos >= 0").select("uid", "pos", "other_uid", "other_pos")
    if edges:
        pairs = pairs.union(spark.createDataFrame(edges, kind))
    windows = materialize(owned_windows(places.where("other_pos < 0"), docs, min_words), "suffix-windows")
    rest = neighbours(windows, ["hash"], "suffix-windows")
    return pairs.withColumn("size", F.lit(PREFIX)).union(rest.withColumn("size", F.lit(min_words)))


def runs(pairs: DataFrame) -> DataFrame:
    """Matches of one diagonal of two documents joined: (uid, low, high, other_uid, other_low), smaller side first."""
    first = (F.col("uid") < F.col("other_uid")) | ((F.col("uid") == F.col("other_uid")) & (F.col("pos") <= F.col("other_pos")))
    one = pairs.select(
        F.when(first, F.col("uid")).otherwise(F.col("other_uid")).alias("uid"), F.when(first, F.col("pos")).otherwise(F.col("other_pos")).alias("pos"),
        F.when(first, F.col("other_uid")).otherwise(F.col("uid")).alias("other_uid"),
        F.when(first, F.col("other_pos") - F.col("pos")).otherwise(F.col("pos") - F.col("other_pos")).alias("shift"), "size",
    ).withColumn("end", F.col("pos") + F.col("size"))
    w = Window.partitionBy("uid", "other_uid", "shift").orderBy("pos")
    new = F.when(F.col("pos") <= F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    grouped = one.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("uid", "other_uid", "shift", "run").agg(F.min("pos").alias("low"), F.max("end").alias("high")).select(
        "uid", "low", "high", "other_uid", (F.col("low") + F.col("shift")).alias("other_low")
    )


def extend(a: np.ndarray, b: np.ndarray, a_left: int, b_left: int, size: int) -> tuple[int, int]:
    """Words that match on from a run, to the left and to the right; a_left, b_left: words held before it."""
    n = min(a_left, b_left)
    left = _agree(a[a_left - n : a_left][::-1], b[b_left - n : b_left][::-1])
    x, y = a[a_left + size :], b[b_left + size :]
    n = min(len(x), len(y))
    return left, _agree(x[:n], y[:n])


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else len(x)


def repeated_passages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row a maximal repeated passage of a document. ``min_words`` of at least PREFIX + WINDOW - 1 loses none."""
    docs = identified(documents, id_col, text_col)
    found = materialize(runs(matches(docs, min_words)), "suffix-runs")
    sides = found.select("uid", "low", "high", F.col("uid").alias("a"), F.col("low").alias("a_low"), F.col("other_uid").alias("b"), F.col("other_low").alias("b_low"), F.lit(0).alias("side")).union(
        found.select(F.col("other_uid").alias("uid"), F.col("other_low").alias("low"), (F.col("other_low") + F.col("high") - F.col("low")).alias("high"), "uid", "low", "other_uid", "other_low", F.lit(1))
    )
    words = with_words(sides, docs, ["a", "a_low", "b", "b_low", "side"], MARGIN)
    row = F.struct("side", "doc_id", "words")
    both = words.groupBy("a", "a_low", "b", "b_low").agg(F.max(F.col("high") - F.col("low")).alias("size"), F.min(row).alias("x"), F.max(row).alias("y"))
    both = both.select("a", "a_low", "b", "b_low", "size", F.col("x.doc_id").alias("a_doc"), F.col("x.words").alias("aw"), F.col("y.doc_id").alias("b_doc"), F.col("y.words").alias("bw"))

    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(5)]
            for a, al, b, bl, size, ad, aw, bd, bw in zip(*(batch.column(i).to_pylist() for i in range(9))):
                left, right = extend(np.frombuffer(aw, np.uint32), np.frombuffer(bw, np.uint32), min(al, MARGIN), min(bl, MARGIN), size)
                if left + size + right < min_words:
                    continue
                for uid, low, doc, other in ((a, al, ad, bd), (b, bl, bd, ad)):
                    for c, v in zip(cols, (uid, doc, low - left, low + size + right, other)):
                        c.append(v)
            if cols[0]:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["uid", "doc_id", "low", "high", "other_doc"])

    spans = both.mapInArrow(run, "uid long, doc_id long, low int, high int, other_doc long").withColumn("identity", F.lit(1.0))
    return merged_spans(spans)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
