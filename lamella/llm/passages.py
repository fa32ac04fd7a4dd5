"""What both passage operators share: sorted neighbours, and words around places.

A document's identity here is ``uid``, a 64-bit hash of its id and text, so
that null ids and ids shared by different texts are told apart; rows that
repeat id and text are one document.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import materialize, texts_of
from lamella.llm.words import occurrence, word_hashes_of

#: Bytes of words that with_words holds before it puts them out.
WORDS_BYTES = 8 << 20


def identified(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("doc_id", "text").alias("uid"), "text"
    )


def keyed_places(documents: DataFrame, places: Callable[[np.ndarray], tuple[np.ndarray, ...]], keys: list[str]) -> DataFrame:
    """Rows (keys..., nth, uid, pos) of the places that ``places`` picks among a text's word hashes; nth counts equal first keys of the text."""
    names = [*keys, "nth", "uid", "pos"]
    schema = ", ".join(f"{k} long" for k in keys) + ", nth int, uid long, pos int"

    def run(batches):
        for batch in batches:
            cols = [[] for _ in names]
            for uid, words in zip(batch.column(0).to_pylist(), word_hashes_of(texts_of(batch.column(1)))):
                *hashes, pos = places(words)
                if len(pos):
                    for c, h in zip(cols, hashes):
                        c.append(h.view(np.int64))
                    cols[-3].append(occurrence(hashes[0]).astype(np.int32))
                    cols[-2].append(np.full(len(pos), uid, np.int64))
                    cols[-1].append(pos.astype(np.int32))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=names)

    return documents.select("uid", "text").mapInArrow(run, schema)


def neighbours(written: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Pairs (uid, pos, other_uid, other_pos) of rows next to each other in the order of (keys, nth, uid, pos) that share the first key.

    By ``nth`` the first places of all texts stand together, then the second
    ones: texts that repeat a line are joined to each other, not only to themselves.

    Range partitions over the whole sort key split a hot key, as a row needs
    only the one before it. The pairs across two partitions come from the
    partitions' first and last rows, two rows a partition. ``written`` is read
    twice, so it should be a table.
    """
    spark = written.sparkSession
    order = [*keys, "nth", "uid", "pos"]
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written.repartitionByRange(count, *order).sortWithinPartitions(*order).select(keys[0], "uid", "pos")
    names = ["uid", "pos", "other_uid", "other_pos", "edge", "edge_key"]

    def run(batches):
        part, last, first = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, uid, pos = (batch.column(i).to_numpy() for i in range(3))
            if last is None:
                first = (key[0], uid[0], pos[0])
            else:
                key, uid, pos = (np.concatenate([[a], b]) for a, b in zip(last, (key, uid, pos)))
            last = (key[-1], uid[-1], pos[-1])
            same = (key[1:] == key[:-1]) & ((uid[1:] != uid[:-1]) | (pos[1:] != pos[:-1]))  # a repeated row is no neighbour
            n = int(same.sum())
            if n:
                yield out(uid[1:][same], pos[1:][same], uid[:-1][same], pos[:-1][same], np.full(n, -1), np.zeros(n))
        if last is not None:
            for k, (key, uid, pos) in enumerate((first, last)):
                yield out([uid], [pos], [0], [0], [2 * part + k], [key])

    def out(*cols):
        kinds = (np.int64, np.int32, np.int64, np.int32, np.int64, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, dtype=t)) for c, t in zip(cols, kinds)], names=names)

    found = materialize(dealt.mapInArrow(run, "uid long, pos int, other_uid long, other_pos int, edge long, edge_key long"), label + "-pairs")
    edges = found.where("edge >= 0").select("edge", "edge_key", "uid", "pos").orderBy("edge").collect()
    across = [(b.uid, b.pos, a.uid, a.pos) for a, b in zip(edges[1::2], edges[2::2]) if a.edge_key == b.edge_key and (a.uid, a.pos) != (b.uid, b.pos)]
    pairs = found.where("edge < 0").select(*names[:4])
    return pairs.union(spark.createDataFrame(across, "uid long, pos int, other_uid long, other_pos int")) if across else pairs


def with_words(requests: DataFrame, documents: DataFrame, carry: list[str], margin: int) -> DataFrame:
    """requests (uid, low, high, carry...) with doc_id, n_words and the word hashes of [low - margin, high + margin) as bytes.

    A document's requests are gathered in one row, so each text moves once; a
    document has at most a few for each of its own places.
    """
    fields = ["low", "high", *carry]
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    grouped = requests.groupBy("uid").agg(F.collect_list(F.struct(*fields)).alias("asked"))
    joined = grouped.join(documents, "uid").select("uid", "doc_id", "text", "asked")
    schema = "uid bigint, doc_id bigint, n_words int, " + ", ".join(f"{f} {kinds[f]}" for f in fields) + ", words binary"

    arrow = {"bigint": pa.int64(), "int": pa.int32()}
    types = [pa.int64(), pa.int64(), pa.int32(), *(arrow[kinds[f]] for f in fields), pa.binary()]

    def run(batches):
        for batch in batches:
            cols, size = [[] for _ in types], 0
            for uid, doc, words, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), word_hashes_of(texts_of(batch.column(2))), batch.column(3).to_pylist()):
                h = (words & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                for q in asked:
                    part = h[max(0, q["low"] - margin) : q["high"] + margin].tobytes()
                    size += len(part)
                    for c, v in zip(cols, (uid, doc, len(h), *(q[f] for f in fields), part)):
                        c.append(v)
                    if size >= WORDS_BYTES:
                        yield out(cols)
                        cols, size = [[] for _ in types], 0
            if cols[0]:
                yield out(cols)

    def out(cols):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["uid", "doc_id", "n_words", *fields, "words"])

    return joined.mapInArrow(run, schema)


def merged_spans(sides: DataFrame) -> DataFrame:
    """Spans (doc_id, uid, low, high, other_doc, identity) that touch or overlap united: one row a run of words.

    Each span must be long enough by itself; nothing is filtered here. A document's spans number a few for each of its own places, so a window
    over one document is bounded by its length.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("uid").orderBy("low", "high")
    before = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = sides.withColumn("new", F.when(F.col("low") <= before, 0).otherwise(1))
    islands = starts.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy("uid", "island").agg(
        F.first("doc_id").alias("doc_id"), F.min("low").alias("start_word"), F.max("high").alias("end_word"),
        F.sort_array(F.collect_set("other_doc")).alias("other_docs"), F.max("identity").alias("identity"),
    )
    return out.select(
        "doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_docs", "identity"
    )
