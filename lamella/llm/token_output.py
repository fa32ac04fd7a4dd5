"""Packed token matrices: best-fit-decreasing with a segment tree over free capacities.

Whole texts become token ids plus a closing id; documents longer than a row
are cut losslessly into pieces of ``capacity`` tokens. Within a task pieces
are gathered into shards of a bounded number of tokens and packed, so there is
no shuffle and no state beyond a shard. Each result row is one row of an id
matrix with its cumulative segment lengths and the offsets at which positions
start again. ``write_matrices`` stores them as binary files: for each shard the
raw id matrix, row after row of little-endian unsigned 32-bit ids, and an index
with the documents, cumulative segment lengths and position resets of its rows;
``read_matrix`` maps them into memory again.

Defined results: a null or empty text is one segment holding the closing id;
repeated rows are packed as often as they stand; a null doc_id stays null in
the lists; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import table, texts_of
from lamella.llm.tokens import held_tokenizer, tokenizer_path

CAPACITY = 2048
SHARD_TOKENS = 1 << 21
CLOSING_ID = 0
PAD_ID = 0

ROW = (
    "shard long, row int, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, "
    "position_resets array<int>, ids binary"
)
_ARROW = pa.schema(
    [
        ("shard", pa.int64()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())),
        ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("ids", pa.binary()),
    ]
)


class CapacityTree:
    """Bins by free capacity; finds the least capacity that is enough in O(log capacity)."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, free: int, by: int) -> None:
        at = free + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def add(self, free: int, bin_: int) -> None:
        self.bins[free].append(bin_)
        self._change(free, 1)

    def pop(self, need: int) -> tuple[int, int] | None:
        """(free, bin) of a bin with the least free capacity of at least ``need``, taken out."""
        at, count = need + self.leaves, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        free = at - self.leaves
        self._change(free, -1)
        return free, self.bins[free].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``lengths`` by bin; every length is at most ``capacity``."""
    tree, bins = CapacityTree(capacity), []
    for at in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[at]
        if (found := tree.pop(size)) is None:
            free, bin_ = capacity, len(bins)
            bins.append([])
        else:
            free, bin_ = found
        bins[bin_].append(at)
        tree.add(free - size, bin_)
    return bins


def packed_rows(
    documents: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """One row of a packed matrix a row; ``ids`` holds ``capacity`` little-endian unsigned 32-bit ids, padded with PAD_ID."""
    path = path or tokenizer_path()
    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        tokenizer = held_tokenizer(path)
        closing = np.array([CLOSING_ID], dtype=tokenizer.kind).tobytes()
        width = tokenizer.kind.itemsize
        first = TaskContext.get().partitionId() << 24
        shard, held, tokens = 0, [], 0

        def flush():
            bins = best_fit_decreasing([len(raw) // width for _, _, raw in held], capacity)
            for low in range(0, len(bins), 256):
                rows = []
                for row, members in enumerate(bins[low : low + 256], low):
                    ids = np.full(capacity, PAD_ID, dtype="<u4")
                    joined = np.frombuffer(b"".join(held[i][2] for i in members), dtype=tokenizer.kind)
                    ids[: len(joined)] = joined
                    ends = np.cumsum([0] + [len(held[i][2]) // width for i in members]).tolist()
                    rows.append((first + shard, row, len(joined), [held[i][0] for i in members], [held[i][1] for i in members], ends, ends[:-1], ids.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                raw = tokenizer.packed(text) + closing
                for piece, start in enumerate(range(0, len(raw), capacity * width)):
                    part = raw[start : start + capacity * width]
                    held.append((doc, piece, part))
                    tokens += len(part) // width
                    if tokens >= shard_tokens:
                        yield from flush()
                        shard, held, tokens = shard + 1, [], 0
        if held:
            yield from flush()

    return source.mapInArrow(run, ROW)


def position_ids(cu_seqlens: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """Positions within segments; padding counts on from 0."""
    out = np.arange(capacity, dtype=np.int32)
    for start in [*cu_seqlens[1:]]:
        if start < capacity:
            out[start:] = np.arange(capacity - start, dtype=np.int32)
    return out


INDEX = ("row_segments", "doc_ids", "null_ids", "pieces", "cu_seqlens", "position_resets")
FILES = "shard long, rows long, n_tokens long, ids_file string, index_file string, ids_sha256 string"


def write_matrices(rows: DataFrame, folder: str) -> DataFrame:
    """Packed rows as files in a folder that all executors can write to (a mounted shared disk); one row a shard.

    ``shard-X.ids``: the matrix. ``shard-X.npz``: row_segments (the first segment of each row, and the number of
    segments), doc_ids and null_ids (1 where the id is null), pieces and position_resets by segment, cu_seqlens
    (a row with k segments has k + 1 values). Files are written beside their place and renamed, and named
    by the shard: a task that runs again, or twice, leaves the same files. ``rows`` are the rows of packed_rows,
    not dealt anew, so that the rows of a shard follow each other in one task. The result has to be consumed.
    """

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        held, now = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != now and held:
                    yield _write_shard(folder, held)
                    held = []
                now = row["shard"]
                held.append(row)
        if held:
            yield _write_shard(folder, held)

    return rows.mapInArrow(run, FILES)


def _write_shard(folder: str, rows: list[dict]) -> pa.RecordBatch:
    base = os.path.join(folder, f"shard-{rows[0]['shard']:012x}")
    ids = b"".join(r["ids"] for r in rows)
    docs = [d for r in rows for d in r["doc_ids"]]
    arrays = (
        np.cumsum([0] + [len(r["doc_ids"]) for r in rows], dtype=np.int64), np.array([d or 0 for d in docs], np.int64), np.array([d is None for d in docs], np.uint8),
        *(np.array([x for r in rows for x in r[c]], np.int32) for c in ("pieces", "cu_seqlens", "position_resets")),
    )
    index = io.BytesIO()
    np.savez(index, **dict(zip(INDEX, arrays)))
    for name, data in ((base + ".ids", ids), (base + ".npz", index.getvalue())):
        part = f"{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, name)
    found = (rows[0]["shard"], len(rows), sum(r["n_tokens"] for r in rows), base + ".ids", base + ".npz", hashlib.sha256(ids).hexdigest())
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(found, kinds)], names=[f.split()[0] for f in FILES.split(", ")])


def read_matrix(ids_file: str, index_file: str, capacity: int = CAPACITY) -> tuple[np.ndarray, list[dict]]:
    """The id matrix of a shard, mapped, and doc_ids, pieces, cu_seqlens and position_resets of each row."""
    matrix = np.memmap(ids_file, "<u4", "r").reshape(-1, capacity)
    with np.load(index_file) as index:
        first, docs, null, pieces, ends, resets = (index[c] for c in INDEX)
    out = []
    for k, (i, j) in enumerate(zip(first.tolist(), first[1:].tolist())):
        ids = [None if n else d for d, n in zip(docs[i:j].tolist(), null[i:j].tolist())]
        out.append({"doc_ids": ids, "pieces": pieces[i:j].tolist(), "cu_seqlens": ends[i + k : j + k + 1].tolist(), "position_resets": resets[i:j].tolist()})
    return matrix, out


def op8_token_output(spark, sf_dir: str) -> DataFrame:
    return packed_rows(table(spark, sf_dir, "documents"))
