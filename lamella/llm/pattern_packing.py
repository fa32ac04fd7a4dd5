"""Pattern packing: few-document length patterns fitted to the length histogram by non-negative least squares.

1. Every whole text becomes token ids plus a closing id 0; longer documents
   are cut into pieces of ``capacity`` tokens. Pieces are written out once,
   each with its rank among the pieces of its length in its partition.
2. The histogram of lengths, of ``capacity`` entries at most, goes to the
   driver. Patterns of up to four lengths (in units of capacity/128) that fill
   a sequence are enumerated, their repeat counts fitted by non-negative least
   squares and rounded. Exact lengths are laid into all places of a pattern but
   its smallest by runs; the smallest takes the length that closes the sequence
   exactly, or the next shorter one within ``SLACK`` units; a pattern that no
   length closes is taken up again. What is left is fitted again, ``ROUNDS`` times at most. Residual pieces go
   best-fit-decreasing into the room that is left, then into new sequences. The
   driver never sees a document.
3. A piece finds its place from its length and its global rank among the
   pieces of that length, by a search in the broadcast plan.

Defined results: a null or empty text is one piece holding only the closing
id; repeated rows are packed as often as they stand; a null doc_id is kept.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.llm.common import arrow_type, materialize, table, texts_of
from lamella.llm.tokens import held_tokenizer, tokenizer_path

CAPACITY = 2048
CLOSING_ID = 0
UNITS = 128
PARTS = 4
#: Units that the closing length of a pattern may fall short of its room.
SLACK = 2
#: Fits one after the other, each to what those before have left; a fit that lays less than LEAST of it is the last.
ROUNDS = 4
LEAST = 0.02
#: Scales of the fitted counts, tried in this order, and the share of sequences that patterns may cost.
SCALES = (1.0, 0.5, 0.25, 0.0)
WORSE = 0.001


def pieces_of(
    documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32[, ids], chunk and rank in the chunk."""
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = [
        source.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if with_ids else []),
        T.StructField("chunk", T.IntegerType()), T.StructField("local", T.LongType()),
    ]

    def run(batches):
        tokenizer = held_tokenizer(path)
        chunk = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        closing = np.array([CLOSING_ID], dtype=tokenizer.kind)
        for batch in batches:
            if not batch.num_rows:
                continue
            owner, cols = [], [[] for _ in fields[1:]]
            for at, packed in enumerate(map(tokenizer.packed, texts_of(batch.column(1)))):
                ids = np.concatenate([np.frombuffer(packed, dtype=tokenizer.kind), closing]).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    raw = ids[start : start + capacity].tobytes()
                    size = len(raw) // 4
                    owner.append(at)
                    row = (piece, start, size, zlib.crc32(raw), *((raw,) if with_ids else ()), chunk, seen[size])
                    seen[size] += 1
                    for c, v in zip(cols, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, arrow_type(f.dataType)) for c, f in zip(cols, fields[1:]))],
                names=[f.name for f in fields],
            )

    return source.mapInArrow(run, T.StructType(fields))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. The table of pieces is read twice, so it should be written out."""
    counts = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("chunk", "length", F.coalesce(before, F.lit(0)).alias("base"))
    placed = pieces.join(bases, ["chunk", "length"])
    plan = pieces.sparkSession.sparkContext.broadcast(Placement(plan_sequences(histogram, capacity)))
    keep = [c for c in pieces.columns if c not in ("chunk", "local")]
    source = placed.select(*keep, (F.col("base") + F.col("local")).alias("__rank"))
    schema = T.StructType([*(pieces.schema[c] for c in keep), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = keep.index("length")

    def run(batches):
        for b in batches:
            if b.num_rows:
                sequence, offset = plan.value.find(b.column(at).to_numpy(), b.column(len(keep)).to_numpy())
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(sequence), pa.array(offset)], names=schema.names)

    return source.mapInArrow(run, schema)


class Placement:
    """For each length, intervals of ranks with the first sequence and the offset."""

    def __init__(self, groups: list[tuple[int, list[int]]]):
        rows, used, first = [], {}, 0
        for count, lengths in groups:
            offset = 0
            for size in lengths:
                low = used.get(size, 0)
                rows.append((size, low, first, offset))
                used[size] = low + count
                offset += size
            first += count
        rows.sort()
        self.sequences = first
        self.size, self.low, self.first, self.offset = (np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
        self.key = self._keys(self.size, self.low)

    @staticmethod
    def _keys(size, rank):
        return (size << np.int64(44)) + rank

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, self._keys(size.astype(np.int64), rank.astype(np.int64)), side="right") - 1
        return self.first[at] + rank - self.low[at], self.offset[at]


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Groups (repeat count, lengths) that hold the histogram exactly.

    In small or ragged histograms patterns can take lengths that others need. The fitted counts are then
    scaled down until at most ``WORSE`` more sequences, and one, come out than by best fit alone.
    """
    least = None
    for scale in SCALES:
        left = {size: n for size, n in histogram.items() if n and size < capacity}
        groups = [(histogram[capacity], [capacity])] if histogram.get(capacity) else []
        if least is None:
            least = sum(n for n, _ in best_fit(list(groups), dict(left), capacity))
        plan = best_fit(groups + fit_patterns(left, capacity, scale), left, capacity)
        if sum(n for n, _ in plan) <= least * (1 + WORSE) + 1:
            return plan
    return plan


def pattern_share(histogram: dict[int, int], capacity: int = CAPACITY) -> float:
    """Share of the pieces below ``capacity`` that patterns place."""
    left = {size: n for size, n in histogram.items() if n and size < capacity}
    total = sum(left.values())
    fit_patterns(left, capacity)
    return 1 - sum(left.values()) / total if total else 1.0


def fit_patterns(left: dict[int, int], capacity: int, scale: float = 1.0) -> list[tuple[int, list[int]]]:
    """Patterns laid with exact lengths; what they take is subtracted from ``left``."""
    units = min(UNITS, capacity)
    patterns, groups = None, []
    for _ in range(ROUNDS):
        before = sum(left.values())
        bins = Bins(left, capacity, units)
        if patterns is None:
            patterns = enumerate_patterns(units, PARTS, set(bins.sizes))
        if not len(patterns):
            break
        usable = patterns[(bins.count[patterns] > 0).all(axis=1)]
        if not len(usable):
            break
        x = nonnegative_least_squares(usable, bins.count.astype(float), units) * scale
        for p in np.argsort(-x, kind="stable"):
            if x[p] < 0.5:
                break
            groups += lay(bins, [int(u) for u in usable[p] if u <= units], int(x[p] + 0.5), capacity)
        if sum(left.values()) > (1 - LEAST) * before:
            break
    return groups


class Bins:
    """Lengths by unit with what is left of each. ``left`` is changed in place."""

    def __init__(self, left: dict[int, int], capacity: int, units: int):
        self.left, self.width = left, capacity / units
        self.unit = {size: min(units, max(1, int(size / self.width + 0.5))) for size in left if left[size]}
        self.sizes: dict[int, list[int]] = {}
        self.count = np.zeros(units + 2, np.int64)
        self.count[units + 1] = 1  # the unused places of a pattern
        for size in sorted(self.unit):
            self.sizes.setdefault(self.unit[size], []).append(size)
            self.count[self.unit[size]] += left[size]
        self.open = sorted(self.unit)

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        self.count[self.unit[size]] -= n
        if not self.left[size]:
            self.sizes[self.unit[size]].remove(size)
            self.open.pop(bisect_left(self.open, size))

    def run(self, unit: int, n: int, top: bool) -> list[tuple[int, int]]:
        """``n`` lengths of a unit, the longest or the shortest first, as (length, repeats)."""
        out = []
        while n:
            size = self.sizes[unit][-1 if top else 0]
            now = min(n, self.left[size])
            out.append((size, now))
            self.take(size, now)
            n -= now
        return out

    def give(self, size: int, n: int) -> None:
        if not self.left[size]:
            insort(self.sizes[self.unit[size]], size)
            insort(self.open, size)
        self.left[size] += n
        self.count[self.unit[size]] += n

    def closing(self, room: int) -> int | None:
        """The longest length that is left within the room, if it falls short by SLACK units at most."""
        at = bisect_right(self.open, room) - 1
        return self.open[at] if at >= 0 and self.open[at] >= room - SLACK * self.width else None


def lay(bins: Bins, parts: list[int], times: int, capacity: int) -> list[tuple[int, list[int]]]:
    """A pattern up to ``times`` times: runs in all places but the smallest, which takes what closes the sequence."""
    first = parts[:-1] or parts
    times = int(min([times, *(bins.count[u] // first.count(u) for u in set(first))]))
    if times <= 0:
        return []
    out = []
    for count, sizes in merge_runs([bins.run(u, times, top=bool(j % 2)) for j, u in enumerate(first)]):
        while sum(sizes) > capacity:  # rounding to units can overfill a sequence; its shortest length goes back
            bins.give(sizes.pop(sizes.index(min(sizes))), count)
        while count and len(parts) > 1 and (size := bins.closing(capacity - sum(sizes))) is not None:
            now = min(count, bins.left[size])
            bins.take(size, now)
            out.append((now, [*sizes, size]))
            count -= now
        if count and len(parts) > 1:  # nothing closes these: they are left to the next fit or to best fit
            for size in sizes:
                bins.give(size, count)
        elif count and sizes:
            out.append((count, sizes))
    return out


def enumerate_patterns(units: int, parts: int, present: set[int]) -> np.ndarray:
    """All ways to fill ``units`` by 1 to ``parts`` present lengths, largest first; unused places hold units + 1."""
    found: list[list[int]] = []
    sizes = sorted(present, reverse=True)

    def grow(prefix: list[int], rest: int, most: int) -> None:
        if len(prefix) == parts - 1:
            if rest <= most and rest in present:
                found.append([*prefix, rest])
            return
        for s in sizes:
            if s > most or s > rest:
                continue
            if s * (parts - len(prefix)) < rest:
                break
            if s == rest:
                found.append([*prefix, s, *[units + 1] * (parts - len(prefix) - 1)])
            else:
                grow([*prefix, s], rest - s, s)

    grow([], units, units)
    return np.array(found, dtype=np.int64).reshape(-1, parts)


def nonnegative_least_squares(patterns: np.ndarray, h: np.ndarray, units: int) -> np.ndarray:
    """Active-set solution of min |A x - h| with x >= 0, where column p of A counts the lengths of pattern p."""
    x = np.zeros(len(patterns))
    active: list[int] = []
    columns = np.zeros((units + 2, 0))
    target = h.copy()
    target[units + 1] = 0
    tol = 1e-9 * max(1.0, float(h.max())) * units

    def column(p: int) -> np.ndarray:
        c = np.bincount(patterns[p], minlength=units + 2).astype(float)
        c[units + 1] = 0
        return c

    for _ in range(6 * units):
        rest = target - (columns @ x[active] if active else 0)
        gain = rest[patterns].sum(axis=1)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= tol:
            break
        active.append(best)
        columns = np.column_stack([columns, column(best)])
        while True:
            gram = columns.T @ columns
            gram[np.diag_indices_from(gram)] += 1e-9
            s = np.linalg.solve(gram, columns.T @ target)
            if s.min() > 1e-12:
                x[active] = s
                break
            now = x[active]
            low = s <= 1e-12
            step = float(np.min(now[low] / np.maximum(now[low] - s[low], 1e-300)))
            now = np.maximum(now + min(1.0, step) * (s - now), 0)
            x[active] = now
            stay = (now > 1e-12) | ~low
            for p in [a for a, ok in zip(active, stay) if not ok]:
                x[p] = 0
            active = [a for a, ok in zip(active, stay) if ok]
            columns = columns[:, stay]
            if not active:
                break
    return x


def merge_runs(slots: list[list[tuple[int, int]]]) -> list[tuple[int, list[int]]]:
    """Rows of equal lengths: [(3, a), (2, b)] beside [(5, c)] is 3 of (a, c) and 2 of (b, c)."""
    edges = sorted({int(e) for s in slots for e in np.cumsum([n for _, n in s])})
    ends = [np.cumsum([n for _, n in s]) for s in slots]
    out, low = [], 0
    for high in edges:
        out.append((high - low, [s[int(np.searchsorted(e, low, side="right"))][0] for s, e in zip(slots, ends)]))
        low = high
    return out


def best_fit(groups: list[tuple[int, list[int]]], left: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit-decreasing by runs of equal lengths into open groups, then into new ones."""
    rooms: dict[int, list[tuple[int, list[int]]]] = {}
    for count, sizes in groups:
        rooms.setdefault(capacity - sum(sizes), []).append((count, sizes))
    order = sorted(r for r in rooms)

    def put(room: int, group: tuple[int, list[int]]) -> None:
        if not rooms.get(room):
            rooms[room] = []
            insort(order, room)
        rooms[room].append(group)

    for size in sorted((s for s in left if left[s]), reverse=True):
        count = left[size]
        while count:
            at = bisect_left(order, size)
            if at == len(order):
                each = capacity // size
                full, rest = divmod(count, each)
                if full:
                    put(capacity - each * size, (full, [size] * each))
                if rest:
                    put(capacity - rest * size, (1, [size] * rest))
                break
            room = order[at]
            n, sizes = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            now = min(n, count)
            if now < n:
                put(room, (n - now, sizes))
            put(room - size, (now, [*sizes, size]))
            count -= now
    return [g for r in sorted(rooms) for g in rooms[r]]


def pack_documents(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, **columns) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset: one row a piece."""
    return pack(materialize(pieces_of(documents, path or tokenizer_path(), capacity=capacity, with_ids=with_ids, **columns), "pieces"), capacity)


def op6_pattern_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
