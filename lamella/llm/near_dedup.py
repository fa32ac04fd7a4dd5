"""Near-duplicate groups by a chosen-path set similarity join.

A document is the set of its distinct five-word shingles (words between ASCII
white space, A-Z lower-cased). Documents of the same set form one class; the
join works on the classes.

1. A class carries ``SIZE`` minwise tokens. In each of ``TREES`` independent
   trees a node picks one or two of the token positions, by a hash of its
   path, 4/3 on average (the branching 1 / threshold that keeps a pair at the
   threshold alive in expectation), and every member goes to the child named
   by its token there. Nodes of up to ``LEAF`` members are compared
   exhaustively on sketches, by a walk that leaves out only comparisons of
   members already linked; larger ones branch again, ``DEPTH`` levels at
   most, after which a large node counts as one candidate group. Each level
   makes 3/2 rows of one on average, so the rows follow the members, not their square.
2. Sketch matches, as spanning trees of the nodes, are united to candidate
   groups, supersets of the true groups. Their members' full shingle sets are
   read again from the texts and compared in blocks of ``BLOCK``: pairs in
   falling order of sketch similarity, each confirmed on the full sets unless
   its members are linked already.
3. Groups of several blocks are first drawn together around pivots, the
   members with most matches in their blocks, which are compared with every
   block. What is still apart is compared in blocks of queries against all
   blocks of its group, so no link is left out and no group is gathered.
4. Confirmed links give the components.

A pair at similarity 0.75 misses all leaves of TREES trees with probability
below 1e-5 at the root level. Sketches cut at 0.75 less four standard errors.

Defined results: null, empty and blank texts have an empty set and are linked
with nothing (component is the own id); with fewer than five words the whole
sequence is one shingle. Rows that repeat are members of one class. A null
doc_id doesn't count towards the smallest id; a component of null ids only has
a null component_id and its rows have kept false. An empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import discard, materialize, table, texts_of
from lamella.llm.components import components
from lamella.llm.tokens import release_tokenizers
from lamella.llm.words import gram_hashes, mix, word_hashes, word_hashes_of

SHINGLE = 5
THRESHOLD = 75  # per cent
SIZE = 128
TREES = 10
#: Most members of a node that one task compares, all with each other: half a megabyte of sketches.
LEAF = 4096
DEPTH = 4
BLOCK = 128
PIVOTS = 4
#: Join keys that a group's rows are spread over.
SALT = 32
#: Of 128 one-byte sketch positions: 0.75 less four standard errors of 0.038.
SKETCH_CUT = int(SIZE * 0.597)

_RNG = np.random.default_rng(20)
_MULTIPLIERS = _RNG.integers(0, 1 << 31, SIZE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _RNG.integers(0, 1 << 32, SIZE, dtype=np.uint32)


def shingles(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it is shorter."""
    return shingles_of(word_hashes(text), k)


def shingles_of(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """shingles of the words with these hashes."""
    return np.unique(gram_hashes(words, min(k, len(words)))) if len(words) else np.zeros(0, np.uint64)


def minwise(s: np.ndarray) -> np.ndarray:
    """SIZE minwise tokens of a set."""
    low = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(low, (x[i : i + 1024, None] * _MULTIPLIERS + _OFFSETS).min(axis=0), out=low)
    return low


def linked(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """100 * intersection >= threshold * union, of sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= threshold * (len(a) + len(b) - both)


def signatures(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, uid (hash of id and text), n_shingles, sid (hash of the set) and the minwise tokens of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), "text")

    def run(batches):
        release_tokenizers()
        for batch in batches:
            n, sid, tokens = [], [], []
            for words in word_hashes_of(texts_of(batch.column(2))):
                s = shingles_of(words)
                n.append(len(s))
                sid.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
                tokens.append(minwise(s).tobytes() if len(s) else None)
            cols = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "uid", "n_shingles", "sid", "tokens"])

    return source.mapInArrow(run, "doc_id long, uid long, n_shingles long, sid long, tokens binary")


# ---------------------------------------------------------------- chosen paths


def chosen_positions(node: int, seed: int, again: bool = False) -> list[int]:
    """One or two token positions that a node branches on, by a hash of its path: 4/3 on average, 3/2 below the root's children."""
    h = int(mix(np.array([(node ^ seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0])
    first = h % SIZE
    if (h >> 20) % (2 if again else 3):
        return [first]
    return [first, (first + 1 + (h >> 40) % (SIZE - 1)) % SIZE]


def _children(nodes: np.ndarray, tokens: np.ndarray, seed: int, again: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) for the members of nodes, rows grouped by node."""
    rows, out = [], []
    for node in np.unique(nodes):
        members = np.flatnonzero(nodes == node)
        for i in chosen_positions(int(node), seed, again):
            start = np.uint64((int(node) * 31 + i * 0x51ED27 + 1) & 0xFFFFFFFFFFFFFFFF)
            rows.append(members)
            out.append(mix(mix(np.full(len(members), start)) ^ tokens[members, i].astype(np.uint64)))
    return np.concatenate(rows), np.concatenate(out)


def branch_roots(classes: DataFrame) -> DataFrame:
    """(node, sid) on the first level of all trees."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sid = batch.column(0).to_numpy()
            tokens = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(sid), SIZE)
            for tree in range(TREES):
                rows, nodes = _children(np.full(len(sid), tree + 1, np.uint64), tokens, tree)
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(sid[rows])], names=["node", "sid"])

    return classes.select("sid", "tokens").mapInArrow(run, "node long, sid long")


def gathered(rows: DataFrame, values: DataFrame, *cells: str) -> DataFrame:
    """values (sid, ...) of the classes in ``rows``, one row a class with the list ``at`` of its ``cells``.

    A class is joined once, however many nodes or blocks it is in: each of its
    cells would be a row of the join otherwise, with all its values.
    """
    return rows.groupBy("sid").agg(F.collect_list(F.struct(*cells)).alias("at")).join(values, "sid")


def branch_again(large: DataFrame, classes: DataFrame, level: int) -> DataFrame:
    """(node, sid) one level below large nodes."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = batch.column(1).value_lengths().to_numpy()
            node = batch.column(1).flatten().field("node").to_numpy().view(np.uint64)
            tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(batch.num_rows, SIZE)
            at = np.repeat(np.arange(batch.num_rows), counts)
            rows, nodes = _children(node, tokens[at], level, True)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(batch.column(0).to_numpy()[at][rows])], names=["node", "sid"])

    return gathered(large, classes.select("sid", "tokens"), "node").select("sid", "at", "tokens").mapInArrow(run, "node long, sid long")


def counted(rows: DataFrame, label: str) -> DataFrame:
    """Members of nodes of two and more, with the node's size and least member.

    The sizes are written first, so that the join reads two plain shuffles and
    adaptive execution can split a node with very many members.
    """
    sizes = materialize(rows.groupBy("node").agg(F.count("*").alias("n"), F.min("sid").alias("leader")).where("n > 1"), label + "-sizes")
    out = materialize(rows.join(sizes, "node"), label)
    discard(sizes)
    return out


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Spanning edges (a, b) of sketch matches within the leaves of all trees."""
    found, rows, used = [], branch_roots(classes), []
    for level in range(1, DEPTH + 1):
        nodes = counted(rows, f"paths-{level}")
        used.append(nodes)
        found.append(leaf_edges(nodes.where(F.col("n") <= LEAF), classes))
        large = nodes.where(F.col("n") > LEAF)
        if not large.limit(1).count():
            break
        if level == DEPTH:
            found.append(large.where("sid <> leader").select(F.col("leader").alias("a"), F.col("sid").alias("b")))
        else:
            rows = materialize(branch_again(large, classes, level + 100), f"branches-{level}")  # read twice
            used.append(rows)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    out = materialize(out.distinct(), "candidates")
    for nodes in used:
        discard(nodes)
    return out


def leaf_edges(leaves: DataFrame, classes: DataFrame) -> DataFrame:
    """All sketches of a leaf against each other; a spanning forest of the matches comes out."""
    sketches = gathered(leaves, classes.select("sid", "sketch"), "node").select(F.explode("at").alias("at"), "sid", "sketch").select("at.node", "sid", "sketch")
    return by_group(sketches, ["node"], _leaf, "a long, b long")


def _leaf(rows: list[tuple]) -> list[tuple]:
    """Spanning forest of a leaf's sketch matches, by a walk over them.

    A member reached is compared with those not reached yet and with no other,
    as the rest are in its tree or in a finished one. So members of which all
    but r match each other cost r comparisons each, not one with every other.
    """
    sids = [r[1] for r in rows]
    sketch = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), SIZE)
    apart, held, out = np.arange(len(rows)), sketch, []
    while len(apart):
        reached, apart, held = [int(apart[0])], apart[1:], held[1:]
        while reached and len(apart):
            i = reached.pop()
            near = similar(sketch[i : i + 1], held)[0] >= SKETCH_CUT
            if near.any():
                found = apart[near].tolist()
                out += [(sids[i], sids[j]) for j in found]
                reached += found
                apart, held = apart[~near], held[~near]
    return out


def similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of equal sketch positions of each pair."""
    return np.stack([(row == y).sum(axis=1, dtype=np.int16) for row in x]) if len(x) else np.zeros((0, len(y)), np.int16)


def _root(group: list[int], i: int) -> int:
    while group[i] != i:
        group[i] = group[group[i]]
        i = group[i]
    return i


def by_group(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """``work`` on the list of rows of each group; groups have a bounded size and follow each other in a sorted partition."""
    from pyspark.sql import types as T

    from lamella.llm.common import arrow_type

    k = len(keys)
    out = T._parse_datatype_string(schema)
    arrow = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in out.fields])
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(count, *keys).sortWithinPartitions(*keys)

    def run(batches):
        release_tokenizers()
        held, key, done = [], None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:k] != key:
                    if held:
                        done += work(held)
                    held, key = [], row[:k]
                    if len(done) > 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
                        done = []
                held.append(row)
        if held:
            done += work(held)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)

    return dealt.mapInArrow(run, out)


# ---------------------------------------------------------------- confirmation


def confirm(rows: list[tuple]) -> list[tuple]:
    """Spanning links among block members, confirmed on full sets.

    rows: (group, left block, right block, side, sid, part, sketch, shingles). Members with the same ``part``
    are linked already. With sides 0 and 1 only pairs across are compared,
    else (side 2) all. A last row kind carries each member's match count.
    """
    sids = [r[4] for r in rows]
    side = np.array([r[3] for r in rows])
    sketch = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(len(rows), SIZE)
    sets = [np.frombuffer(r[7], np.uint64) for r in rows]
    group, first, out = list(range(len(rows))), {}, []
    for i, r in enumerate(rows):
        if r[5] in first:
            group[i] = first[r[5]]
        first.setdefault(r[5], i)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    match = similar(sketch[left], sketch[right])
    pairs = np.argwhere(match >= SKETCH_CUT)
    pairs = pairs[np.argsort(-match[pairs[:, 0], pairs[:, 1]], kind="stable")]
    for p, q in pairs:
        i, j = int(left[p]), int(right[q])
        if i == j or side[i] == side[j] == 2 and i > j:
            continue
        if _root(group, i) != _root(group, j) and linked(sets[i], sets[j]):
            group[_root(group, i)] = _root(group, j)
            out.append((sids[i], sids[j], None))
    if (side == 2).all():
        for i, n in enumerate((match >= SIZE * THRESHOLD // 100 - 4).sum(axis=1).tolist()):
            out.append((sids[i], None, n))
    return out


PAIRED = "a long, b long, matches int"


def confirmed_links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (a, b) that span each true component. groups: (sid, group); sets: (sid, sketch, shingles)."""
    # The rank within a group is spread over 256 parts of it, so that a hot group is not sorted by one task.
    salted = groups.withColumn("part", F.pmod(F.hash("sid"), F.lit(256)))
    sizes = salted.groupBy("group", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = F.sum("n").over(Window.partitionBy("group"))
    offsets = sizes.select("group", "part", before.alias("before"), totals.alias("members"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("group", "part").orderBy("sid")))
    members = ranked.join(offsets, ["group", "part"]).select(
        "sid", "group", "members", F.floor((F.col("rank") - 1 + F.col("before")) / BLOCK).cast("int").alias("block")
    )
    members = materialize(members.join(sets, "sid"), "members")
    whole = members.select("group", F.col("block").alias("l"), F.col("block").alias("r"), F.lit(2).alias("side"), "sid", F.col("sid").alias("linked"), "sketch", "shingles")
    first = materialize(by_group(whole, ["group", "l", "r"], confirm, PAIRED), "links-1")
    links = first.where("b IS NOT NULL").select("a", "b")
    large = members.where(F.col("members") > BLOCK)
    if not large.limit(1).count():
        return links
    for step, pairing in enumerate((pivot_tasks, rest_tasks)):
        parts = components(links, f"parts-{step}")
        state = large.join(parts, F.col("sid") == F.col("node"), "left").withColumn("linked", F.coalesce("root", "sid")).drop("node", "root")
        state = materialize(state, f"state-{step}")
        more = materialize(by_group(pairing(state, first), ["group", "l", "r"], confirm, PAIRED), f"links-{step + 2}")
        links = links.union(more.where("b IS NOT NULL").select("a", "b"))
        discard(state)
    return links


def _task(frame: DataFrame, left, right, side: int, *held: str) -> DataFrame:
    return frame.select("group", left.alias("l"), right.alias("r"), F.lit(side).alias("side"), "sid", "linked", "sketch", *held)


def _dealt(members: DataFrame) -> DataFrame:
    """Members with a part number, which spreads a hot group's rows over SALT join keys."""
    return members.withColumn("part", F.pmod(F.hash("sid"), F.lit(SALT)))


def _copied(few: DataFrame) -> DataFrame:
    """Rows that belong to a whole group, one for each part of it."""
    return few.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def pivot_tasks(state: DataFrame, first: DataFrame) -> DataFrame:
    """Each block of a large group against the group's PIVOTS members with most matches."""
    matches = first.where("b IS NULL").select(F.col("a").alias("sid"), "matches")
    best = F.max_by(F.col("sid"), F.struct("matches", "sid"))
    scored = state.select("group", "block", "sid").join(matches, "sid").withColumn("slot", F.pmod(F.hash("sid"), F.lit(PIVOTS)))
    pivots = scored.groupBy("group", "slot").agg(best.alias("sid")).select("group", "sid")
    chosen = state.join(pivots, ["group", "sid"], "left_semi")  # PIVOTS rows a group at most
    blocks = state.select("group", F.col("block").alias("at")).distinct()
    return _task(state, F.col("block"), F.lit(-1), 0, "shingles").union(_task(chosen.join(blocks, "group"), F.col("at"), F.lit(-1), 1, "shingles"))


def rest_tasks(state: DataFrame, first: DataFrame) -> DataFrame:
    """Members outside their group's largest part, in blocks, against every block of the group.

    The blocks are compared on sketches first; full sets are read only for
    members with a sketch match in the other block that is not linked yet.
    """
    sizes = state.groupBy("group", "linked").agg(F.count("*").alias("n"))
    largest = materialize(sizes.groupBy("group").agg(F.max_by(F.col("linked"), F.struct("n", "linked")).alias("largest")), "largest")
    dealt = _dealt(state.drop("shingles"))
    rest = dealt.join(_copied(largest), ["group", "part"]).where("linked <> largest").drop("largest")
    blocks = state.select("group", F.col("block").alias("at")).distinct()
    asked = rest.select("group", F.col("block").alias("from")).distinct()
    left, right = rest.join(_copied(blocks), ["group", "part"]), dealt.join(_copied(asked), ["group", "part"])
    sketches = _task(left, F.col("block"), F.col("at"), 0).union(_task(right, F.col("from"), F.col("block"), 1))
    alike = materialize(by_group(sketches, ["group", "l", "r"], alike_members, "group long, l int, r int, side int, sid long"), "alike")
    held = gathered(alike, state.select("sid", "linked", "sketch", "shingles"), "group", "l", "r", "side")
    return held.select(F.explode("at").alias("at"), "sid", "linked", "sketch", "shingles").select("at.*", "sid", "linked", "sketch", "shingles")


def alike_members(rows: list[tuple]) -> list[tuple]:
    """Of two blocks (group, left block, right block, side, sid, part, sketch) the members with a sketch match across that is of another part."""
    side, part = np.array([r[3] for r in rows]), np.array([r[5] for r in rows])
    sketch = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(len(rows), SIZE)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    match = (similar(sketch[left], sketch[right]) >= SKETCH_CUT) & (part[left][:, None] != part[right][None, :])
    return [rows[i][:5] for i in [*left[match.any(axis=1)].tolist(), *right[match.any(axis=0)].tolist()]]


def full_sets(documents: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sid, sketch, shingles) for the rows (uid, sid, sketch) chosen; each text is read once more."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(F.xxhash64("doc_id", "text").alias("uid"), "text")
    joined = source.join(chosen, "uid").select("sid", "sketch", "text")

    def run(batches):
        for batch in batches:
            sets = [shingles_of(words).tobytes() for words in word_hashes_of(texts_of(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["sid", "sketch", "shingles"])

    return joined.mapInArrow(run, "sid long, sketch binary, shingles binary").dropDuplicates(["sid"])


def near_duplicate_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept; and uid, a hash of id and text."""
    rows = materialize(signatures(documents, id_col, text_col), "signatures")
    full = rows.where("sid IS NOT NULL")
    grouped = full.groupBy("sid").agg(F.min("uid").alias("uid"), F.first("tokens").alias("tokens"))

    def lows(batches):
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8)
            low = raw.reshape(-1, SIZE, 4)[:, :, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in low], pa.binary())], names=["sid", "uid", "tokens", "sketch"])

    classes = materialize(grouped.mapInArrow(lows, "sid long, uid long, tokens binary, sketch binary"), "classes")
    edges = candidate_edges(classes)
    groups = components(edges, "groups").select(F.col("node").alias("sid"), F.col("root").alias("group"))
    groups = materialize(groups, "groups")
    chosen = classes.select("sid", "uid", "sketch").join(groups.select("sid"), "sid")
    links = confirmed_links(groups, full_sets(documents, chosen, id_col, text_col))
    parts = components(links, "links").select(F.col("node").alias("sid"), F.col("root").alias("root"))
    placed = materialize(full.select("doc_id", "uid", "n_shingles", "sid").join(parts, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "placed")
    least = materialize(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    out = placed.join(least, "root").select("doc_id", "n_shingles", "component_id", "uid")
    alone = rows.where("sid IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "uid")
    return out.union(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "uid")


def keep_one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents without the rows that are not kept, columns as they were.

    Rows that repeat id and text are one document and stay or go together;
    rows with a null id, which the groups can't choose by id, all stay.
    """
    found = near_duplicate_groups(documents, id_col, text_col)
    gone = found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("uid").alias("__gone")).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    uid = F.xxhash64(F.col(id_col).cast("long"), text)
    return documents.join(gone, uid == F.col("__gone"), "left_anti")


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents")).drop("uid")
