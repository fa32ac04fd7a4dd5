"""Event-sourced document store on Parquet tables.

The log is ops(revision, seq, op, id, page, parent, position, kind, before,
after, origin, before_page, before_parent, before_position): insert, move and
delete of entities (kind null), set and unset of components (kind named). State
is a fold of the log; undo appends inverse operations as a new revision, for
which moves and deletes carry the place before, and a delete comes behind unset
rows of the components that go with it (``move_ops``, ``delete_ops``). Trees are walked level by level, graph
closures by a frontier loop of joins; recursive SQL would end at a million rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACE = ("page", "parent", "position")
CHECKPOINT_COMMITS = 1024
CHECKPOINT_BYTES = 64 << 20
#: Levels of a tree.
MAX_DEPTH = 256
#: Revisions that one task numbers.
RANGE = 1 << 16
FUNCTIONAL = ("Presents", "RecognizedFrom", "FitsTo")
#: kind -> (source kind, target kind), as far as endpoints are bound.
ENDPOINTS = {"Presents": ("layer", "content"), "RecognizedFrom": ("content", "region"), "FitsTo": ("layer", "region"), "Inside": ("region", "region")}


def history_range(ops: DataFrame, after: Column, through: Column) -> DataFrame:
    """Operations of revisions in (after, through]; sort by revision and seq where order matters."""
    return ops.where((F.col("revision") > after) & (F.col("revision") <= through))


def fold_components(ops: DataFrame) -> DataFrame:
    """Components as they stand: the last set of each (id, kind), unless unset or deleted since."""
    at = F.struct("revision", "seq")
    last = ops.where("kind IS NOT NULL").groupBy("id", "kind").agg(F.max_by(F.struct("op", "after", "origin"), at).alias("v"), F.max(at).alias("at"))
    gone = ops.where("op = 'delete'").groupBy("id").agg(F.max(at).alias("gone"))
    live = last.join(gone, "id", "left").where((F.col("v.op") == "set") & (F.col("gone").isNull() | (F.col("at") > F.col("gone"))))
    return live.select("id", "kind", F.col("v.after").alias("value"), F.col("v.origin").alias("origin"), F.col("at.revision").alias("revision"))


def fold_entities(ops: DataFrame) -> DataFrame:
    """Entities as they stand: page, parent and position of the last insert or move of those not deleted."""
    at = F.struct("revision", "seq")
    last = ops.where("op IN ('insert', 'move', 'delete')").groupBy("id").agg(F.max_by(F.struct("op", "page", "parent", "position"), at).alias("v"))
    return last.where("v.op <> 'delete'").select("id", "v.page", "v.parent", "v.position")


def recovery(checkpoint: DataFrame, ops: DataFrame, head: int, at: int) -> DataFrame:
    """Components from a checkpoint (id, kind, value, origin, revision) plus the log behind it."""
    base = checkpoint.select(F.col("revision"), F.lit(-1).alias("seq"), F.lit("set").alias("op"), "id", "kind", F.col("value").alias("after"), "origin")
    tail = history_range(ops, F.lit(at), F.lit(head)).select("revision", "seq", "op", "id", "kind", "after", "origin")
    return fold_components(base.unionByName(tail))


def inverse(ops: DataFrame) -> DataFrame:
    """Exact inverse operations: sides and places swapped, order reversed. Without before_* columns moves and deletes keep their place."""
    op = F.col("op")
    back = F.when(op == "insert", "delete").when(op == "delete", "insert").when((op == "set") & F.col("before").isNull(), "unset").when(op == "unset", "set").otherwise(op)
    sides = [("before", "after"), *((f"before_{c}", c) for c in PLACE if f"before_{c}" in ops.columns)]
    swapped = {c: F.col(d) for a, b in sides for c, d in ((a, b), (b, a))}
    return ops.withColumns({**swapped, "op": back, "seq": -F.col("seq")})


def undo(ops: DataFrame, revisions: list[int] | Column, head: int) -> DataFrame:
    """Inverse operations of revisions (a list, or a condition on the log), the latest first, as revision head + 1.

    Rows are numbered within their revision and shifted by the sizes of those before: no window runs over all of them.
    """
    chosen = revisions if isinstance(revisions, Column) else F.col("revision").isin(*sorted(set(revisions)))
    back = inverse(ops.where(chosen))
    later = Window.orderBy(F.desc("revision")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = back.groupBy("revision").agg(F.count("*").alias("__n")).select("revision", F.coalesce(F.sum("__n").over(later), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("revision").orderBy("seq")) - 1
    numbered = back.withColumn("__rank", rank).join(sizes, "revision")
    return numbered.withColumns({"seq": F.col("__rank") + F.col("__before"), "revision": F.lit(head + 1).cast("long")}).select(*ops.columns)


def _log_rows(rows: DataFrame, revision: int, **given: Column) -> DataFrame:
    """Rows of the log with the given columns; the others are null."""
    kinds = {"seq": "int", "position": "int", "before_position": "int"}
    names = ["seq", "op", "id", "page", "parent", "position", "kind", "before", "after", "origin", "before_page", "before_parent", "before_position"]
    return rows.select(F.lit(revision).cast("long").alias("revision"), *[given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in names])


def insert_ops(new: DataFrame, revision: int) -> DataFrame:
    """Inserts of entities (id, page, parent, position)."""
    return _log_rows(new, revision, seq=F.lit(0), op=F.lit("insert"), id=F.col("id"), **{c: F.col(c) for c in PLACE})


def move_ops(entities: DataFrame, moves: DataFrame, revision: int) -> DataFrame:
    """Moves (id, page, parent, position) of entities as they stand, with their place before; unknown ids give no row."""
    was = entities.select("id", *[F.col(c).alias(f"before_{c}") for c in PLACE])
    return _log_rows(moves.join(was, "id"), revision, seq=F.lit(0), op=F.lit("move"), id=F.col("id"), **{c: F.col(c) for c in (*PLACE, *(f"before_{c}" for c in PLACE))})


def set_ops(components: DataFrame, edits: DataFrame, revision: int) -> DataFrame:
    """Edits (id, kind, value, origin) of components as they stand; a null value unsets, and what changes nothing gives no row."""
    was = components.select("id", "kind", F.col("value").alias("before"))
    changed = edits.join(was, ["id", "kind"], "left").where(~F.col("value").eqNullSafe(F.col("before")))
    op = F.when(F.col("value").isNull(), "unset").otherwise("set")
    return _log_rows(changed, revision, seq=F.lit(0), op=op, id=F.col("id"), kind=F.col("kind"), before=F.col("before"), after=F.col("value"), origin=F.col("origin"))


def delete_ops(entities: DataFrame, components: DataFrame, doomed: DataFrame, revision: int) -> DataFrame:
    """Deletes of entities (id) as they stand, behind the unset rows of their components, so that undo restores both."""
    gone = components.join(doomed.select("id").distinct(), "id")
    unset = _log_rows(gone, revision, seq=F.lit(0), op=F.lit("unset"), id=F.col("id"), kind=F.col("kind"), before=F.col("value"), origin=F.col("origin"))
    rows = entities.join(doomed.select("id").distinct(), "id")
    return unset.union(_log_rows(rows, revision, seq=F.lit(1), op=F.lit("delete"), id=F.col("id"), **{f"before_{c}": F.col(c) for c in PLACE}))


def place_violations(entities: DataFrame, pages: DataFrame, moves: DataFrame) -> DataFrame:
    """Why moves or inserts (id, page, parent, position) can't be made: a page (id) below the root, an unknown parent, a parent in the own subtree."""
    below = moves.where("parent IS NOT NULL")
    not_root = below.join(pages.select("id"), "id", "left_semi").select("id", F.lit("page below the root").alias("why"))
    known = entities.select("id").union(moves.select("id")).distinct().select(F.col("id").alias("parent"))
    orphan = below.join(known, "parent", "left_anti").select("id", F.lit("unknown parent").alias("why"))
    above = ancestors(entities, below.select(F.col("parent").alias("id"))).select(F.col("id").alias("parent"), F.col("above").alias("id"))
    cycle = below.join(above, ["id", "parent"], "left_semi").select("id", F.lit("parent in the own subtree").alias("why"))
    return not_root.union(orphan).union(cycle)


def origin_conflicts(current: DataFrame, edits: DataFrame) -> DataFrame:
    """Generated edits (id, kind, origin) of values that the user or another producer owns; user edits never conflict."""
    c = current.select("id", "kind", F.col("origin").alias("owner"))
    return edits.where("origin <> 'user'").join(c, ["id", "kind"]).where(F.col("owner") != F.col("origin"))


def read_conflicts(observed: DataFrame, current: DataFrame) -> DataFrame:
    """Observations (id, kind, fingerprint; null: absent) that no longer hold. An empty result lets a patch rebase."""
    c = current.select("id", "kind", F.sha2(F.col("value").cast("binary"), 256).alias("now"))
    return observed.join(c, ["id", "kind"], "left").where(~F.col("fingerprint").eqNullSafe(F.col("now")))


def rebase(patch: DataFrame, observed: DataFrame, current: DataFrame, head: int) -> DataFrame:
    """The patch as revision head + 1; raises at run time if an observation changed."""
    broken = read_conflicts(observed, current).agg(F.count("*").alias("n"))
    fail = F.raise_error(F.lit("the patch reads values that changed")).cast("boolean")
    checked = patch.crossJoin(F.broadcast(broken)).where(F.when(F.col("n") > 0, fail).otherwise(True))
    return checked.withColumn("revision", F.lit(head + 1).cast("long")).select(*patch.columns)


def preview(ops: DataFrame, patch: DataFrame) -> DataFrame:
    """State with a patch applied, nothing written."""
    return fold_components(ops.unionByName(patch))


def ensure_head(ops: DataFrame, expected: int) -> DataFrame:
    """The log, if its head is the expected revision; else an error at run time."""
    head = ops.agg(F.coalesce(F.max("revision"), F.lit(0)).alias("head"))
    fail = F.raise_error(F.lit("the head moved")).cast("boolean")
    return ops.crossJoin(F.broadcast(head)).where(F.when(F.col("head") != expected, fail).otherwise(True)).drop("head")


def needs_checkpoint(commits: DataFrame, commits_at: int = CHECKPOINT_COMMITS, bytes_at: int = CHECKPOINT_BYTES) -> DataFrame:
    """commits (revision, bytes, checkpointed) with what ran up since the last checkpoint and whether one is due.

    Epochs are counted within ranges of revisions and shifted by the ranges before, one row each.
    """
    flag = F.col("checkpointed").cast("int")
    ranged = commits.withColumn("__range", F.floor(F.col("revision") / RANGE))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy("__range").agg(F.sum(flag).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    w = Window.partitionBy("__range").orderBy("revision").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn("epoch", F.sum(flag).over(w) - flag).join(shifts, "__range").withColumn("epoch", F.col("epoch") + F.col("__shift")).drop("__range", "__shift")
    in_epoch = Window.partitionBy("epoch").orderBy("revision").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("commits", F.count("*").over(in_epoch)).withColumn("size", F.sum("bytes").over(in_epoch))
    return out.withColumn("due", (F.col("commits") >= commits_at) | (F.col("size") >= bytes_at))


def changes(ops: DataFrame) -> DataFrame:
    """Ids created, removed and updated by a log: by their first and last existence."""
    at = F.struct("revision", "seq")
    g = ops.groupBy("id").agg(F.min_by("op", at).alias("first"), F.max_by("op", at).alias("last"))
    born, dead = F.col("first") == "insert", F.col("last") == "delete"
    return g.select("id", F.when(born & dead, "none").when(born, "created").when(dead, "removed").otherwise("updated").alias("change")).where("change <> 'none'")


# ---------------------------------------------------------------- trees and graphs


def _levels(first: DataFrame, below: Callable[[DataFrame], DataFrame], max_depth: int) -> DataFrame:
    """``first`` and the levels that ``below`` finds under each other, written one by one, until one is empty; an error where ``max_depth`` aren't enough."""
    from lamella.sources.tables import written

    found = level = written(first, "level")
    for _ in range(max_depth + 1):
        level = written(below(level), "level")
        if not level.limit(1).count():
            return found
        found = found.union(level)
    raise ValueError(f"the tree is deeper than {max_depth} levels, or goes in a circle")


def subtree(entities: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Entities (id, parent, position) under the roots (id), in pre-order by ``path``; the roots come with depth 0."""
    step = F.lpad(F.col("position").cast("string"), 10, "0")
    top = entities.select("id", step.alias("path"))
    kids = entities.select(F.col("parent").alias("above"), F.col("id").alias("kid"), step.alias("step"))
    first = roots.select("id").join(top, "id").select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), "path")
    below = lambda t: t.join(kids, F.col("id") == F.col("above")).select("root", F.col("kid").alias("id"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.lit("/"), "step").alias("path"))
    return _levels(first, below, max_depth)


def ancestors(entities: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Pairs (id, above) of the starts (id) that are entities with themselves and each entity above them."""
    up = entities.where("parent IS NOT NULL").select(F.col("id").alias("above"), "parent")
    first = starts.select("id").distinct().join(entities.select("id").distinct(), "id", "left_semi").select("id", F.col("id").alias("above"))
    known = entities.select(F.col("id").alias("parent")).distinct()
    return _levels(first, lambda t: t.join(up, "above").join(known, "parent", "left_semi").select("id", F.col("parent").alias("above")), max_depth)


def descendants(entities: DataFrame, roots: DataFrame) -> DataFrame:
    return subtree(entities, roots).where("depth > 0")


def children(entities: DataFrame, parent) -> DataFrame:
    return entities.where(F.col("parent") == parent).orderBy("position", "id")


def containing_page(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """The page (id) above each entity."""
    return subtree(entities, pages).select("id", F.col("root").alias("page"))


def unique_roots(entities: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen ids without those that lie under another chosen one."""
    return chosen.join(descendants(entities, chosen).select("id"), "id", "left_anti")


def visual_order(entities: DataFrame, roots: DataFrame) -> DataFrame:
    """Visible nodes in order with opacity multiplied down the tree; hidden ones take their subtree along.

    entities: id, parent, position, opacity, visible.
    """
    seen = entities.where("visible").select("id", "parent", F.col("opacity").cast("double").alias("opacity"), F.lpad(F.col("position").cast("string"), 10, "0").alias("path"))
    kids = seen.select(F.col("parent").alias("above"), F.col("id").alias("kid"), F.col("opacity").alias("own"), F.col("path").alias("step"))
    first = roots.select("id").join(seen, "id").select(F.col("id").alias("root"), "id", "opacity", "path")
    below = lambda t: t.join(kids, F.col("id") == F.col("above")).select("root", F.col("kid").alias("id"), (F.col("opacity") * F.col("own")).alias("opacity"), F.concat("path", F.lit("/"), "step").alias("path"))
    return _levels(first, below, MAX_DEPTH)


def relations_from(relations: DataFrame, kind: str | None = None) -> DataFrame:
    return relations if kind is None else relations.where(F.col("kind") == kind)


def relation_lookup(rows: DataFrame, relations: DataFrame, kind: str, source: str, name: str) -> DataFrame:
    """Rows with the target of a functional relation, which can't fan out."""
    one = relations.where(F.col("kind") == kind).select(F.col("source").alias(source), F.col("target").alias(name))
    return rows.join(one, source, "left")


def closure(relations: DataFrame, seeds: DataFrame) -> DataFrame:
    """Entities joined to the seeds (id) by relations in either direction; rounds go on until none is new."""
    from lamella.sources.tables import written

    edges = relations.select(F.col("source").alias("id"), F.col("target").alias("to")).union(relations.select(F.col("target").alias("id"), F.col("source").alias("to")))
    reached = frontier = seeds.select("id").distinct()
    while True:
        frontier = written(frontier.join(edges, "id").select(F.col("to").alias("id")).distinct().join(reached, "id", "left_anti"))
        if not frontier.limit(1).count():
            break
        reached = written(reached.union(frontier))
    return reached


# ---------------------------------------------------------------- blobs and validation


def referenced_blobs(components: DataFrame) -> DataFrame:
    """Distinct blob ids that components (…, blob_refs array) name."""
    return components.select(F.explode("blob_refs").alias("blob_id")).distinct()


def missing_blobs(wanted: DataFrame, index: DataFrame) -> DataFrame:
    return wanted.select("blob_id").distinct().join(index.select("blob_id"), "blob_id", "left_anti")


def read_blobs(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """Bytes of wanted ids with a check of their content hash."""
    return wanted.select("blob_id").distinct().join(blobs, "blob_id").withColumn("intact", F.sha2("bytes", 256) == F.col("blob_id"))


def collect_garbage(blobs: DataFrame, marked: DataFrame, leased: DataFrame | None = None) -> DataFrame:
    """Blobs (blob_id, size) that nothing references or leases."""
    keep = marked.select("blob_id")
    if leased is not None:
        keep = keep.union(leased.select("blob_id"))
    return blobs.join(keep, "blob_id", "left_anti")


def reclaimed(garbage: DataFrame) -> DataFrame:
    return garbage.agg(F.count("*").alias("blobs"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def prune_history(ops: DataFrame, before: int) -> DataFrame:
    return ops.where(F.col("revision") >= before)


def endpoint_violations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations whose ends aren't of the kinds they bind (entities: id, kind); unknown kinds pass."""
    s, d = entities.select(F.col("id").alias("source"), F.col("kind").alias("__s")), entities.select(F.col("id").alias("target"), F.col("kind").alias("__t"))
    r = relations.join(s, "source", "left").join(d, "target", "left")
    bad = F.lit(False)
    for kind, (a, b) in ENDPOINTS.items():
        bad = bad | ((F.col("kind") == kind) & ~(F.col("__s").eqNullSafe(F.lit(a)) & F.col("__t").eqNullSafe(F.lit(b))))
    return r.where(bad).select(*relations.columns)


def functional_violations(relations: DataFrame) -> DataFrame:
    return relations.where(F.col("kind").isin(*FUNCTIONAL)).groupBy("source", "kind").agg(F.count("*").alias("n")).where("n > 1")


def structure_violations(entities: DataFrame) -> DataFrame:
    """Entities whose parent is missing, that are their own parent, or that share a place with a sibling."""
    parents = entities.select(F.col("id").alias("parent"), F.lit(True).alias("__p"))
    orphan = entities.where("parent IS NOT NULL").join(parents, "parent", "left").where("__p IS NULL").select("id", F.lit("missing parent").alias("rule"))
    own = entities.where("parent = id").select("id", F.lit("own parent").alias("rule"))
    w = Window.partitionBy("parent", "position")
    twice = entities.withColumn("__n", F.count("*").over(w)).where("__n > 1 AND parent IS NOT NULL").select("id", F.lit("shared position").alias("rule"))
    return orphan.union(own).union(twice)


def component_violations(components: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violation counts of named rules, true where a row breaks one."""
    return components.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])


def removal_blocks(entities: DataFrame, relations: DataFrame, doomed: DataFrame, policy: str) -> DataFrame:
    """Why ids can't be removed under a policy (reject, promote, cascade): children, or incident relations."""
    kids = entities.select(F.col("parent").alias("id")).distinct()
    ends = relations.select(F.col("source").alias("id")).union(relations.select(F.col("target").alias("id"))).distinct()
    blocked = doomed.join(ends, "id", "left_semi").select("id", F.lit("relations").alias("why"))
    if policy == "cascade":
        return blocked.limit(0)
    if policy == "reject":
        blocked = blocked.union(doomed.join(kids, "id", "left_semi").select("id", F.lit("children").alias("why")))
    return blocked


def removal_ops(entities: DataFrame, doomed: DataFrame, policy: str, revision: int) -> DataFrame:
    """Delete operations of a removal, with moves of promoted children."""
    ids = descendants(entities, doomed).select("id").union(doomed.select("id")).distinct() if policy == "cascade" else doomed.select("id")
    out = ids.select(F.lit(revision).alias("revision"), "id", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("parent"))
    if policy == "promote":
        up = doomed.join(entities, "id").select(F.col("id").alias("__gone"), F.col("parent").alias("__up"))
        moved = entities.join(up, F.col("parent") == F.col("__gone")).select(F.lit(revision).alias("revision"), "id", F.lit("move").alias("op"), F.col("__up").cast("string").alias("parent"))
        out = out.union(moved)
    return out


def partial_update(current: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of updates where they are not null, else as they are."""
    u = updates.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return current.join(u, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])
