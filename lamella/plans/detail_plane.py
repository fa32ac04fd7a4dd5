"""Queries over single operators that no other query reaches, each with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.functions import geometry as g
from lamella.functions import keys as k
from lamella.functions import text as t
from lamella.operators import cache, history, order, regions, reply, reports, sequence, settings, spatial, store
from lamella.plans import samples as s
from lamella.plans.sequence_plane import _ENTRIES_SQL, _entries
from lamella.plans.store_plane import _OPS_SQL, _TREE_SQL, _ops, _tree
from lamella.sources import readers
from lamella.sources.tables import table


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- undo of every kind of operation


def _edit_log(spark, sf_dir):
    """Inserts, moves, sets and unsets of each user in the order of the events, with what stood before; then deletes of every fourth user."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("revision"), F.col("user_id").cast("string").alias("id"), "event_type", F.col("event_id").alias("n"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("revision")) == 1
    op = F.when(first, "insert").when(F.col("event_type") == "error", "move").when(F.col("event_type") == "view", "unset").otherwise("set")
    rows = e.withColumn("op", op).withColumn("seq", F.lit(0))
    placed, valued = F.col("op").isin("insert", "move"), F.col("op").isin("set", "unset")
    places = {"page": F.concat(F.lit("p"), F.col("n") % 3), "parent": F.concat(F.lit("g"), F.col("n") % 7), "position": (F.col("n") % 11).cast("int")}
    rows = rows.withColumns({c: F.when(placed, v) for c, v in places.items()})
    rows = rows.withColumn("kind", F.when(valued, (F.col("n") % 3).cast("string"))).withColumn("after", F.when(F.col("op") == "set", F.col("event_type")))
    by_id, by_kind = Window.partitionBy("id", placed).orderBy("revision"), Window.partitionBy("id", "kind").orderBy("revision")
    rows = rows.withColumns({f"before_{c}": F.when(placed, F.lag(c).over(by_id)) for c in places}).withColumn("before", F.when(valued, F.lag("after").over(by_kind)))
    rows = rows.where("op <> 'unset' OR before IS NOT NULL").withColumn("origin", F.lit("user"))
    log = rows.select("revision", "seq", "op", "id", "page", "parent", "position", "kind", "before", "after", "origin", "before_page", "before_parent", "before_position")
    doomed = e.where(F.col("id").cast("long") % 4 == 0).select("id").distinct()
    gone = store.delete_ops(store.fold_entities(log), store.fold_components(log), doomed, 1_000_000_000)
    return log.unionByName(gone)


def store_undo_replay(spark, sf_dir):
    """Entities and components after all revisions of the later half, deletes and moves among them, are undone."""
    from lamella.sources.tables import written

    log = written(_edit_log(spark, sf_dir), "edit-log")
    half = table(spark, sf_dir, "events").agg((F.max("event_id") / 2).cast("long").alias("h")).first()["h"]
    state = log.unionByName(store.undo(log, F.col("revision") > half, 1_000_000_000))
    parts = store.fold_components(state).select("id", F.lit("component").alias("what"), F.col("kind").alias("a"), F.col("value").alias("b"), F.lit(None).cast("long").alias("c"))
    return parts.union(store.fold_entities(state).select("id", F.lit("entity"), "page", "parent", F.col("position").cast("long")))


STORE_UNDO_REPLAY = """
WITH x AS (SELECT event_id AS n, CAST(user_id AS VARCHAR) AS id, event_type AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events),
early AS (SELECT * FROM x WHERE n <= (SELECT CAST(floor(max(event_id) / 2) AS BIGINT) FROM events)),
sets AS (SELECT id, CAST(n % 3 AS VARCHAR) AS kind, arg_max(e, n) AS last FROM early WHERE nth > 1 AND e <> 'error' GROUP BY 1, 2),
places AS (SELECT id, max(n) AS n FROM early WHERE nth = 1 OR e = 'error' GROUP BY 1)
SELECT id, 'component' AS what, kind AS a, last AS b, CAST(NULL AS BIGINT) AS c FROM sets WHERE last <> 'view'
UNION ALL SELECT id, 'entity', 'p' || n % 3, 'g' || n % 7, n % 11 FROM places"""


def store_edit_rules(spark, sf_dir):
    """Moves of customers and nations that break a rule of places, and why."""
    e = _tree(spark, sf_dir)
    nation = F.concat(F.lit("n"), F.col("position") % 5)
    moves = e.where("id LIKE 'c%' OR id LIKE 'n%'").select(
        "id", F.lit("p").alias("page"), "position",
        F.when(F.col("id").like("c%") & (F.col("position") % 3 == 0), F.lit("x")).when(F.col("id").like("c%"), nation).when(F.col("position") % 2 == 0, F.col("id")).otherwise(F.lit("r0")).alias("parent"),
    )
    pages = e.where("id LIKE 'n%' AND position < 4").select("id")
    return store.place_violations(e.select("id", "parent", "position"), pages, moves.select("id", "page", "parent", "position"))


STORE_EDIT_RULES = f"""
WITH {_TREE_SQL}, m AS (
    SELECT id, CASE WHEN id LIKE 'c%' AND position % 3 = 0 THEN 'x' WHEN id LIKE 'c%' THEN 'n' || position % 5 WHEN position % 2 = 0 THEN id ELSE 'r0' END AS parent, position FROM e WHERE id LIKE 'c%' OR id LIKE 'n%'
)
SELECT id, 'page below the root' AS why FROM m WHERE id LIKE 'n%' AND position < 4
UNION ALL SELECT id, 'unknown parent' FROM m WHERE parent = 'x'
UNION ALL SELECT id, 'parent in the own subtree' FROM m WHERE parent = id"""


def store_edits(spark, sf_dir):
    """Log rows of edits and moves made on the state: what changes nothing gives none."""
    ops = _ops(spark, sf_dir)
    components, entities = store.fold_components(ops), store.fold_entities(ops).withColumn("position", F.col("position").cast("int"))
    edits = components.select("id", "kind", F.when(F.col("kind") == "0", "click").when(F.col("kind") == "1", None).otherwise("new").alias("value"), F.lit("user").alias("origin"))
    moves = entities.select("id", F.lit("q").alias("page"), F.lit("g1").alias("parent"), (F.col("position") + 1).alias("position"))
    rows = store.set_ops(components, edits, 9).unionByName(store.move_ops(entities, moves, 9)).unionByName(store.insert_ops(moves.withColumn("id", F.concat("id", F.lit("x"))), 9))
    return rows.select("op", "id", "kind", "before", "after", "page", "parent", F.col("position").cast("long").alias("position"), "before_page", F.col("before_position").cast("long").alias("before_position"))


STORE_EDITS = f"""
WITH {_OPS_SQL}, c AS (
    SELECT l.id, l.kind, l.value FROM (SELECT id, kind, max(revision) AS r, arg_max(op, revision) AS op, arg_max(event_type, revision) AS value FROM ops WHERE kind IS NOT NULL GROUP BY 1, 2) l
    LEFT JOIN (SELECT id, max(revision) AS gone FROM ops WHERE op = 'delete' GROUP BY 1) d USING (id) WHERE l.op = 'set' AND (gone IS NULL OR r > gone)
), n AS (SELECT *, CASE kind WHEN '0' THEN 'click' WHEN '1' THEN NULL ELSE 'new' END AS v FROM c),
p AS (SELECT id, arg_max(op, revision) AS op, arg_max(position, revision) AS position FROM ops WHERE op IN ('insert', 'delete') GROUP BY 1)
SELECT CASE WHEN v IS NULL THEN 'unset' ELSE 'set' END AS op, id, kind, value AS before, v AS after, NULL AS page, NULL AS parent, CAST(NULL AS BIGINT) AS position, NULL AS before_page, CAST(NULL AS BIGINT) AS before_position
FROM n WHERE v IS DISTINCT FROM value
UNION ALL SELECT 'move', id, NULL, NULL, NULL, 'q', 'g1', position + 1, 'p', position FROM p WHERE op = 'insert'
UNION ALL SELECT 'insert', id || 'x', NULL, NULL, NULL, 'q', 'g1', position + 1, NULL, NULL FROM p WHERE op = 'insert'"""


def relation_lookups(spark, sf_dir):
    """Region above each entity, and the target of a customer's one relation."""
    e = _tree(spark, sf_dir)
    above = store.containing_page(e, e.where("parent IS NULL").select("id")).select(F.lit("page").alias("what"), "id", F.col("page").alias("value"))
    rel = e.where("parent IS NOT NULL").select(F.when(F.col("id").like("c%"), "Inside").otherwise("Other").alias("kind"), F.col("id").alias("source"), F.col("parent").alias("target"))
    one = store.relation_lookup(e.select("id").withColumnRenamed("id", "source"), rel, "Inside", "source", "value").select(F.lit("inside").alias("what"), F.col("source").alias("id"), "value")
    return above.union(one).union(store.relations_from(rel, "Other").select(F.lit("other"), "source", "target"))


RELATION_LOOKUPS = f"""
WITH RECURSIVE {_TREE_SQL}, t AS (SELECT id AS root, id FROM e WHERE parent IS NULL UNION ALL SELECT t.root, e.id FROM t JOIN e ON e.parent = t.id)
SELECT 'page' AS what, id, root AS value FROM t UNION ALL SELECT 'inside', id, CASE WHEN id LIKE 'c%' THEN parent END FROM e UNION ALL SELECT 'other', id, parent FROM e WHERE id LIKE 'n%'"""


def log_ranges(spark, sf_dir):
    """Operations by kind in a range of revisions, and behind a pruned history."""
    ops = _ops(spark, sf_dir)
    ranged = store.history_range(ops, F.lit(100), F.lit(700)).groupBy("op").agg(F.count("*").alias("n")).select(F.lit("range").alias("what"), "op", "n")
    return ranged.union(store.prune_history(ops, 500).groupBy("op").agg(F.count("*").alias("n")).select(F.lit("pruned"), "op", "n"))


LOG_RANGES = f"""
WITH {_OPS_SQL} SELECT 'range' AS what, op, count(*) AS n FROM ops WHERE revision BETWEEN 101 AND 700 GROUP BY 2 UNION ALL SELECT 'pruned', op, count(*) FROM ops WHERE revision >= 500 GROUP BY 2"""


# ---------------------------------------------------------------- replies, glossaries, forms


def reply_roots(spark, sf_dir):
    """Records read from model output with brackets ahead, fences, trailing words, or nothing to read."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    body = F.concat(F.lit('{"translations": [{"id": "'), F.col("turn").cast("string"), F.lit('", "text": "'), F.concat_ws(" ", "role", "conv_id"), F.lit('"}]}'))
    kind = F.col("conv_id") % 4
    made = F.when(kind == 0, F.concat(F.lit("Here [note] is {it}: "), body, F.lit(" done [x]"))).when(kind == 1, F.concat(F.lit("Sure.\n```json\n"), body, F.lit("\n```\nbye"))).when(
        kind == 2, F.concat(F.lit("["), F.col("role"), F.lit("] "), body)
    ).otherwise(F.lit("no [records] here {at all}"))
    return readers.reply_records(c.select("conv_id", "turn", made.alias("reply"))).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "id", "text")


REPLY_ROOTS = """
SELECT conv_id, turn, CAST(0 AS BIGINT) AS pos, turn AS id, min(role) || ' ' || conv_id AS text FROM conversations WHERE conv_id % 4 <> 3 GROUP BY 1, 2"""


def glossary_texts(spark, sf_dir):
    """Glossary text of each nation's customers, whether strict reading takes it, and its fingerprint's count."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("c_name").alias("source"), F.col("c_mktsegment").alias("translation")))).alias("terms"))
    strict = readers.strict_terms(F.to_json("terms"), most=60)
    pins = readers.translation_pins(F.to_json(F.transform("terms", lambda x: F.struct(x["source"].alias("s"), x["translation"].alias("t")))), most=50)
    return c.select(F.col("c_nationkey").cast("long").alias("nation"), readers.glossary_text(F.col("terms")).alias("text"), F.size(strict).cast("long").alias("strict"), F.size(pins).cast("long").alias("pins"), F.substring_index(k.glossary_fingerprint(F.col("terms")), "-", 1).alias("mark"))


GLOSSARY_TEXTS = """
SELECT CAST(c_nationkey AS BIGINT) AS nation, string_agg(c_name || ' = ' || c_mktsegment, chr(10) ORDER BY c_name, c_mktsegment) AS text,
       CASE WHEN count(*) <= 60 THEN count(*) END AS strict, CASE WHEN count(*) <= 50 THEN count(*) END AS pins, 'g' || count(*) AS mark FROM customer GROUP BY 1"""


def request_fields(spark, sf_dir):
    """Fields of the pages' requests that are under a size cap."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.octet_length("html").alias("size"))
    params = p.select("path", F.lit("lang").alias("name"), F.when(F.length("path") % 2 == 0, "en").otherwise("de").alias("value")).union(p.where("path LIKE '%1'").select("path", F.lit("seed"), "path"))
    return readers.request_forms(p, params, 3000).select("path", F.col("fields")["lang"].alias("lang"), F.try_element_at("fields", F.lit("seed")).alias("seed"))


REQUEST_FIELDS = """
SELECT CAST(page_id AS VARCHAR) AS path, CASE WHEN length(CAST(page_id AS VARCHAR)) % 2 = 0 THEN 'en' ELSE 'de' END AS lang, CASE WHEN page_id % 10 = 1 THEN CAST(page_id AS VARCHAR) END AS seed
FROM pages WHERE strlen(html) <= 3000"""


def response_bodies(spark, sf_dir):
    """JSON of each order's outcome, its header, whether it is worth reporting and whether nothing came out."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("segments"), F.count_if(F.col("l_returnflag") == "N").alias("missed"), F.count_if(F.col("l_linestatus") == "F").alias("repeated"))
    body = reports.response_body(F.struct("segments", "missed", F.when(F.col("repeated") > 0, F.col("repeated")).alias("repeated")))
    return o.select("l_orderkey", body.alias("body"), reports.summary_header(F.col("missed"), F.col("segments")).alias("header"),
                    reply.worth_reporting(F.col("missed"), F.lit(False), F.col("repeated"), F.lit(0)).alias("worth"), reply.nothing_translated(F.col("segments"), F.col("missed")).alias("nothing"))


RESPONSE_BODIES = """
SELECT l_orderkey, '{"segments":' || n || ',"missed":' || m || CASE WHEN r > 0 THEN ',"repeated":' || r ELSE '' END || '}' AS body, m || '/' || n AS header, m > 0 OR r > 0 AS worth, m >= n AS nothing
FROM (SELECT l_orderkey, count(*) AS n, count_if(l_returnflag = 'N') AS m, count_if(l_linestatus = 'F') AS r FROM lineitem GROUP BY 1)"""


# ---------------------------------------------------------------- geometry and regions


def box_measures(spark, sf_dir):
    """Shape rules and mappings of every box."""
    b, free = F.col("box"), F.col("label") == "text"
    view = g.box(F.lit(10), F.lit(20), F.lit(350), F.lit(550))
    src, grown = g.to_source(b, view, F.lit(700), F.lit(1100)), g.pad(b, 5)
    cut = g.crop(b, F.lit(700), F.lit(1100))
    poly = g.rotated_box(b, F.lit(90.0))
    corners = F.array(*[F.struct((b["x"] + dx * b["width"]).alias("x"), (b["y"] + dy * b["height"]).alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))])
    bounds, turned = g.polygon_bounds(corners), g.polygon_bounds(poly)
    fit = g.effective_box(g.box(b["x"], F.when(b["y"] % 2 == 0, b["y"]), b["width"], b["height"]), g.box(F.lit(1), F.lit(2), b["width"], b["height"]))
    r = lambda c, name: F.round(c.cast("double"), 4).alias(name)
    return s.boxes(spark, sf_dir).select(
        "page", "id", g.rotation_candidate(b, free).alias("rotation"), g.oversized(b["width"], b["height"], F.lit(300)).alias("oversized"), g.narrow(b, 100).alias("narrow"),
        regions.box_eligible(b["width"], b["height"], 100).alias("eligible"), regions.rejection(b["width"], b["height"], free, 100).alias("rejection"), regions.letters_text(F.col("label")).alias("lettered"),
        regions.short_role(F.concat(F.lit("a.b."), F.col("label"))).alias("role"), g.in_viewport(b, F.lit(600), F.lit(900), 50).alias("seen"),
        r(src["x"], "source_x"), r(src["width"], "source_width"), r(grown["x"], "pad_x"), r(grown["height"], "pad_height"), r(cut["width"], "crop_width"), r(cut["height"], "crop_height"),
        r(bounds["x"], "bounds_x"), r(bounds["width"], "bounds_width"), r(turned["width"], "turned_width"), r(turned["y"], "turned_y"), r(fit["x"], "fit_x"), r(fit["y"], "fit_y"),
        g.polygon_meets(corners, view).alias("meets"), r(g.fit_free_text(F.lit(40.0), b, F.col("page") % 50), "font"), r(g.contain_scale(b["width"], b["height"], F.lit(350), F.lit(550)), "scale"),
        g.same_rect(b, g.box(b["x"] + 2, b["y"], b["width"], b["height"] - 1)).alias("same"), r(g.luma(b["x"] % 256, b["y"] % 256, b["width"] % 256), "luma"),
    )


BOX_MEASURES = f"""
WITH {s.BOXES_SQL}
SELECT page, id, label = 'text' AND w > 0 AND h >= 3 * w AS rotation, greatest(w, h) > 300 AS oversized, least(w, h) <= 100 AS narrow, w >= 100 AND h >= 100 AS eligible,
       CASE WHEN label <> 'text' THEN 'not-loaded' WHEN w <= 0 OR h <= 0 THEN 'no-size' WHEN w < 100 OR h < 100 THEN 'too-small' END AS rejection, label = 'text' AS lettered, label AS role,
       y + h >= -50 AND y <= 950 AND x + w >= -50 AND x <= 650 AS seen, CAST((x - 10) * 2 AS DOUBLE) AS source_x, CAST(w * 2 AS DOUBLE) AS source_width, CAST(x - 5 AS DOUBLE) AS pad_x, CAST(h + 10 AS DOUBLE) AS pad_height,
       CASE WHEN least(x + w, 700) > x AND least(y + h, 1100) > y THEN CAST(least(x + w, 700) - x AS DOUBLE) END AS crop_width, CASE WHEN least(x + w, 700) > x AND least(y + h, 1100) > y THEN CAST(least(y + h, 1100) - y AS DOUBLE) END AS crop_height,
       CAST(x AS DOUBLE) AS bounds_x, CAST(w AS DOUBLE) AS bounds_width, round(CAST(h AS DOUBLE), 4) AS turned_width, round(y + h / 2 - w / 2, 4) AS turned_y,
       CAST(CASE WHEN y % 2 = 0 THEN x ELSE 1 END AS DOUBLE) AS fit_x, CAST(CASE WHEN y % 2 = 0 THEN y ELSE 2 END AS DOUBLE) AS fit_y,
       x < 360 AND 10 < x + w AND y < 570 AND 20 < y + h AS meets, round(greatest(9.0, least(40.0, sqrt(0.55 * w * h / (0.42 * greatest(page % 50, 1))))), 4) AS font, round(least(350.0 / w, 550.0 / h), 4) AS scale,
       true AS same, round(CAST(0.299 * (x % 256) + 0.587 * (y % 256) + 0.114 * (w % 256) AS DOUBLE), 4) AS luma
FROM boxes"""


def text_block_bubbles(spark, sf_dir):
    """First bubble of each text, and texts whose lettering would land on another box."""
    b = s.boxes(spark, sf_dir)
    texts = b.where("label = 'text'").select("page", "id", "box")
    bubbles = b.where("label = 'bubble'").select("page", F.col("id").alias("ordinal"), "box")
    found = spatial.text_blocks(texts, bubbles).select(F.lit("bubble").alias("what"), "page", "id", F.col("bubble").alias("value"))
    effects = texts.select("page", "id", g.box(F.col("box")["x"] + 40, F.col("box")["y"], F.col("box")["width"], F.col("box")["height"]).alias("placed"))
    shadow = spatial.overshadowed(effects, b.where("label = 'panel'").select("page", "id", "box")).select(F.lit("overshadowed"), "page", "id", F.lit(None).cast("string"))
    return found.union(shadow)


TEXT_BLOCK_BUBBLES = f"""
WITH {s.BOXES_SQL}, j AS (
    SELECT t.page, t.id, b.id AS bubble FROM boxes t JOIN boxes b ON b.page = t.page AND b.label = 'bubble' WHERE t.label = 'text' AND (
        (t.x >= b.x AND t.y >= b.y AND t.x + t.w <= b.x + b.w AND t.y + t.h <= b.y + b.h)
        OR greatest(0, least(t.x + t.w, b.x + b.w) - greatest(t.x, b.x)) * greatest(0, least(t.y + t.h, b.y + b.h) - greatest(t.y, b.y)) * 1.0
           >= 0.2 * (t.w * t.h + b.w * b.h - greatest(0, least(t.x + t.w, b.x + b.w) - greatest(t.x, b.x)) * greatest(0, least(t.y + t.h, b.y + b.h) - greatest(t.y, b.y))))
)
SELECT 'bubble' AS what, t.page, t.id, min(j.bubble) AS value FROM boxes t LEFT JOIN j ON j.page = t.page AND j.id = t.id WHERE t.label = 'text' GROUP BY t.page, t.id
UNION ALL SELECT 'overshadowed', t.page, t.id, NULL FROM boxes t WHERE t.label = 'text' AND EXISTS (
    SELECT 1 FROM boxes p WHERE p.page = t.page AND p.label = 'panel' AND t.x + 40 < p.x + p.w AND p.x < t.x + 40 + t.w AND t.y < p.y + p.h AND p.y < t.y + t.h)"""


def mask_and_edges(spark, sf_dir):
    """Erased detections, weak texts at a page edge, and pages that agree on one label."""
    b = s.boxes(spark, sf_dir)
    refused = b.where("score < 0.02").select("page", "id")
    erased = regions.mask_sources(b, refused).select(F.lit("erased").alias("what"), "page", "id", F.lit(None).cast("string").alias("value"))
    hints = regions.edge_hints(b, 0.05, F.lit(1100)).select(F.lit("edge"), "page", "id", "edge")
    agreed = regions.unanimous(b, "page", "label").select(F.lit("agreed"), "page", F.lit(None).cast("string"), "label")
    return erased.union(hints).union(agreed)


MASK_AND_EDGES = f"""
WITH {s.BOXES_SQL}
SELECT 'erased' AS what, page, id, NULL AS value FROM boxes WHERE label = 'text' AND NOT score < 0.02
UNION ALL SELECT 'edge', page, id, CASE WHEN y <= 16 THEN 'top' ELSE 'bottom' END FROM boxes WHERE label = 'text' AND score < 0.05 AND (y <= 16) <> (y + h >= 1084)
UNION ALL SELECT 'agreed', page, NULL, CASE WHEN count(DISTINCT label) = 1 THEN min(label) END FROM boxes GROUP BY page"""


def top_scores(spark, sf_dir):
    """The three dearest line items of each order, and items ranked by pairwise wins."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("item"), "l_partkey", "l_suppkey", "l_extendedprice")
    top = order.top_per_group(li, "l_orderkey", 3, F.desc("l_extendedprice"), "item", "l_partkey", "l_suppkey").select(F.lit("top").alias("what"), F.col("l_orderkey").alias("page"), "item", F.col("l_partkey").alias("value"))
    per = li.groupBy("l_orderkey", "item").agg(F.max("l_extendedprice").alias("price"))
    other = per.select("l_orderkey", F.col("item").alias("b"), F.col("price").alias("other"))
    pairs = per.join(other, "l_orderkey").where("item <> b").select(F.col("l_orderkey").alias("page"), F.col("item").alias("a"), "b", (F.col("price") - F.col("other")).alias("logit"))
    return top.union(order.order_from_votes(pairs).select(F.lit("rank"), "page", "id", F.col("rank").cast("long")))


TOP_SCORES = """
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem),
p AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2),
w AS (SELECT p.l_orderkey, p.l_linenumber, count_if(p.price > q.price) AS wins FROM p JOIN p q ON q.l_orderkey = p.l_orderkey AND q.l_linenumber <> p.l_linenumber GROUP BY 1, 2)
SELECT 'top' AS what, l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS item, l_partkey AS value FROM t WHERE rn <= 3
UNION ALL SELECT 'rank', l_orderkey, CAST(l_linenumber AS BIGINT), row_number() OVER (PARTITION BY l_orderkey ORDER BY wins DESC, l_linenumber) - 1 FROM w"""


# ---------------------------------------------------------------- text forms


def text_forms(spark, sf_dir):
    """Forms of every turn: vote key, reader's clean-up, kinds and flags."""
    x, script = F.col("text"), F.when(F.col("conv_id") % 3 == 0, "ko").otherwise("ja")
    free, effect = F.col("turn") % 2 == 0, F.col("turn") % 5 == 0
    c = table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id", "turn", "role", F.md5(t.vote_form(x).cast("binary")).alias("form"), F.length(t.vote_key(x)).cast("long").alias("key_chars"), F.md5(t.ocr_post_process(x).cast("binary")).alias("processed"),
        t.is_interjection(F.substring_index(x, " ", 1)).alias("interjection"), t.segment_kind(F.when(effect, "onomatopoeia"), F.when(free, "free").otherwise("dialogue")).alias("kind"),
        t.first_lower(F.substring(x, 1, 1)).alias("initial"), F.md5(t.without_nul(x).cast("binary")).alias("plain"), t.latex_wrapped(F.concat(F.lit("$"), x, F.when(free, "$").otherwise(""))).alias("wrapped"),
        t.spot_candidate(F.substring_index(x, " ", 1), script).alias("spot"), t.reread_candidate(x, script, free, effect).alias("reread"), t.unlettered_read(x, effect, ["the"], [], False).alias("unlettered"),
        t.refuse_repetition(F.substring(x, 1, 31)).alias("kept"), regions.feeds_story(F.when(effect, "junk"), F.lit("text")).alias("feeds"),
        k.seam_boundary_key(F.col("role"), F.col("conv_id").cast("string")).alias("boundary"), t.is_prolongation(F.lit("ー")).alias("prolonged"), t.is_symbol_or_punctuation(F.substring(x, 1, 1)).alias("symbol"),
    )


TEXT_FORMS = r"""
WITH c AS (SELECT *, regexp_replace(text, '\s', '', 'g') AS bare, split_part(text, ' ', 1) AS first, regexp_replace(text, '[^\p{L}]', '', 'g') AS letters,
           conv_id % 3 = 0 AS ko, turn % 2 = 0 AS free, turn % 5 = 0 AS effect FROM conversations)
SELECT conv_id, turn, role, md5(bare) AS form, length(regexp_replace(bare, '[^\p{L}\p{N}]', '', 'g')) AS key_chars,
       md5(translate(regexp_replace(replace(bare, '…', '...'), '[・.]{2,}', '...', 'g'), array_to_string(list_transform(range(33, 127), lambda i: chr(CAST(i AS INTEGER))), ''), array_to_string(list_transform(range(65281, 65375), lambda i: chr(CAST(i AS INTEGER))), ''))) AS processed,
       length(regexp_replace(first, '\s', '', 'g')) <= 4 AS interjection, CASE WHEN effect THEN 'sound effect' WHEN free THEN 'free text' ELSE 'dialogue' END AS kind,
       lower(left(text, 1)) AS initial, md5(text) AS plain, free OR regexp_matches(text, '\$\s*$') AS wrapped,
       (length(regexp_replace(first, '\s', '', 'g')) BETWEEN 1 AND 4 OR length(regexp_replace(first, '[^\p{L}]', '', 'g')) > 0) AND length(regexp_replace(first, '[^\p{L}]', '', 'g')) >= 3 AS spot,
       ko AND NOT free AND NOT effect AND length(letters) >= 3 AS reread, effect OR length(letters) < 3 OR contains(lower(text), 'the') AS unlettered,
       left(text, 31) AS kept, NOT effect AS feeds, role || '|' || conv_id AS boundary, true AS prolonged, false AS symbol
FROM c"""


# ---------------------------------------------------------------- caches, histories, runs, settings


def cache_operations(spark, sf_dir):
    """What expiry, sweeping, listing, look-up by key, counting and clearing leave of a cache."""
    e = _entries(spark, sf_dir)
    now = F.lit(1_706_000_000_000)
    e = e.withColumn("blob", F.lit("x"))
    name = lambda df, what: df.select(F.lit(what).alias("what"), "key", F.col("bytes").cast("long").alias("n"))
    events = table(spark, sf_dir, "events").select(F.when(F.col("value") > 50, "hit").otherwise("miss").alias("name"))
    old = spark.createDataFrame([("hit", 5), ("gone", 2)], "name string, n long")
    counted = cache.bump(old, events).select(F.lit("bump").alias("what"), F.col("name").alias("key"), "n")
    day = 24 * 3600 * 1000
    return _union([
        name(cache.drop_expired(e, now, 23 * day), "fresh"), name(cache.sweep(e.withColumn("at", F.col("used")), now, 40, 900_000), "sweep"), name(cache.listing(e), "listing"),
        name(cache.by_key(e.withColumn("at", F.col("used")), F.lit("click-7"), now), "by_key"), name(cache.clear(e), "cleared"), counted,
    ])


CACHE_OPERATIONS = f"""
WITH {_ENTRIES_SQL}, now AS (SELECT 1706000000000 AS now), s AS (
    SELECT key, bytes, count(*) OVER w AS n, sum(bytes) OVER w AS b FROM entries, now WHERE used >= now - 86400000 WINDOW w AS (ORDER BY used DESC, bytes DESC, key DESC ROWS UNBOUNDED PRECEDING)
), l AS (SELECT key, bytes FROM entries ORDER BY "at" DESC, key LIMIT 30)
SELECT 'fresh' AS what, key, bytes AS n FROM entries, now WHERE "at" >= now - 23 * 86400000::BIGINT
UNION ALL SELECT 'sweep', key, bytes FROM s WHERE n <= 40 AND b <= 900000
UNION ALL SELECT 'listing', key, bytes FROM l
UNION ALL SELECT 'by_key', key, bytes FROM entries, now WHERE key = 'click-7' AND used >= now - 86400000
UNION ALL SELECT 'bump', name, CAST(sum(n) AS BIGINT) FROM (SELECT CASE WHEN value > 50 THEN 'hit' ELSE 'miss' END AS name, count(*) AS n FROM events GROUP BY 1 UNION ALL VALUES ('hit', 5), ('gone', 2)) GROUP BY 2"""


def history_operations(spark, sf_dir):
    """Rows one page sees, stories without a dropped one, resets, renderings of a part and drifted glossaries."""
    p = s.pairs(spark, sf_dir).withColumn("story", F.col("story").cast("string"))
    row = lambda df, what, a, b: df.select(F.lit(what).alias("what"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    li = table(spark, sf_dir, "lineitem").select(F.lit("s").alias("series"), F.concat(F.lit("p"), F.col("l_partkey")).alias("source"), F.concat("l_returnflag", "l_linestatus").alias("translated"), F.col("l_orderkey").alias("at"))
    rows = history.ledger(li.where("source IN ('p40', 'p41')"))
    seen = history.story_context(p, F.lit("3"), F.lit(40), 15)
    left = history.drop_story(p, "3").groupBy("story").agg(F.count("*").alias("n"))
    resets = history.reset_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("key")))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("fingerprint"))
    now = table(spark, sf_dir, "orders").where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("key"), F.lit("O").alias("fingerprint"))
    options = history.pin_options(rows, spark.createDataFrame([("s", "p40", "AF")], "series string, term string, translation string")).where("pin IS NOT NULL")
    return _union([row(seen, "seen", "page", "pos"), row(left, "left", "story", "n"), row(resets, "resets", "key", "resets"), row(history.renderings(rows, "s", F.lit("p40")), "rendering", "rendering", "n"),
                   row(history.glossary_drifted(o, now), "drifted", "key", "fingerprint"), row(options, "option", "rendering", "pin")])


HISTORY_OPERATIONS = rf"""
WITH {s.PAIRS_SQL}, w AS (SELECT *, list_filter(regexp_split_to_array(translation, '\s+'), lambda x: x <> '') AS ws, trim(source) AS a, trim(translation) AS b FROM pairs),
good AS (SELECT * FROM w WHERE a <> '' AND b <> '' AND a <> b AND NOT (len(ws) >= 12 AND len(list_distinct(list_transform(ws, lambda x: lower(x)))) < 0.20 * len(ws))),
r AS (SELECT 'p' || l_partkey AS term, l_returnflag || l_linestatus AS rendering, count(*) AS n FROM lineitem WHERE l_partkey IN (40, 41) GROUP BY 1, 2)
SELECT 'seen' AS what, CAST(page AS VARCHAR) AS a, CAST(pos AS VARCHAR) AS b FROM (SELECT *, row_number() OVER (ORDER BY page DESC, pos DESC) AS age FROM good WHERE story = 3 AND page < 40) WHERE age <= 15
UNION ALL SELECT 'left', CAST(story AS VARCHAR), CAST(count(*) AS VARCHAR) FROM pairs WHERE story <> 3 GROUP BY story
UNION ALL SELECT 'resets', event_type, CAST(count(*) AS VARCHAR) FROM events GROUP BY event_type
UNION ALL SELECT 'rendering', rendering, CAST(n AS VARCHAR) FROM r WHERE term = 'p40'
UNION ALL SELECT 'drifted', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END FROM orders
          WHERE coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END, '') <> CASE WHEN o_orderkey % 5 > 0 THEN 'O' ELSE '' END
UNION ALL SELECT 'option', rendering, 'AF' FROM r WHERE term = 'p40'"""


def run_measures(spark, sf_dir):
    """Running peaks, look-ahead, composite offsets and run edges of each user's events."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", "value")
    e = e.withColumn("idx", (F.row_number().over(Window.partitionBy("run").orderBy("event_id")) - 1).cast("long")).withColumn("height", (F.col("event_id") % 90 + 10).cast("long"))
    peaks = sequence.running_peaks(e, "run", "event_id", ["value"])
    ahead = sequence.lookahead(peaks.withColumn("reached", F.when(F.col("event_id") % 3 == 0, F.col("idx"))), "run", "event_id", "reached")
    placed = sequence.composite_offsets(ahead)
    n = F.count("*").over(Window.partitionBy("run"))
    return placed.select("run", "event_id", "peak_value", "mark", "admit_through", F.col("offset").cast("long").alias("offset"), sequence.into_image(F.col("height"), F.lit(3), F.col("offset")).cast("long").alias("y"),
                         F.array_join(sequence.run_edges(F.col("idx"), n), ",").alias("edges"), reports.penalized(F.col("height"), F.lit(1000)).cast("double").alias("penalized"))


RUN_MEASURES = """
WITH e AS (SELECT user_id AS run, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, event_id % 90 + 10 AS height FROM events),
f AS (SELECT *, max(value) OVER w AS peak_value, max(CASE WHEN event_id % 3 = 0 THEN idx END) OVER w AS mark, CAST(sum(height) OVER w AS BIGINT) - height AS offset_, count(*) OVER (PARTITION BY run) AS n FROM e WINDOW w AS (PARTITION BY run ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT run, event_id, peak_value, mark, mark + 2 AS admit_through, offset_ AS "offset", height - 3 + offset_ AS y, CASE WHEN idx = 0 THEN 'bottom' WHEN idx = n - 1 THEN 'top' ELSE 'top,bottom' END AS edges,
       CAST(height + greatest(height / 2, 100) AS DOUBLE) AS penalized FROM f"""


def stage_reports(spark, sf_dir):
    """Time by stage and model, and replay rates by arm."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 3).cast("string").alias("model"), F.col("event_id").alias("ms"), "user_id")
    stages = reports.stage_totals(e.groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("stage"), "model", "ms", (F.col("ms") % 7).alias("wait_ms"))).alias("stages")))
    arms = e.select(F.col("event_type").alias("arm"), F.lit(3).alias("segments"), F.when(F.col("ms") % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.slice(F.array(F.lit(1)), 1, 0)).alias("untranslated"), (F.col("ms") % 5 == 0).alias("truncated"), F.lit(1).alias("duplicate_ids"), F.lit(0).alias("out_of_range_ids"), "ms")
    x = stages.select(F.concat_ws("/", "stage", "model").alias("what"), F.col("runs").alias("n"), F.col("ms").cast("double").alias("a"), F.col("wait_ms").cast("double").alias("b"), F.col("slowest").cast("double").alias("c"))
    return x.union(reports.replay_rates(arms).select("arm", "pages", F.col("unanswered").cast("double"), F.col("truncated").cast("double"), "ms_per_page"))


STAGE_REPORTS = """
SELECT event_type || '/' || event_id % 3 AS what, count(*) AS n, CAST(sum(event_id) AS DOUBLE) AS a, CAST(sum(event_id % 7) AS DOUBLE) AS b, CAST(max(event_id) AS DOUBLE) AS c FROM events GROUP BY 1
UNION ALL SELECT event_type, count(*), CAST(2 * count_if(event_id % 4 = 0) AS DOUBLE), CAST(count_if(event_id % 5 = 0) AS DOUBLE), round(avg(event_id), 3) FROM events GROUP BY 1"""


def setting_choices(spark, sf_dir):
    """Strict choices, engine, format, writing mode and text of each customer's request; models that weren't applied."""
    c = table(spark, sf_dir, "customer")
    seg, n = F.col("c_mktsegment"), F.col("c_custkey")
    script = F.when(n % 3 == 0, "han").otherwise("latin")
    out = settings.resolve_text(F.when(n % 4 > 0, F.col("c_name")), seg)
    langs = spark.createDataFrame([("EN", "English"), ("de", "German")], "tag string, language string")
    rows = settings.parse_language(c.withColumn("tag", F.when(n % 2 == 0, "en").when(n % 5 == 0, "DE").otherwise("xx")), langs)
    observed = c.where("c_custkey % 6 > 0").select(F.col("c_custkey").alias("stage"), F.lit("m").alias("model"))
    wrong = settings.unapplied(c.select(F.col("c_custkey").alias("stage"), F.lit("m").alias("model")), observed).select(F.col("stage").alias("c_custkey"), F.lit(True).alias("unapplied"))
    return rows.join(wrong, "c_custkey", "left").select(
        "c_custkey", settings.parse_choice(seg, ["automobile", "building", "furniture", "household", "machinery"]).alias("choice"), history.engine_for(F.when(n % 2 == 0, "ja"), F.lit("manga"), "a", "b").alias("engine"),
        settings.migrated_format(F.when(n % 3 == 1, "strip"), F.when(n % 2 == 0, "a"), "a").alias("form"), settings.writing_mode(script, F.when(n % 5 == 0, "vertical"), F.lit(None).cast("string"), F.lit(10), n % 20).alias("mode"),
        out["text"].alias("text"), out["note"].alias("note"), "language", F.coalesce("unapplied", F.lit(False)).alias("unapplied"),
    )


SETTING_CHOICES = """
SELECT c_custkey, lower(c_mktsegment) AS choice, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS engine, CASE WHEN c_custkey % 3 = 1 THEN 'strip' WHEN c_custkey % 2 = 0 THEN 'paged' ELSE 'strip' END AS form,
       CASE WHEN c_custkey % 3 > 0 THEN 'horizontal' WHEN c_custkey % 5 = 0 OR c_custkey % 20 > 10 THEN 'vertical' ELSE 'horizontal' END AS mode,
       CASE WHEN c_custkey % 4 > 0 THEN c_name ELSE c_mktsegment END AS text, CASE WHEN c_custkey % 4 = 0 THEN 'untranslated' END AS note,
       CASE WHEN c_custkey % 2 = 0 THEN 'English' WHEN c_custkey % 5 = 0 THEN 'German' END AS language, c_custkey % 6 = 0 AS unapplied FROM customer"""


QUERIES = {
    "store_undo_replay": (store_undo_replay, STORE_UNDO_REPLAY), "store_edit_rules": (store_edit_rules, STORE_EDIT_RULES), "store_edits": (store_edits, STORE_EDITS), "relation_lookups": (relation_lookups, RELATION_LOOKUPS),
    "log_ranges": (log_ranges, LOG_RANGES), "reply_roots": (reply_roots, REPLY_ROOTS), "glossary_texts": (glossary_texts, GLOSSARY_TEXTS), "request_fields": (request_fields, REQUEST_FIELDS),
    "response_bodies": (response_bodies, RESPONSE_BODIES), "text_block_bubbles": (text_block_bubbles, TEXT_BLOCK_BUBBLES), "mask_and_edges": (mask_and_edges, MASK_AND_EDGES), "top_scores": (top_scores, TOP_SCORES),
    "text_forms": (text_forms, TEXT_FORMS), "cache_operations": (cache_operations, CACHE_OPERATIONS), "history_operations": (history_operations, HISTORY_OPERATIONS), "run_measures": (run_measures, RUN_MEASURES),
    "stage_reports": (stage_reports, STAGE_REPORTS), "setting_choices": (setting_choices, SETTING_CHOICES), "box_measures": (box_measures, BOX_MEASURES),
}
