"""Queries of the document store with their SQL, over events and customers as logs and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.functions import keys as k
from lamella.operators import reports, settings, store
from lamella.sources.tables import table


def _ops(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = F.col("event_id")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "unset").otherwise("set")
    kind = F.when(op.isin("set", "unset"), (at % 3).cast("string"))
    return e.select(
        at.alias("revision"), F.lit(0).alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("id"), F.lit("p").alias("page"), F.lit(None).cast("string").alias("parent"),
        (at % 5).cast("int").alias("position"), kind.alias("kind"), F.lit(None).cast("string").alias("before"), F.when(op == "set", F.col("event_type")).alias("after"),
        F.when(at % 4 == 0, "user").otherwise(F.concat(F.lit("g"), (at % 2).cast("string"))).alias("origin"),
    )


_OPS_SQL = """
ops AS (
    SELECT event_id AS revision, CAST(user_id AS VARCHAR) AS id, event_id % 5 AS position, event_type,
           CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'unset' ELSE 'set' END AS op,
           CASE WHEN event_type NOT IN ('signup', 'error') THEN CAST(event_id % 3 AS VARCHAR) END AS kind,
           CASE WHEN event_id % 4 = 0 THEN 'user' ELSE 'g' || event_id % 2 END AS origin FROM events
)"""


def store_fold(spark, sf_dir):
    """Components as they stand after the log."""
    return store.fold_components(_ops(spark, sf_dir)).select("id", "kind", "value", "origin", "revision")


_LIVE = """
live AS (
    SELECT l.*, g.gone FROM (SELECT id, kind, max(revision) AS revision, arg_max(op, revision) AS op, arg_max(event_type, revision) AS value, arg_max(origin, revision) AS origin FROM ops WHERE kind IS NOT NULL GROUP BY 1, 2) l
    LEFT JOIN (SELECT id, max(revision) AS gone FROM ops WHERE op = 'delete' GROUP BY 1) g USING (id)
)"""
STORE_FOLD = f"""
WITH {_OPS_SQL}, {_LIVE} SELECT id, kind, value, origin, revision FROM live WHERE op = 'set' AND (gone IS NULL OR revision > gone)"""


def store_changes(spark, sf_dir):
    """What a log created, removed and updated."""
    return store.changes(_ops(spark, sf_dir)).groupBy("change").agg(F.count("*").alias("n"))


STORE_CHANGES = f"""
WITH {_OPS_SQL}, g AS (SELECT id, arg_min(op, revision) AS a, arg_max(op, revision) AS b FROM ops GROUP BY 1),
c AS (SELECT CASE WHEN a = 'insert' AND b = 'delete' THEN 'none' WHEN a = 'insert' THEN 'created' WHEN b = 'delete' THEN 'removed' ELSE 'updated' END AS change FROM g)
SELECT change, count(*) AS n FROM c WHERE change <> 'none' GROUP BY 1"""


def store_conflicts(spark, sf_dir):
    """Generated edits of values that others own."""
    cur = store.fold_components(_ops(spark, sf_dir))
    edits = cur.select("id", "kind", F.when(F.col("revision") % 3 == 0, "user").otherwise("g1").alias("origin"))
    return store.origin_conflicts(cur, edits).groupBy("origin", "owner").agg(F.count("*").alias("n"))


STORE_CONFLICTS = f"""
WITH {_OPS_SQL}, {_LIVE}, cur AS (SELECT * FROM live WHERE op = 'set' AND (gone IS NULL OR revision > gone))
SELECT 'g1' AS origin, origin AS owner, count(*) AS n FROM cur WHERE revision % 3 <> 0 AND origin <> 'g1' GROUP BY 2"""


def store_undo(spark, sf_dir):
    """Inverse operations of the last revisions."""
    ops = _ops(spark, sf_dir)
    return store.undo(ops, list(range(40, 80)), 1_000_000).select("revision", F.col("seq").cast("long").alias("seq"), "op", "id")


STORE_UNDO = f"""
WITH {_OPS_SQL} SELECT CAST(1000001 AS BIGINT) AS revision, row_number() OVER (ORDER BY revision DESC) - 1 AS seq,
CASE op WHEN 'insert' THEN 'delete' WHEN 'delete' THEN 'insert' WHEN 'set' THEN 'unset' ELSE 'set' END AS op, id FROM ops WHERE revision BETWEEN 40 AND 79"""


def store_gc_shipped(spark, sf_dir):
    """Parts that no line item shipped from a date on references: count and size reclaimed."""
    blobs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("blob_id"), F.col("p_size").cast("long").alias("size"))
    refs = table(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '2001-07-01'").select(F.array("l_partkey").alias("blob_refs"))
    return store.reclaimed(store.collect_garbage(blobs, store.referenced_blobs(refs)))


STORE_GC_SHIPPED = """
SELECT count(*) AS blobs, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS bytes FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-07-01')"""


def _tree(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("position"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.col("n_nationkey").cast("long").alias("position"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"), F.col("c_custkey").alias("position"))
    return r.union(n).union(c)


_TREE_SQL = """
e AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_regionkey AS position FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation
      UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey FROM customer)"""


def subtree(spark, sf_dir):
    """Everything under two regions, in pre-order."""
    e = _tree(spark, sf_dir)
    return store.subtree(e, e.where("id IN ('r1', 'r3')").select("id")).select("root", "id", F.col("depth").cast("long").alias("depth"), "path")


SUBTREE = f"""
WITH RECURSIVE {_TREE_SQL}, t AS (
    SELECT id AS root, id, 0 AS depth, lpad(CAST(position AS VARCHAR), 10, '0') AS path FROM e WHERE id IN ('r1', 'r3')
    UNION ALL SELECT t.root, e.id, t.depth + 1, t.path || '/' || lpad(CAST(e.position AS VARCHAR), 10, '0') FROM t JOIN e ON e.parent = t.id)
SELECT root, id, CAST(depth AS BIGINT) AS depth, path FROM t"""


def unique_roots(spark, sf_dir):
    """Chosen nodes without those under another chosen one."""
    e = _tree(spark, sf_dir)
    return store.unique_roots(e, e.where("id IN ('r1', 'n2', 'n3') OR (startswith(id, 'c') AND position % 7 = 0)").select("id"))


UNIQUE_ROOTS = f"""
WITH {_TREE_SQL}, c AS (SELECT * FROM e WHERE id IN ('r1', 'n2', 'n3') OR (starts_with(id, 'c') AND position % 7 = 0))
SELECT id FROM c WHERE (parent IS NULL OR parent NOT IN (SELECT id FROM c)) AND coalesce((SELECT x.parent FROM e x WHERE x.id = c.parent), '-') NOT IN (SELECT id FROM c)"""


def visual_order(spark, sf_dir):
    """Opacity multiplied down the tree, hidden subtrees left out."""
    e = _tree(spark, sf_dir).withColumn("opacity", 1 - (F.col("position") % 4) / 8).withColumn("visible", (F.col("position") % 6 != 5) | F.startswith("id", F.lit("r")))
    out = store.visual_order(e, e.where("parent IS NULL").select("id"))
    return out.select("root", "id", F.round("opacity", 6).alias("opacity"))


VISUAL_ORDER = f"""
WITH RECURSIVE {_TREE_SQL}, v AS (SELECT *, 1 - (position % 4) / 8 AS opacity FROM e WHERE position % 6 <> 5 OR starts_with(id, 'r')),
t AS (SELECT id AS root, id, CAST(opacity AS DOUBLE) AS opacity FROM v WHERE parent IS NULL UNION ALL SELECT t.root, v.id, t.opacity * v.opacity FROM t JOIN v ON v.parent = t.id)
SELECT root, id, round(opacity, 6) AS opacity FROM t"""


def relation_closure_all(spark, sf_dir):
    """Orders and parts joined to a part by line items, two ways, over all line items."""
    rel = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"))
    return store.closure(rel, rel.where("target = 'p40'").select(F.col("target").alias("id")).distinct())


RELATION_CLOSURE_ALL = """
WITH RECURSIVE r AS (SELECT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem), u AS (SELECT a, b FROM r UNION SELECT b, a FROM r),
t AS (SELECT 'p40' AS id WHERE EXISTS (SELECT 1 FROM r WHERE b = 'p40') UNION SELECT u.b FROM t JOIN u ON u.a = t.id)
SELECT id FROM t"""


def relation_rules(spark, sf_dir):
    """Functional relations with several targets, and ends of the wrong kind."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "Presents").when(F.col("l_returnflag") == "N", "FitsTo").otherwise("Inside")
    rel = li.select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").cast("long").alias("target"), kind.alias("kind"))
    kinds = spark.range(1, 8).select("id", F.when(F.col("id") < 4, "content").otherwise("region").alias("kind"))
    layers = table(spark, sf_dir, "orders").where("o_orderkey > 7").select(F.col("o_orderkey").alias("id"), F.lit("layer").alias("kind"))
    bad = store.endpoint_violations(rel, kinds.union(layers)).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("endpoint").alias("rule"), "kind", "n")
    many = store.functional_violations(rel).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("functional").alias("rule"), "kind", "n")
    return bad.union(many)


RELATION_RULES = """
WITH r AS (SELECT l_orderkey AS s, l_linenumber AS t, CASE l_returnflag WHEN 'A' THEN 'Presents' WHEN 'N' THEN 'FitsTo' ELSE 'Inside' END AS kind FROM lineitem),
k AS (SELECT i AS id, CASE WHEN i < 4 THEN 'content' ELSE 'region' END AS kind FROM range(1, 8) x(i) UNION ALL SELECT o_orderkey, 'layer' FROM orders WHERE o_orderkey > 7),
j AS (SELECT r.*, a.kind AS sk, b.kind AS tk FROM r LEFT JOIN k a ON a.id = s LEFT JOIN k b ON b.id = t)
SELECT 'endpoint' AS rule, kind, count(*) AS n FROM j
WHERE NOT CASE kind WHEN 'Presents' THEN coalesce(sk = 'layer' AND tk = 'content', false) WHEN 'FitsTo' THEN coalesce(sk = 'layer' AND tk = 'region', false) ELSE coalesce(sk = 'region' AND tk = 'region', false) END GROUP BY 2
UNION ALL SELECT 'functional', kind, count(*) FROM (SELECT s, kind FROM r WHERE kind IN ('Presents', 'FitsTo') GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 2"""


def checkpoint_due(spark, sf_dir):
    """Commits at which a checkpoint is due."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("revision"), F.coalesce(F.col("user_id"), F.lit(0)).alias("bytes"), (F.col("event_id") % 400 == 0).alias("checkpointed"))
    return store.needs_checkpoint(e, 300, 25000).groupBy("epoch").agg(F.count_if("due").alias("due"), F.max("commits").alias("commits"), F.max("size").alias("size"))


CHECKPOINT_DUE = """
WITH c AS (SELECT event_id AS revision, coalesce(user_id, 0) AS bytes, event_id % 400 = 0 AS cp FROM events),
x AS (SELECT *, sum(CAST(cp AS INT)) OVER (ORDER BY revision ROWS UNBOUNDED PRECEDING) - CAST(cp AS INT) AS epoch FROM c),
y AS (SELECT *, count(*) OVER w AS commits, sum(bytes) OVER w AS size FROM x WINDOW w AS (PARTITION BY epoch ORDER BY revision ROWS UNBOUNDED PRECEDING))
SELECT CAST(epoch AS BIGINT) AS epoch, count_if(commits >= 300 OR size >= 25000) AS due, max(commits) AS commits, CAST(max(size) AS BIGINT) AS size FROM y GROUP BY 1"""


def guard_verdicts(spark, sf_dir):
    """Host, origin and token checks of requests made of pages."""
    p = table(spark, sf_dir, "pages").select(
        "page_id", F.when(F.col("page_id") % 5 == 0, "evil.test").otherwise("localhost:8080").alias("host"),
        F.when(F.col("page_id") % 3 == 0, "https://x.test").when(F.col("page_id") % 3 == 1, "moz-extension://1").alias("origin"), F.when(F.col("page_id") % 7 == 0, "bad").otherwise("secret").alias("token"),
    )
    hosts = settings.allowed_hosts(spark.createDataFrame([("127.0.0.1", 8080)], "host string, port int"))
    origins = spark.createDataFrame([("http://localhost",)], "origin string")
    import hashlib

    return settings.guard(p, hosts, origins, hashlib.sha256(b"secret").hexdigest()).groupBy("verdict").agg(F.count("*").alias("n"))


GUARD_VERDICTS = """
SELECT CASE WHEN page_id % 5 = 0 THEN 'host' WHEN page_id % 3 = 0 THEN 'origin' WHEN page_id % 7 = 0 THEN 'token' ELSE 'ok' END AS verdict, count(*) AS n FROM pages GROUP BY 1"""


def export_names(spark, sf_dir):
    """File names of exported pages."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", k.page_file_name(F.col("page_id"), F.col("url")).alias("name"))


EXPORT_NAMES = r"""SELECT page_id, lpad(CAST(page_id AS VARCHAR), CAST(greatest(4, length(CAST(page_id AS VARCHAR))) AS INTEGER), '0') || '_' || regexp_replace(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '[. ]+$', '') AS name FROM pages"""


def stage_schedule(spark, sf_dir):
    """Next stage of each order's page whose needs are done."""
    o = table(spark, sf_dir, "orders")
    names = spark.createDataFrame([(0, "detection"), (1, "ocr"), (2, "translation"), (3, "inpainting")], "ordinal int, stage string")
    st = o.select(F.col("o_orderkey").alias("page")).distinct().crossJoin(F.broadcast(names)).where("NOT (stage = 'ocr' AND page % 5 = 0)")
    done = st.where("(page % 4 >= 1 AND stage = 'detection') OR (page % 4 >= 2 AND stage = 'ocr') OR (page % 4 = 3 AND stage = 'translation')").select("page", "stage")
    busy = names.where("stage = 'inpainting'")
    needs = spark.createDataFrame([("ocr", "detection"), ("translation", "ocr"), ("inpainting", "ocr"), ("translation", "detection"), ("inpainting", "detection")], "stage string, need string")
    return reports.next_stage(st, done, busy, needs).groupBy("stage").agg(F.count("*").alias("n"))


STAGE_SCHEDULE = """
WITH p AS (SELECT DISTINCT o_orderkey AS page FROM orders)
SELECT stage, count(*) AS n FROM (
    SELECT CASE WHEN page % 4 = 0 THEN 'detection' WHEN page % 5 <> 0 AND page % 4 = 1 THEN 'ocr' WHEN page % 4 <> 3 THEN 'translation' END AS stage FROM p
) WHERE stage IS NOT NULL GROUP BY 1"""

QUERIES = {
    "store_fold": (store_fold, STORE_FOLD), "store_changes": (store_changes, STORE_CHANGES), "store_conflicts": (store_conflicts, STORE_CONFLICTS), "store_undo": (store_undo, STORE_UNDO),
    "store_gc_shipped": (store_gc_shipped, STORE_GC_SHIPPED), "subtree": (subtree, SUBTREE), "unique_roots": (unique_roots, UNIQUE_ROOTS), "visual_order": (visual_order, VISUAL_ORDER),
    "relation_closure_all": (relation_closure_all, RELATION_CLOSURE_ALL), "relation_rules": (relation_rules, RELATION_RULES), "checkpoint_due": (checkpoint_due, CHECKPOINT_DUE),
    "guard_verdicts": (guard_verdicts, GUARD_VERDICTS), "export_names": (export_names, EXPORT_NAMES), "stage_schedule": (stage_schedule, STAGE_SCHEDULE),
}
