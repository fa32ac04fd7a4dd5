"""Queries of the sequence and state planes with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamella.operators import cache, history, regions, reply, reports, sequence
from lamella.plans import samples as s
from lamella.plans.text_plane import _counts
from lamella.sources.readers import glossary_lines
from lamella.sources.tables import table

_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CUT = r"(regexp_matches({0}, '\S') AND regexp_matches({0}, '\s$'))"


def story_window(spark, sf_dir):
    """Newest 20 recordable pairs of each story."""
    w = history.story_window(s.pairs(spark, sf_dir), 20)
    return w.select("story", "page", "pos", F.col("age").cast("long").alias("age"))


_GOOD = rf"""
good AS (
    SELECT * FROM pairs WHERE {_TRIM.format('source')} <> '' AND {_TRIM.format('translation')} <> '' AND {_TRIM.format('source')} <> {_TRIM.format('translation')}
    AND NOT (len({_WORDS.format('translation')}) >= 12 AND len(list_distinct(list_transform({_WORDS.format('translation')}, lambda x: lower(x)))) < 0.20 * len({_WORDS.format('translation')}))
)"""
STORY_WINDOW = f"""
WITH {s.PAIRS_SQL}, {_GOOD}
SELECT story, page, pos, age FROM (SELECT *, row_number() OVER (PARTITION BY story ORDER BY page DESC, pos DESC) AS age FROM good) WHERE age <= 20"""


def story_visible(spark, sf_dir):
    """How many pairs each page sees, its own excluded."""
    p = s.pairs(spark, sf_dir)
    return history.visible_context(p.select("story", "page"), p, 20)


STORY_VISIBLE = f"""
WITH {s.PAIRS_SQL}, {_GOOD}
SELECT p.story, p.page, least(count(g.page), 20) AS visible, count(g.page) AS recorded
FROM (SELECT DISTINCT story, page FROM pairs) p LEFT JOIN good g ON g.story = p.story AND g.page < p.page GROUP BY 1, 2"""


def ledger_drift(spark, sf_dir):
    """Parts with two flag and status renderings or more, without pinned ones."""
    li = table(spark, sf_dir, "lineitem")
    obs = li.select(
        (F.col("l_suppkey") % 3).alias("series"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat("l_returnflag", F.lit("/"), "l_linestatus").alias("translated"),
        F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("at"),
    )
    pinned = table(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("series"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("term"))
    out = history.drifting_terms(history.ledger(obs), pinned)
    return out.select("series", "term", "total", "n_renderings", F.array_join("renderings", ",").alias("renderings"))


LEDGER_DRIFT = """
WITH l AS (SELECT l_suppkey % 3 AS series, 'p' || l_partkey AS term, l_returnflag || '/' || l_linestatus AS rendering, count(*) AS n FROM lineitem WHERE l_partkey % 10 <> 0 GROUP BY 1, 2, 3)
SELECT series, term, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_renderings, string_agg(rendering, ',' ORDER BY n DESC, rendering) AS renderings FROM l GROUP BY 1, 2 HAVING count(*) >= 2"""


def _reply_tables(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber")
    replies = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("id"), F.concat(F.lit("r"), F.col("l_partkey").cast("string")).alias("text"), F.row_number().over(w).alias("pos"))
    segments = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("id"))
    return segments.withColumn("source", F.concat(F.lit("s"), F.col("id").cast("string"))), replies


_REPLIES_SQL = """
r AS (SELECT l_orderkey AS page, l_linenumber AS id, 'r' || l_partkey AS text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS pos FROM lineitem),
seg AS (SELECT o_orderkey AS page, unnest([1, 2, 3, 4, 5]) AS id FROM orders),
first AS (SELECT page, id, arg_min(text, pos) AS text, min(pos) AS pos, count(*) AS n FROM r GROUP BY 1, 2)"""


def reply_reconcile(spark, sf_dir):
    """Counters of replies against segments."""
    return reply.reply_counters(*_reply_tables(spark, sf_dir))


REPLY_RECONCILE = f"""
WITH {_REPLIES_SQL}, placed AS (SELECT f.*, coalesce(f.id < lag(f.id) OVER (PARTITION BY f.page ORDER BY pos), false) AS back FROM first f JOIN seg USING (page, id)),
p AS (SELECT page, count(*) AS placed, sum(n - 1) AS dup, count_if(back) AS back FROM placed GROUP BY page),
b AS (SELECT page, sum(n) AS beyond FROM first WHERE id NOT BETWEEN 1 AND 5 GROUP BY page)
SELECT o_orderkey AS page, 5 AS segments, coalesce(placed, 0) AS placed, CAST(coalesce(dup, 0) AS BIGINT) AS duplicate_ids, CAST(coalesce(beyond, 0) AS BIGINT) AS out_of_range_ids,
       coalesce(back, 0) AS out_of_order, 5 - coalesce(placed, 0) AS missing
FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN p ON p.page = o_orderkey LEFT JOIN b ON b.page = o_orderkey"""


def reply_placement(spark, sf_dir):
    """Segments with their first reply or their source."""
    out = reply.place_replies(*_reply_tables(spark, sf_dir))
    return out.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "translated"))), lambda x: x["translated"]), ",").alias("texts"), F.count_if("answered").alias("answered"))


REPLY_PLACEMENT = f"""
WITH {_REPLIES_SQL} SELECT seg.page, string_agg(coalesce(text, 's' || seg.id), ',' ORDER BY seg.id, text) AS texts, count(pos) AS answered FROM seg LEFT JOIN first USING (page, id) GROUP BY 1"""


def cut_neighbours(spark, sf_dir):
    """Cut turns, their neighbours and the tail behind the first cut."""
    seg = s.segments(spark, sf_dir).groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return sequence.after_cuts(seg, ["conv_id"], "turn", "text").select("conv_id", "turn", "is_cut", "neighbour", "tail")


CUT_NEIGHBOURS = f"""
WITH {s.SEGMENTS_SQL}, c AS (SELECT conv_id, turn, {_CUT.format('min(text)')} AS is_cut FROM segments GROUP BY 1, 2)
SELECT conv_id, turn, is_cut, coalesce(lag(is_cut) OVER w, false) AND NOT is_cut AS neighbour,
       bool_or(is_cut) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AND NOT is_cut AS tail FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""


def cascade_vote(spark, sf_dir):
    """Share of turns behind a cut that fit the source before better."""
    p = s.pairs(spark, sf_dir).withColumn("translation", F.when((F.col("page") + F.col("pos")) % 3 == 0, F.concat("translation", F.lit(" "))).otherwise(F.col("translation")))
    out = sequence.cascade_vote(p, ["page"], "pos", "source", "translation")
    return out.select("page", "total", "wins", F.round("vote", 6).alias("vote"))


CASCADE_VOTE = f"""
WITH {s.PAIRS_SQL}, c AS (SELECT page, pos, source, CASE WHEN (page + pos) % 3 = 0 THEN translation || ' ' ELSE translation END AS tr FROM pairs),
v AS (SELECT page, source, tr, lag(source) OVER w AS prev, coalesce(bool_or({_CUT.format('tr')}) OVER (PARTITION BY page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS behind FROM c WINDOW w AS (PARTITION BY page ORDER BY pos)),
k AS (SELECT page, count(*) AS total, count_if(abs(ln((length(tr) + 1) / (length(prev) + 1))) < abs(ln((length(tr) + 1) / (length(source) + 1)))) AS wins
      FROM v WHERE behind AND prev IS NOT NULL AND regexp_matches(tr, '\\S') GROUP BY page)
SELECT page, total, wins, round(CASE WHEN total < 2 THEN 0.0 ELSE wins / total END, 6) AS vote FROM k"""


def page_shape_runs(spark, sf_dir):
    """Longest runs of users' events of one type within a day's length."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    same = F.lag("event_type").over(w) == F.col("event_type")
    r = sequence.runs(e.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", same)
    lengths = r.groupBy("user_id", "run").agg(F.count("*").alias("n"))
    return lengths.groupBy("user_id").agg(F.max("n").alias("longest"), F.count("*").alias("runs"), F.when(F.max("n") >= 3, "strip").otherwise("paged").alias("shape"))


PAGE_SHAPE_RUNS = """
WITH r AS (SELECT user_id, event_id, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (
    SELECT user_id, event_id, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM events)),
l AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY 1, 2)
SELECT user_id, max(n) AS longest, count(*) AS runs, CASE WHEN max(n) >= 3 THEN 'strip' ELSE 'paged' END AS shape FROM l GROUP BY 1"""


def slice_runs(spark, sf_dir):
    """Joined run lengths from each slice on, over events as slices."""
    e = table(spark, sf_dir, "events")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    sl = e.select(F.col("user_id").alias("run"), idx.cast("long").alias("idx"), (F.col("event_id") % 3 != 0).alias("spans"))
    return sequence.run_length(sl).select("run", "idx", F.col("length").cast("long").alias("length"))


SLICE_RUNS = """
WITH x AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, event_id % 3 <> 0 AS spans FROM events),
y AS (SELECT *, min(CASE WHEN NOT spans THEN idx END) OVER (PARTITION BY run ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop, max(idx) OVER (PARTITION BY run) AS last FROM x)
SELECT run, idx, CASE WHEN idx = last THEN 0 WHEN stop IS NULL THEN CASE WHEN idx + 5 <= last THEN 6 ELSE 0 END ELSE least(6, stop - idx + 1) END AS length FROM y"""


def _entries(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return e.groupBy((F.col("user_id") % 50).alias("site"), F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")).alias("key")).agg(
        F.max(at).alias("used"), F.min(at).alias("at"), F.sum(F.round(F.abs("value") * 100).cast("long")).alias("bytes"), F.count("*").alias("hits")
    )


_ENTRIES_SQL = """
entries AS (SELECT user_id % 50 AS site, event_type || '-' || user_id AS key, max(epoch_us(ts) // 1000) AS used, min(epoch_us(ts) // 1000) AS at, CAST(sum(CAST(round(abs(value) * 100) AS BIGINT)) AS BIGINT) AS bytes, count(*) AS hits FROM events GROUP BY 1, 2)"""


def cache_lru_ttl(spark, sf_dir):
    """Entries of each site that stay after expiry and both caps."""
    e = _entries(spark, sf_dir)
    now = e.agg(F.max("used").alias("now"))
    live = e.crossJoin(F.broadcast(now)).where(cache.fresh(F.col("used"), F.col("now"), 20 * 24 * 3600 * 1000)).drop("now")
    return cache.enforce_caps(live, 12, 400000, ["site"]).select("site", "key", "used", "bytes")


CACHE_LRU_TTL = f"""
WITH {_ENTRIES_SQL}, live AS (SELECT * FROM entries WHERE used >= (SELECT max(used) FROM entries) - 20 * 24 * 3600 * 1000::BIGINT),
r AS (SELECT *, count(*) OVER w AS n, sum(bytes) OVER w AS b FROM live WINDOW w AS (PARTITION BY site ORDER BY used DESC, bytes DESC, key DESC ROWS UNBOUNDED PRECEDING))
SELECT site, key, used, bytes FROM r WHERE n <= 12 AND b <= 400000"""


def cache_totals(spark, sf_dir):
    """Totals and hit counters of a cache."""
    e = _entries(spark, sf_dir)
    ev = table(spark, sf_dir, "events").select(F.when(F.col("value") > 50, "hit").otherwise("miss").alias("name"))
    counters = ev.groupBy("name").agg(F.count("*").alias("n"))
    return cache.summary(e, counters)


CACHE_TOTALS = f"""
WITH {_ENTRIES_SQL} SELECT (SELECT count(*) FROM entries) AS entries, (SELECT CAST(sum(bytes) AS BIGINT) FROM entries) AS bytes, count_if(value > 50) AS hits, count_if(NOT coalesce(value > 50, false)) AS misses FROM events"""


def cache_touch(spark, sf_dir):
    """Entries after touches: use, hits and the last eight addresses."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    base = e.groupBy(F.col("user_id").alias("key")).agg(F.min("event_id").alias("used")).select("key", "used", F.lit(0).cast("long").alias("hits"), F.array(F.lit("first")).alias("urls"))
    touches = e.select(F.col("user_id").alias("key"), F.concat_ws(":", "event_type", (F.col("event_id") % 5).cast("string")).alias("url_key"), F.col("event_id").alias("at"))
    out = cache.touch(base, touches)
    return out.select("key", "used", "hits", F.size("urls").cast("long").alias("n_urls"))


CACHE_TOUCH = """
SELECT user_id AS key, max(event_id) AS used, count(*) AS hits, least(8, 1 + count(DISTINCT event_type || ':' || event_id % 5)) AS n_urls FROM events GROUP BY 1"""


def latch_language(spark, sf_dir):
    """Language and format of hosts by script evidence."""
    out = history.latch(history.script_evidence(s.reads(spark)))
    return out.select("host", F.col("total").cast("long").alias("total"), "ready", "language", "format", F.round("share", 6).alias("share"))


LATCH_LANGUAGE = f"""
WITH c AS (SELECT host, format, {_counts('text')} AS c FROM ({s.READS_SQL})),
e AS (SELECT host, sum(c.kana) AS kana, sum(c.han) AS han, sum(c.hangul) AS hangul, count_if(format = 'strip') AS strip, count_if(format = 'paged') AS paged FROM c GROUP BY host),
d AS (SELECT *, CASE WHEN kana + han > 0 THEN kana / (kana + han) ELSE 0.0 END AS s, kana + han + hangul AS total FROM e)
SELECT host, CAST(total AS BIGINT) AS total, total >= 40 AS ready,
       CASE WHEN total >= 40 THEN CASE WHEN hangul > kana + han THEN 'ko' WHEN s >= 0.35 THEN 'ja' WHEN han > 0 THEN 'zh' ELSE '' END END AS language,
       CASE WHEN total >= 40 THEN CASE WHEN strip >= paged THEN 'strip' ELSE 'paged' END END AS format, CASE WHEN total >= 40 THEN round(s, 6) END AS share FROM d"""


def weighted_lower_median(spark, sf_dir):
    """Weighted lower median of prices by supplier."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("q"))
    return sequence.weighted_lower_median(li, ["l_suppkey"], "l_extendedprice", "q")


WEIGHTED_LOWER_MEDIAN = """
WITH r AS (SELECT l_suppkey, l_extendedprice, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice RANGE UNBOUNDED PRECEDING) AS cum,
                  sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey) AS total FROM lineitem)
SELECT l_suppkey, min(l_extendedprice) AS median FROM r WHERE 2 * cum >= total GROUP BY 1"""


def middle_medians(spark, sf_dir):
    """Floor-of-middles and upper medians of sizes by brand."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_list(F.col("p_size").cast("long")).alias("v"))
    return p.select("p_brand", sequence.middle_median(F.col("v")).cast("long").alias("middle"), sequence.upper_median(F.col("v")).alias("upper"))


MIDDLE_MEDIANS = """
SELECT p_brand, CASE WHEN len(v) % 2 = 1 THEN v[len(v) // 2 + 1] ELSE (v[len(v) // 2] + v[len(v) // 2 + 1]) // 2 END AS middle, v[len(v) // 2 + 1] AS upper
FROM (SELECT p_brand, list_sort(list(CAST(p_size AS BIGINT))) AS v FROM part GROUP BY 1)"""


def probe_sample(spark, sf_dir):
    """Five evenly spaced healthy segments of each story."""
    p = s.pairs(spark, sf_dir).select(F.col("story").alias("page"), (F.col("page") * 1000 + F.col("pos")).alias("pos"), "source", F.col("translation").alias("translated"))
    return regions.probe_sample(p, 5).select("page", "pos")


PROBE_SAMPLE = f"""
WITH {s.PAIRS_SQL}, h AS (
    SELECT story AS page, page * 1000 + pos AS pos FROM pairs WHERE regexp_matches(translation, '\\S') AND NOT {_CUT.format('translation')}
    AND {_TRIM.format('translation')} <> {_TRIM.format('source')} AND length({_TRIM.format('source')}) >= 4
), n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY page) AS c FROM h)
SELECT page, pos FROM n WHERE list_contains([i * c // least(5, c) for i in range(5) if i < least(5, c)], k)"""


def run_report(spark, sf_dir):
    """Counts, rates and spread of events by type."""
    return reports.run_report(table(spark, sf_dir, "events"), "event_type", "value", F.col("value") > 50)


RUN_REPORT = """
SELECT event_type, count(*) AS n, count_if(value > 50) AS flagged, round(count_if(value > 50) / count(*), 6) AS rate, round(sum(value), 2) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY 1"""


def outcome_counters(spark, sf_dir):
    """Page counters over conversations as regions."""
    seg = s.segments(spark, sf_dir)
    r = seg.select(F.col("conv_id").alias("page"), F.col("text").alias("source"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")).alias("translated"),
                   F.when(F.col("turn") % 4 == 1, "junk").alias("refused"), F.when(F.col("role") == "user", "onomatopoeia").alias("label"))
    return reports.outcome_counters(r)


OUTCOME_COUNTERS = f"""
WITH {s.SEGMENTS_SQL}, r AS (SELECT conv_id AS page, text AS source, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS tr, turn % 4 = 1 AS refused, role FROM segments)
SELECT page, count(*) AS regions, count_if(NOT regexp_matches(tr, '\\S')) AS missed, count_if(regexp_matches(source, '\\S') AND NOT regexp_matches(tr, '\\S') AND NOT refused) AS dropped,
       count_if({_CUT.format('tr')} AND NOT refused) AS split, count_if(refused) AS refused, count_if(role = 'user') AS effects FROM r GROUP BY 1"""


def glossary_parse(spark, sf_dir):
    """Glossary lines made of parts, with their errors."""
    p = table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 6
    line = F.when(kind == 0, F.concat(F.lit("# "), F.col("p_name"))).when(kind == 1, F.col("p_brand")).when(kind == 2, F.concat(F.col("p_brand"), F.lit(" = "))).when(
        kind == 3, F.concat(F.lit("  "), F.col("p_brand"), F.lit(" = a = b "))
    ).otherwise(F.concat_ws(" = ", "p_name", "p_brand"))
    texts = p.groupBy((F.col("p_partkey") % 40).alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return glossary_lines(texts).select("key", F.col("line").cast("long").alias("line"), "source", "translation", "error")


GLOSSARY_PARSE = r"""
WITH l AS (
    SELECT p_partkey % 40 AS key, row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) AS line,
           trim(CASE p_partkey % 6 WHEN 0 THEN '# ' || p_name WHEN 1 THEN p_brand WHEN 2 THEN p_brand || ' = ' WHEN 3 THEN '  ' || p_brand || ' = a = b ' ELSE p_name || ' = ' || p_brand END) AS t FROM part
), r AS (SELECT key, line, CASE WHEN contains(t, '=') THEN trim(left(t, instr(t, '=') - 1)) END AS source, CASE WHEN contains(t, '=') THEN trim(substr(t, instr(t, '=') + 1)) END AS translation FROM l WHERE NOT starts_with(t, '#')),
e AS (SELECT *, CASE WHEN source IS NULL THEN 'no =' WHEN source = '' THEN 'empty source' WHEN translation = '' THEN 'empty translation' END AS error FROM r)
SELECT key, line, source, translation, CASE WHEN error IS NULL AND row_number() OVER (PARTITION BY key, source, error IS NULL ORDER BY line) > 1 THEN 'duplicate source' ELSE error END AS error FROM e"""


def prevailing_sizes(spark, sf_dir):
    """Sizes of texts capped by their page's prevailing size."""
    b = s.boxes(spark, sf_dir).select("page", F.col("id").alias("ord"), F.col("box.height").alias("size"), F.col("box.width").alias("chars"), (F.col("label") == "panel").alias("interjection"))
    return sequence.prevailing_sizes(b).select("page", "ord", F.col("capped").cast("double").alias("capped"))


PREVAILING_SIZES = f"""
WITH {s.BOXES_SQL}, p AS (SELECT page, h, sum(w) OVER (PARTITION BY page ORDER BY h RANGE UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY page) AS total FROM boxes WHERE label <> 'panel'),
m AS (SELECT page, min(CASE WHEN 2 * cum >= total THEN h END) AS base, min(h) AS lo FROM p GROUP BY page)
SELECT b.page, b.id AS ord, CAST(CASE WHEN base IS NULL THEN h ELSE least(h, least(greatest(lo, base), base * 1.25)) END AS DOUBLE) AS capped FROM boxes b LEFT JOIN m ON m.page = b.page"""

QUERIES = {
    "story_window": (story_window, STORY_WINDOW), "story_visible": (story_visible, STORY_VISIBLE), "ledger_drift": (ledger_drift, LEDGER_DRIFT), "reply_reconcile": (reply_reconcile, REPLY_RECONCILE),
    "reply_placement": (reply_placement, REPLY_PLACEMENT), "cut_neighbours": (cut_neighbours, CUT_NEIGHBOURS), "cascade_vote": (cascade_vote, CASCADE_VOTE),
    "page_shape_runs": (page_shape_runs, PAGE_SHAPE_RUNS), "slice_runs": (slice_runs, SLICE_RUNS), "cache_lru_ttl": (cache_lru_ttl, CACHE_LRU_TTL), "cache_totals": (cache_totals, CACHE_TOTALS),
    "cache_touch": (cache_touch, CACHE_TOUCH), "latch_language": (latch_language, LATCH_LANGUAGE), "weighted_lower_median": (weighted_lower_median, WEIGHTED_LOWER_MEDIAN),
    "middle_medians": (middle_medians, MIDDLE_MEDIANS), "probe_sample": (probe_sample, PROBE_SAMPLE), "run_report": (run_report, RUN_REPORT), "outcome_counters": (outcome_counters, OUTCOME_COUNTERS),
    "glossary_parse": (glossary_parse, GLOSSARY_PARSE), "prevailing_sizes": (prevailing_sizes, PREVAILING_SIZES),
}
