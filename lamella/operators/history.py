"""State plane in batch form: story windows, renderings ledger, glossaries, script latch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions import keys
from lamella.functions import text as t

WINDOW_PAIRS = 96
MAX_TERMS = 64
MAX_TERM_BYTES = 256


def recordable(source: Column, translation: Column) -> Column:
    """Both sides there, not the same, and the translation no degenerate repetition."""
    s, x = t.strip_space(source), t.strip_space(translation)
    return F.coalesce((s != "") & (x != "") & (s != x) & ~t.degenerate_words(x), F.lit(False))


def story_window(pairs: DataFrame, most: int = WINDOW_PAIRS) -> DataFrame:
    """The newest pairs of each story (story, page, pos, source, translation), those worth recording."""
    w = Window.partitionBy("story").orderBy(F.desc("page"), F.desc("pos"))
    return pairs.where(recordable(F.col("source"), F.col("translation"))).withColumn("age", F.row_number().over(w)).where(F.col("age") <= most)


def visible_context(pages: DataFrame, pairs: DataFrame, most: int = WINDOW_PAIRS) -> DataFrame:
    """What each page (story, page) sees: pairs of earlier pages only, the newest ``most``, as a count and its first and last page.

    Counts at page grain give the window without a self join: a pair is seen
    by a page if fewer than ``most`` pairs lie between it and that page.
    """
    good = pairs.where(recordable(F.col("source"), F.col("translation")))
    per_page = good.groupBy("story", "page").agg(F.count("*").alias("n"))
    known = pages.select("story", "page").distinct().join(per_page, ["story", "page"], "full").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("story").orderBy("page")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = known.withColumn("before", before)
    return sums.select("story", "page", F.least(F.col("before"), F.lit(most)).cast("long").alias("visible"), F.col("before").cast("long").alias("recorded"))


def story_context(pairs: DataFrame, story: Column, page: Column, most: int = WINDOW_PAIRS) -> DataFrame:
    """The rows one page sees; none for a story nobody recorded."""
    return story_window(pairs.where((F.col("story") == story) & (F.col("page") < page)), most).orderBy("page", "pos")


def drop_story(pairs: DataFrame, story: str) -> DataFrame:
    return pairs.where(F.col("story") != story)


def ledger(observations: DataFrame) -> DataFrame:
    """Renderings of each term: series, term, rendering, n, last seen; from (series, source, translated, at)."""
    o = observations.select("series", keys.ledger_term(F.col("source")).alias("term"), keys.ledger_rendering(F.col("translated")).alias("rendering"), "at")
    return o.where("term <> '' AND rendering <> ''").groupBy("series", "term", "rendering").agg(F.count("*").alias("n"), F.max("at").alias("at"))


def ledger_capped(rows: DataFrame, most_terms: int = 128, most_renderings: int = 6) -> DataFrame:
    """Batch bound of a ledger: the most frequent renderings of a term, the latest terms of a series."""
    by_term = Window.partitionBy("series", "term").orderBy(F.desc("n"), F.desc("at"), "rendering")
    kept = rows.withColumn("__r", F.row_number().over(by_term)).where(F.col("__r") <= most_renderings).drop("__r")
    latest = kept.groupBy("series", "term").agg(F.max("at").alias("__at"))
    terms = latest.withColumn("__t", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("__at"), "term"))).where(F.col("__t") <= most_terms)
    return kept.join(terms.select("series", "term"), ["series", "term"], "left_semi")


def renderings(rows: DataFrame, series: str, source: Column) -> DataFrame:
    """Renderings of one term, most frequent first."""
    return rows.where((F.col("series") == series) & (F.col("term") == keys.ledger_term(source))).orderBy(F.desc("n"), "rendering").select("rendering", "n")


def drifting_terms(rows: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """Terms of two renderings or more that aren't pinned (series, term): renderings sorted, total; most used first."""
    item = F.struct((-F.col("n")).alias("k"), F.col("rendering"))
    out = rows.groupBy("series", "term").agg(F.sum("n").alias("total"), F.count("*").alias("n_renderings"), F.transform(F.array_sort(F.collect_list(item)), lambda i: i["rendering"]).alias("renderings"))
    out = out.where("n_renderings >= 2")
    return out if pinned is None else out.join(pinned, ["series", "term"], "left_anti")


def pin_options(rows: DataFrame, glossary: DataFrame) -> DataFrame:
    """Each rendering of each term with the term's current pin (series, term, translation)."""
    return rows.join(glossary.select("series", "term", F.col("translation").alias("pin")), ["series", "term"], "left")


def pin_term(glossary: DataFrame, pins: DataFrame) -> DataFrame:
    """Pins (key, source, translation, at) laid over a glossary by term key; the latest wins."""
    both = glossary.withColumn("__new", F.lit(0)).unionByName(pins.withColumn("__new", F.lit(1)))
    keyed = both.withColumn("__term", F.coalesce(F.nullif(keys.ledger_term(F.col("source")), F.lit("")), F.col("source")))
    best = keyed.groupBy("key", "__term").agg(F.max_by(F.struct("source", "translation", "at"), F.struct("__new", "at")).alias("v"))
    return best.select("key", "v.*")


def set_glossary(current: DataFrame, updates: DataFrame, most_keys: int = 8) -> DataFrame:
    """Replace-all updates (key, at, terms) over (key, at, terms): the latest per key, empty clears, the smallest go beyond ``most_keys``."""
    latest = current.unionByName(updates).groupBy("key").agg(F.max_by(F.struct("at", "terms"), "at").alias("v")).select("key", "v.*").where(F.size("terms") > 0)
    w = Window.orderBy(F.desc(F.size("terms")), F.desc("at"), "key")
    return latest.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most_keys).drop("__r")


def glossary_drifted(entries: DataFrame, current: DataFrame) -> DataFrame:
    """Entries whose stored glossary fingerprint differs from the key's present one."""
    c = current.select("key", F.col("fingerprint").alias("__now"))
    return entries.join(c, "key", "left").where(~F.coalesce("fingerprint", F.lit("")).eqNullSafe(F.coalesce("__now", F.lit("")))).drop("__now")


def reset_counts(resets: DataFrame) -> DataFrame:
    return resets.groupBy("key").agg(F.count("*").alias("resets"))


# ---------------------------------------------------------------- script latch


def script_evidence(rows: DataFrame) -> DataFrame:
    """Letters by script of each host (host, text, format)."""
    c = rows.withColumn("c", t.script_counts(F.col("text")))
    return c.groupBy("host").agg(
        F.sum("c.kana").alias("kana"), F.sum("c.han").alias("han"), F.sum("c.hangul").alias("hangul"),
        F.count_if(F.col("format") == "strip").alias("strip"), F.count_if(F.col("format") == "paged").alias("paged"),
    )


def latch(evidence: DataFrame, least: int = 40, kana_share: float = 0.35) -> DataFrame:
    """Language of a host: ready at ``least`` letters; Korean by majority, Japanese by kana share, Chinese by han, else none."""
    scripted = F.col("kana") + F.col("han")
    total = scripted + F.col("hangul")
    share = F.when(scripted > 0, F.col("kana") / scripted).otherwise(0.0)
    language = F.when(F.col("hangul") > scripted, "ko").when(share >= kana_share, "ja").when(F.col("han") > 0, "zh").otherwise("")
    form = F.when((F.col("strip") == 0) & (F.col("paged") == 0), "").when(F.col("strip") >= F.col("paged"), "strip").otherwise("paged")
    ready = total >= least
    return evidence.select("host", total.alias("total"), ready.alias("ready"), F.when(ready, language).alias("language"), F.when(ready, form).alias("format"), F.when(ready, share).alias("share"))


def engine_for(language: Column, profile: Column, manga_engine: str, other_engine: str) -> Column:
    return F.when((language == "ja") & (profile == "manga"), manga_engine).otherwise(other_engine)


def resolve_site(picks: DataFrame, latches: DataFrame) -> DataFrame:
    """Explicit picks (host, language, profile) before what the latch says."""
    profile = F.when(F.col("format") == "strip", "webtoon").when(F.col("format") == "paged", "manga").otherwise("")
    l = latches.select("host", F.col("language").alias("__l"), profile.alias("__p"))  # noqa: E741
    out = picks.join(l, "host", "full")
    pick = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(d), F.lit("")).alias(c)
    return out.select("host", pick("language", "__l"), pick("profile", "__p"))
