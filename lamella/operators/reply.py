"""Reply reconciliation: reply records against the segments that were asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions import text as t


def segment_id(value: Column) -> Column:
    """An integer or a numeric string; null otherwise."""
    return value.cast("string").try_cast("bigint")


def place_replies(segments: DataFrame, replies: DataFrame) -> DataFrame:
    """Segments (page, id, source) with the first reply (page, pos, id, text) to them; unanswered ones keep their source."""
    first = replies.groupBy("page", "id").agg(F.min_by(F.struct("text", "pos"), "pos").alias("r")).select("page", "id", "r.text", "r.pos")
    out = segments.join(first, ["page", "id"], "left")
    return out.select("page", "id", "source", F.coalesce("text", "source").alias("translated"), F.col("pos").isNotNull().alias("answered"), "pos")


def reply_counters(segments: DataFrame, replies: DataFrame) -> DataFrame:
    """Per page: segments, placed, duplicate ids, ids out of range, placed out of order, missing."""
    known = segments.select("page", "id", F.lit(True).alias("__known")).distinct()
    r = replies.join(known, ["page", "id"], "left")
    per_id = r.groupBy("page", "id", "__known").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    w = Window.partitionBy("page").orderBy("pos")
    placed = per_id.where("__known").withColumn("__back", F.coalesce(F.col("id") < F.lag("id").over(w), F.lit(False)))
    counts = placed.groupBy("page").agg(F.count("*").alias("placed"), F.sum(F.col("n") - 1).alias("duplicate_ids"), F.count_if("__back").alias("out_of_order"))
    beyond = per_id.where("__known IS NULL").groupBy("page").agg(F.sum("n").alias("out_of_range_ids"))
    total = segments.groupBy("page").agg(F.count("*").alias("segments"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = total.join(counts, "page", "left").join(beyond, "page", "left")
    return out.select("page", "segments", zero("placed"), zero("duplicate_ids"), zero("out_of_range_ids"), zero("out_of_order"), (F.col("segments") - F.coalesce("placed", F.lit(0))).alias("missing"))


def worth_reporting(missed: Column, truncated: Column, duplicates: Column, beyond: Column) -> Column:
    return (missed > 0) | truncated | (duplicates > 0) | (beyond > 0)


def nothing_translated(segments: Column, missed: Column) -> Column:
    return (segments > 0) & (missed >= segments)


def page_context(segments: DataFrame) -> DataFrame:
    """Every segment with the other translated segments of its page, in order."""
    pair = F.struct("pos", F.col("source").alias("source"), F.col("translated").alias("translation"))
    all_ = segments.where(~t.is_blank(F.col("translated"))).groupBy("page").agg(F.array_sort(F.collect_list(pair)).alias("__all"))
    return segments.join(all_, "page", "left").withColumn("context", F.filter(F.coalesce("__all", F.array()), lambda p: p["pos"] != F.col("pos"))).drop("__all")


def split_fragments(segments: DataFrame) -> DataFrame:
    """Answered segments whose translation looks cut."""
    return segments.where(F.col("answered") & t.is_cut(F.col("translated")))


def cut_repair_targets(rows: DataFrame, votes: DataFrame, threshold: float = 0.5, neighbours: bool = False) -> DataFrame:
    """Rows to ask again: cut ones; the tail behind the first cut where the cascade vote passes, else neighbours on demand.

    rows carry page, is_cut, tail and neighbour; votes carry page and vote.
    """
    r = rows.join(votes.select("page", "vote"), "page", "left")
    cascade = F.coalesce(F.col("vote") > threshold, F.lit(False))
    return r.where(F.col("is_cut") | (cascade & F.col("tail")) | (~cascade & F.lit(neighbours) & F.col("neighbour"))).drop("vote")


def accept_repair(text: Column, answered: Column, source: Column) -> Column:
    """A new answer counts if it is there, not blank, not cut and no echo of the source."""
    return answered & ~t.is_blank(text) & ~t.is_cut(text) & (t.strip_space(text) != t.strip_space(source))


def retry_is_cleaner(before: Column, after: Column, truncated: Column) -> Column:
    """A retry stays if it has strictly fewer fragments and wasn't cut short."""
    return (after < before) & ~truncated


def repair_counters(rows: DataFrame) -> DataFrame:
    """repaired, echoed, failed per page from asked-again rows (page, source, text, answered)."""
    ok = accept_repair(F.col("text"), F.col("answered"), F.col("source"))
    echo = F.col("answered") & (t.strip_space(F.col("text")) == t.strip_space(F.col("source")))
    return rows.groupBy("page").agg(F.count_if(ok).alias("repaired"), F.count_if(echo).alias("echoed"), F.count_if(~ok & ~echo).alias("failed"))
