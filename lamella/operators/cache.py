"""Result cache as a table: key, urls, at, used, bytes, hits and what hangs on them (times in ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.keys import TTL_MS

ENTRIES = 500
BYTES = 1 << 30
URLS = 8


def fresh(at: Column, now: Column, ttl: int = TTL_MS) -> Column:
    return F.coalesce(at >= now - ttl, F.lit(False))


def by_key(entries: DataFrame, key: Column, now: Column) -> DataFrame:
    return entries.where((F.col("key") == key) & fresh(F.col("at"), now))


def by_url(entries: DataFrame, lookups: DataFrame, now: Column) -> DataFrame:
    """lookups (url_key) with the newest fresh entry that carries the address."""
    urls = entries.where(fresh(F.col("at"), now)).select(F.explode("urls").alias("url_key"), "key", "at")
    best = urls.groupBy("url_key").agg(F.max_by("key", F.struct("at", "key")).alias("key"))
    return lookups.join(best, "url_key", "left")


def lookup_report(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if(F.col("key").isNotNull()).alias("hits"), F.count_if(F.col("key").isNull()).alias("misses"))


def listing(entries: DataFrame, limit: int = 30) -> DataFrame:
    """The newest entries without their bodies."""
    return entries.drop("blob").orderBy(F.desc("at"), "key").limit(limit)


def put(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert: the latest row of each key."""
    cols = [c for c in entries.columns if c != "key"]
    both = entries.unionByName(rows)
    return both.groupBy("key").agg(F.max_by(F.struct(*cols), "at").alias("v")).select("key", "v.*").select(*entries.columns)


def touch(entries: DataFrame, touches: DataFrame, most: int = URLS) -> DataFrame:
    """touches (key, url_key, at): used moves on, hits count up, new addresses join the last ``most``."""
    seen = touches.groupBy("key").agg(
        F.max("at").alias("__used"), F.count("*").alias("__hits"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "url_key"))), lambda u: u["url_key"]).alias("__urls"),
    )
    out = entries.join(seen, "key", "left")
    urls = F.array_union("urls", F.coalesce("__urls", F.slice("urls", 1, 0)))
    tail = F.when(F.size(urls) > most, F.slice(urls, F.size(urls) - most + 1, F.lit(most))).otherwise(urls)
    return out.withColumn("used", F.greatest("used", "__used")).withColumn("hits", F.col("hits") + F.coalesce("__hits", F.lit(0))).withColumn("urls", tail).select(*entries.columns)


def drop_expired(entries: DataFrame, now: Column, ttl: int = TTL_MS) -> DataFrame:
    return entries.where(fresh(F.col("at"), now, ttl))


def enforce_caps(entries: DataFrame, most: int = ENTRIES, most_bytes: int = BYTES, scope: list[str] | None = None) -> DataFrame:
    """The longest newest-first prefix within both caps: what evicting the oldest until both hold leaves.

    The order is (used, bytes, key), falling. ``scope`` names columns that
    hold separate caches, which are cut side by side.
    """
    w = Window.partitionBy(*(scope or [F.lit(0)])).orderBy(F.desc("used"), F.desc("bytes"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = entries.withColumn("__n", F.count("*").over(w)).withColumn("__b", F.sum("bytes").over(w))
    return ranked.where((F.col("__n") <= most) & (F.col("__b") <= most_bytes)).drop("__n", "__b")


def sweep(entries: DataFrame, now: Column, most: int = ENTRIES, most_bytes: int = BYTES) -> DataFrame:
    return enforce_caps(drop_expired(entries, now), most, most_bytes)


def mark_seamed(entries: DataFrame, marks: DataFrame) -> DataFrame:
    """marks (key, edge, expected_at): an edge joins the entry's list once, if the entry is still the one that was read."""
    m = marks.groupBy("key", F.col("expected_at").alias("at")).agg(F.sort_array(F.collect_set("edge")).alias("__e"))
    return entries.join(m, ["key", "at"], "left").withColumn("seamed", F.array_union(F.coalesce("seamed", F.array()), F.coalesce("__e", F.array()))).select(*entries.columns)


def totals(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def summary(entries: DataFrame, counters: DataFrame) -> DataFrame:
    """Totals beside counters (name, n) of hits and misses; two one-row tables."""
    c = counters.agg(F.coalesce(F.sum(F.when(F.col("name") == "hit", F.col("n"))), F.lit(0)).alias("hits"), F.coalesce(F.sum(F.when(F.col("name") == "miss", F.col("n"))), F.lit(0)).alias("misses"))
    return totals(entries).crossJoin(F.broadcast(c))


def bump(counters: DataFrame, events: DataFrame) -> DataFrame:
    return counters.unionByName(events.groupBy("name").agg(F.count("*").alias("n"))).groupBy("name").agg(F.sum("n").alias("n"))


def clear(entries: DataFrame) -> DataFrame:
    return entries.limit(0)


def limits(value: Column, fallback: int) -> Column:
    """A positive number as given, else the fallback."""
    n = value.try_cast("bigint")
    return F.when(n > 0, n).otherwise(F.lit(fallback).cast("bigint"))
