"""Keyed state over streams: story windows, result cache, ledgers, latches, idle timers.

The sources are processing-time and bounded per key. Aggregates that need no
bound are plain streaming aggregations; bounded state uses
``transformWithStateInPandas`` on the RocksDB store. State of a key is small
by construction: a story holds 96 pairs, a site's cache its capped entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lamella.operators.history import WINDOW_PAIRS, recordable, script_evidence
from lamella.sources.tables import table as _table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class StoryWindow(StatefulProcessor):
    """Newest pairs of a story; puts out, for each page that arrives, how many pairs of earlier pages it saw.

    A batch's pages are taken in order; rows of a page see what was held before it.
    """

    def __init__(self, most: int = WINDOW_PAIRS):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pairs = handle.getListState("pairs", "source string, translation string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.pairs.get()) if self.pairs.exists() else []
        new = pd.concat(list(rows)).sort_values(["page", "pos"])
        out = []
        for page, group in new.groupby("page", sort=True):
            out.append((key[0], page, len(held)))
            held += [(s, t) for s, t, ok in zip(group["source"], group["translation"], group["good"]) if ok]
            held = held[-self.most :]
        if held:
            self.pairs.put(held)
        yield pd.DataFrame(out, columns=["story", "page", "visible"])

    def close(self) -> None:
        pass


def story_stream(pairs: DataFrame, most: int = WINDOW_PAIRS) -> DataFrame:
    """pairs (story, page, pos, source, translation) as a stream; pages of a story arrive in order."""
    ready = pairs.withColumn("good", recordable(F.col("source"), F.col("translation")))
    kind = pairs.schema["story"].dataType.simpleString()
    return ready.groupBy("story").transformWithStateInPandas(
        StoryWindow(most), outputStructType=f"story {kind}, page long, visible long", outputMode="Append", timeMode="None"
    )


class SiteCache(StatefulProcessor):
    """Entries of a site under a time and a size bound; puts out what a batch evicted."""

    def __init__(self, most: int, most_bytes: int, ttl: int):
        self.most, self.most_bytes, self.ttl = most, most_bytes, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key string", "at long, used long, bytes long, hits long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: tuple(v) for k, v in self.entries.iterator()} if self.entries.exists() else {}
        before, now = set(held), 0
        for pdf in rows:
            for r in pdf.sort_values("at").itertuples():
                old = held.get(r.key)
                held[r.key] = (int(r.at), int(r.at), int(r.bytes), 0) if r.put or old is None else (old[0], int(r.at), old[2], old[3] + 1)
                now = max(now, int(r.at))
        before |= set(held)
        live = sorted(((k, v) for k, v in held.items() if v[0] >= now - self.ttl), key=lambda e: (-e[1][1], -e[1][2], e[0]))
        kept, size = {}, 0
        for k, v in live:
            size += v[2]
            if len(kept) + 1 > self.most or size > self.most_bytes:
                break
            kept[k] = v
        self.entries.clear()
        for k, v in kept.items():
            self.entries.updateValue((k,), v)
        gone = sorted(before - set(kept))
        yield pd.DataFrame({"site": [key[0]] * len(gone), "key": gone})

    def close(self) -> None:
        pass


def cache_stream(events: DataFrame, most: int, most_bytes: int, ttl: int) -> DataFrame:
    """events (site, key, at, bytes, put): stores and touches; evictions come out."""
    return events.groupBy("site").transformWithStateInPandas(SiteCache(most, most_bytes, ttl), outputStructType="site string, key string", outputMode="Append", timeMode="None")


class IdleTimer(StatefulProcessor):
    """Armed by activity of a key, fires after a quiet budget of processing time."""

    def __init__(self, budget_ms: int):
        self.budget = budget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.armed = handle.getValueState("armed", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        if self.armed.exists():
            self.handle.deleteTimer(self.armed.get()[0])
        at = timerValues.getCurrentProcessingTimeInMs() + self.budget
        self.handle.registerTimer(at)
        self.armed.update((at,))
        yield pd.DataFrame({"key": [], "expired_at": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.armed.clear()
        yield pd.DataFrame({"key": [key[0]], "expired_at": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self) -> None:
        pass


def idle_stream(activity: DataFrame, budget_ms: int) -> DataFrame:
    return activity.groupBy("key").transformWithStateInPandas(IdleTimer(budget_ms), outputStructType="key string, expired_at long", outputMode="Append", timeMode="ProcessingTime")


def latch_stream(reads: DataFrame) -> DataFrame:
    """Script evidence of hosts as a running aggregation (output mode complete or update); feed to history.latch."""
    return script_evidence(reads)


def ledger_stream(observations: DataFrame) -> DataFrame:
    """Running counts of renderings (series, term, rendering)."""
    from lamella.operators.history import ledger

    return ledger(observations)


def run_to_end(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Everything available of a stream into a memory table."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def upsert_batches(stream: DataFrame, path: str, key: str, order: str):
    """A sink that keeps the latest row of each key: every batch is merged into a new version of the table."""
    from lamella.sources.tables import written

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        versions = f"{path}/version="
        cols = [c for c in batch.columns if c != key]
        rows = batch if epoch == 0 else spark.read.parquet(f"{versions}{epoch - 1}").select(*batch.columns).unionByName(batch)
        best = rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("v")).select(key, "v.*").select(*batch.columns)
        written(best, "upsert").write.mode("overwrite").parquet(f"{versions}{epoch}")

    return stream.writeStream.foreachBatch(merge)


def events_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table as a file stream."""
    return spark.readStream.schema(_table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
