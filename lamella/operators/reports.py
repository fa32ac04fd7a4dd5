"""Run reports: outcome counters, stage timing, response bodies, replay results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions import text as t


def outcome_counters(regions: DataFrame) -> DataFrame:
    """Per page: regions, missed, dropped, split, refused, effects skipped."""
    from lamella.operators.regions import EFFECT, is_dropped, is_split_fragment

    s, x, r = F.col("source"), F.col("translated"), F.col("refused")
    return regions.groupBy("page").agg(
        F.count("*").alias("regions"), F.count_if(t.is_blank(x)).alias("missed"), F.count_if(is_dropped(s, x, r)).alias("dropped"),
        F.count_if(is_split_fragment(x, r)).alias("split"), F.count_if(r.isNotNull()).alias("refused"), F.count_if(F.col("label") == EFFECT).alias("effects"),
    )


def response_body(outcome: Column) -> Column:
    """JSON of an outcome struct; nulls are left out."""
    return F.to_json(outcome)


def wire_fields(**lists: Column) -> Column:
    """JSON object of those lists that aren't empty, each as a JSON string."""
    pairs = [F.struct(F.lit(k).alias("key"), F.when(F.size(v) > 0, F.to_json(v)).alias("value")) for k, v in lists.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def summary_header(missed: Column, total: Column) -> Column:
    return F.concat_ws("/", missed.cast("string"), total.cast("string"))


def run_report(events: DataFrame, by: str, value: str, flag: Column) -> DataFrame:
    """Counts, rates and spread of measured values by stage."""
    return events.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(flag).alias("flagged"), F.round(F.count_if(flag) / F.count("*"), 6).alias("rate"),
        F.round(F.sum(value), 2).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"),
    )


def stage_totals(outcomes: DataFrame) -> DataFrame:
    """Per stage and model: runs, time and waiting time, from outcomes' stage lists."""
    s = outcomes.select(F.explode("stages").alias("s")).select("s.*")
    return s.groupBy("stage", "model").agg(F.count("*").alias("runs"), F.sum("ms").alias("ms"), F.sum("wait_ms").alias("wait_ms"), F.max("ms").alias("slowest"))


def replay_rates(results: DataFrame) -> DataFrame:
    """Per arm: pages, segments, unanswered, truncated pages, ids repeated or out of range, time a page."""
    return results.groupBy("arm").agg(
        F.count("*").alias("pages"), F.sum("segments").alias("segments"), F.sum(F.size("untranslated")).alias("unanswered"), F.count_if("truncated").alias("truncated"),
        F.sum("duplicate_ids").alias("duplicate_ids"), F.sum("out_of_range_ids").alias("out_of_range_ids"), F.round(F.avg("ms"), 3).alias("ms_per_page"),
    )


def output_name(arms: dict[str, tuple[Column, str]]) -> Column:
    """Name of a run from the arms that aren't at their default."""
    parts = [F.when(value != default, F.concat(F.lit(f"{name}="), value)) for name, (value, default) in arms.items()]
    name = F.concat_ws("_", *parts)
    return F.when(name == "", "default").otherwise(name)


def next_stage(stages: DataFrame, done: DataFrame, busy: DataFrame, needs: DataFrame) -> DataFrame:
    """Per page, the first pending stage (page, stage, ordinal) that isn't busy and whose needed stages, as far as the page has them, are done."""
    pending = stages.join(done, ["page", "stage"], "left_anti").join(busy.select("stage"), "stage", "left_anti")
    wanted = pending.join(needs, "stage").join(stages.select("page", F.col("stage").alias("need")), ["page", "need"], "left_semi")
    blocked = wanted.join(done.select("page", F.col("stage").alias("need")), ["page", "need"], "left_anti").select("page", "stage").distinct()
    ready = pending.join(blocked, ["page", "stage"], "left_anti")
    return ready.groupBy("page").agg(F.min_by("stage", "ordinal").alias("stage"))


def admission(needed: Column, free: Column, reserve: Column, loaded: Column) -> Column:
    """Admit, evict first, or refuse, by what a stage needs beside the reserve; unknown memory admits."""
    room = F.coalesce(free - reserve, F.lit(float("inf")))
    return F.when(needed <= room, "admit").when(needed <= room + F.coalesce(loaded, F.lit(0)), "evict").otherwise("refuse")


def safety_reserve(budget: Column) -> Column:
    """A tenth or 512 MiB, whichever is more, a third at most."""
    return F.least(F.greatest(budget / 10, F.lit(512 * 2**20)), budget / 3)


def penalized(workspace: Column, budget: Column) -> Column:
    return workspace + F.greatest(workspace / 2, budget / 10)


def memory_is_sufficient(needed: Column, available: Column) -> Column:
    """Permissive where unknown."""
    return F.coalesce(available >= needed, F.lit(True))


def shortfall(needed: Column, available: Column) -> Column:
    return F.greatest(F.lit(0), needed - available)


def eviction_order(loaded: DataFrame) -> DataFrame:
    return loaded.orderBy("last_used", "stage")


def idle_remaining(armed_at: Column, now: Column, budget: Column) -> Column:
    """Null while disarmed, else what is left of the budget, 0 at least."""
    return F.when(armed_at.isNotNull(), F.greatest(F.lit(0), budget - (now - armed_at)))
