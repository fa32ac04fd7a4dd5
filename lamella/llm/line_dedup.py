"""Line dedup by site-relative frequency.

Pages are grouped by host. For each host and each line, trimmed of spaces,
the number of the host's pages that contain it is divided by the host's page
total; lines over ``ratio``, found on at least ``min_pages`` pages, are
boilerplate and are dropped from every page of the host.

Only DataFrame functions are used. A page counts a line once, so one hash per
page and distinct line is shuffled, pre-aggregated before that; whole texts
are not. A host has at most (mean lines of a page) / ratio boilerplate lines,
so its list is bounded; the table of lists is written out, its size is read,
and it is broadcast only within ``broadcast_bytes``. Otherwise it is joined by
host, a join whose hot hosts adaptive execution splits.

Defined results: pages with a null host form a host of their own; a null text
counts as a page without lines and stays null; blank lines are never counted
nor dropped; repeated rows count as pages each; a page all of whose lines go
keeps the empty text. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import materialize, table

RATIO = 0.05
MIN_PAGES = 3
BROADCAST_BYTES = 32 << 20


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(documents: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """host, keys: the hashed boilerplate lines of each host that has any."""
    pages = documents.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    distinct = F.array_distinct(F.transform(F.filter(lines_of(F.col("text")), lambda x: F.trim(x) != ""), line_key))
    counts = pages.select("host", F.explode(distinct).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = totals.withColumnRenamed("host", "of")
    frequent = counts.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > F.lit(ratio) * F.col("total"))
    return frequent.groupBy("host").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(
    documents: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """documents with ``__lines``, ``__kept``: all lines, and those that stay."""
    found = materialize(boilerplate(documents, host_col, text_col, ratio, min_pages).withColumnRenamed("host", "__host"), "boilerplate")
    size = found.agg(F.sum(16 + 8 * F.size("keys")).alias("b")).first()["b"] or 0
    small = F.broadcast(found) if size <= broadcast_bytes else found.hint("merge")
    joined = documents.join(small.withColumnRenamed("keys", "__keys"), documents[host_col].eqNullSafe(F.col("__host")), "left")
    lines = lines_of(F.col(text_col))
    keys = F.col("__keys")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(keys, line_key(x)))
    return joined.select(*[documents[c] for c in documents.columns], lines.alias("__lines"), F.when(keys.isNull(), lines).otherwise(kept).alias("__kept"))


def line_dedup(documents: DataFrame, text_col: str = "text", length_col: str | None = None, **options) -> DataFrame:
    """documents, columns as they were, with boilerplate lines cut from the text; ``length_col`` gets the new length."""
    found = drop_boilerplate(documents, text_col=text_col, **options)
    text = F.when(F.size("__kept") == F.size("__lines"), F.col(f"`{text_col}`")).otherwise(F.array_join("__kept", "\n")).alias(text_col)
    out = found.select(*[text if c == text_col else F.col(f"`{c}`") for c in documents.columns])
    if length_col is None:
        return out
    return out.withColumn(length_col, F.length(text_col).cast(documents.schema[length_col].dataType))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, source, n_lines, n_dropped and the text that stays."""
    found = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select(
        "doc_id", "source",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"),
        F.array_join("__kept", "\n").alias("text"),
    )


OP1_SQL = f"""
WITH lines AS (
    SELECT DISTINCT doc_id, source, trim(line) AS line
    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE trim(line) <> ''
), totals AS (
    SELECT source, count(*) AS total FROM documents GROUP BY source
), dropped AS (
    SELECT l.source, l.line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
    GROUP BY l.source, l.line, t.total HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO} * t.total
), lists AS (
    SELECT source, list(line) AS dropped FROM dropped GROUP BY source
), cut AS (
    SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS all_lines,
           list_filter(string_split(d.text, chr(10)),
                       lambda x: trim(x) = '' OR NOT coalesce(list_contains(l.dropped, trim(x)), FALSE)) AS kept
    FROM documents d LEFT JOIN lists l ON d.source IS NOT DISTINCT FROM l.source
)
SELECT doc_id, source, CAST(len(all_lines) AS BIGINT) AS n_lines, CAST(len(all_lines) - len(kept) AS BIGINT) AS n_dropped,
       array_to_string(kept, chr(10)) AS text
FROM cut
"""
