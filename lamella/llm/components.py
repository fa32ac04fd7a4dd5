"""Connected components of an edge table, in a logarithmic number of rounds.

Each round every node hooks onto its least neighbour, the resulting forest is
flattened by pointer jumping, and the graph is contracted to its roots. All
steps are joins and pre-aggregated minima; nothing is gathered in one task or
on the driver. Each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import discard, materialize


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    live = materialize(both.where("a <> b").distinct(), label + "-edges")
    labels = None
    while live.limit(1).count():
        parents = live.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root"))
        parents = flatten(materialize(parents, label + "-parents"), label)
        if labels is None:
            labels = parents
        else:
            step = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
            before, labels = labels, materialize(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), label + "-labels")
            discard(before)
        p, q = parents.select(F.col("node").alias("a"), F.col("root").alias("ra")), parents.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = live.join(p, "a").join(q, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct()
        before, live = live, materialize(left, label + "-edges")
        discard(before)
        if labels is not parents:
            discard(parents)
    return labels if labels is not None else live.select(F.col("a").alias("node"), F.col("b").alias("root"))


def flatten(parents: DataFrame, label: str) -> DataFrame:
    """parents with every root its own parent; the forest's depth halves each time. ``parents`` is a table of this module and goes."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = materialize(parents.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), label + "-jump")
        discard(parents)
        parents = jumped.select("node", "root")
        if not jumped.where("moved").limit(1).count():
            return parents
