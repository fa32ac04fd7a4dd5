"""Seams between page slices: edge boxes, candidate pairs, run plans, composite rectangles.

slices: run, idx, width, height, top, bottom (arrays of SEAM_BOX), white
(struct of depth profiles top and bottom and their step, null without one).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions import geometry as g
from lamella.operators.folds import match_greedily

SEAM_BOX = "struct<x: double, y: double, width: double, height: double, label: string, role: string, refused: boolean, hint: boolean>"
MAX_SLICES = 6
MIN_ASPECT, MAX_ASPECT, MAX_SIDE = 0.75, 2.0, 8192
FLUSH = 8


def seam_box(b: Column, label: Column, role: Column, refused: Column, hint: Column) -> Column:
    return F.struct(
        *[b[f].cast("double").alias(f) for f in ("x", "y", "width", "height")], label.cast("string").alias("label"), role.cast("string").alias("role"),
        F.coalesce(refused, F.lit(False)).alias("refused"), F.coalesce(hint, F.lit(False)).alias("hint"),
    )


def live(boxes: Column) -> Column:
    """Lettered boxes: neither refused nor hints."""
    return F.filter(F.coalesce(boxes, F.array().cast(f"array<{SEAM_BOX}>")), lambda b: ~b["refused"] & ~b["hint"])


def slice_edges(slices: DataFrame, regions: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """slices (run, idx, width, height) with the boxes that reach their upper and lower band.

    regions: run, idx, ord, box, label, role, refused. hints: run, idx, ord,
    box, spans; a hint at both edges counts only if it spans the slice.
    """
    rows = regions.select("run", "idx", "ord", seam_box(F.col("box"), F.col("label"), F.col("role"), F.col("refused"), F.lit(False)).alias("b"), F.lit(True).alias("spans"))
    if hints is not None:
        none = F.lit(None).cast("string")
        rows = rows.union(hints.select("run", "idx", F.col("ord") + 1_000_000, seam_box(F.col("box"), none, none, F.lit(False), F.lit(True)), "spans"))
    b = F.col("b")
    found = slices.select("run", "idx", "height").join(rows.where((b["width"] > 0) & (b["height"] > 0)), ["run", "idx"])
    band = g.edge_band(F.col("height"))
    at_top, at_bottom = b["y"] <= band, g.bottom(b) >= F.col("height") - band
    counts = ~b["hint"] | (at_top != at_bottom) | F.coalesce(F.col("spans"), F.lit(False))
    edge = lambda at: F.transform(F.array_sort(F.collect_list(F.when(at & counts, F.struct("ord", "b")))), lambda e: e["b"])
    edges = found.groupBy("run", "idx").agg(edge(at_top).alias("top"), edge(at_bottom).alias("bottom"))
    none = F.array().cast(f"array<{SEAM_BOX}>")
    return slices.join(edges, ["run", "idx"], "left").withColumn("top", F.coalesce("top", none)).withColumn("bottom", F.coalesce("bottom", none))


def spans_slice(top: Column, bottom: Column, regions_only: bool = False) -> Column:
    """A box reaches both edges of a slice; with ``regions_only`` hints don't count."""
    held = live(top) if regions_only else F.filter(top, lambda b: ~b["refused"])
    return F.exists(held, lambda t: F.exists(bottom, lambda b: (b["x"] == t["x"]) & (b["y"] == t["y"]) & (b["width"] == t["width"]) & (b["height"] == t["height"])))


def touch_counterparts(boxes: Column, profile: Column, step: Column, gap, place) -> Column:
    """Boxes made of a neighbour's white depth under flush dialogue boxes that have no partner there."""
    flush = F.filter(boxes, lambda b: ~b["hint"] & (b["role"] == "dialogue") & ~F.coalesce(b["label"] == "onomatopoeia", F.lit(False)) & (gap(b) <= FLUSH))
    made = F.transform(flush, lambda b: F.struct(b["x"].alias("x"), b["width"].alias("width"), g.touch_probe(profile, step, b["x"], b["width"]).cast("double").alias("depth")))
    deep = F.filter(made, lambda m: m["depth"].isNotNull())
    none = F.lit(None).cast("string")
    return F.transform(deep, lambda m: seam_box(g.box(m["x"], place(m["depth"]), m["width"], m["depth"]), none, none, F.lit(False), F.lit(False)))


def candidates(slices: DataFrame) -> DataFrame:
    """Pairs at each cut (run, cut, i, j, top, low, veto, score, hint_rank, heights), or one row with ``refused`` why there are none.

    A cut lies between slices idx and idx + 1. Where only one side is
    lettered, the white of the other side stands in for its missing boxes.
    """
    a = slices.select("run", F.col("idx").alias("cut"), *[F.col(c).alias(f"a_{c}") for c in ("width", "height", "bottom", "white")])
    b = slices.select("run", (F.col("idx") - 1).alias("cut"), *[F.col(c).alias(f"b_{c}") for c in ("width", "height", "top", "white")])
    p = a.join(b, ["run", "cut"])
    alive_a, alive_b = F.size(live(F.col("a_bottom"))) > 0, F.size(live(F.col("b_top"))) > 0
    low_side = touch_counterparts(F.col("a_bottom"), F.col("b_white.top"), F.col("b_white.step"), lambda x: F.col("a_height") - g.bottom(x), lambda d: F.lit(0.0))
    top_side = touch_counterparts(F.col("b_top"), F.col("a_white.bottom"), F.col("a_white.step"), lambda x: x["y"], lambda d: F.col("a_height") - d)
    none = F.array().cast(f"array<{SEAM_BOX}>")
    p = p.withColumn("b_top", F.when(alive_a & ~alive_b & F.col("b_white").isNotNull(), F.concat("b_top", F.coalesce(low_side, none))).otherwise(F.col("b_top")))
    p = p.withColumn("a_bottom", F.when(alive_b & ~alive_a & F.col("a_white").isNotNull(), F.concat("a_bottom", F.coalesce(top_side, none))).otherwise(F.col("a_bottom")))
    why = F.when(F.coalesce(F.col("a_width") * F.col("b_width") * F.col("a_height") * F.col("b_height"), F.lit(0)) == 0, "no-size").when(
        F.col("a_width") != F.col("b_width"), "width-mismatch"
    ).when((F.size("a_bottom") == 0) | (F.size("b_top") == 0), "one-sided")
    p = p.withColumn("refused", why)
    pairs = p.where("refused IS NULL").select("run", "cut", "a_height", "b_height", F.posexplode("a_bottom").alias("i", "top"), "b_top").select(
        "run", "cut", "a_height", "b_height", "i", "top", F.posexplode("b_top").alias("j", "low")
    )
    top, low = F.col("top"), F.col("low")
    band = F.greatest(g.edge_band(F.col("a_height")), g.edge_band(F.col("b_height")))
    score = g.seam_score(top, low, F.greatest(F.lit(0), F.col("a_height") - g.bottom(top)), F.greatest(F.lit(0), low["y"]), band)
    made = pairs.select("run", "cut", "i", "j", "top", "low", g.seam_veto(top, low).alias("veto"), score.alias("score"), (top["hint"].cast("int") + low["hint"].cast("int")).alias("hint_rank"))
    return made.unionByName(p.where("refused IS NOT NULL").select("run", "cut", "refused"), allowMissingColumns=True)


def matches(found: DataFrame) -> DataFrame:
    """One-to-one pairs per cut: fewer hints first, then the score, then places."""
    scored = found.where("score IS NOT NULL")
    taken = match_greedily(scored, ["run", "cut"], "i", "j", [F.col("hint_rank"), -F.col("score")])
    return scored.join(taken, ["run", "cut", "i", "j"], "left_semi")


def run_plan(slices: DataFrame, found: DataFrame) -> DataFrame:
    """Crop of each whole run: run, idx, y, height, offset of its slices in the composite, and the composite's size.

    A run has two to MAX_SLICES slices, no refused cut and a matched pair. The
    crop keeps MARGIN beyond the outermost matched boxes and grows, evenly up
    and down, to a ceiling between MIN_ASPECT and MAX_ASPECT times the width.
    """
    best = matches(found)
    refused = found.where("refused IS NOT NULL").select("run").distinct()
    pairs = best.select("run", "cut", F.col("top.y").alias("top_y"), (F.col("low.y") + F.col("low.height")).alias("low_end"))
    rows = slices.select("run", "idx", "width", "height").join(refused, "run", "left_anti").join(best.select("run").distinct(), "run", "left_semi")
    lists = rows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("idx", "width", "height"))).alias("s"))
    marks = pairs.groupBy("run").agg(F.collect_list(F.struct("cut", "top_y", "low_end")).alias("p"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for run, s, p in zip(pdf["run"], pdf["s"], pdf["p"]):
            n, width, cuts = len(s), s[0]["width"], len(s) - 1
            heights = [x["height"] for x in s]
            if not 2 <= n <= MAX_SLICES:
                continue
            first, last = s[0]["idx"], s[0]["idx"] + cuts - 1
            top = min([heights[0], *(q["top_y"] for q in p if q["cut"] == first)])
            low = max([0, *(q["low_end"] for q in p if q["cut"] == last)])
            top = min(max(math.floor(top - g.MARGIN), 0), heights[0])
            low = min(max(math.ceil(low + g.MARGIN), 0), heights[-1])
            if heights[0] - top <= 0 or low <= 0:
                continue
            middle = sum(heights[1:-1])
            half_up = lambda v: math.floor(v + 0.5)
            ceiling = min(max(min(max(heights), half_up(width * MAX_ASPECT)), half_up(width * MIN_ASPECT)), sum(heights), MAX_SIDE)
            want = ceiling - (heights[0] - top + middle + low)
            if want > 0:
                up = min(top, math.ceil(want / 2))
                down = min(heights[-1] - low, want - up)
                up = min(top, want - down)
                top, low = top - up, low + down
            total = heights[0] - top + middle + low
            if max(total, width) > MAX_SIDE or total > half_up(width * MAX_ASPECT * cuts):
                continue
            offset = 0
            for i, x in enumerate(s):
                y, h = (top, heights[0] - top) if i == 0 else (0, low) if i == n - 1 else (0, heights[i])
                out.append((run, x["idx"], float(y), float(h), float(offset), float(width), float(total)))
                offset += h
        return pd.DataFrame(out, columns=["run", "idx", "y", "height", "offset", "plan_width", "plan_height"])

    kind, number = slices.schema["run"].dataType.simpleString(), slices.schema["idx"].dataType.simpleString()
    schema = f"run {kind}, idx {number}, y double, height double, offset double, plan_width double, plan_height double"
    return lists.join(marks, "run").mapInPandas(lambda it: (plan(pdf) for pdf in it), schema)


def composite_rects(plans: DataFrame, pairs: DataFrame, boxes: DataFrame, passes: int = 4, most_share: float = 0.6) -> DataFrame:
    """Rectangles of the composite that hold each matched pair, and every box they touch.

    A pair's boxes, in composite places, are united with a box that spans the
    cut, padded, and grown by touched boxes for at most ``passes`` rounds
    while under ``most_share`` of the composite; rectangles that meet are
    merged. boxes: run, box, unrefused regions in composite places.
    """

    def union(a, b):
        x, y = min(a[0], b[0]), min(a[1], b[1])
        return x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y

    def meets(a, b):
        return a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3]

    def holds(a, b):
        return b[0] >= a[0] and b[1] >= a[1] and b[0] + b[2] <= a[0] + a[2] and b[1] + b[3] <= a[1] + a[3]

    def padded(a):
        return a[0] - g.MARGIN, a[1] - g.MARGIN, a[2] + 2 * g.MARGIN, a[3] + 2 * g.MARGIN

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for run, slices, ps, bs in zip(pdf["run"], pdf["s"], pdf["p"], pdf["b"]):
            at = {x["idx"]: x for x in slices}
            width, height = slices[0]["plan_width"], slices[0]["plan_height"]
            cuts = [x["offset"] for x in slices if x["offset"] > 0]
            held = [tuple(b[f] for f in ("x", "y", "width", "height")) for b in (bs if bs is not None else [])]
            spanning = [b for b in held if any(b[1] < c < b[1] + b[3] for c in cuts)]
            rects = []
            for p in ps:
                up, down = at[p["cut"]], at[p["cut"] + 1]
                a = (p["top"]["x"], p["top"]["y"] - up["y"] + up["offset"], p["top"]["width"], p["top"]["height"])
                b = (p["low"]["x"], p["low"]["y"] - down["y"] + down["offset"], p["low"]["width"], p["low"]["height"])
                r = union(a, b)
                r = padded(union(r, next((s for s in spanning if meets(s, r)), r)))
                for _ in range(passes):
                    new = [b for b in held if meets(b, r) and not holds(r, b)]
                    grown = r
                    for b in new:
                        grown = union(grown, padded(b))
                    if not new or grown[2] * grown[3] > most_share * width * height:
                        break
                    r = grown
                rects.append(r)
            merged = True
            while merged:
                merged = False
                for i in range(len(rects)):
                    j = next((j for j in range(i + 1, len(rects)) if meets(rects[i], rects[j])), None)
                    if j is not None:
                        rects[i] = union(rects[i], rects.pop(j))
                        merged = True
                        break
            for x, y, w, h in rects:
                x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + w, width), min(y + h, height)
                if x1 > x0 and y1 > y0:
                    out.append((run, float(x0), float(y0), float(x1 - x0), float(y1 - y0)))
        return pd.DataFrame(out, columns=["run", "x", "y", "width", "height"])

    s = plans.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("offset", "idx", "y", "plan_width", "plan_height"))).alias("s"))
    p = pairs.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("cut", "i", "j", "top", "low"))).alias("p"))
    b = boxes.groupBy("run").agg(F.collect_list("box").alias("b"))
    kind = plans.schema["run"].dataType.simpleString()
    return s.join(p, "run").join(b, "run", "left").mapInPandas(lambda it: (fold(pdf) for pdf in it), f"run {kind}, x double, y double, width double, height double")


def join_for(slices: DataFrame, spans: Column, most: int = MAX_SLICES) -> DataFrame:
    """Per run and cut: the first and last slice of the widest join around it, cut to ``most`` from below, then from above.

    slices: run, idx. A join grows over slices that a box spans.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("run").orderBy("idx")
    r = slices.withColumn("__s", spans)
    before = F.coalesce(F.max(F.when(~F.col("__s"), F.col("idx"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.min("idx").over(Window.partitionBy("run")))
    r = r.withColumn("first", before)
    after = F.min(F.when(~F.col("__s"), F.col("idx"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    r = r.withColumn("end", F.max("idx").over(Window.partitionBy("run"))).withColumn("last", F.coalesce(after, F.col("end"))).where("idx < end")
    last = F.greatest(F.col("idx") + 1, F.least(F.col("last"), F.col("first") + most - 1))
    first = F.greatest(F.col("first"), last - most + 1)
    return r.select("run", F.col("idx").alias("cut"), first.alias("first"), last.alias("last"))
