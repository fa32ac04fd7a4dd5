"""Order-dependent folds over the rows of one page, run or image.

Groups are pages, bounded by what a page holds. Native folds are ``aggregate``
over a sorted array; the others are grouped pandas functions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import geometry as g
from lamella.operators.spatial import gridded


def greedy_suppression(detections: DataFrame, iou_at: float = 0.5, contained_at: float = 0.9, lettered: tuple[str, ...] = ("text",)) -> DataFrame:
    """Detections (page, id, label, score, box) that greedy suppression keeps, as page and kept ids in order.

    Order: score falling, top edge, left edge falling, label, id. A candidate
    is dropped if a kept one of a comparable label overlaps it; dropped ones
    suppress nothing.
    """
    b = F.col("box")
    item = F.struct(
        (-F.col("score")).alias("k1"), b["y"].alias("k2"), (-b["x"]).alias("k3"), F.col("label").alias("k4"), F.col("id").alias("k5"),
        b.alias("box"), F.col("label").alias("label"), F.col("score").alias("score"), F.col("id").alias("id"),
    )
    sorted_items = detections.groupBy("page").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(kept, c):
        hit = F.exists(kept, lambda k: g.suppression(k["box"], c["box"], k["label"], c["label"], k["score"], c["score"], iou_at, contained_at, lettered=lettered) == "suppress")
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(c)))

    kept = F.aggregate("items", F.slice("items", 1, 0), step)
    return sorted_items.select("page", F.posexplode(kept).alias("rank", "kept")).select("page", "rank", F.col("kept.id").alias("id"), F.col("kept.score").alias("score"))


def _area(b):
    return max(b[2], 0) * max(b[3], 0)


def _inter(a, b):
    return max(min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), 0) * max(min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]), 0)


def _overlaps(a, b):
    return a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3]


def _ratio(a, b):
    low, high = sorted((a, b))
    return float("inf") if low <= 0 else high / low


def settle_detections(detections: DataFrame, iou_at: float = 0.5, contained_at: float = 0.9, least_score_ratio: float = 0.5, lettered: tuple[str, ...] = ("text",)) -> DataFrame:
    """Suppression with the axis tie-break: page, id, outcome kept / suppressed / replaced.

    A candidate that shares one axis with a kept box and is taller, or
    narrower, takes its place, once at most; a second such box, or any plain
    suppression, drops the candidate.
    """

    def verdict(k, c):
        kb, cb = k[1], c[1]
        if k[2] != c[2] and not (k[2] in lettered and c[2] in lettered):
            return 0
        both, least = _inter(kb, cb), min(_area(kb), _area(cb))
        union = _area(kb) + _area(cb) - both
        if not ((union > 0 and both / union >= iou_at) or (least > 0 and both / least >= contained_at)):
            return 0
        w, h = _ratio(kb[2], cb[2]), _ratio(kb[3], cb[3])
        better = cb[3] > kb[3] if w <= g.AXIS_SHARED and h >= g.AXIS_DIFFERS else cb[2] < kb[2] if h <= g.AXIS_SHARED and w >= g.AXIS_DIFFERS else False
        return 2 if k[3] > 0 and c[3] / k[3] >= least_score_ratio and better else 1

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf.itertuples(index=False), key=lambda r: (-r.score, r.y, -r.x, r.label, r.id))
        kept, outcome = [], {}
        for r in rows:
            c = (r.id, (r.x, r.y, r.width, r.height), r.label, r.score)
            place, dropped = None, False
            for i, k in enumerate(kept):
                v = verdict(k, c)
                if v == 1 or v == 2 and place is not None:
                    dropped = True
                    break
                if v == 2:
                    place = i
            if dropped:
                outcome[r.id] = "suppressed"
            elif place is not None:
                outcome[kept[place][0]], outcome[r.id] = "replaced", "kept"
                kept[place] = c
            else:
                outcome[r.id] = "kept"
                kept.append(c)
        return pd.DataFrame({"page": pdf["page"].iloc[0], "id": list(outcome), "outcome": list(outcome.values())})

    flat = detections.select("page", "id", "label", "score", "box.x", "box.y", "box.width", "box.height")
    page, ident = detections.schema["page"].dataType.simpleString(), detections.schema["id"].dataType.simpleString()
    return flat.groupBy("page").applyInPandas(fold, f"page {page}, id {ident}, outcome string")


def duplicate_verdict(left_text, right_text, left_area, right_area):
    """0 drops the left text, 1 the right; null if neither holds the other or the shorter (in bytes) has under 3 letters."""
    from lamella.functions.text import alnum_count, strip_space

    left, right = F.lower(strip_space(left_text)), F.lower(strip_space(right_text))
    shorter = F.when(F.octet_length(left) <= F.octet_length(right), left).otherwise(right)
    return F.when((left == "") | (right == "") | (alnum_count(shorter) < 3), F.lit(None).cast("int")).when(
        left.contains(right) & right.contains(left), F.when(left_area >= right_area, 1).otherwise(0)
    ).when(left.contains(right), 1).when(right.contains(left), 0)


def resolve_duplicates(candidates: DataFrame, shared_source: bool = False, oriented: bool = False) -> DataFrame:
    """Dropped candidates (page, ord). A dropped one condemns nobody: pairs are walked in (a, b) order.

    candidates: page, ord, text, fit, source_box, and poly if oriented. The
    pairs come from shared grid cells, those of polygons from a join on page;
    the walk is a fold over a page's sorted pairs.
    """
    second = candidates.select("page", *[F.col(c).alias(f"r_{c}") for c in candidates.columns if c != "page"])
    later = F.col("ord") < F.col("r_ord")
    if oriented:
        pairs = candidates.join(second, "page").where(later & g.convex_overlaps(F.col("poly"), F.col("r_poly")))
    else:
        pairs = gridded(candidates, second, later, left_box="fit", right_box="r_fit")
    if shared_source:
        pairs = pairs.where(g.shares_source(F.col("source_box"), F.col("r_source_box")))
    area = lambda b: b["width"] * b["height"]
    pairs = pairs.withColumn("loser", duplicate_verdict(F.col("text"), F.col("r_text"), area(F.col("fit")), area(F.col("r_fit")))).where("loser IS NOT NULL")
    walk = pairs.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("a"), F.col("r_ord").alias("b"), "loser"))).alias("walk"))

    def step(dropped, p):
        idle = F.array_contains(dropped, p["a"]) | F.array_contains(dropped, p["b"])
        return F.when(idle, dropped).otherwise(F.array_append(dropped, F.when(p["loser"] == 0, p["a"]).otherwise(p["b"])))

    start = F.slice(F.transform("walk", lambda p: p["a"]), 1, 0)
    return walk.select("page", F.explode(F.aggregate("walk", start, step)).alias("ord"))


def match_greedily(pairs: DataFrame, by: list[str], left: str, right: str, order: list) -> DataFrame:
    """One-to-one matches per group: candidates in ``order``, each taken if both sides are free."""
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(left).alias("l"), F.col(right).alias("r"))
    lists = pairs.groupBy(*by).agg(F.array_sort(F.collect_list(ranked)).alias("c"))

    def step(taken, c):
        used = F.exists(taken, lambda t: (t["l"] == c["l"]) | (t["r"] == c["r"]))
        return F.when(used, taken).otherwise(F.array_append(taken, F.struct(c["l"].alias("l"), c["r"].alias("r"))))

    start = F.slice(F.transform("c", lambda c: F.struct(c["l"].alias("l"), c["r"].alias("r"))), 1, 0)
    return lists.select(*by, F.explode(F.aggregate("c", start, step)).alias("m")).select(*by, F.col("m.l").alias(left), F.col("m.r").alias(right))


def take_previous(new: DataFrame, previous: DataFrame, least: float = 0.5) -> DataFrame:
    """new (page, ord, box) with the previous text (page, prev, box) it consumes.

    New boxes choose in order; each takes the free one with the greatest
    overlap of the smaller box, if it is ``least``; the last one on ties.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for ord_, group in pdf.sort_values(["ord", "prev"]).groupby("ord", sort=True):
            best = None
            for r in group.itertuples():
                if r.prev not in used and r.share >= least and (best is None or r.share >= best[0]):
                    best = (r.share, r.prev)
            if best:
                used.add(best[1])
                out.append((pdf["page"].iloc[0], ord_, best[1]))
        return pd.DataFrame(out, columns=["page", "ord", "prev"])

    p = previous.select("page", "prev", F.col("box").alias("__box"))
    pairs = new.join(p, "page").select("page", "ord", "prev", g.overlap_of_smaller(F.col("box"), F.col("__box")).cast("double").alias("share")).where(F.col("share") >= least)
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    taken = pairs.groupBy("page").applyInPandas(fold, f"page {kind(new, 'page')}, ord {kind(new, 'ord')}, prev {kind(previous, 'prev')}")
    return new.join(taken, ["page", "ord"], "left")


def unmatched_previous(previous: DataFrame, matched: DataFrame, producer: str) -> DataFrame:
    """Previous texts nobody took: delete own ones, keep the frame of others as the user's."""
    rest = previous.join(matched.select("page", "prev").where("prev IS NOT NULL"), ["page", "prev"], "left_anti")
    return rest.withColumn("action", F.when(F.col("producer") == producer, "delete").otherwise("keep_frame"))


def merge_boxes(boxes: DataFrame, contained: float = 0.9, iou_at: float = 0.5, most_growth: float = 3.0, gap: float = 10) -> DataFrame:
    """Boxes (page, ord, box) merged one after the other into those before them.

    Contained or overlapping: the larger stays. Stacked with a small gap and
    shared columns: the union, unless it is over ``most_growth`` times the larger.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for r in pdf.sort_values("ord").itertuples():
            b = (r.x, r.y, r.width, r.height)
            for i, o in enumerate(out):
                both, least = _inter(o, b), min(_area(o), _area(b))
                union = _area(o) + _area(b) - both
                if least > 0 and both / least >= contained or union > 0 and both / union >= iou_at:
                    out[i] = o if _area(o) >= _area(b) else b
                    break
                share = min(o[0] + o[2], b[0] + b[2]) - max(o[0], b[0])
                apart = max(b[1] - o[1] - o[3], o[1] - b[1] - b[3])
                if share > 0.5 * min(o[2], b[2]) and apart <= gap:
                    x, y = min(o[0], b[0]), min(o[1], b[1])
                    u = (x, y, max(o[0] + o[2], b[0] + b[2]) - x, max(o[1] + o[3], b[1] + b[3]) - y)
                    if _area(u) <= most_growth * max(_area(o), _area(b)):
                        out[i] = u
                        break
            else:
                out.append(b)
        return pd.DataFrame([(pdf["page"].iloc[0], i, *map(float, b)) for i, b in enumerate(out)], columns=["page", "rank", "x", "y", "width", "height"])

    flat = boxes.select("page", "ord", "box.x", "box.y", "box.width", "box.height")
    return flat.groupBy("page").applyInPandas(fold, f"page {boxes.schema['page'].dataType.simpleString()}, rank int, x double, y double, width double, height double")


def reconcile_collisions(texts: DataFrame, most: float = 0.1, shrink: float = 0.8) -> DataFrame:
    """Placed texts (page, ord, role, box, size): of two that share over ``most`` of the smaller, the loser shrinks.

    Dialogue never yields to others; else the larger yields, the later on ties.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [dict(r) for r in pdf.sort_values("ord").to_dict("records")]
        for i, a in enumerate(rows):
            for b in rows[i + 1 :]:
                p, q = [(r["x"], r["y"], r["width"], r["height"]) for r in (a, b)]
                least = min(_area(p), _area(q))
                if least <= 0 or _inter(p, q) / least <= most:
                    continue
                da, db = a["role"] == "dialogue", b["role"] == "dialogue"
                if da and db:
                    continue
                loser = b if da else a if db else (a if _area(p) > _area(q) else b)
                loser["width"], loser["height"], loser["size"] = loser["width"] * shrink, loser["height"] * shrink, loser["size"] * shrink
        return pd.DataFrame(rows)[list(pdf.columns)]

    flat = texts.select("page", "ord", "role", F.col("size").cast("double").alias("size"), *[F.col(f"box.{f}").cast("double").alias(f) for f in ("x", "y", "width", "height")])
    return flat.groupBy("page").applyInPandas(fold, flat.schema)


EDITS = "x double, y double, width double, height double, place_x double, place_y double, place_width double, place_height double"


def merge_edits(edits: DataFrame, most: int = 32, least_place: float = 24) -> DataFrame:
    """Ordered box edits of images folded into their add, remove and place lists.

    edits: image, seq, kind (add, remove, place: prior state; resized,
    deleted, drawn, unplaced, placed: changes), box, to (for resized), place
    (for placed and prior place). Resizes come first, then deletions,
    drawings, removed and new placements; rectangles are the same within two
    pixels, and a deletion also takes the added box or placement centred in it.
    One row a list entry: image, list, pos and the rectangles; an image over
    the caps or with a placement that is too small gives one row 'error'.
    """

    def same(a, b):
        return all(abs(x - y) <= 2 for x, y in zip(a, b))

    def inside(rect, box):
        cx, cy = box[0] + box[2] / 2, box[1] + box[3] / 2
        return rect[0] <= cx <= rect[0] + rect[2] and rect[1] <= cy <= rect[1] + rect[3]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        by: dict[str, list] = {}
        for r in pdf.sort_values("seq").itertuples():
            by.setdefault(r.kind, []).append(((r.x, r.y, r.width, r.height), (r.tx, r.ty, r.tw, r.th), (r.px, r.py, r.pw, r.ph)))
        add, remove = [b for b, _, _ in by.get("add", [])], [b for b, _, _ in by.get("remove", [])]
        place = [(b, p) for b, _, p in by.get("place", [])]

        def unplace(gone):
            place[:] = [(b, p) for b, p in place if not (same(b, gone) or inside(b, gone))]

        def delete(gone):
            at = next((i for i, b in enumerate(add) if same(b, gone)), None)
            at = at if at is not None else next((i for i, b in enumerate(add) if inside(b, gone)), None)
            if at is not None:
                del add[at]
            elif not any(same(b, gone) for b in remove):
                remove.append(gone)

        def draw(box):
            if not any(same(b, box) for b in add):
                add.append(box)

        for old, new, _ in by.get("resized", []):
            place[:] = [(new, p) if same(b, old) or inside(b, old) else (b, p) for b, p in place]
            delete(old)
            draw(new)
        for gone, _, _ in by.get("deleted", []):
            delete(gone)
            unplace(gone)
        for box, _, _ in by.get("drawn", []):
            draw(box)
        for gone, _, _ in by.get("unplaced", []):
            unplace(gone)
        for box, _, p in by.get("placed", []):
            at = next((i for i, (b, _) in enumerate(place) if same(b, box)), None)
            if at is None:
                place.append((box, p))
            else:
                place[at] = (box, p)
        none = (None,) * 4
        image = pdf["image"].iloc[0]
        bad = any(p[2] < least_place or p[3] < least_place for _, p in place) or max(len(add), len(remove), len(place)) > most
        rows = [(image, "error", 0, *none, *none)] if bad else [
            *[(image, "add", i, *b, *none) for i, b in enumerate(add)], *[(image, "remove", i, *b, *none) for i, b in enumerate(remove)],
            *[(image, "place", i, *b, *p) for i, (b, p) in enumerate(place)],
        ]
        return pd.DataFrame(rows, columns=["image", "list", "pos", "x", "y", "width", "height", "place_x", "place_y", "place_width", "place_height"])

    part = lambda c, names: [F.col(f"{c}.{f}").cast("double").alias(n) for f, n in zip(("x", "y", "width", "height"), names)]
    flat = edits.select("image", "seq", "kind", *part("box", ("x", "y", "width", "height")), *part("to", ("tx", "ty", "tw", "th")), *part("place", ("px", "py", "pw", "ph")))
    return flat.groupBy("image").applyInPandas(fold, f"image string, list string, pos int, {EDITS}")


def upright_vote(reads: DataFrame) -> DataFrame:
    """The read of a crop (crop, ord, text, score) that most of its rotated reads support.

    Reads are keyed by their letters; a key is supported by equal keys and by
    keys that hold it or lie in it. Most support wins, then score, then the later read.
    """
    from lamella.functions.text import vote_key

    keyed = reads.withColumn("key", vote_key(F.col("text"))).withColumn("score", F.coalesce("score", F.lit(float("-inf"))))
    o = keyed.select("crop", F.col("key").alias("__key"))
    held = keyed.where("key <> ''").join(o, "crop").where((F.col("__key") != "") & (F.col("key").contains(F.col("__key")) | F.col("__key").contains(F.col("key"))))
    votes = held.groupBy("crop", "ord").agg(F.count("*").alias("votes"), F.first("score").alias("score"), F.first("text").alias("text"))
    return votes.groupBy("crop").agg(F.max_by(F.struct("ord", "text", "votes"), F.struct("votes", "score", "ord")).alias("best")).select("crop", "best.*")
