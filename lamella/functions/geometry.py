"""Geometry plane: boxes, polygons, placements and colours as Column expressions.

A box is a struct (x, y, width, height) unless a function names corners. Each
predicate states whether its edges are strict, as operators differ in that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_FLOOR = 16
EDGE_FRACTION = 0.006
MARGIN = 24
MAX_WIDTH_RATIO = 2.2
MIN_OVERLAP = 0.35
CUT_SLACK = 1.2
AXIS_SHARED = 1.15
AXIS_DIFFERS = 1.30


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def area(b: Column) -> Column:
    return F.greatest(b["width"], F.lit(0)) * F.greatest(b["height"], F.lit(0))


def intersection_area(a: Column, b: Column) -> Column:
    w = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    h = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def overlaps(a: Column, b: Column) -> Column:
    """Strict: boxes that only touch don't overlap."""
    return (a["x"] < right(b)) & (b["x"] < right(a)) & (a["y"] < bottom(b)) & (b["y"] < bottom(a))


def contains(outer: Column, inner: Column) -> Column:
    """Inclusive."""
    return (inner["x"] >= outer["x"]) & (inner["y"] >= outer["y"]) & (right(inner) <= right(outer)) & (bottom(inner) <= bottom(outer))


def center_inside(target: Column, b: Column) -> Column:
    """Inclusive: the centre of ``b`` lies in ``target``."""
    cx, cy = b["x"] + b["width"] / 2, b["y"] + b["height"] / 2
    return cx.between(target["x"], right(target)) & cy.between(target["y"], bottom(target))


def point_near(target: Column, x: Column, y: Column, pad: float = 8) -> Column:
    return x.between(target["x"] - pad, right(target) + pad) & y.between(target["y"] - pad, bottom(target) + pad)


def containment(container: Column, value: Column) -> Column:
    """Share of ``value`` within ``container``; 0 for an empty value."""
    return F.when(area(value) > 0, intersection_area(container, value) / area(value)).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    both = intersection_area(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def overlap_of_smaller(a: Column, b: Column) -> Column:
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection_area(a, b) / least).otherwise(0.0)


def mostly_same_ink(a: Column, b: Column) -> Column:
    """More than half of either box lies in the other."""
    return (containment(a, b) > 0.5) | (containment(b, a) > 0.5)


def shares_source(a: Column, b: Column, floor: float = 0.42) -> Column:
    """Source boxes meet in ``floor`` of the smaller; a missing box corroborates nothing."""
    return F.coalesce(a.isNotNull() & b.isNotNull() & (overlap_of_smaller(a, b) >= floor), F.lit(False))


def axis_gaps(a: Column, b: Column) -> Column:
    gap = lambda x0, x1, y0, y1: F.greatest(y0 - x1, x0 - y1, F.lit(0))
    return F.struct(gap(a["x"], right(a), b["x"], right(b)).alias("dx"), gap(a["y"], bottom(a), b["y"], bottom(b)).alias("dy"))


def within_band(a: Column, b: Column, reach: float = 16) -> Column:
    """Inclusive: gaps on both axes are at most ``reach``."""
    g = axis_gaps(a, b)
    return (g["dx"] <= reach) & (g["dy"] <= reach)


def extent_ratio(a: Column, b: Column) -> Column:
    return F.when(F.least(a, b) > 0, F.greatest(a, b) / F.least(a, b)).otherwise(F.lit(float("inf")))


def prefers_on_axis(kept: Column, candidate: Column) -> Column:
    """One axis shared, the other not: the taller one wins, or the narrower."""
    w, h = extent_ratio(kept["width"], candidate["width"]), extent_ratio(kept["height"], candidate["height"])
    return (
        F.when((w <= AXIS_SHARED) & (h >= AXIS_DIFFERS), candidate["height"] > kept["height"])
        .when((h <= AXIS_SHARED) & (w >= AXIS_DIFFERS), candidate["width"] < kept["width"])
        .otherwise(False)
    )


def suppression(
    kept: Column, candidate: Column, kept_label: Column, label: Column, kept_score: Column, score: Column,
    iou_at: float = 0.5, contained_at: float = 0.9, axis_aware: bool = False, least_score_ratio: float = 0.5, lettered: tuple[str, ...] = ("text",),
) -> Column:
    """Verdict on a candidate against a kept box: independent, suppress or replace."""
    comparable = (kept_label == label) | (kept_label.isin(*lettered) & label.isin(*lettered))
    over = (iou(kept, candidate) >= iou_at) | (overlap_of_smaller(kept, candidate) >= contained_at)
    replaces = F.lit(axis_aware) & (kept_score > 0) & (score / kept_score >= least_score_ratio) & prefers_on_axis(kept, candidate)
    return F.when(~comparable | ~over, "independent").when(replaces, "replace").otherwise("suppress")


def residue(loser: Column, winner: Column, least: float = 24) -> Column:
    """What a winner leaves of a loser: left, right, upper and lower strip, where both sides are long enough."""
    x0, x1 = F.greatest(loser["x"], winner["x"]), F.least(right(loser), right(winner))
    corners = [
        (loser["x"], loser["y"], F.least(right(loser), winner["x"]), bottom(loser)),
        (F.greatest(loser["x"], right(winner)), loser["y"], right(loser), bottom(loser)),
        (x0, loser["y"], x1, F.least(bottom(loser), winner["y"])),
        (x0, F.greatest(loser["y"], bottom(winner)), x1, bottom(loser)),
    ]
    strips = F.array(*[box(a, b, c - a, d - b) for a, b, c, d in corners])
    return F.filter(strips, lambda s: F.least(s["width"], s["height"]) >= least)


def union(a: Column, b: Column) -> Column:
    """Bounding box of both; of one, if the other is null."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    both = box(x, y, F.greatest(right(a), right(b)) - x, F.greatest(bottom(a), bottom(b)) - y)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def pad(b: Column, margin: float = MARGIN) -> Column:
    return box(b["x"] - margin, b["y"] - margin, b["width"] + 2 * margin, b["height"] + 2 * margin)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def clamp_axis(start: Column, span: Column, page: Column) -> Column:
    """A span moved into the page; one as long as the page takes all of it."""
    return F.when(span >= page, F.struct(F.lit(0.0).alias("start"), page.cast("double").alias("span"))).otherwise(
        F.struct(clamp(start, F.lit(0.0), page - span).cast("double").alias("start"), span.cast("double").alias("span"))
    )


def clamp_to_page(b: Column, width: Column, height: Column) -> Column:
    """Box in the page and whether it moved."""
    x, y = clamp_axis(b["x"], b["width"], width), clamp_axis(b["y"], b["height"], height)
    moved = (x["start"] != b["x"]) | (y["start"] != b["y"]) | (x["span"] != b["width"]) | (y["span"] != b["height"])
    return F.struct(box(x["start"], y["start"], x["span"], y["span"]).alias("box"), moved.alias("moved"))


def crop(b: Column, width: Column, height: Column, grow: float = 0) -> Column:
    """Whole pixels of a box, grown and cut at the image's edges; null if nothing is left."""
    x0, y0 = F.greatest(F.floor(b["x"] - grow), F.lit(0)), F.greatest(F.floor(b["y"] - grow), F.lit(0))
    x1, y1 = F.least(F.ceil(right(b) + grow), width), F.least(F.ceil(bottom(b) + grow), height)
    return F.when((x1 > x0) & (y1 > y0), box(x0, y0, x1 - x0, y1 - y0))


# ---------------------------------------------------------------- polygons: arrays of (x, y)


def polygon_bounds(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, box(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)))


def polygon_meets(points: Column, b: Column) -> Column:
    """Strict overlap of a box with the polygon's extents."""
    return overlaps(polygon_bounds(points), b)


def _edges(points: Column) -> Column:
    n = F.size(points)
    return F.transform(points, lambda p, i: F.struct(p.alias("p"), F.element_at(points, (i + 1) % n + 1).alias("q")))


def point_in_polygon(points: Column, x: Column, y: Column) -> Column:
    """Even-odd rule."""
    crossed = F.filter(
        _edges(points),
        lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / F.nullif(e["q"]["y"] - e["p"]["y"], F.lit(0.0)) + e["p"]["x"]),
    )
    return F.size(crossed) % 2 == 1


def edge_distance_squared(points: Column, x: Column, y: Column) -> Column:
    def one(e):
        dx, dy = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
        length = dx * dx + dy * dy
        t = F.when(length > 0, clamp(((x - e["p"]["x"]) * dx + (y - e["p"]["y"]) * dy) / length, F.lit(0.0), F.lit(1.0))).otherwise(0.0)
        return F.pow(x - e["p"]["x"] - t * dx, F.lit(2)) + F.pow(y - e["p"]["y"] - t * dy, F.lit(2))

    return F.array_min(F.transform(_edges(points), one))


def convex_overlaps(a: Column, b: Column) -> Column:
    """Separating-axis test of two convex polygons; touching is apart, fewer than three points never overlap."""

    def apart(axes: Column) -> Column:
        def separated(e):
            nx, ny = e["q"]["y"] - e["p"]["y"], e["p"]["x"] - e["q"]["x"]
            on = lambda pts: F.transform(pts, lambda p: p["x"] * nx + p["y"] * ny)
            pa, pb = on(a), on(b)
            return ((nx != 0) | (ny != 0)) & ((F.array_max(pa) <= F.array_min(pb)) | (F.array_max(pb) <= F.array_min(pa)))

        return F.exists(_edges(axes), separated)

    return (F.size(a) >= 3) & (F.size(b) >= 3) & ~apart(a) & ~apart(b)


def rotated_box(b: Column, degrees: Column) -> Column:
    """Corners of a box turned about its centre."""
    cx, cy = b["x"] + b["width"] / 2, b["y"] + b["height"] / 2
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1)]

    def one(i, j):
        dx, dy = b["width"] / 2 * i, b["height"] / 2 * j
        return F.struct((cx + dx * c - dy * s).alias("x"), (cy + dx * s + dy * c).alias("y"))

    return F.array(*[one(i, j) for i, j in corners])


def envelope_fits(b: Column, degrees: Column, target: Column, slack: float = 0.5) -> Column:
    """The bounds of a turned box lie in the target."""
    e = polygon_bounds(rotated_box(b, degrees))
    return (e["x"] >= target["x"] - slack) & (e["y"] >= target["y"] - slack) & (right(e) <= right(target) + slack) & (bottom(e) <= bottom(target) + slack)


def quad_is_vertical(points: Column) -> Column:
    b = polygon_bounds(points)
    return b["height"] > b["width"]


# ---------------------------------------------------------------- admission by shape


def implausible_area(b: Column, width: Column, height: Column, most: Column | None) -> Column:
    """At least a share of the page; off for a null, non-positive or NaN share."""
    if most is None:
        return F.lit(False)
    on = most.isNotNull() & ~F.isnan(most.cast("double")) & (most > 0)
    return F.coalesce(on & (b["width"] * b["height"] >= most * width * height), F.lit(False))


def spans_slice(b: Column, height: Column, share: float = 0.95, least: int = 128) -> Column:
    return (height >= least) & (b["height"] >= share * height)


def refused_by_shape(b: Column, width: Column, height: Column, most: Column | None, joined: Column | None = None) -> Column:
    """Implausible or, on pages that weren't joined, a fragment across the slice."""
    whole = implausible_area(b, width, height, most)
    cut = spans_slice(b, height)
    return whole | cut if joined is None else F.when(joined, whole).otherwise(whole | cut)


def rotation_candidate(b: Column, free_standing: Column, aspect: float = 3.0) -> Column:
    return free_standing & (b["width"] > 0) & (b["height"] >= aspect * b["width"])


def oversized(width: Column, height: Column, threshold: Column) -> Column:
    return F.coalesce(F.greatest(width, height) > threshold, F.lit(False))


def narrow(b: Column, most: float = 256) -> Column:
    return F.least(b["width"], b["height"]) <= most


def spans_a_cut(b: Column, cuts: Column) -> Column:
    """Half-open: a cut at the lower edge isn't crossed."""
    return F.exists(cuts, lambda c: (b["y"] < c) & (bottom(b) > c))


def edge_band(height: Column) -> Column:
    return F.greatest(F.lit(EDGE_FLOOR), F.floor(height * EDGE_FRACTION + 0.5)).cast("int")


def edge_touched(b: Column, height: Column) -> Column:
    """The one page edge a box reaches; null for none or both."""
    band = edge_band(height)
    top, low = b["y"] <= band, bottom(b) >= height - band
    return F.when(top & ~low, "top").when(low & ~top, "bottom")


def column_shaped(b: Column, aspect: float = 1.2, least_width: float = 24) -> Column:
    return (b["height"] * aspect > b["width"]) & (b["width"] >= least_width)


def effective_box(fit: Column, raw: Column) -> Column:
    """The fitted box if all its numbers are there, else the raw one; null without a positive size."""
    finite = F.lit(True)
    for f in ("x", "y", "width", "height"):
        finite = finite & fit[f].isNotNull() & ~F.isnan(fit[f].cast("double"))
    chosen = F.when(finite, fit).otherwise(raw)
    return F.when((chosen["width"] > 0) & (chosen["height"] > 0), chosen)


def fit_free_text(size: Column, b: Column, chars: Column, share: float = 0.55, floor: float = 9) -> Column:
    """Font size at which free text fills a share of its box, never larger than asked, floored."""
    return F.greatest(F.lit(floor), F.least(size, F.sqrt(share * b["width"] * b["height"] / (0.42 * F.greatest(chars, F.lit(1))))))


def halo(stroke: Column, size: Column, role: Column) -> Column:
    return F.when((role == "dialogue") & ~F.coalesce(stroke > 0, F.lit(False)), 0.05 * size).otherwise(stroke)


# ---------------------------------------------------------------- seams between slices


def _narrower(top: Column, low: Column) -> Column:
    return F.greatest(F.lit(1), F.least(top["width"], low["width"]))


def _shared_width(top: Column, low: Column) -> Column:
    return F.greatest(F.lit(0), F.least(right(top), right(low)) - F.greatest(top["x"], low["x"]))


def seam_veto(top: Column, low: Column, effect: str = "onomatopoeia") -> Column:
    """Why the last box of a slice and the first of the next aren't one: sfx, width-ratio, overlap; null if they may be.

    Unlike widths are allowed where one lies over the other and the cut has
    clipped one of them: its height is small beside the share of the widths.
    """
    wider, narrower = F.greatest(F.lit(1), top["width"], low["width"]), _narrower(top, low)
    shared = _shared_width(top, low)
    a, b = F.coalesce(top["label"] == effect, F.lit(False)), F.coalesce(low["label"] == effect, F.lit(False))
    heights = F.least(top["height"], low["height"]) / F.greatest(F.lit(1), top["height"], low["height"])
    clipped = ~a & ~b & (heights < narrower / wider * CUT_SLACK)
    return (
        F.when(a & b, "sfx")
        .when((wider / narrower > MAX_WIDTH_RATIO) & ~((shared >= narrower - 1) & clipped), "width-ratio")
        .when(shared / narrower < MIN_OVERLAP, "overlap")
    )


def seam_score(top: Column, low: Column, top_gap: Column, low_gap: Column, band: Column) -> Column:
    """Overlap counts for a pair; distance of centres, unlike widths and gaps to the cut count against it. Null for a vetoed pair."""
    narrower = _narrower(top, low)
    centre = F.abs(top["x"] + top["width"] / 2 - low["x"] - low["width"] / 2)
    unlike = F.abs(F.greatest(top["width"], low["width"]) / narrower - 1)
    gaps = (top_gap + low_gap) / F.greatest(F.lit(1), 3 * band)
    shared = 26 * _shared_width(top, low) / 10  # 2.6 times it as a decimal
    return F.when(seam_veto(top, low).isNull(), shared / narrower - 0.75 * centre / narrower - 0.35 * unlike - gaps)


def rounded(value: Column, digits: int) -> Column:
    """A double rounded as DuckDB's round does: the scaled number, halves away from zero. Spark's round goes by the decimal digits of the number itself."""
    scale = float(10**digits)
    return F.round(value * scale, 0) / scale


def touch_probe(profile: Column, step: Column, x: Column, width: Column, least: float = 60, share: float = 0.6) -> Column:
    """Upper median depth of the white under a box if enough of it runs deep, else null."""
    first = F.greatest(F.lit(0), F.floor(x / step)).cast("int")
    last = F.least(F.size(profile) - 1, F.ceil((x + width) / step) - 1).cast("int")
    part = F.transform(F.slice(profile, first + 1, F.greatest(last - first + 1, F.lit(0))), lambda d: F.greatest(F.coalesce(d, F.lit(0)), F.lit(0)))
    deep = F.size(F.filter(part, lambda d: d >= least))
    return F.when((last >= first) & (deep >= share * F.size(part)), F.element_at(F.array_sort(part), F.floor(F.size(part) / 2).cast("int") + 1))


# ---------------------------------------------------------------- views, edits, colours


def to_source(rect: Column, view: Column, width: Column, height: Column) -> Column:
    sx, sy = width / view["width"], height / view["height"]
    return box((rect["x"] - view["x"]) * sx, (rect["y"] - view["y"]) * sy, rect["width"] * sx, rect["height"] * sy)


def to_view(b: Column, view: Column, width: Column, height: Column) -> Column:
    sx, sy = view["width"] / width, view["height"] / height
    return box(view["x"] + b["x"] * sx, view["y"] + b["y"] * sy, b["width"] * sx, b["height"] * sy)


def same_rect(a: Column, b: Column, tolerance: float = 2) -> Column:
    out = F.lit(True)
    for f in ("x", "y", "width", "height"):
        out = out & (F.abs(a[f] - b[f]) <= tolerance)
    return out


def resize_rect(b: Column, handle: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """A box whose edges named in the handle (n, e, s, w) go to a point within bounds."""
    px, py = clamp(x, F.lit(0), width), clamp(y, F.lit(0), height)
    x0 = F.when(handle.contains("w"), px).otherwise(b["x"])
    x1 = F.when(handle.contains("e"), px).otherwise(right(b))
    y0 = F.when(handle.contains("n"), py).otherwise(b["y"])
    y1 = F.when(handle.contains("s"), py).otherwise(bottom(b))
    return box(F.least(x0, x1), F.least(y0, y1), F.abs(x1 - x0), F.abs(y1 - y0))


def move_rect(b: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    return box(clamp(b["x"] + dx, F.lit(0), width - b["width"]), clamp(b["y"] + dy, F.lit(0), height - b["height"]), b["width"], b["height"])


def contain_scale(width: Column, height: Column, view_width: Column, view_height: Column) -> Column:
    return F.least(view_width / width, view_height / height)


def page_to_screen(x: Column, y: Column, scale: Column, dx: Column, dy: Column) -> Column:
    return F.struct((x * scale + dx).alias("x"), (y * scale + dy).alias("y"))


def denormalize_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, unit: int = 1000) -> Column:
    return box(x0 * width / unit, y0 * height / unit, (x1 - x0) * width / unit, (y1 - y0) * height / unit)


def in_viewport(b: Column, width: Column, height: Column, margin: float = 0) -> Column:
    return (bottom(b) >= -margin) & (b["y"] <= height + margin) & (right(b) >= -margin) & (b["x"] <= width + margin)


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def colour_distance_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, x: s + x)


def normalize_colour(rgb: Column) -> Column:
    """Nearly grey and dark to black, nearly grey and light to white."""
    chroma = F.array_max(rgb) - F.array_min(rgb)
    mean = F.aggregate(rgb, F.lit(0).cast("long"), lambda s, x: s + x) / 3
    grey = chroma <= 24
    return F.when(grey & (mean <= 64), F.transform(rgb, lambda x: x * 0)).when(grey & (mean >= 191), F.transform(rgb, lambda x: x * 0 + 255)).otherwise(rgb)


def size_ceiling(group_min: Column, base: Column, ratio: Column) -> Column:
    return F.least(F.greatest(group_min, base), base * ratio)


def tiles(width: int, height: int, size: int, overlap: int = 0) -> list[tuple[int, int, int, int]]:
    """Grid of (x, y, width, height) that covers an image, for explode."""
    step = max(1, size - overlap)
    spans = lambda n: [(a, min(size, n - a)) for a in range(0, max(1, n - overlap), step)]
    return [(x, y, w, h) for y, h in spans(height) for x, w in spans(width)]


