from pyspark.sql import functions as F

from lamella.functions import geometry as g
from lamella.operators import seams


def make(spark, rows):
    """rows: run, idx, height, [(x, y, width, height, label, role)]"""
    slices = spark.createDataFrame([(r, i, 600, h) for r, i, h, _ in rows], "run string, idx long, width long, height long").withColumn(
        "white", F.lit(None).cast("struct<top: array<int>, bottom: array<int>, step: int>")
    )
    regions = [(r, i, o, *map(float, b[:4]), b[4], b[5]) for r, i, _, boxes in rows for o, b in enumerate(boxes)]
    regions = spark.createDataFrame(regions, "run string, idx long, ord long, x double, y double, w double, h double, label string, role string")
    regions = regions.select("run", "idx", "ord", g.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box"), "label", "role", F.lit(False).alias("refused"))
    return seams.slice_edges(slices, regions), regions


ROWS = [
    ("a", 0, 1000, [(100, 900, 200, 100, "text", "dialogue"), (400, 100, 50, 50, "text", "dialogue")]),
    ("a", 1, 1000, [(110, 0, 190, 120, "text", "dialogue"), (400, 0, 150, 90, "text", "dialogue")]),
    ("b", 0, 1000, [(100, 900, 200, 100, "onomatopoeia", "effect")]),
    ("b", 1, 1000, [(100, 0, 200, 100, "onomatopoeia", "effect")]),
    ("c", 0, 1000, [(100, 900, 200, 100, "text", "dialogue")]),
    ("c", 1, 1000, []),
]


def test_edges_candidates_and_plan(spark):
    slices, regions = make(spark, ROWS)
    edges = {(r.run, r.idx): (len(r.top), len(r.bottom)) for r in slices.collect()}
    assert edges == {("a", 0): (0, 1), ("a", 1): (2, 0), ("b", 0): (0, 1), ("b", 1): (1, 0), ("c", 0): (0, 1), ("c", 1): (0, 0)}
    found = seams.candidates(slices)
    why = {(r.run, r.i, r.j): (r.veto, r.refused, r.score is not None) for r in found.collect()}
    assert why == {("a", 0, 0): (None, None, True), ("a", 0, 1): ("overlap", None, False), ("b", 0, 0): ("sfx", None, False), ("c", None, None): (None, "one-sided", False)}
    pairs = seams.matches(found)
    assert [(r.run, r.cut, r.i, r.j) for r in pairs.collect()] == [("a", 0, 0, 0)]
    plan = seams.run_plan(slices, found)
    rows = plan.orderBy("idx").collect()
    assert [(r.run, r.idx) for r in rows] == [("a", 0), ("a", 1)] and rows[0].plan_height == 1000 and rows[1].offset == rows[0].height
    boxes = spark.createDataFrame([("a", 100.0, 400.0, 200.0, 220.0)], "run string, x double, y double, w double, h double").select("run", g.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box"))
    rect = seams.composite_rects(plan, pairs, boxes).collect()
    assert len(rect) == 1 and rect[0].y < rows[1].offset < rect[0].y + rect[0].height and rect[0].width < 600


def test_white_stands_in(spark):
    slices, _ = make(spark, ROWS[4:])
    white = F.when(F.col("idx") == 1, F.struct(F.array_repeat(F.lit(80), 75).alias("top"), F.array_repeat(F.lit(0), 75).alias("bottom"), F.lit(8).alias("step")))
    found = seams.candidates(slices.withColumn("white", white)).collect()
    assert len(found) == 1 and found[0].refused is None and found[0].score > 2 and found[0].low.height == 80


def test_join_for(spark):
    rows = spark.createDataFrame([("r", i, s) for i, s in enumerate([False, True, True, False, False, True, False])], "run string, idx long, spans boolean")
    got = {r.cut: (r.first, r.last) for r in seams.join_for(rows, F.col("spans")).collect()}
    assert got == {0: (0, 3), 1: (0, 3), 2: (0, 3), 3: (3, 4), 4: (4, 6), 5: (4, 6)}
    assert {r.cut: (r.first, r.last) for r in seams.join_for(rows, F.col("spans"), 3).collect()}[2] == (1, 3)


def test_seam_match_rounds_scores_as_its_sql(spark, tmp_path):
    """Scores at the half of a millionth: an upper box and two lower ones of about one score, in either order of their ids."""
    import datetime

    from lamella.plans import catalog
    from tests.oracle import compare

    cases = [((61, 160), (112, 232, 0), (48, 164, 57)), ((27, 192), (101, 296, 19), (24, 96, 60)), ((403, 96), (404, 172, 46), (372, 128, 64)), ((42, 320), (170, 444, 87), (188, 416, 81))]

    def item(order, line, x, y, width):
        grow = next(m for m in (1, 2, 3) if width % m == 0 and (width // m - 20) % 4 == 0 and 1 <= (width // m - 20) // 4 <= 50)
        return order, x + 700, y * pow(13, -1, 1100) % 1100, line, (width // grow - 20) / 4, 1.0, 0.5, 0.0, " ANR"[grow], "F", datetime.datetime(2020, 1, 1)

    rows = []
    for n, ((x, width), a, b) in enumerate(cases + [(u, b, a) for u, a, b in cases]):
        rows.append(item(16 * n, 7, x, 1000, width))
        rows += [item(16 * n + 8, line, low_x, gap, low_width) for line, (low_x, low_width, gap) in enumerate((a, b), 1)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "lineitem.parquet")
    got, want = compare(spark, catalog.queries()["seam_match"], catalog.oracle_sql()["seam_match"], str(tmp_path))
    assert got == want and len(got) == 2 * len(cases)
