"""Operators that no table query exercises in full, on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from lamella.functions import geometry as g
from lamella.functions import keys as k
from lamella.functions import text as t
from lamella.operators import cache, folds, history, order, regions, reply, reports, sequence, settings, spatial, store
from lamella.sources import readers


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def b(x, y, w, h):
    return F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("width"), F.lit(h).alias("height"))


def test_text(spark):
    L = F.lit
    assert one(spark, t.strip_mark(L("A MarK and mark"), "mark"), t.is_cut(L("cut ")), t.is_cut(L(" ")), t.scream_read(L("aaab!")), t.scream_read(L("abc"))) == ("A  and ", True, False, True, False)
    assert one(spark, t.clip_bytes(L("éééé"), 5), t.clip_bytes(L("abc"), 5), t.widen_halfwidth(L("ｶﾞﾊﾟa")), t.fold_fullwidth(L("Ａ１"))) == ("éé...", "abc", "ガパａ", "A1")
    assert one(spark, t.site_address(L("(www.ab-c.net)")), t.site_address(L("a.b")), t.site_address(L("x_y.net")), t.orphaned_address_tail(L(".com!")), t.orphaned_address_tail(L("com"))) == (True, False, False, True, False)
    assert one(spark, t.misread_plate(L("晨光書由 x.test"), ["晨光書曲"], ["免費"]), t.only_function_words(L("The a"), ["the", "a"]), t.only_function_words(L("..."), ["the"])) == (True, True, False)
    assert one(spark, t.degenerate_period(L("ab" * 20)), t.degenerate_period(L("ab" * 10)), t.degenerate_words(L("no " * 20)), t.normalize_placeholders(L("□□"))) == (True, False, True, "...")
    assert one(spark, t.strip_engine_preamble(L("The text is: hi"), ["The text"]), t.strip_latex(L(r"$\text{hi} x$")), t.strip_latex(L("hi")), t.squeeze(L(" a \n b "))) == ("hi", "hi x", "hi", "a b")
    assert one(spark, t.token_budget(L(1), L(None).cast("int")), t.token_budget(L(100), L(500)), t.resolve_script(L("ja-JP"), L("zh")), t.resolve_script(L("en"), L("zh"))) == (1000, 2048, "ja", "zh")
    assert one(spark, t.is_romanised(L("sakura no hana")), t.is_romanised(L("strength")), t.dominant_script(L("!か漢")), t.uppercase_dialogue(L("a"), L("dialogue"))) == (True, False, "kana", "A")
    assert one(spark, t.effect_refusal(L(" and "), L("onomatopoeia"), ["and"]), t.effect_refusal(L("and"), L("text"), ["and"])) == ("drawn_connective", None)


def test_keys(spark):
    L = F.lit
    assert one(spark, k.fnv1a(L("abc")), k.slug(L("--A b/ç  D__")), k.valid_id(L("a-1_")), k.valid_id(L("a b"))) == ("1a47e90b", "a-b-d", True, False)
    assert one(spark, k.utf16_units(L("a😀"))) == ([97, 0xD83D, 0xDE00],)
    key = k.story_page_key(L("https://H.test/series/My-Tale-chapter-12.html?x=1"))
    assert one(spark, key["key"], k.story_page_key(L("https://h.test/a/b?titleId=A9"))["series"], k.story_page_key(L("no url"))["key"]) == ("h.test|my-tale", "titleid=a9", "|")
    assert one(spark, k.story_id(key, L(2)), k.ledger_term(L("「Ann  Lee」!")), k.ledger_term(L("Run. Now")), k.cache_url_key(L("data:x"), L("f"))) == (
        "my-tale-" + one(spark, k.fnv1a(L("h.test|my-tale")))[0] + "-r2", "Ann Lee", "", None
    )
    terms = F.array(F.struct(L("a").alias("source"), L("b").alias("translation")))
    assert one(spark, k.glossary_fingerprint(terms), k.same_site(L("x.a.test"), L("a.test")), k.same_site(L("xa.test"), L("a.test")))[1:] == (True, False)
    assert one(spark, k.page_file_name(L(12345), L("a/b. ")), k.page_file_name(L(7), L("x"))) == ("12345_a_b", "0007_x")


def test_geometry(spark):
    L = F.lit
    assert one(spark, g.overlaps(b(0, 0, 10, 10), b(10, 0, 5, 5)), g.contains(b(0, 0, 10, 10), b(5, 5, 5, 5)), g.center_inside(b(0, 0, 10, 10), b(5, 5, 10, 10)), g.within_band(b(0, 0, 10, 10), b(26, 0, 1, 1))) == (False, True, True, True)
    tri = F.array(*[F.struct(L(float(x)).alias("x"), L(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (0, 10))])
    far = F.array(*[F.struct(L(float(x)).alias("x"), L(float(y)).alias("y")) for x, y in ((6, 6), (10, 6), (10, 10))])
    near = F.array(*[F.struct(L(float(x)).alias("x"), L(float(y)).alias("y")) for x, y in ((4, 4), (10, 4), (10, 10))])
    assert one(spark, g.point_in_polygon(tri, L(2.0), L(2.0)), g.point_in_polygon(tri, L(8.0), L(8.0)), g.convex_overlaps(tri, far), g.convex_overlaps(tri, near), g.edge_distance_squared(tri, L(5.0), L(-3.0))) == (True, False, False, True, 9.0)
    assert one(spark, g.envelope_fits(b(4, 4, 2, 2), L(45.0), b(3, 3, 4, 4)), g.envelope_fits(b(4, 4, 2, 2), L(45.0), b(4, 4, 2, 2), 0.1), g.union(b(0, 0, 1, 1), b(4, 5, 2, 2))["height"]) == (True, False, 7)
    assert one(spark, g.touch_probe(F.array(*[L(x) for x in (70, 80, 0, 90, 100)]), L(8), L(0), L(40)), g.touch_probe(F.array(L(70), L(0), L(0)), L(8), L(0), L(24))) == (80, None)
    assert one(spark, g.resize_rect(b(0, 0, 10, 10), L("se"), L(-5), L(20), L(100), L(15))["width"], g.move_rect(b(0, 0, 10, 10), L(500), L(-3), L(100), L(100))["x"], g.same_rect(b(0, 0, 1, 1), b(2, 2, 3, 3))) == (0, 90, True)
    assert one(spark, g.normalize_colour(F.array(L(10), L(20), L(30))), g.normalize_colour(F.array(L(200), L(210), L(220))), g.normalize_colour(F.array(L(0), L(99), L(0))), g.luma(L(255), L(255), L(255))) == ([0] * 3, [255] * 3, [0, 99, 0], 255.0)
    assert one(spark, g.edge_touched(b(0, 0, 5, 5), L(1000)), g.edge_touched(b(0, 0, 5, 1000), L(1000)), g.spans_a_cut(b(0, 0, 5, 100), F.array(L(100))), g.halo(L(None).cast("double"), L(20.0), L("dialogue"))) == ("top", None, False, 1.0)
    covered = {(x + i, y + j) for x, y, w, h in g.tiles(70, 50, 32, 8) for i in range(w) for j in range(h)}
    assert covered == {(i, j) for i in range(70) for j in range(50)}


def boxes_df(spark, rows):
    rows = [(*r[:3], *map(float, r[3:])) for r in rows]
    df = spark.createDataFrame(rows, "page long, id long, label string, score double, x double, y double, w double, h double")
    return df.select("page", "id", "label", "score", g.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box"))


def test_settle(spark):
    rows = [(1, 1, "text", 0.9, 0, 0, 100, 100), (1, 2, "text", 0.8, 0, 0, 98, 150), (1, 3, "text", 0.7, 0, 5, 100, 90), (1, 4, "bubble", 0.95, 0, 0, 100, 100), (1, 5, "text", 0.5, 500, 500, 10, 10)]
    out = {r.id: r.outcome for r in folds.settle_detections(boxes_df(spark, rows)).collect()}
    assert out == {1: "replaced", 2: "kept", 3: "suppressed", 4: "kept", 5: "kept"}


def test_greedy_against_loop(spark):
    rng = random.Random(1)
    rows = [(i % 5, i, rng.choice(["text", "bubble"]), rng.randrange(20) / 20, *map(float, (rng.randrange(200), rng.randrange(200), rng.randrange(20, 90), rng.randrange(20, 90)))) for i in range(150)]
    got = {(r.page, r.id) for r in folds.greedy_suppression(boxes_df(spark, rows)).collect()}
    want = set()
    for page in range(5):
        kept = []
        for r in sorted((r for r in rows if r[0] == page), key=lambda r: (-r[3], r[5], -r[4], r[2], r[1])):
            hit = False
            for q in kept:
                both, a, c = folds._inter(q[4:], r[4:]), r[6] * r[7], q[6] * q[7]
                hit |= q[2] == r[2] and (both / (a + c - both) >= 0.5 or both / min(a, c) >= 0.9)
            if not hit:
                kept.append(r)
        want |= {(page, r[1]) for r in kept}
    assert got == want


def test_duplicates_walk(spark):
    rows = [(1, 0, "abc def", 0), (1, 1, "abc", 5), (1, 2, "ABC def", 8), (1, 3, "ab", 9), (2, 0, "xyz", 0), (2, 1, "xyz", 500)]
    df = spark.createDataFrame([(*r[:3], float(r[3])) for r in rows], "page long, ord long, text string, x double").select("page", "ord", "text", g.box(F.col("x"), F.lit(0.0), F.lit(50.0), F.lit(50.0) + F.col("ord")).alias("fit"), g.box(F.col("x"), F.lit(0.0), F.lit(50.0), F.lit(50.0)).alias("source_box"))
    assert {(r.page, r.ord) for r in folds.resolve_duplicates(df).collect()} == {(1, 1), (1, 0)}
    assert {(r.page, r.ord) for r in folds.resolve_duplicates(df, shared_source=True).collect()} == {(1, 1), (1, 0)}


def test_edits(spark):
    none = (None,) * 4
    rows = [("i", 1, "add", (0, 0, 10, 10), none, none), ("i", 2, "deleted", (1, 1, 10, 10), none, none), ("i", 3, "deleted", (50, 50, 9, 9), none, none), ("i", 4, "drawn", (70, 70, 5, 5), none, none),
            ("i", 5, "placed", (70, 70, 5, 5), none, (1, 1, 30, 30)), ("j", 1, "placed", (0, 0, 5, 5), none, (1, 1, 3, 3))]
    rect = "struct<x: double, y: double, width: double, height: double>"
    df = spark.createDataFrame([(a, s, kd, *[tuple(None if v is None else float(v) for v in r) for r in rs]) for a, s, kd, *rs in rows], f"image string, seq int, kind string, box {rect}, to {rect}, place {rect}")
    out = sorted((r.image, r.list, r.x) for r in folds.merge_edits(df).collect() if r.list != "error")
    assert out == [("i", "add", 70.0), ("i", "place", 70.0), ("i", "remove", 50.0)]
    assert [r.image for r in folds.merge_edits(df).collect() if r.list == "error"] == ["j"]


def test_take_previous_and_merge(spark):
    new = boxes_df(spark, [(1, 0, "t", 1, 0, 0, 10, 10), (1, 1, "t", 1, 1, 1, 10, 10), (1, 2, "t", 1, 90, 90, 5, 5)]).withColumnRenamed("id", "ord")
    old = boxes_df(spark, [(1, 7, "t", 1, 0, 0, 10, 10), (1, 8, "t", 1, 2, 2, 10, 10)]).withColumnRenamed("id", "prev")
    matched = folds.take_previous(new, old)
    assert {r.ord: r.prev for r in matched.collect()} == {0: 7, 1: 8, 2: None}
    left = folds.unmatched_previous(old.withColumn("producer", F.lit("me")), matched.where("ord = 0"), "me")
    assert [(r.prev, r.action) for r in left.collect()] == [(8, "delete")]
    merged = folds.merge_boxes(boxes_df(spark, [(1, 0, "t", 1, 0, 0, 50, 20), (1, 1, "t", 1, 0, 24, 50, 20), (1, 2, "t", 1, 5, 5, 10, 10), (1, 3, "t", 1, 200, 0, 5, 5)]).withColumnRenamed("id", "ord"))
    assert sorted((r.x, r.height) for r in merged.collect()) == [(0.0, 44.0), (200.0, 5.0)]


def test_votes_and_choices(spark):
    reads = spark.createDataFrame([("c", 0, "ABC", 0.5), ("c", 1, "abc!", 0.4), ("c", 2, "ABC?", None), ("c", 3, "zz", 0.99)], "crop string, ord long, text string, score double")
    assert folds.upright_vote(reads).first().text in ("ABC", "ABC?")
    flips = spark.createDataFrame([("c", 0, "a", 0.9), ("c", 1, "b", 0.9), ("c", 2, " ", 1.0)], "crop string, ord long, text string, confidence double")
    assert order.best_flip(flips).first().text == "b"
    assert one(spark, order.choose_flip(F.lit(0.5), F.lit(0.6)), order.choose_flip(F.lit(0.5), F.lit(0.7)), order.choose_orientation(F.lit(0.5), F.lit(0.6))) == ("plain", "flipped", "rotated")


def test_cells_and_cover(spark):
    df = boxes_df(spark, [(1, 1, "t", 1, 40, 40, 20, 20), (1, 2, "t", 1, 100, 45, 20, 20), (1, 3, "t", 1, 45, 200, 20, 20)])
    cells = {r.id: r.cell for r in spatial.free_text_cell(df, F.lit(300.0), F.lit(300.0)).collect()}
    assert (cells[1].x, cells[1].width, cells[1].y, cells[1].height) == (0, 100, 0, 200)
    framed = df.withColumn("frame", b(0.0, 0.0, 300.0, 300.0))
    halves = {r.id: r.cell for r in spatial.bubble_text_cell(framed).collect()}
    assert (halves[1].width, halves[1].height) == (80.0, 130.0)
    pts = spark.createDataFrame([(1, 1, 50.0, 50.0), (1, 2, 299.0, 299.0)], "page long, id long, px double, py double")
    hit = spatial.pin_hit(pts, df.select("page", F.col("id").alias("ordinal"), "box"))
    assert {r.id: r.term for r in hit.collect()} == {1: 1, 2: None}
    assert [r.id for r in spatial.rescue_candidates(df.where("id = 1").withColumn("ink", F.lit(0.2)), df.where("id = 2"), F.lit(9000.0)).collect()] == [1]
    page = spark.createDataFrame([("r", 0, 100, 0.0), ("r", 1, 100, 51.0), ("r", 2, 90, 101.0)], "run string, ordinal long, natural_width long, y double").withColumn("box", g.box(F.lit(0.0), F.col("y"), F.lit(100.0), F.lit(50.0)))
    assert {r.ordinal: r.next for r in spatial.slice_neighbours(page).collect()} == {0: 1, 1: None, 2: None}


def test_regions(spark):
    rows = [(1, 0, "c0", "l0", "src", "", None, "text"), (1, 1, "c1", "l1", "boom", None, None, "onomatopoeia"), (1, 2, "c2", "l2", "x", "cut ", None, "text"), (1, 3, "c3", "l3", "hi", "yo", "junk", "text")]
    df = spark.createDataFrame(rows, "page long, idx long, content string, layer string, source string, translated string, refused string, label string")
    lists = regions.index_lists(df).first()
    assert lists.dropped == [0, 1] and lists.split_fragments == [2]
    pins = spark.createDataFrame([(1, 0, "src", "first"), (1, 1, "src", "second")], "page long, ordinal long, source string, translation string")
    assert {r.idx: r.translated for r in regions.apply_pins(df, pins).collect()}[0] == "first"
    d = regions.merge_dictionaries(spark.createDataFrame([(1, 0, "boom ", "late"), (0, 5, " boom", "BAM")], "file_ordinal int, pos int, source string, target string"))
    assert {r.idx: r.translated for r in regions.pin_effects(df, d).collect()}[1] == "BAM"
    assert [r.idx for r in regions.untranslated(df, df.where("idx = 1")).collect()] == [1]
    warned = spark.createDataFrame([(1, "l2", "w"), (1, "zz", "w")], "page long, layer string, warning string")
    assert {r.layer: r.region for r in regions.attribute_to_regions(warned, df).collect()} == {"l2": 2, "zz": None}
    hidden = regions.hide_implausible(df.withColumn("role", F.when(F.col("idx") == 2, "dialogue")), F.lit("unknown"), connectives=["boom"])
    assert {r.idx: r.refused for r in hidden.collect()} == {0: None, 1: "drawn_connective", 2: None, 3: "junk"}
    seg = df.withColumn("furniture", F.col("idx") < 2)
    assert regions.translation_targets(seg, F.col("furniture")).count() == 2 and regions.translation_targets(seg.where("idx < 2"), F.col("furniture")).count() == 2


def test_reply(spark):
    votes = spark.createDataFrame([(1, 0.9), (2, 0.1)], "page long, vote double")
    rows = spark.createDataFrame([(p, i, i == 1, i > 1, i == 2) for p in (1, 2) for i in range(4)], "page long, pos long, is_cut boolean, tail boolean, neighbour boolean")
    got = {(r.page, r.pos) for r in reply.cut_repair_targets(rows, votes, neighbours=True).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)}
    L = F.lit
    assert one(spark, reply.accept_repair(L("a"), L(True), L("b")), reply.accept_repair(L("b "), L(True), L("b")), reply.accept_repair(L("b"), L(True), L(" b")), reply.segment_id(L("12")), reply.segment_id(L("x"))) == (True, False, False, 12, None)
    text = "```json\n{translations: [{id: '0', text: \"a\"}, {id: 2, text: 'b'}]} trailing\n```"
    raw = spark.createDataFrame([(1, text), (2, "nothing")], "page long, reply string")
    assert [(r.page, r.pos, r.id, r.text) for r in readers.reply_records(raw).collect()] == [(1, 0, 0, "a"), (1, 1, 2, "b")]
    ctx = reply.page_context(spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", ""), (1, 2, "c", "z")], "page long, pos long, source string, translated string"))
    assert {r.pos: [p.pos for p in r.context] for r in ctx.collect()} == {0: [2], 1: [0, 2], 2: [0]}


def test_history(spark):
    g0 = spark.createDataFrame([("k", 1, [("a", "b")]), ("e", 1, [])], "key string, at long, terms array<struct<source: string, translation: string>>")
    upd = spark.createDataFrame([("k", 2, [])], "key string, at long, terms array<struct<source: string, translation: string>>")
    assert [r.key for r in history.set_glossary(g0, upd.limit(0)).collect()] == ["k"] and history.set_glossary(g0, upd).count() == 0
    led = spark.createDataFrame([("s", f"t{i % 3}", f"r{i}", i, i) for i in range(9)], "series string, term string, rendering string, n long, at long")
    capped = history.ledger_capped(led, most_terms=2, most_renderings=2).collect()
    assert {(r.term, r.rendering) for r in capped} == {("t2", "r8"), ("t2", "r5"), ("t1", "r7"), ("t1", "r4")}
    picks = spark.createDataFrame([("a", "", ""), ("b", "ko", "")], "host string, language string, profile string")
    lat = spark.createDataFrame([("a", "ja", "paged"), ("b", "ja", "strip")], "host string, language string, format string")
    assert {tuple(r) for r in history.resolve_site(picks, lat).collect()} == {("a", "ja", "manga"), ("b", "ko", "webtoon")}
    pins = history.pin_term(spark.createDataFrame([("k", "Ann!", "x", 9)], "key string, source string, translation string, at long"), spark.createDataFrame([("k", "Ann", "y", 1)], "key string, source string, translation string, at long"))
    assert [(r.source, r.translation) for r in pins.collect()] == [("Ann", "y")]


def test_cache_equals_eviction_loop(spark):
    rng = random.Random(8)
    rows = [(f"g{i % 20}", f"k{i}", rng.randrange(40), rng.randrange(1, 50)) for i in range(400)]
    df = spark.createDataFrame(rows, "site string, key string, used long, bytes long")
    got = {r.key for r in cache.enforce_caps(df, 7, 150, ["site"]).collect()}
    want = set()
    for site in {r[0] for r in rows}:
        held = sorted((r for r in rows if r[0] == site), key=lambda r: (r[2], r[3], r[1]))
        while len(held) > 7 or sum(r[3] for r in held) > 150:
            held.pop(0)
        want |= {r[1] for r in held}
    assert got == want


def test_cache_lookup(spark):
    e = spark.createDataFrame([("a", ["u1", "u2"], 100, 5), ("b", ["u2"], 200, 6), ("c", ["u3"], -10**9, 7)], "key string, urls array<string>, at long, bytes long")
    look = spark.createDataFrame([("u2",), ("u3",), ("u9",)], "url_key string")
    found = cache.by_url(e, look, F.lit(300))
    assert {tuple(r) for r in found.collect()} == {("u2", "b"), ("u3", None), ("u9", None)} and tuple(cache.lookup_report(found).first()) == (1, 2)
    assert {tuple(r) for r in cache.put(e.select("key", "at", "bytes"), spark.createDataFrame([("a", 300, 9)], "key string, at long, bytes long")).collect()} == {("a", 300, 9), ("b", 200, 6), ("c", -10**9, 7)}
    seamed = spark.createDataFrame([("a", 1, ["top"])], "key string, at long, seamed array<string>")
    marks = spark.createDataFrame([("a", "bottom", 1), ("a", "left", 2)], "key string, edge string, expected_at long")
    assert cache.mark_seamed(seamed, marks).first().seamed == ["top", "bottom"]
    assert one(spark, cache.limits(F.lit("7"), 500), cache.limits(F.lit("x"), 500), cache.limits(F.lit("-1"), 500)) == (7, 500, 500)


def test_store(spark):
    schema = "revision long, seq int, op string, id string, page string, parent string, position int, kind string, before string, after string, origin string"
    ops = spark.createDataFrame([
        (1, 0, "insert", "a", "p", None, 0, None, None, None, "user"), (1, 1, "set", "a", None, None, None, "k", None, "v1", "g1"), (2, 0, "set", "a", None, None, None, "k", "v1", "v2", "user"),
        (3, 0, "insert", "b", "p", "a", 0, None, None, None, "user"), (3, 1, "delete", "b", "p", "a", 0, None, None, None, "user"),
    ], schema)
    assert [(r.id, r.value) for r in store.fold_components(ops).collect()] == [("a", "v2")] and [r.id for r in store.fold_entities(ops).collect()] == ["a"]
    undone = ops.unionByName(store.undo(ops, [2, 2], 3))
    assert store.fold_components(undone).first().value == "v1" and store.inverse(store.inverse(ops)).orderBy("revision", "seq").collect() == ops.orderBy("revision", "seq").collect()
    base = store.fold_components(ops.where("revision = 1"))
    assert store.recovery(base, ops, 3, 1).first().value == "v2"
    cur = store.fold_components(ops)
    seen = cur.select("id", "kind", F.sha2(F.col("value").cast("binary"), 256).alias("fingerprint"))
    patch = ops.where("revision = 2")
    assert store.rebase(patch, seen, cur, 9).first().revision == 10
    with pytest.raises(Exception, match="values that changed"):
        store.rebase(patch, seen.withColumn("fingerprint", F.lit("x")), cur, 9).collect()
    with pytest.raises(Exception, match="head moved"):
        store.ensure_head(ops, 7).collect()
    assert store.ensure_head(ops, 3).count() == 5
    ents = spark.createDataFrame([("a", None, 0), ("b", "a", 0), ("c", "a", 0), ("d", "zz", 0)], "id string, parent string, position long")
    assert {(r.id, r.rule) for r in store.structure_violations(ents).collect()} == {("d", "missing parent"), ("b", "shared position"), ("c", "shared position")}
    rel = spark.createDataFrame([("b", "c", "Inside")], "source string, target string, kind string")
    doomed = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {tuple(r) for r in store.removal_blocks(ents, rel, doomed, "reject").collect()} == {("b", "relations"), ("a", "children")}
    assert {r.id for r in store.removal_ops(ents, doomed.where("id = 'a'"), "cascade", 5).collect()} == {"a", "b", "c"}
    assert {(r.id, r.op) for r in store.removal_ops(ents, doomed.where("id = 'a'"), "promote", 5).collect()} == {("a", "delete"), ("b", "move"), ("c", "move")}
    blobs = spark.createDataFrame([(b"x",)], "bytes binary").withColumn("blob_id", F.sha2("bytes", 256))
    assert store.read_blobs(blobs, blobs).first().intact and store.missing_blobs(blobs, blobs).count() == 0


def test_sequence(spark):
    px = spark.createDataFrame([("r", i, 10 + i % 3, 20, 30, i < 8) for i in range(80)], "region string, i int, r int, g int, b int, foreground boolean")
    assert sequence.uniform_colour(px, "region").first().colour == [11, 20, 30] and sequence.text_colour(px, "region").first().r in (10, 11, 12)
    gaps = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 5, 0, 0, 7, 0, 0, 0, 0, 3, 0])], "k long, i long, v long")
    assert [r.closed for r in sequence.close_gaps(gaps, "k", "i", "v", 2).orderBy("i").collect()] == [False, True, True, True, True, False, False, False, False, True, False]
    lines = spark.createDataFrame([("t", i, at, p, i == 5) for i, (at, p) in enumerate([(0, 0.0), (3, 50.0), (6, 51.0), (7, 52.0), (40, 53.0), (41, 54.0)])], "task string, seq long, at long, percent double, last boolean")
    assert [r.seq for r in sequence.emitted_lines(lines).orderBy("seq").collect()] == [0, 2, 4, 5]
    imgs = spark.createDataFrame([("h", i, 100, 50.0 * i) for i in range(3)] + [("h", 3, 90, 150.0)], "host string, ordinal long, natural_width long, y double").withColumn("box", g.box(F.lit(0.0), F.col("y"), F.lit(100.0), F.lit(50.0)))
    assert tuple(sequence.page_shape(imgs).first()) == ("h", 3, "strip")


def test_settings_and_reports(spark):
    L = F.lit
    assert one(spark, settings.parse_seed(L("42")), settings.parse_seed(L(None).cast("string")), settings.parse_flag(L("Yes")), settings.choose_plan(L(False), L(True), L(False)), settings.substitute_engine(L("x"), "x", L("y"))) == (42, None, True, "clean", "y")
    for bad in (settings.parse_seed(L("-1")), settings.parse_flag(L("maybe")), settings.choose_plan(L(True), L(True), L(False)), settings.resolve_pinned(L("a"), L("b"))):
        with pytest.raises(Exception):
            one(spark, bad)
    assert one(spark, settings.desired(L(None), L("d"), L(None)), settings.needs_reload(L(None), L("a")), settings.wants_json(L(None).cast("string"), L("application/json"))) == ("d", True, True)
    assert one(spark, reports.admission(L(5), L(10), L(2), L(0)), reports.admission(L(9), L(10), L(2), L(3)), reports.admission(L(99), L(10), L(2), L(3)), reports.admission(L(9), L(None).cast("int"), L(2), L(0))) == ("admit", "evict", "refuse", "admit")
    assert one(spark, reports.idle_remaining(L(None).cast("long"), L(5), L(10)), reports.idle_remaining(L(0), L(15), L(10)), reports.memory_is_sufficient(L(5), L(None).cast("int")), reports.shortfall(L(5), L(9))) == (None, 0, True, 0)
    fields = one(spark, reports.wire_fields(add=F.array(L(1)), remove=F.array().cast("array<int>")))[0]
    assert fields == {"add": "[1]"} and one(spark, reports.output_name({"w": (L("96"), "96"), "s": (L("x"), "y")})) == ("s=x",)


def test_readers(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big"))
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc2\x00\x0b\x08\x00\x10\x00\x20" + b"\0" * 20)
    (tmp_path / "c.webp").write_bytes(b"junk")
    got = {r.path.rsplit("/", 1)[1]: (r.mime, r.width, r.height) for r in readers.image_pages(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("image/png", 7, 9), "b.jpg": ("image/jpeg", 32, 16), "c.webp": (None, None, None)}
    (tmp_path / "d.json").write_text('{"regions": [{"x": 1, "y": 2, "width": 3, "height": 4, "source": "s", "color": [1, 2, 3, 4]}]}')
    r = readers.region_files(spark, str(tmp_path / "d.json")).first()
    assert (r.idx, r.x, r.source, r.color, r.label) == (0, 1.0, "s", [1, 2, 3, 4], None)
    for i, (src, dst) in enumerate((("a ", "first"), ("a", "second"))):
        (tmp_path / f"dict{i}.json").write_text(f'{{"entries": [{{"source": "{src}", "target": "{dst}", "origin": "o"}}]}}')
    assert [tuple(x) for x in readers.dictionary_files(spark, [str(tmp_path / "dict0.json"), str(tmp_path / "dict1.json")]).collect()] == [("a", "first")]
    assert one(spark, readers.spot_boxes(F.lit("x ```[[1,2,3,4],[5,5,1,9]]```")), readers.spot_boxes(F.lit("none"))) == ([[1.0, 2.0, 3.0, 4.0]], [])
    with pytest.raises(Exception, match="bad rectangles"):
        one(spark, readers.caller_boxes(F.lit('[{"x":1,"y":1,"width":0,"height":1}]')))
    data = b"aaaaabcabcddd" * 40 + bytes(300)

    def unpack(p):
        out, i = b"", 0
        while i < len(p):
            n = p[i]
            out += p[i + 1 : i + 2 + n] if n < 128 else p[i + 1 : i + 2] * (257 - n)
            i += 2 + n if n < 128 else 2
        return out

    assert unpack(readers.pack_bits(data)) == data


def test_small_predicates(spark):
    L = F.lit
    assert one(spark, regions.illegible_read(L(0.3), L("free")), regions.illegible_read(L(0.3), L("dialogue")), regions.illegible_read(L(None).cast("double"), L("free")), regions.wire_confidence(L(1.5))) == (True, False, False, None)
    assert one(spark, regions.spot_refuses(L("漢字"), L("ja"), L("free"), L(0.1)), regions.spot_refuses(L("漢字"), L("ja"), L("free"), L(0.9)), regions.is_synthesised(F.array(L("a"), L("synthesised")))) == (True, False, True)
    tx = spark.createDataFrame([("r1", "c1", "l1", "b1"), ("r2", "c2", "l2", None)], "region string, content string, layer string, bubble string")
    assert sorted((r.kind, r.source, r.target) for r in regions.dialogue_relations(tx).collect())[:3] == [("FitsTo", "l1", "b1"), ("FitsTo", "l2", "r2"), ("Inside", "r1", "b1")]
    assert one(spark, regions.reply_report(L('{"missed": 2, "cut": true}')))[0].missed == 2
    place = '[{"x":1,"y":1,"width":5,"height":5,"place_x":0,"place_y":0,"place_width":%d,"place_height":30}]'
    assert one(spark, readers.caller_placements(L(place % 30)))[0][0].place_width == 30 and one(spark, readers.caller_placements(L(place % 3))) == (None,)
    df = boxes_df(spark, [(1, 1, "text", 0.5, 0, 0, 1, 1)]).withColumn("rank", F.lit(0))
    assert sorted(r.kind for r in regions.component_rows(df, "det", "m").collect()) == ["geometry", "label", "order"]
    seg = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "page long, id long, source string").withColumn("context", F.array(F.lit("x")))
    assert regions.prompts(seg).first().body == '{"segments":[{"id":0,"text":"a"},{"id":1,"text":"b"}],"context":["x"]}'


def test_closure_of_a_long_chain(spark):
    """Entities more than 64 relations away from the seed are reached."""
    rel = spark.createDataFrame([(i, i + 1) for i in range(67)], "source long, target long").coalesce(1)
    seeds = spark.createDataFrame([(0,)], "id long").coalesce(1)
    assert {r.id for r in store.closure(rel, seeds).collect()} == set(range(68))


def test_undo_restores_places_and_components(spark):
    log = spark.createDataFrame(
        [(1, 0, "insert", "a", "p1", None, 1, None, None, None, "user", None, None, None), (1, 1, "set", "a", None, None, None, "k", None, "v", "user", None, None, None)],
        "revision long, seq int, op string, id string, page string, parent string, position int, kind string, before string, after string, origin string, before_page string, before_parent string, before_position int",
    )
    moved = log.unionByName(store.move_ops(store.fold_entities(log), spark.createDataFrame([("a", "p2", "g", 5)], "id string, page string, parent string, position int"), 2))
    assert [tuple(r) for r in store.fold_entities(moved).collect()] == [("a", "p2", "g", 5)]
    back = moved.unionByName(store.undo(moved, [2], 2))
    assert [tuple(r) for r in store.fold_entities(back).collect()] == [("a", "p1", None, 1)]
    gone = moved.unionByName(store.delete_ops(store.fold_entities(moved), store.fold_components(moved), spark.createDataFrame([("a",)], "id string"), 3))
    assert not store.fold_entities(gone).count() and not store.fold_components(gone).count()
    again = gone.unionByName(store.undo(gone, [3], 3))
    assert [tuple(r) for r in store.fold_entities(again).collect()] == [("a", "p2", "g", 5)]
    assert [(r.id, r.kind, r.value) for r in store.fold_components(again).collect()] == [("a", "k", "v")]


def test_refusal_counts_once(spark):
    """The refusal's plan holds few patterns, however many cases name the counts."""
    from pyspark.sql import functions as F

    from lamella.functions import text as t
    from lamella.plans import samples

    why = t.refusal(F.col("text"), F.col("script"), samples.MARKS, samples.PHRASES, samples.STOP_WORDS, samples.PREFIXES)
    plan = samples.reads(spark).select(why.alias("why"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 12 and plan.count("regexp_count") <= 4


def test_rest_works_without_llm(tmp_path):
    """A copy without the llm folders imports, has the other queries and runs one."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("lamella", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{root}/{name}"):
            (shutil.copytree if os.path.isdir(f"{root}/{name}") else shutil.copy)(f"{root}/{name}", tmp_path / name)
    for name in ("lamella/llm", "tests/llm"):
        shutil.rmtree(tmp_path / name, ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert len(q) > 70 and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q), len(q); assert set(s) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-800:]


def test_images_with_long_headers(tmp_path, spark):
    """A JPEG whose metadata blocks are longer than 64 KB still has a size."""
    import struct

    from lamella.sources import readers

    block = b"\xff\xe1" + struct.pack(">H", 60_002) + b"x" * 60_000
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8" + block * 3 + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 40, 30, 1) + b"\x01\x11\x00" + b"\xff\xd9")
    (tmp_path / "b.png").write_bytes(b"no image")
    rows = readers.page_order(readers.image_pages(spark, str(tmp_path))).orderBy("page").collect()
    assert [(r.mime, r.width, r.height, r.page) for r in rows] == [("image/jpeg", 30, 40, 0), (None, None, None, 1)]


def test_grid_cells_lose_no_pair(spark):
    """Pairs through grid cells are those of all boxes of a page: over cell borders, empty, turned inside out, below zero."""
    rng = random.Random(5)
    made = [(rng.randint(-1500, 3000), rng.randint(-1500, 3000), rng.choice([0, -30, 5, 200, 1024, 2500]), rng.choice([0, 5, 300, 1100])) for _ in range(120)]
    made += [(1000, 1000, 24, 24), (1024, 1024, 10, 10), (1040, 1000, 5, 5), (1041, 1000, 5, 5)]
    rows = [(1 + i % 2, i, *b) for i, b in enumerate(made)]
    df = spark.createDataFrame(rows, "page long, id long, x long, y long, w long, h long").select("page", "id", g.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box"))
    other = df.select("page", F.col("id").alias("other_id"), F.col("box").alias("other"))
    meet = lambda a, b: a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5]
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and meet(a, b))
    got = spatial.gridded(df, other, F.col("id") < F.col("other_id")).select("id", "other_id").collect()
    assert sorted((r.id, r.other_id) for r in got) == want and want

    gap = lambda p, q, s, t: max(s - q, p - t, 0)
    near = lambda a, b: gap(a[2], a[2] + a[4], b[2], b[2] + b[4]) <= 16 and gap(a[3], a[3] + a[5], b[3], b[3] + b[5]) <= 16
    plates = {r[1] for r in rows if r[1] % 10 == 0 or r[1] == 120}
    live = df.withColumn("refused", F.when(F.col("id").isin(*plates), "watermark"))
    out = regions.stamp_occlusion(live, df.select("page", "box").limit(0)).where("occluded_by = 'watermark'").collect()
    assert {r.id for r in out} == {a[1] for a in rows if a[1] not in plates and any(b[1] in plates and a[0] == b[0] and near(a, b) for b in rows)}


def test_trees_of_over_a_million_rows(spark):
    """Recursive SQL stops at a million rows; walks by level don't."""
    n = 1_100_000
    kids = spark.range(1, n + 1).select(F.col("id").cast("string").alias("id"), F.lit("0").alias("parent"), F.col("id").alias("position"))
    tree = spark.createDataFrame([("0", None, 0)], "id string, parent string, position long").union(kids)
    root = tree.where("parent IS NULL").select("id")
    assert store.subtree(tree, root).count() == n + 1
    order = store.visual_order(tree.withColumn("opacity", F.lit(0.5)).withColumn("visible", F.col("position") % 2 == 0), root)
    assert order.agg(F.count("*"), F.sum("opacity")).first()[:] == (n // 2 + 1, 0.5 + 0.25 * (n // 2))
    moves = tree.select("id", F.lit("p").alias("page"), F.when(F.col("position") == 0, "7").when(F.col("position") == 8, "8").when(F.col("position") == 9, "x").otherwise("5").alias("parent"), "position").where("id <> '5'")
    found = store.place_violations(tree, root, moves)
    assert sorted(found.collect()) == [("0", "page below the root"), ("0", "parent in the own subtree"), ("8", "parent in the own subtree"), ("9", "unknown parent")]


def test_trees_too_deep_are_an_error(spark):
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None, i) for i in range(5)], "id string, parent string, position long")
    root = chain.where("parent IS NULL").select("id")
    rows = store.subtree(chain, root, 4).orderBy("depth").collect()
    assert [r.depth for r in rows] == [0, 1, 2, 3, 4] and rows[-1].path == "/".join(str(i).rjust(10, "0") for i in range(5))
    with pytest.raises(ValueError):
        store.subtree(chain, root, 3)
    assert sorted(store.ancestors(chain, spark.createDataFrame([("2",), ("9",)], "id string")).collect()) == [("2", "0"), ("2", "1"), ("2", "2")]
