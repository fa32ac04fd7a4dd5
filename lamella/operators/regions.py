"""Region plane: the wide projection, stamps, index lists and equi joins over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions import geometry as g
from lamella.functions import text as t
from lamella.operators.spatial import gridded

EFFECT = "onomatopoeia"


def region_rows(layers: DataFrame, **parts: DataFrame) -> DataFrame:
    """Star of left joins: layers (page, layer, content, region) with one row at most a key in each part.

    Each part is keyed by ``entity`` and joined to the layer's content, or to
    its region for parts named region_*; layers without a box drop out.
    """
    out = layers
    for name, part in parts.items():
        key = "region" if name.startswith("region_") else "content"
        out = out.join(part.withColumnRenamed("entity", f"__{name}"), F.col(key) == F.col(f"__{name}"), "left").drop(f"__{name}")
    return out.where("x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL")


def short_role(role: Column) -> Column:
    """Last dotted part."""
    return F.substring_index(role, ".", -1)


def ordinals(rows: DataFrame, by: list[str], order: list, name: str = "idx") -> DataFrame:
    """Rows numbered from 0 within ``by``."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def skipped(regions: DataFrame, label: str = EFFECT, kind: str = "text") -> DataFrame:
    """Effects that are no text regions."""
    return regions.where((F.col("label") == label) & ~F.coalesce(F.col("region_kind") == kind, F.lit(False))).select("page", "label", "x", "y", "width", "height")


def untranslated(regions: DataFrame, missed: DataFrame) -> DataFrame:
    """Regions whose content is on the miss list (page, content)."""
    return regions.join(missed.select("page", "content").distinct(), ["page", "content"], "left_semi")


def is_dropped(source: Column, translated: Column, refused: Column) -> Column:
    return ~t.is_blank(source) & t.is_blank(translated) & refused.isNull()


def is_split_fragment(translated: Column, refused: Column) -> Column:
    return t.is_cut(translated) & refused.isNull()


def feeds_story(refused: Column, label: Column, excludes_effects: bool = False) -> Column:
    out = refused.isNull()
    return out & ~F.coalesce(label == EFFECT, F.lit(False)) if excludes_effects else out


def index_lists(regions: DataFrame) -> DataFrame:
    """Per page: sorted indices that were dropped, and that look cut."""
    dropped = F.when(is_dropped(F.col("source"), F.col("translated"), F.col("refused")), F.col("idx"))
    split = F.when(is_split_fragment(F.col("translated"), F.col("refused")), F.col("idx"))
    return regions.groupBy("page").agg(F.sort_array(F.collect_list(dropped)).alias("dropped"), F.sort_array(F.collect_list(split)).alias("split_fragments"))


def stamp_refusals(regions: DataFrame, refusals: DataFrame) -> DataFrame:
    """Refusals (page, content, ordinal, refused) overwrite what they match; of several the last one holds."""
    last = refusals.groupBy("page", "content").agg(F.max_by("refused", "ordinal").alias("__new"))
    return regions.join(last, ["page", "content"], "left").withColumn("refused", F.coalesce("__new", "refused")).drop("__new")


def stamp_occlusion(regions: DataFrame, hints: DataFrame, reach: float = 16) -> DataFrame:
    """Unrefused regions near a watermark's box, else near an unread hint that isn't their own ink.

    regions: page, id, box, refused; hints: page, box. Joined through grid
    cells of widened hints, with the distance as residual; each region keeps
    one row.
    """
    own, other, out = F.col("box"), F.col("__box"), reach + 1
    near = g.within_band(own, other, reach)
    plates = regions.where("refused = 'watermark'").select("page", F.col("box").alias("__box"), F.lit(0).alias("__rank"))
    unread = hints.select("page", F.col("box").alias("__box"), F.lit(1).alias("__rank"))
    live = regions.where("refused IS NULL")
    wide = g.box(other["x"] - out, other["y"] - out, other["width"] + 2 * out, other["height"] + 2 * out)
    marks = plates.union(unread).withColumn("__wide", wide)
    ranked = gridded(live, marks, near & ((F.col("__rank") == 0) | ~g.mostly_same_ink(own, other)), right_box="__wide")
    best = ranked.groupBy("page", "id").agg(F.min("__rank").alias("__rank"))
    why = F.when(F.col("__rank") == 0, "watermark").when(F.col("__rank") == 1, "unread-box")
    return regions.join(best, ["page", "id"], "left").withColumn("occluded_by", why).drop("__rank")


def layer_index(regions: DataFrame) -> DataFrame:
    """layer -> ordinal, the last one if a layer repeats."""
    return regions.groupBy("page", "layer").agg(F.max("idx").alias("region"))


def attribute_to_regions(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Warnings or rendered text (page, layer, ...) with the index of their region, null without one."""
    return rows.join(layer_index(regions), ["page", "layer"], "left")


def apply_pins(regions: DataFrame, pins: DataFrame) -> DataFrame:
    """Translations of pins (page, ordinal, source, translation) whose source is equal byte by byte; the first pin wins."""
    first = pins.groupBy("page", "source").agg(F.min_by("translation", "ordinal").alias("__pin"))
    return regions.join(first, ["page", "source"], "left").withColumn("pinned", F.col("__pin").isNotNull()).withColumn(
        "translated", F.coalesce("__pin", "translated")
    ).drop("__pin")


def pin_effects(regions: DataFrame, dictionary: DataFrame, label: str = EFFECT) -> DataFrame:
    """Dictionary targets for effects, by the trimmed source, else without its closing marks."""
    exact = F.when(F.col("label") == label, t.strip_space(F.col("source")))
    bare = F.regexp_replace(exact, r"[^\p{L}\p{N}]+$", "")
    d1 = dictionary.select(F.col("source").alias("__s1"), F.col("target").alias("__t1"))
    d2 = dictionary.select(F.col("source").alias("__s2"), F.col("target").alias("__t2"))
    out = regions.join(d1, exact == F.col("__s1"), "left").join(d2, bare == F.col("__s2"), "left")
    return out.withColumn("translated", F.coalesce("__t1", "__t2", "translated")).drop("__s1", "__s2", "__t1", "__t2")


def merge_dictionaries(entries: DataFrame) -> DataFrame:
    """(file_ordinal, pos, source, target): the earlier file, then the earlier entry, wins on a trimmed source."""
    keyed = entries.withColumn("source", t.strip_space(F.col("source"))).where("source <> ''")
    return keyed.groupBy("source").agg(F.min_by("target", F.struct("file_ordinal", "pos")).alias("target"))


def unread(layers: DataFrame, sources: DataFrame, translations: DataFrame) -> DataFrame:
    """Layers with neither source nor translation."""
    return layers.join(sources.select("content").distinct(), "content", "left_anti").join(translations.select("content").distinct(), "content", "left_anti")


def hide_implausible(
    regions: DataFrame, script: Column, marks=(), phrases=(), stop_words=(), engine_prefixes=(), connectives=(), scoped: bool = True
) -> DataFrame:
    """Refusals of reads. Dialogue keeps its read unless it is nothing but prolongation marks."""
    why = F.coalesce(t.effect_refusal(F.col("source"), F.col("label"), connectives), t.refusal(F.col("source"), script, marks, phrases, stop_words, engine_prefixes, scoped))
    spared = F.coalesce(F.col("role") == "dialogue", F.lit(False)) & ~F.coalesce(why.isin("prolongation_only", "empty"), F.lit(False))
    return regions.withColumn("refused", F.coalesce("refused", F.when(~spared, why)))


def translate_terms(regions: DataFrame) -> DataFrame:
    """Unrefused regions with a translation and a source in the form of a term."""
    from lamella.functions.keys import ledger_term

    term = ledger_term(F.col("source"))
    return regions.where(F.col("refused").isNull() & ~t.is_blank(F.col("translated")) & (term != "")).withColumn("term", term)


def translate_pins(regions: DataFrame) -> DataFrame:
    kept = regions.where(F.col("refused").isNull() & ~t.is_blank(F.col("source")) & ~t.is_blank(F.col("translated")))
    return kept.select("page", F.col("source").alias("s"), F.col("translated").alias("t"))


def translation_targets(segments: DataFrame, unlettered: Column, in_scope: Column | None = None) -> DataFrame:
    """Segments with a source and in scope; furniture goes unless a page had nothing else."""
    base = segments.where(~t.is_blank(F.col("source")) & (F.lit(True) if in_scope is None else in_scope))
    any_real = F.max(~unlettered).over(Window.partitionBy("page"))
    return base.withColumn("__real", any_real).where(~unlettered | ~F.col("__real")).drop("__real")


def contains_entity(entities: DataFrame, page, ids: DataFrame | None = None, region: Column | None = None) -> DataFrame:
    """On the page, then in the id set, else meeting the rectangle."""
    out = entities.where(F.col("page") == page)
    if ids is not None:
        return out.join(ids.select("entity"), "entity", "left_semi")
    return out if region is None else out.where(F.coalesce(g.overlaps(F.col("box"), region), F.lit(False)))


def probe_sample(segments: DataFrame, want: int) -> DataFrame:
    """``want`` healthy segments of a page, evenly spaced: item n is healthy[n * count / take]."""
    source, translated = t.strip_space(F.col("source")), t.strip_space(F.col("translated"))
    healthy = segments.where((translated != "") & ~t.is_cut(F.col("translated")) & (translated != source) & (F.length(source) >= 4))
    w = Window.partitionBy("page")
    numbered = healthy.withColumn("__at", F.row_number().over(w.orderBy("pos")) - 1).withColumn("__n", F.count("*").over(w))
    take = F.least(F.lit(want), F.col("__n"))
    first = F.ceil(F.col("__at") * take / F.col("__n"))
    return numbered.where((first < take) & (F.floor(first * F.col("__n") / take) == F.col("__at"))).drop("__at", "__n")


def edge_hints(detections: DataFrame, floor: float, height: Column) -> DataFrame:
    """Text boxes under the score floor that reach one page edge."""
    return detections.where((F.col("label") == "text") & (F.col("score") < floor)).withColumn("edge", g.edge_touched(F.col("box"), height)).where("edge IS NOT NULL")


def unanimous(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The one value all rows of a group agree on, else null; nulls disagree with nothing."""
    return rows.groupBy(by).agg(F.when(F.count_distinct(value) == 1, F.first(value, ignorenulls=True)).alias(value))


def box_eligible(width: Column, height: Column, least: int = 300) -> Column:
    return (width >= least) & (height >= least)


def rejection(width: Column, height: Column, loaded: Column, least: int = 300) -> Column:
    return F.when(~loaded, "not-loaded").when(width.isNull() | height.isNull() | (width <= 0) | (height <= 0), "no-size").when(~box_eligible(width, height, least), "too-small")


def letters_text(label: Column, translate_effects: bool = False) -> Column:
    """Labels that get lettered."""
    return label.isin("text", EFFECT) if translate_effects else label == "text"


def illegible_read(confidence: Column, role: Column, least: float = 0.55) -> Column:
    """A free-standing read of low confidence; an unknown confidence refuses nothing."""
    return F.coalesce((confidence < least) & ~F.coalesce(role == "dialogue", F.lit(False)), F.lit(False))


def wire_confidence(confidence: Column) -> Column:
    """Null outside 0 to 1."""
    return F.when(confidence.between(0, 1), confidence)


def spot_refuses(text: Column, script: Column, role: Column, best_coverage: Column, least: float = 0.2) -> Column:
    """A free-standing suspect read that no spotted box covers."""
    return ~F.coalesce(role == "dialogue", F.lit(False)) & t.spot_candidate(text, script) & (F.coalesce(best_coverage, F.lit(0.0)) < least)


def is_synthesised(labels: Column, kind: str = "synthesised") -> Column:
    """Any label of the kind."""
    return F.coalesce(F.exists(labels, lambda x: x == kind), F.lit(False))


def dialogue_relations(texts: DataFrame) -> DataFrame:
    """Edges (kind, source, target) of texts (region, content, layer, bubble): what the text is read from, fits to and lies in."""
    edge = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("source"), F.col(b).alias("target"))
    edges = F.array(edge("Presents", "layer", "content"), edge("RecognizedFrom", "content", "region"), F.struct(F.lit("FitsTo").alias("kind"), F.col("layer").alias("source"), F.coalesce("bubble", "region").alias("target")), edge("Inside", "region", "bubble"))
    return texts.select(F.explode(edges).alias("e")).select("e.*").where("target IS NOT NULL")


def mask_sources(detections: DataFrame, refused: DataFrame, translate_effects: bool = False) -> DataFrame:
    """Detections whose pixels are erased: lettered labels that aren't refused (page, id)."""
    return detections.where(letters_text(F.col("label"), translate_effects)).join(refused.select("page", "id"), ["page", "id"], "left_anti")


def component_rows(detections: DataFrame, producer: str, model: str) -> DataFrame:
    """Components (page, entity, kind, value, origin) of ordered detections (page, id, label, score, box, rank)."""
    origin = F.struct(F.lit("generated").alias("by"), F.lit(producer).alias("producer"), F.lit(model).alias("model"), F.col("score").cast("double").alias("confidence"))
    value = lambda kind, v: F.struct(F.lit(kind).alias("kind"), F.to_json(v).alias("value"))
    parts = F.array(value("geometry", F.struct("box.*")), value("label", F.struct("label", "score")), value("order", F.struct("rank")))
    return detections.select("page", F.col("id").alias("entity"), F.explode(parts).alias("c"), origin.alias("origin")).select("page", "entity", "c.kind", "c.value", "origin")


def reply_report(payload: Column) -> Column:
    """Counters of a response body, zero or false where absent."""
    schema = "missed int, dropped int, cut boolean, duplicate_ids int, out_of_range_ids int, cut_found int, still_cut int, ms long"
    p = F.from_json(payload, schema)
    zero = lambda c: F.coalesce(p[c], F.lit(0)).alias(c)
    return F.struct(*[zero(c) for c in ("missed", "dropped", "duplicate_ids", "out_of_range_ids", "cut_found", "still_cut", "ms")], F.coalesce(p["cut"], F.lit(False)).alias("cut"))


def prompts(segments: DataFrame, context: str = "context") -> DataFrame:
    """One request body a page: segments with their ids in order, and context pairs."""
    seg = F.array_sort(F.collect_list(F.struct(F.col("id"), F.col("source").alias("text"))))
    return segments.groupBy("page").agg(F.to_json(F.struct(seg.alias("segments"), F.first(context).alias("context"))).alias("body"))
