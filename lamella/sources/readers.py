"""Scans: region JSON, tolerant reply JSON, corpora, dictionaries, glossary text, image headers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.text import once

REGION = (
    "x double, y double, width double, height double, source string, translated string, fit_x double, fit_y double, fit_width double, fit_height double, "
    "source_language string, target_language string, detection_confidence float, ocr_confidence float, direction string, writing_mode string, "
    "region_kind string, label string, role string, font_size float, color array<smallint>, stroke_color array<smallint>, stroke_width float, "
    "font_weight int, refused string, occluded_by string"
)
REPLY = "translations array<struct<id: string, text: string>>"
TOLERANT = {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "allowComments": "true", "mode": "PERMISSIVE"}
MAX_ROOTS = 64


def region_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a region of recorded bodies (top-level key regions), with file and index."""
    raw = spark.read.schema(f"regions array<struct<{_struct(REGION)}>>").option("multiLine", True).json(path)
    return raw.select(F.input_file_name().alias("file"), F.posexplode("regions").alias("idx", "r")).select("file", "idx", "r.*")


def _struct(fields: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.strip().split(" ", 1) for f in fields.split(", ")))


def corpus_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row a page of a frozen corpus: key, language, engine, file, error."""
    schema = "sources array<struct<key: string, language: string, engine: string, pages: array<struct<file: string, error: string>>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.explode("sources").alias("s")).select("s.key", "s.language", "s.engine", F.posexplode("s.pages").alias("page", "p")).select("key", "language", "engine", "page", "p.*")


def json_roots(text: Column) -> Column:
    """The text from each of the first MAX_ROOTS places where an object or list opens, with typographic quotes made plain; what trails is cut by the parser."""
    plain = F.translate(F.coalesce(text, F.lit("")), "“”„‟‘’‚", "\"\"\"\"\'\'\'")
    body = F.regexp_replace(plain, r"(?s)^.*?```(?:json)?\s*|\s*```.*$", "")
    fenced = F.when(plain.rlike(r"(?s)```.*```"), body).otherwise(plain)

    def from_each(parts: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(MAX_ROOTS + 1))), lambda i: F.element_at(parts, i).rlike(r"^[\[{]"))
        return F.transform(F.slice(starts, 1, MAX_ROOTS), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ""))

    return once(F.split(fenced, r"(?=[\[{])"), from_each)


def reply_records(replies: DataFrame, text: str = "reply") -> DataFrame:
    """One row a reply record (…, pos, id, text) from model output, read from the first root that holds records; unreadable output gives none."""
    tried = F.transform(json_roots(F.col(text)), lambda root: F.from_json(root, REPLY, TOLERANT)["translations"])
    parsed = F.try_element_at(F.filter(tried, lambda x: x.isNotNull()), F.lit(1))
    keep = [c for c in replies.columns if c != text]
    out = replies.select(*keep, F.posexplode(parsed).alias("pos", "r"))
    return out.select(*keep, "pos", F.col("r.id").try_cast("bigint").alias("id"), F.translate(F.col("r.text"), "\x00", "").alias("text"))


def spot_boxes(text: Column) -> Column:
    """Boxes [x0, y0, x1, y1] of a fenced or bare JSON array; an empty list where nothing can be read."""
    found = F.from_json(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\[\s*\[.*\]\s*\])", 1), "array<array<double>>")
    return F.filter(F.coalesce(found, F.array().cast("array<array<double>>")), lambda b: (F.size(b) == 4) & (b[2] > b[0]) & (b[3] > b[1]))


def caller_boxes(value: Column, most: int = 32) -> Column:
    """Caller's rectangles from JSON; an error at run time for bad JSON, too many, or non-positive ones."""
    boxes = F.from_json(value, "array<struct<x: double, y: double, width: double, height: double>>")
    bad = boxes.isNull() | (F.size(boxes) > most) | F.exists(boxes, lambda b: ~F.coalesce((b["width"] > 0) & (b["height"] > 0) & b["x"].isNotNull() & b["y"].isNotNull(), F.lit(False)))
    return F.when(value.isNull() | (value == ""), F.array().cast("array<struct<x: double, y: double, width: double, height: double>>")).when(
        bad, F.raise_error(F.lit("bad rectangles")).cast("array<struct<x: double, y: double, width: double, height: double>>")
    ).otherwise(boxes)


def translation_pins(value: Column, most: int = 128, most_chars: int = 512) -> Column:
    """Pins {s, t} from JSON; null for bad, too many, blank or long ones."""
    pins = F.from_json(value, "array<struct<s: string, t: string>>")
    ok = lambda c: F.coalesce((F.trim(c) != "") & (F.length(c) <= most_chars), F.lit(False))
    return F.when((F.size(pins) <= most) & F.forall(pins, lambda p: ok(p["s"]) & ok(p["t"])), pins)


def strict_terms(value: Column, most: int = 64, most_bytes: int = 256) -> Column:
    """Terms {source, translation} from JSON, rejected as a whole (null) over 64 terms or 256 bytes."""
    terms = F.from_json(value, "array<struct<source: string, translation: string>>")
    ok = lambda c: F.coalesce(F.octet_length(c) <= most_bytes, F.lit(False))
    return F.when((F.size(terms) <= most) & F.forall(terms, lambda p: ok(p["source"]) & ok(p["translation"])), terms)


def glossary_lines(texts: DataFrame, key: str = "key", text: str = "text", most_bytes: int = 256) -> DataFrame:
    """Lines 'source = translation' of glossary texts: line number, source, translation and error.

    Blank lines and # comments go. The first '=' splits. Errors: no '=', an
    empty side, too many bytes, a source that an earlier good line has.
    """
    from pyspark.sql import Window

    lines = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("pos", "raw"))
    trimmed = F.regexp_replace("raw", r"^\s+|\s+$", "")
    lines = lines.select(key, (F.col("pos") + 1).alias("line"), trimmed.alias("t")).where("t <> '' AND NOT startswith(t, '#')")
    at = F.instr("t", "=")
    side = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    source = F.when(at > 0, side(F.expr("substring(t, 1, instr(t, '=') - 1)")))
    translation = F.when(at > 0, side(F.expr("substring(t, instr(t, '=') + 1)")))
    rows = lines.select(key, "line", at.alias("at"), source.alias("source"), translation.alias("translation"))
    why = F.when(F.col("at") == 0, "no =").when(F.col("source") == "", "empty source").when(F.col("translation") == "", "empty translation").when(
        (F.octet_length("source") > most_bytes) | (F.octet_length("translation") > most_bytes), "too long"
    )
    rows = rows.withColumn("error", why)
    good = Window.partitionBy(key, "source", F.col("error").isNull()).orderBy("line")
    again = F.col("error").isNull() & (F.row_number().over(good) > 1)
    return rows.withColumn("error", F.when(again, "duplicate source").otherwise(F.col("error"))).drop("at")


def glossary_text(terms: Column) -> Column:
    return F.array_join(F.transform(terms, lambda x: F.concat(x["source"], F.lit(" = "), x["translation"])), "\n")


def dictionary_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Entries of dictionary files in the order given, merged so that earlier files win."""
    from lamella.operators.regions import merge_dictionaries

    schema = "entries array<struct<source: string, target: string, origin: string>>"
    parts = [spark.read.schema(schema).option("multiLine", True).json(p).select(F.lit(i).alias("file_ordinal"), F.posexplode("entries").alias("pos", "e")) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return merge_dictionaries(out.select("file_ordinal", "pos", "e.source", "e.target"))


def image_size(data: bytes) -> tuple[str | None, int | None, int | None]:
    """Format, width and height from the header of a PNG, JPEG, GIF or WebP file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return ("png", *struct.unpack(">II", data[16:24]))
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return ("gif", *struct.unpack("<HH", data[6:10]))
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return "webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", data[26:30])
            return "webp", w & 0x3FFF, h & 0x3FFF
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            kind = data[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", w, h
            at += 2 if kind == 0xFF or 0xD0 <= kind <= 0xD9 or kind == 1 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None, None, None


def image_pages(spark: SparkSession, path: str, glob: str = "*.{png,jpg,jpeg,webp}") -> DataFrame:
    """Pages of image files: path, mime, width, height, blob_id (content hash) and size; files that are no image have null mime."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)

    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [image_size(b) for b in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "blob_id": pdf["blob_id"], "size": pdf["size"], "mime": [f and "image/" + f for f, _, _ in found],
                                "width": pd.array([w for _, w, _ in found], "Int32"), "height": pd.array([h for _, _, h in found], "Int32")})

    source = files.select("path", F.sha2("content", 256).alias("blob_id"), F.col("length").alias("size"), "content")
    return source.mapInPandas(heads, "path string, blob_id string, size long, mime string, width int, height int")


def page_order(pages: DataFrame) -> DataFrame:
    """Pages numbered by path: within each folder, shifted by the pages of the folders before, one row each."""
    from pyspark.sql import Window

    foldered = pages.withColumn("__folder", F.regexp_replace("path", "[^/]*$", "")).withColumn("__name", F.regexp_extract("path", "[^/]*$", 0))
    before = Window.orderBy("__folder").rowsBetween(Window.unboundedPreceding, -1)
    shifts = foldered.groupBy("__folder").agg(F.count("*").alias("__n")).select("__folder", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    ranked = foldered.withColumn("__rank", F.row_number().over(Window.partitionBy("__folder").orderBy("__name")) - 1)
    return ranked.join(shifts, "__folder").withColumn("page", F.col("__rank") + F.col("__shift")).select(*pages.columns, "page")


def pack_bits(data: bytes) -> bytes:
    """Run-length code of a row: runs of 3 to 128 equal bytes, literals of up to 128."""
    out, literal, i = bytearray(), bytearray(), 0

    def flush():
        while literal:
            part = literal[:128]
            out.append(len(part) - 1)
            out.extend(part)
            del literal[:128]

    while i < len(data):
        n = 1
        while n < 128 and i + n < len(data) and data[i + n] == data[i]:
            n += 1
        if n >= 3:
            flush()
            out += bytes([257 - n, data[i]])
        else:
            literal += data[i : i + n]
        i += n
    flush()
    return bytes(out)


def packed_rows(rows: DataFrame, data: str = "data") -> DataFrame:
    """Rows with the run-length code of a binary column."""

    @F.pandas_udf("binary")
    def code(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else pack_bits(bytes(b)))

    return rows.withColumn("packed", code(F.col(data)))


def request_forms(images: DataFrame, params: DataFrame, max_bytes: int) -> DataFrame:
    """Images (path, size, …) with their request fields (path, name, value) as a map; those over the cap are left out."""
    fields = params.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("fields"))
    return images.where(F.col("size") <= max_bytes).join(fields, "path", "left").withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string, string>")))


def caller_placements(value: Column, most: int = 32, least_place: float = 24) -> Column:
    """Caller's placements {x, y, width, height, place_*} from JSON; null if bad, too many or placed too small."""
    names = ("x", "y", "width", "height", "place_x", "place_y", "place_width", "place_height")
    rows = F.from_json(value, "array<struct<" + ", ".join(f"{n}: double" for n in names) + ">>")
    whole = lambda p: F.coalesce((p["width"] > 0) & (p["height"] > 0) & (p["place_width"] >= least_place) & (p["place_height"] >= least_place) & p["x"].isNotNull() & p["y"].isNotNull() & p["place_x"].isNotNull() & p["place_y"].isNotNull(), F.lit(False))
    return F.when((F.size(rows) <= most) & F.forall(rows, whole), rows)
