"""Text plane: script counts, furniture, refusals and read clean-up as Column expressions.

All functions take and return Columns and stay inside whole-stage codegen.
Word lists are parameters: the caller brings the marks, phrases and stop words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code-point classes, in natural order.
SYMBOLS = (
    r"\x{00B7}\x{2000}-\x{206F}\x{2190}-\x{21FF}\x{2200}-\x{22FF}\x{2500}-\x{257F}\x{25A0}-\x{25FF}\x{2600}-\x{27BF}\x{3000}-\x{303F}"
    r"\x{309B}\x{309C}\x{30FB}\x{FE30}-\x{FE4F}\x{FF01}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}"
)
ASCII_MARKS = r"!-/:-@\[-`{-~0-9"
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
KANA = r"\x{3040}-\x{30FF}\x{FF66}-\x{FF9F}"
HANGUL = r"\x{1100}-\x{11FF}\x{AC00}-\x{D7AF}"
PROLONGATION = r"\x{30FC}\x{FF70}"

#: The symbols, marks and white space below U+1100 one by one, which a pattern looks up in a bitmap.
_NARROW = "".join(rf"\x{c:02x}" for c in (*range(0x09, 0x0E), *range(0x20, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F), 0xB7))

FOREIGN_SHARE = 0.34
STRICT_HANGUL_MIN = 3
DESCRIPTION_WORDS = 4
REFUSALS = (
    "empty", "watermark", "punctuation_only", "prolongation_only", "junk", "image_description", "script_mismatch",
    "drawn_connective", "duplicate_lettering", "unread",
)
CJK = ("ja", "ko", "zh")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often ``use`` names it: Catalyst does not copy it into a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


# ---------------------------------------------------------------- white space and letters


def squeeze(text: Column) -> Column:
    """White-space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip_space(text) == "", F.lit(True))


def words(text: Column) -> Column:
    """Words between white space; none for a blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def alnum_count(text: Column) -> Column:
    """Letters and numbers."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def alnum_skeleton(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def without_nul(text: Column) -> Column:
    return F.translate(text, "\x00", "")


def first_lower(character: Column) -> Column:
    """First character of the lower-case mapping."""
    return F.substring(F.lower(character), 1, 1)


def fold_fullwidth(text: Column) -> Column:
    """Full-width ASCII forms to ASCII."""
    return F.translate(text, "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)))


def widen_halfwidth(text: Column) -> Column:
    """ASCII forms to full width; half-width kana to full, voiced pairs joined."""
    plain = "ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝ"
    full = "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"
    out = text
    for base, mark, shift in [("ｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾊﾋﾌﾍﾎ", "ﾞ", 1), ("ﾊﾋﾌﾍﾎ", "ﾟ", 2)]:
        for c in base:
            out = F.regexp_replace(out, c + mark, chr(ord(full[plain.index(c)]) + shift))
    out = F.translate(out, plain, full)
    return F.translate(out, "".join(chr(c) for c in range(0x21, 0x7F)), "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)))


def is_prolongation(character: Column) -> Column:
    return character.rlike(f"^[{PROLONGATION}]$")


def is_symbol_or_punctuation(character: Column) -> Column:
    return character.rlike(f"^[{SYMBOLS}]$")


# ---------------------------------------------------------------- scripts


def script_counts(text: Column) -> Column:
    """Letters by script. Symbols go first: the katakana middle dot stands inside the kana block.

    Texts without a character from U+1100 on, where the three scripts begin, are counted by two short patterns.
    """
    known = HAN + KANA + HANGUL
    names = ("han", "kana", "hangul", "latin", "other", "prolongation")
    row = lambda *values: F.struct(*[v.cast("int").alias(n) for v, n in zip(values, names)])
    zero = F.lit(0)

    def wide(t: Column) -> Column:
        count = lambda c: F.regexp_count(t, F.lit(f"[{c}]"))
        latin, rest = F.length(F.regexp_replace(t, rf"[{known}\P{{L}}]+", "")), F.length(F.regexp_replace(t, f"[{known}]+", ""))
        return row(count(HAN), count(KANA), count(HANGUL), latin, rest - latin, count(PROLONGATION))

    def narrow(t: Column) -> Column:
        left = F.length(F.regexp_replace(t, f"[{_NARROW}]+", ""))
        return once(F.length(F.regexp_replace(t, r"\P{L}+", "")), lambda latin: row(zero, zero, zero, latin, left - latin, zero))

    def counts(t: Column) -> Column:
        bare = F.regexp_replace(t, rf"[{SYMBOLS}{ASCII_MARKS}\s]+", "")
        return F.when(t.rlike(r"[\x{1100}-\x{10FFFF}]"), once(bare, wide)).otherwise(narrow(t))

    return once(F.coalesce(text, F.lit("")), counts)


def letters(counts: Column) -> Column:
    return counts["han"] + counts["kana"] + counts["hangul"] + counts["latin"] + counts["other"]


def scripted(counts: Column) -> Column:
    return counts["han"] + counts["kana"] + counts["hangul"] + counts["latin"]


def is_cjk_text(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"[{HAN}{KANA}{HANGUL}]")


def dominant_script(text: Column) -> Column:
    """Script of the first character that has one of its own; 'latin' where none has."""
    first = F.regexp_extract(F.coalesce(text, F.lit("")), r"([\p{L}])", 1)
    return (
        F.when(first.rlike(f"[{HAN}]"), "han").when(first.rlike(f"[{KANA}]"), "kana").when(first.rlike(f"[{HANGUL}]"), "hangul")
        .when(first.rlike(r"\p{IsCyrillic}"), "cyrillic").when(first.rlike(r"\p{IsGreek}"), "greek").when(first.rlike(r"\p{IsArabic}"), "arabic")
        .when(first.rlike(r"\p{IsHebrew}"), "hebrew").when(first.rlike(r"\p{IsThai}"), "thai").otherwise("latin")
    )


def language_script(tag: Column) -> Column:
    """Primary subtag to ja, ko, zh or unknown."""
    base = F.lower(F.split(tag, "[-_]")[0])
    return F.when(base.isin(*CJK), base).otherwise("unknown")


def resolve_script(tag: Column, engine_script: Column) -> Column:
    """The declared language's script, else the engine's."""
    declared = F.coalesce(language_script(tag), F.lit("unknown"))
    return F.when(declared != "unknown", declared).otherwise(F.coalesce(engine_script, F.lit("unknown")))


def _foreign(c: Column, script: Column, share: float) -> Column:
    foreign = F.when(script == "ko", c["han"] + c["kana"]).when(script == "zh", c["kana"])
    return F.coalesce((scripted(c) > 0) & (foreign / scripted(c) >= share), F.lit(False))


def script_mismatch(text: Column, script: Column, share: float = FOREIGN_SHARE) -> Column:
    """Share of letters of a foreign script: han and kana on Korean pages, kana on Chinese ones."""
    return once(script_counts(text), lambda c: _foreign(c, script, share))


def strict_korean_mismatch(text: Column, least: int = STRICT_HANGUL_MIN) -> Column:
    """No hangul, and several letters of known scripts."""
    return once(script_counts(text), lambda c: (c["hangul"] == 0) & (scripted(c) >= least))


def latin_on_cjk(text: Column, script: Column) -> Column:
    """On a CJK page, letters of known scripts, all of them Latin."""
    return F.coalesce(script.isin(*CJK), F.lit(False)) & once(script_counts(text), lambda c: (scripted(c) > 0) & (scripted(c) == c["latin"]))


def illegible_text(text: Column) -> Column:
    """No letter, one or two Latin letters only, or prolongation marks only."""

    def illegible(c: Column) -> Column:
        n = letters(c)
        return (n == 0) | (c["prolongation"] == n) | ((c["latin"] > 0) & (n == c["latin"]) & (n < 3))

    return once(script_counts(text), illegible)


def wants_rotated_reread(text: Column) -> Column:
    return once(script_counts(text), lambda c: (c["han"] > 0) & (c["kana"] == 0))


def admit_hangul_reread(text: Column) -> Column:
    return once(script_counts(text), lambda c: (c["hangul"] > 0) & (2 * c["hangul"] >= scripted(c)))


def reread_candidate(text: Column, script: Column, free_standing: Column, effect: Column) -> Column:
    """Korean, in a bubble, no effect, legible, and of a foreign script."""
    return (script == "ko") & ~free_standing & ~effect & ~illegible_text(text) & (script_mismatch(text, script) | strict_korean_mismatch(text))


def spot_suspect(text: Column) -> Column:
    """One to four glyphs."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")).between(1, 4)


def spot_candidate(text: Column, script: Column) -> Column:
    return (spot_suspect(text) | latin_on_cjk(text, script)) & ~illegible_text(text)


def is_romanised(text: Column) -> Column:
    """Every word scans as romanised Japanese syllables."""
    syllable = r"(?:(?:[kgsztdnhbpmyrwfj]|ky|gy|sh|ch|ts|ny|hy|by|py|my|ry)?[aiueo]|n'?|(?<=[aiueo])(?:kk|ss|tt|pp)(?=[aiueoshy]))"
    return F.coalesce(F.lower(squeeze(text)).rlike(rf"^(?:{syllable})+(?: (?:{syllable})+)*$"), F.lit(False))


# ---------------------------------------------------------------- furniture


def _any(phrases: Sequence[str], text: Column) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p.lower())
    return out


def watermark_text(text: Column, marks: Sequence[str]) -> Column:
    """Contains a mark, whatever its case."""
    return _any(marks, F.lower(F.coalesce(text, F.lit(""))))


def site_prose(line: Column, phrases: Sequence[str]) -> Column:
    return _any(phrases, F.lower(line))


def strip_mark(text: Column, mark: str) -> Column:
    """All places of a mark cut out, whatever their case."""
    return F.regexp_replace(text, "(?iu)" + re.escape(mark), "") if mark else text


def site_address(token: Column) -> Column:
    """host.tld with a top level of two to four letters, within other marks."""
    dotted = token.contains(".") | token.contains("．")
    return dotted & fold_fullwidth(token).rlike(r"^[^A-Za-z0-9]*[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,4}[^A-Za-z0-9]*$")


def orphaned_address_tail(token: Column) -> Column:
    return F.startswith(token, F.lit(".")) & token.rlike(r"^\.[A-Za-z]{2,4}[^A-Za-z0-9]*$")


def story_text(text: Column, marks: Sequence[str], phrases: Sequence[str]) -> Column:
    """What stays of a text without marks, addresses and site prose, line by line."""
    marked = watermark_text(text, marks)
    out = F.coalesce(text, F.lit(""))
    for m in marks:
        out = strip_mark(out, m)
    clean = F.transform(
        F.split(out, r"\r?\n"), lambda line: F.array_join(F.filter(words(line), lambda t: ~site_address(t) & ~orphaned_address_tail(t)), " ")
    )
    kept = F.filter(clean, lambda line: (line != "") & ~site_prose(line, phrases) & ~(marked & (scripted(script_counts(line)) == 0)))
    return strip_space(F.array_join(kept, "\n"))


def edit_distance_within(a: Column, b: Column, cap: int) -> Column:
    """Edit distance, null over the cap."""
    d = F.levenshtein(a, b, cap)
    return F.when(d >= 0, d)


def _window_match(residue: Column, term: str, cap: int, width: Column):
    """Whether the window at a place is the term within the cap, and nothing scripted stands beside it."""

    def match(i: Column) -> Column:
        rest = F.concat(F.substr(residue, F.lit(1), i - 1), F.substr(residue, i + width))
        return (F.levenshtein(F.substr(residue, i, width), F.lit(term), cap) >= 0) & (scripted(script_counts(rest)) == 0)

    return match


def misread_plate(text: Column, marks: Sequence[str], phrases: Sequence[str]) -> Column:
    """A non-ASCII term stands in the residue within half its length of edits (two at most), and nothing scripted beside it."""
    residue = F.regexp_replace(story_text(text, marks, phrases), r"\s", "")
    out = F.lit(False)
    for term in [*marks, *phrases]:
        if term.isascii():
            continue
        cap = min(max(len(term) // 2, 1), 2)
        width = F.least(F.lit(len(term)), F.length(residue))
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(residue) - width + 1))

        out = out | F.exists(starts, _window_match(residue, term, cap, width))
    return (F.length(residue) >= 2) & out


def only_site_furniture(text: Column, marks: Sequence[str], phrases: Sequence[str], scoped: bool = False) -> Column:
    literal = watermark_text(text, marks)
    if not scoped:
        return literal
    addressed = F.exists(words(F.coalesce(text, F.lit(""))), lambda t: site_address(t) | orphaned_address_tail(t))
    return (literal | addressed) & ((story_text(text, marks, phrases) == "") | misread_plate(text, marks, phrases))


def only_function_words(text: Column, stop_words: Sequence[str]) -> Column:
    """At least one word, and every word, trimmed of marks, is a stop word."""
    bare = F.filter(F.transform(words(text), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))), lambda w: w != "")
    return (F.size(bare) > 0) & F.forall(bare, lambda w: w.isin(*stop_words) if stop_words else F.lit(False))


def unlettered_read(text: Column, hidden: Column, marks: Sequence[str], phrases: Sequence[str], scoped: bool = True) -> Column:
    return hidden | illegible_text(text) | only_site_furniture(text, marks, phrases, scoped)


# ---------------------------------------------------------------- refusals


def refusal(
    text: Column, script: Column, marks: Sequence[str] = (), phrases: Sequence[str] = (), stop_words: Sequence[str] = (),
    engine_prefixes: Sequence[str] = (), scoped: bool = False,
) -> Column:
    """Why a read is refused, null if it isn't. The order of the cases is part of the meaning."""

    def verdict(t: Column, c: Column) -> Column:
        n, all_latin = letters(c), (c["latin"] > 0) & (letters(c) == c["latin"])
        voice = F.lit(False)
        for p in engine_prefixes:
            voice = voice | F.startswith(t, F.lit(p))
        prose = all_latin & script.isin(*CJK) & ((word_count(t) >= DESCRIPTION_WORDS) | only_function_words(t, stop_words))
        return (
            F.when(t == "", "empty")
            .when(only_site_furniture(t, marks, phrases, scoped), "watermark")
            .when(n == 0, "punctuation_only")
            .when(c["prolongation"] == n, "prolongation_only")
            .when(all_latin & (n < 3), "junk")
            .when(voice | F.coalesce(prose, F.lit(False)), "image_description")
            .when(_foreign(c, script, FOREIGN_SHARE), "script_mismatch")
        )

    return once(strip_space(F.coalesce(text, F.lit(""))), lambda t: once(script_counts(t), lambda c: verdict(t, c)))


def effect_refusal(text: Column, label: Column, connectives: Sequence[str], effect_label: str = "onomatopoeia") -> Column:
    """A connective read off a drawn effect."""
    return F.when((label == effect_label) & strip_space(text).isin(*connectives), "drawn_connective")


# ---------------------------------------------------------------- repetition and read clean-up


def degenerate_words(text: Column, least: int = 12, share: float = 0.20) -> Column:
    """Twelve words or more with fewer distinct ones than a fifth."""
    w = words(F.coalesce(text, F.lit("")))
    return (F.size(w) >= least) & (F.size(F.array_distinct(F.transform(w, F.lower))) < share * F.size(w))


def degenerate_period(text: Column, least: int = 32, share: float = 0.90, periods: int = 4) -> Column:
    """32 glyphs or more that repeat with a period of one to four in nine of ten places."""
    glyphs = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""), ""), lambda g: g != "")
    n = F.size(glyphs)

    def repeats(u):
        rest = F.slice(glyphs, u + 1, F.greatest(n - u, F.lit(0)))
        same = F.size(F.filter(F.arrays_zip(rest.alias("x"), F.slice(glyphs, 1, F.greatest(n - u, F.lit(0))).alias("y")), lambda p: p["x"] == p["y"]))
        return same >= share * (n - u)

    return (n >= least) & F.exists(F.sequence(F.lit(1), F.lit(periods)), repeats)


def refuse_repetition(text: Column) -> Column:
    return F.when(degenerate_period(text), "").otherwise(text)


def scream_read(text: Column) -> Column:
    """Three letters or more, half of them the same glyph."""
    glyphs = F.filter(F.split(alnum_skeleton(F.coalesce(text, F.lit(""))), ""), lambda g: g != "")
    most = F.array_max(F.transform(F.array_distinct(glyphs), lambda g: F.size(F.filter(glyphs, lambda x: x == g))))
    return (F.size(glyphs) >= 3) & F.coalesce(2 * most >= F.size(glyphs), F.lit(False))


def normalize_placeholders(text: Column, placeholder: str = r"[□■◯○]") -> Column:
    """A read of placeholders only is an ellipsis."""
    bare = F.regexp_replace(text, r"\s", "")
    return F.when(bare.rlike(f"^{placeholder}+$"), "...").otherwise(text)


def strip_engine_preamble(text: Column, prefixes: Sequence[str]) -> Column:
    """Behind the first colon if the text opens with engine chatter."""
    opens = F.lit(False)
    for p in prefixes:
        opens = opens | F.startswith(F.ltrim(text), F.lit(p))
    return F.when(opens, strip_space(F.regexp_extract(text, r"(?s)^[^:：]*[:：](.*)$", 1))).otherwise(text)


def latex_wrapped(text: Column) -> Column:
    return strip_space(text).rlike(r"(?s)^(\$\$?.*\$\$?|\\\(.*\\\)|\\\[.*\\\])$")


def strip_latex(text: Column) -> Column:
    """Unwraps a wrapped formula: delimiters, \\text-like commands and braces go, commands become their names."""
    inner = F.regexp_replace(strip_space(text), r"(?s)^(?:\$\$?|\\\(|\\\[)|(?:\$\$?|\\\)|\\\])$", "")
    for _ in range(3):
        inner = F.regexp_replace(inner, r"\\(?:text|mathrm|mathbf|mathit|operatorname|textbf|textit|boldsymbol)\s*\{([^{}]*)\}", "$1")
    inner = F.regexp_replace(F.regexp_replace(inner, r"\\(?:quad|qquad|,|;|!|:| )", " "), r"\\([A-Za-z]+)", "$1")
    return F.when(latex_wrapped(text), squeeze(F.regexp_replace(inner, r"[{}^_]", ""))).otherwise(text)


def clean_read(text: Column, prefixes: Sequence[str] = ()) -> Column:
    """Preamble, placeholders, formula wrapping, repetition, in this order."""
    return refuse_repetition(strip_latex(normalize_placeholders(strip_engine_preamble(text, prefixes))))


def ocr_post_process(text: Column) -> Column:
    """White space out, dot runs to full stops, half-width forms to full."""
    t = F.regexp_replace(text, r"\s+", "")
    t = F.regexp_replace(t, "…", "...")
    return widen_halfwidth(F.regexp_replace(t, r"[・.]{2,}", "..."))


def vote_form(text: Column) -> Column:
    """Form of a read that votes are cast on: full-width folded, white space out."""
    return F.regexp_replace(fold_fullwidth(F.coalesce(text, F.lit(""))), r"\s", "")


def vote_key(text: Column) -> Column:
    return alnum_skeleton(vote_form(text))


def uppercase_dialogue(text: Column, role: Column) -> Column:
    return F.when(role == "dialogue", F.upper(text)).otherwise(text)


def is_cut(text: Column) -> Column:
    """Not blank, and trailing white space."""
    return F.coalesce(~is_blank(text) & text.rlike(r"\s$"), F.lit(False))


def is_interjection(text: Column, most: int = 4) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")) <= most


def clip_bytes(text: Column, budget: int) -> Column:
    """At most ``budget`` bytes, cut between characters, with an ellipsis where something went."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    sizes = F.transform(chars, F.octet_length)
    fits = F.aggregate(
        sizes, F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda s, x: F.struct(
            F.when(s["open"] & (s["bytes"] + x <= budget), s["bytes"] + x).otherwise(s["bytes"]).alias("bytes"),
            F.when(s["open"] & (s["bytes"] + x <= budget), s["n"] + 1).otherwise(s["n"]).alias("n"),
            (s["open"] & (s["bytes"] + x <= budget)).alias("open"),
        ),
        lambda s: s["n"],
    )
    return F.when(F.octet_length(text) <= budget, text).otherwise(F.concat(F.substr(text, F.lit(1), fits), F.lit("...")))


def segment_kind(kind: Column, role: Column) -> Column:
    """Plain noun for a segment by region kind and role."""
    return F.when(kind == "onomatopoeia", "sound effect").when(role == "dialogue", "dialogue").when(role == "narration", "narration").when(role == "free", "free text")


def token_budget(segments: Column, floor: Column) -> Column:
    f = F.coalesce(floor, F.lit(1000))
    return F.least(F.greatest(F.lit(96) + F.lit(48) * segments, f), F.greatest(F.lit(2048), f))
