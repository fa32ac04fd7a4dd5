"""Queries of the text plane with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.functions import keys as k
from lamella.functions import text as t
from lamella.plans import samples as s
from lamella.sources.tables import table

# The classes of lamella.functions.text in DuckDB's regex syntax.
_SYM = t.SYMBOLS + t.ASCII_MARKS


def _counts(text: str) -> str:
    bare = rf"regexp_replace(coalesce({text}, ''), '[{_SYM}\s]', '', 'g')"
    n = lambda c: f"len(regexp_extract_all({bare}, '[{c}]'))"
    known = t.HAN + t.KANA + t.HANGUL
    return (
        f"{{'han': {n(t.HAN)}, 'kana': {n(t.KANA)}, 'hangul': {n(t.HANGUL)}, "
        f"'latin': length(regexp_replace({bare}, '[{known}]|[^\\p{{L}}]', '', 'g')), "
        f"'other': length(regexp_replace({bare}, '[{known}]|\\p{{L}}', '', 'g')), 'prolongation': {n(t.PROLONGATION)}}}"
    )


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def _quoted(items) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


def _refusal_sql(source: str) -> str:
    """(keys..., refusal) over ``source`` (id, text, script)."""
    marks = " OR ".join(f"contains(lower(tt), '{m.lower()}')" for m in s.MARKS)
    voice = " OR ".join(f"starts_with(tt, '{p}')" for p in s.PREFIXES)
    return f"""
    SELECT *, CASE
        WHEN tt = '' THEN 'empty'
        WHEN {marks} THEN 'watermark'
        WHEN n = 0 THEN 'punctuation_only'
        WHEN c.prolongation = n THEN 'prolongation_only'
        WHEN c.latin > 0 AND n = c.latin AND n < 3 THEN 'junk'
        WHEN {voice} OR (c.latin > 0 AND n = c.latin AND script IN ('ja', 'ko', 'zh') AND (
            len(words) >= {t.DESCRIPTION_WORDS}
            OR (len(bare) > 0 AND len(list_filter(bare, lambda w: w NOT IN ({_quoted(s.STOP_WORDS)}))) = 0)
        )) THEN 'image_description'
        WHEN scripted > 0 AND script = 'ko' AND (c.han + c.kana) / scripted >= {t.FOREIGN_SHARE} THEN 'script_mismatch'
        WHEN scripted > 0 AND script = 'zh' AND c.kana / scripted >= {t.FOREIGN_SHARE} THEN 'script_mismatch'
    END AS refusal FROM (
        SELECT *, c.han + c.kana + c.hangul + c.latin + c.other AS n, c.han + c.kana + c.hangul + c.latin AS scripted,
               list_filter(list_transform(words, lambda w: lower(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'))), lambda w: w <> '') AS bare
        FROM (SELECT *, {_counts('tt')} AS c, list_filter(regexp_split_to_array(tt, '\\s+'), lambda w: w <> '') AS words
              FROM (SELECT *, {_strip("coalesce(text, '')")} AS tt FROM ({source})))
    )"""


def _tagged(spark, sf_dir):
    """Documents and literal reads as (text, script, lang, n_chars)."""
    docs = table(spark, sf_dir, "documents").select("text", F.when(F.col("doc_id") % 5 == 0, "ko").otherwise("unknown").alias("script"), "lang", "n_chars")
    lit = s.reads(spark).select("text", "script", F.col("script").alias("lang"), F.length("text").cast("long").alias("n_chars"))
    return docs.union(lit)


_TAGGED_SQL = f"""
    SELECT text, CASE WHEN doc_id % 5 = 0 THEN 'ko' ELSE 'unknown' END AS script, lang, n_chars FROM documents
    UNION ALL SELECT text, script, script AS lang, length(text) AS n_chars FROM ({s.READS_SQL})"""


def text_refusal_report(spark, sf_dir):
    """Refusals by language over documents and literal reads."""
    why = t.refusal(F.col("text"), F.col("script"), s.MARKS, s.PHRASES, s.STOP_WORDS, s.PREFIXES)
    rows = _tagged(spark, sf_dir).withColumn("refusal", F.coalesce(why, F.lit("none")))
    return rows.groupBy("lang", "refusal").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


TEXT_REFUSAL_REPORT = f"""
SELECT lang, coalesce(refusal, 'none') AS refusal, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars
FROM ({_refusal_sql(_TAGGED_SQL)}) GROUP BY 1, 2"""


def read_predicates(spark, sf_dir):
    """Every read predicate on the literal reads."""
    x, sc = F.col("text"), F.col("script")
    c = t.script_counts(x)
    return s.reads(spark).select(
        "id", *[c[f].cast("long").alias(f) for f in ("han", "kana", "hangul", "latin", "other", "prolongation")],
        t.refusal(x, sc, s.MARKS, s.PHRASES, s.STOP_WORDS, s.PREFIXES).alias("refusal"), t.illegible_text(x).alias("illegible"),
        t.script_mismatch(x, sc).alias("mismatch"), t.strict_korean_mismatch(x).alias("strict_korean"), t.latin_on_cjk(x, sc).alias("latin_on_cjk"),
        t.wants_rotated_reread(x).alias("rotated"), t.admit_hangul_reread(x).alias("hangul_reread"), t.spot_suspect(x).alias("suspect"),
        t.is_cjk_text(x).alias("cjk"), t.alnum_count(x).cast("long").alias("alnum"), t.fold_fullwidth(x).alias("folded"),
    )


READ_PREDICATES = f"""
SELECT id, c.han AS han, c.kana AS kana, c.hangul AS hangul, c.latin AS latin, c.other AS other, c.prolongation AS prolongation, refusal,
       n = 0 OR c.prolongation = n OR (c.latin > 0 AND n = c.latin AND n < 3) AS illegible,
       coalesce(scripted > 0 AND CASE script WHEN 'ko' THEN (c.han + c.kana) / scripted WHEN 'zh' THEN c.kana / scripted END >= {t.FOREIGN_SHARE}, false) AS mismatch,
       c.hangul = 0 AND scripted >= {t.STRICT_HANGUL_MIN} AS strict_korean,
       script IN ('ja', 'ko', 'zh') AND scripted > 0 AND scripted = c.latin AS latin_on_cjk,
       c.han > 0 AND c.kana = 0 AS rotated, c.hangul > 0 AND 2 * c.hangul >= scripted AS hangul_reread,
       length(regexp_replace(text, '\\s', '', 'g')) BETWEEN 1 AND 4 AS suspect,
       regexp_matches(text, '[{t.HAN}{t.KANA}{t.HANGUL}]') AS cjk, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS alnum,
       translate(text, 'ＡＢＣ１２３', 'ABC123') AS folded
FROM ({_refusal_sql(s.READS_SQL)})"""

_MARK = "the"


def furniture_strip(spark, sf_dir):
    """Documents without addresses, orphaned tails and a mark, line by line."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = d.withColumn("text", F.concat("text", F.lit("\nsee example.com and .net now")))
    story = t.story_text(F.col("text"), [], [])
    tokens = F.filter(t.words(F.col("text")), lambda w: t.site_address(w) | t.orphaned_address_tail(w))
    return rows.select("doc_id", F.md5(story.cast("binary")).alias("story"), F.size(tokens).cast("long").alias("addresses"), F.length(t.strip_mark(F.col("text"), _MARK)).cast("long").alias("unmarked"))


_ADDRESS = r"regexp_matches(w, '^[^A-Za-z0-9]*[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,4}[^A-Za-z0-9]*$') OR regexp_matches(w, '^\.[A-Za-z]{2,4}[^A-Za-z0-9]*$')"
FURNITURE_STRIP = rf"""
WITH d AS (SELECT doc_id, text || chr(10) || 'see example.com and .net now' AS text FROM documents)
SELECT doc_id, md5(regexp_replace(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r?\n'),
           lambda l: array_to_string(list_filter(regexp_split_to_array(l, '\s+'), lambda w: w <> '' AND NOT ({_ADDRESS})), ' ')), lambda l: l <> ''), chr(10)), '^\s+|\s+$', '', 'g')) AS story,
       CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '' AND ({_ADDRESS}))) AS BIGINT) AS addresses,
       CAST(length(regexp_replace(text, '{_MARK}', '', 'gi')) AS BIGINT) AS unmarked
FROM d"""


def misread_fuzzy(spark, sf_dir):
    """Words of benchmark items that a garbled term matches within two edits."""
    w = table(spark, sf_dir, "benchmark").select("item_id", F.explode(t.words(F.col("text"))).alias("word"))
    d = t.edit_distance_within(F.lower("word"), F.lit("ernding"), 2)
    return w.groupBy("item_id").agg(F.count_if(d.isNotNull()).alias("hits"), F.min(d).cast("long").alias("least"))


MISREAD_FUZZY = r"""
SELECT item_id, count_if(d <= 2) AS hits, min(CASE WHEN d <= 2 THEN d END) AS least FROM (
    SELECT item_id, levenshtein(lower(word), 'ernding') AS d
    FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS word FROM benchmark)
) GROUP BY item_id"""


def degenerate_repetition(spark, sf_dir):
    """Documents that repeat few words, by language and with word counts."""
    d = table(spark, sf_dir, "documents")
    bad = t.degenerate_words(F.col("text"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(bad).alias("degenerate"), F.sum(t.word_count(F.col("text")).cast("long")).alias("words"))


DEGENERATE_REPETITION = r"""
SELECT lang, count(*) AS n, count_if(len(w) >= 12 AND len(list_distinct(list_transform(w, lambda x: lower(x)))) < 0.20 * len(w)) AS degenerate,
       CAST(sum(len(w)) AS BIGINT) AS words
FROM (SELECT lang, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) GROUP BY lang"""


def story_key(spark, sf_dir):
    """Host, series, key and id of each page's address."""
    p = table(spark, sf_dir, "pages").select("page_id", k.story_page_key(F.col("url")).alias("k"))
    return p.select("page_id", "k.host", "k.series", k.fnv1a(F.col("k.key")).alias("hash"), k.story_id(F.col("k"), F.col("page_id") % 3).alias("story_id"))


_FNV = "lower(lpad(printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda h, u: ((xor(h, u)) * 16777619) & 4294967295)), 8, '0'))"
STORY_KEY = rf"""
WITH u AS (
    SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host,
           list_filter(list_transform(string_split(lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '/'), lambda x: regexp_replace(x, '\.(?:html?|php|aspx?|jsp)$', '')),
               lambda x: x <> '' AND NOT regexp_matches(x, '^(?:\d+(?:[._-]\d+)*|(?:chapter|chap|ch|episode|ep|volume|vol)[-_.]?\d+(?:[._-][a-z0-9]+)*)$')) AS parts
    FROM pages
), v AS (SELECT page_id, host, coalesce(parts[-1], '') AS series FROM u)
SELECT page_id, host, series, {_FNV.format("host || '|' || series")} AS hash,
       coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(CASE WHEN series <> '' THEN series ELSE host END, '[^a-z0-9_-]+', '-', 'g'), '-{{2,}}', '-', 'g'), '^[-_]+|[-_]+$', '', 'g'), 32), '[-_]+$', ''), ''), 'page')
       || '-' || {_FNV.format("host || '|' || series")} || CASE WHEN page_id % 3 > 0 THEN '-r' || (page_id % 3) ELSE '' END AS story_id
FROM v"""


def settings_fingerprint(spark, sf_dir):
    """Cache key of each turn: content hash and settings."""
    c = table(spark, sf_dir, "conversations")
    fp = k.settings_fingerprint([F.col("role"), F.lit(None), F.col("turn")])
    return c.select("conv_id", "turn", k.cache_key(k.content_hash(F.col("text").cast("binary")), fp).alias("key"), k.cache_url_key(F.concat(F.lit("http://h/"), F.col("conv_id").cast("string")), fp).alias("url_key"))


_FP = """'["' || role || '","","' || turn || '"]'"""
SETTINGS_FINGERPRINT = f"""
SELECT conv_id, turn, sha256(text) || ':' || {_FP} AS key, 'http://h/' || conv_id || chr(10) || {_FP} AS url_key FROM conversations"""


def ledger_terms(spark, sf_dir):
    """Term keys of short leading parts of conversations."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("「"), F.substring("text", 1, 20), F.lit("! ")).alias("source"))
    return c.select("conv_id", "turn", k.ledger_term(F.col("source")).alias("term"))


LEDGER_TERMS = rf"""
SELECT conv_id, turn, CASE WHEN length(b) <= 24 AND NOT regexp_matches(b, '[。．.?!？！…‥]') AND len(string_split(b, ' ')) <= 2 THEN b ELSE '' END AS term
FROM (SELECT conv_id, turn, regexp_replace(regexp_replace('「' || left(text, 20) || '! ', '{k._EDGE[:-1].replace("'", "''")}+$|^{k._EDGE.replace("'", "''")}', '', 'g'), '\s+', ' ', 'g') AS b FROM conversations)"""

QUERIES = {
    "text_refusal_report": (text_refusal_report, TEXT_REFUSAL_REPORT), "read_predicates": (read_predicates, READ_PREDICATES), "furniture_strip": (furniture_strip, FURNITURE_STRIP),
    "misread_fuzzy": (misread_fuzzy, MISREAD_FUZZY), "degenerate_repetition": (degenerate_repetition, DEGENERATE_REPETITION), "story_key": (story_key, STORY_KEY),
    "settings_fingerprint": (settings_fingerprint, SETTINGS_FINGERPRINT), "ledger_terms": (ledger_terms, LEDGER_TERMS),
}
