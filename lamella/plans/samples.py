"""Derived inputs of the queries: boxes from line items, segments from conversations, literal CJK reads.

Each comes as a DataFrame and as the SQL that gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import geometry as g
from lamella.sources.tables import table

#: (host, text, script, format): reads that reach every branch of the script rules.
READS = [
    ("a.test", "これはペンです。", "ja", "paged"), ("a.test", "漢字とかなをまぜた文を書いてみました", "ja", "paged"), ("a.test", "ーー", "ja", "paged"),
    ("a.test", "・・・", "ja", "paged"), ("a.test", "hm", "ja", "paged"), ("a.test", "the text in the image", "ja", "paged"),
    ("b.test", "안녕하세요 여러분 만나서 반갑습니다", "ko", "strip"), ("b.test", "漢字だけ", "ko", "strip"), ("b.test", "오늘은 날씨가 참 좋네요 그렇죠", "ko", "strip"),
    ("b.test", "그래서 우리는 함께 길을 떠났습니다 아주 멀리", "ko", "strip"), ("c.test", "你好世界", "zh", "strip"), ("c.test", "これはかな", "zh", "strip"),
    ("c.test", "www.willowleaf.test", "zh", "strip"), ("c.test", "柳叶书屋 willowleaf.test", "zh", "strip"), ("c.test", "", "zh", "strip"), ("c.test", "!!", "zh", "strip"),
    ("c.test", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜", "zh", "strip"), ("d.test", "is a the", "zh", "paged"),
    ("d.test", "图片中没有文字", "unknown", "paged"), ("d.test", "ＡＢＣ１２３", "unknown", "paged"),
]
MARKS = ["柳叶书屋", "willowleaf"]
PHRASES = ["漫画", "免费"]
STOP_WORDS = ["the", "a", "an", "of", "is", "in", "to"]
PREFIXES = ["图片中没有", "图中没有"]


def reads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(READS)], "id long, host string, text string, script string, format string")


READS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    "({}, '{}', '{}', '{}', '{}')".format(i, *[str(x).replace("'", "''") for x in r]) for i, r in enumerate(READS)
) + ") AS t(id, host, text, script, format)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, id, label, score, box: about thirty boxes a page."""
    li = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_partkey") % 700, F.col("l_suppkey") * 13 % 1100
    w, h = (20 + F.col("l_quantity") * 4).cast("long"), (20 + F.col("l_linenumber") * 25).cast("long")
    label = F.when(F.col("l_returnflag") == "A", "text").when(F.col("l_returnflag") == "N", "bubble").otherwise("panel")
    page = F.floor(F.col("l_orderkey") / 8).cast("long").alias("page")
    ident = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id")
    grow = F.when(label == "panel", 3).when(label == "bubble", 2).otherwise(1)
    return li.select(page, ident, label.alias("label"), F.col("l_discount").alias("score"), g.box(x, y, w * grow, h * grow).alias("box")).distinct()


BOXES_SQL = """
boxes AS (
    SELECT DISTINCT l_orderkey // 8 AS page, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
           CASE l_returnflag WHEN 'A' THEN 'text' WHEN 'N' THEN 'bubble' ELSE 'panel' END AS label, l_discount AS score,
           l_partkey % 700 AS x, l_suppkey * 13 % 1100 AS y,
           CAST(20 + l_quantity * 4 AS BIGINT) * CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS w,
           CAST(20 + l_linenumber * 25 AS BIGINT) * CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS h
    FROM lineitem
)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, text with every fifth text cut."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return c.withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")))


SEGMENTS_SQL = """
segments AS (
    SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 5 = 0 THEN text || ' ' ELSE text END AS text FROM conversations
)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """story, page, pos, source, translation: adjacent turns, several conversations a story."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = c.withColumn("translation", F.lead("text").over(w)).where("translation IS NOT NULL")
    return p.select((F.col("conv_id") % 7).alias("story"), F.col("conv_id").alias("page"), F.col("turn").alias("pos"), F.col("text").alias("source"), "translation")


PAIRS_SQL = """
pairs AS (
    SELECT conv_id % 7 AS story, conv_id AS page, turn AS pos, text AS source, translation FROM (
        SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS translation
        FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn)
    ) WHERE translation IS NOT NULL
)"""
