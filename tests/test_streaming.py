import random

from pyspark.sql import functions as F

from lamella.operators import history
from lamella.plans import samples as s
from lamella.streaming import stateful as st


def as_stream(spark, df, path, parts, key):
    """The table as a stream of several files in order."""
    schema = df.schema
    rows = sorted(df.collect(), key=lambda r: r[key])
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_story_window_stream(spark, sf, tmp_path):
    st.use_rocksdb(spark)
    pairs = s.pairs(spark, sf)
    stream = as_stream(spark, pairs, tmp_path / "pairs", 1, "page")
    got = {(r.story, r.page): r.visible for r in st.run_to_end(st.story_stream(stream, 5), "stories").collect()}
    want = {(r.story, r.page): r.visible for r in history.visible_context(pairs.select("story", "page"), pairs, 5).collect()}
    assert got == want and max(got.values()) == 5


def test_cache_stream(spark, tmp_path):
    st.use_rocksdb(spark)
    rng = random.Random(3)
    events = [(f"s{i % 3}", f"k{rng.randrange(12)}", 100 * i, rng.randrange(1, 40), rng.random() < 0.5) for i in range(120)]
    df = spark.createDataFrame(events, "site string, key string, at long, bytes long, put boolean")
    stream = as_stream(spark, df, tmp_path / "ev", 1, "at")
    gone = {(r.site, r.key) for r in st.run_to_end(st.cache_stream(stream, 4, 90, 5000), "evictions").collect()}
    for site in ("s0", "s1", "s2"):
        held = {}
        for x, k, at, size, put in events:
            if x == site:
                old = held.get(k)
                held[k] = (at, at, size) if put or old is None else (old[0], at, old[2])
        now = max(v[1] for v in held.values())
        live = {k: v for k, v in held.items() if v[0] >= now - 5000}
        while len(live) > 4 or sum(v[2] for v in live.values()) > 90:
            del live[min(live, key=lambda k: (live[k][1], live[k][2], k))]
        assert {k for y, k in gone if y == site} == set(held) - set(live)


def test_latch_stream(spark, tmp_path):
    stream = as_stream(spark, s.reads(spark), tmp_path / "reads", 1, "id")
    evidence = st.run_to_end(st.latch_stream(stream), "evidence", "complete")
    got = {tuple(r) for r in history.latch(evidence).collect()}
    assert got == {tuple(r) for r in history.latch(history.script_evidence(s.reads(spark))).collect()}


def test_ledger_stream(spark, sf, tmp_path):
    obs = s.pairs(spark, sf).select(F.lit("a").alias("series"), F.substring("source", 1, 8).alias("source"), F.substring("translation", 1, 6).alias("translated"), F.col("page").alias("at"))
    stream = as_stream(spark, obs, tmp_path / "obs", 2, "at")
    got = {tuple(r) for r in st.run_to_end(st.ledger_stream(stream), "ledgers", "complete").collect()}
    assert got == {tuple(r) for r in history.ledger(obs).collect()}
