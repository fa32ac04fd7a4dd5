import duckdb

from lamella.llm import line_dedup as ld
from lamella.llm.common import table


def test_against_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(duckdb.sql(ld.OP1_SQL).fetchall())
    got = sorted(tuple(r) for r in ld.op1_line_dedup(spark, sf).collect())
    assert got == want and any(r[3] for r in got)


def test_edges(spark):
    rows = [(i, "h", f"menu\nown {i}\n\n menu ") for i in range(6)] + [(10, "h", "menu"), (11, "h", None), (12, None, "menu\nx"), (13, "k", ""), (13, "k", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS host", "2 AS keys", "3 AS `__host2`")
    for limit in (ld.BROADCAST_BYTES, -1):
        out = ld.line_dedup(docs, broadcast_bytes=limit)
        assert out.columns == docs.columns
        got = sorted(((r.doc_id or -1, r.text) for r in out.collect()), key=str)
        want = [(i, f"own {i}\n") for i in range(1, 6)] + [(-1, "own 0\n"), (10, ""), (11, None), (12, "menu\nx"), (13, ""), (13, "")]
        assert got == sorted(want, key=str)
    assert ld.line_dedup(docs.limit(0)).count() == 0
