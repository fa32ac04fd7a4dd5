import pytest

import __spark_entry__ as entry_point
from lamella.plans import catalog
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, name):
    got, want = compare(spark, catalog.queries()[name], catalog.oracle_sql()[name], "/root/testdata/sf0.01")
    assert got == want and got, name


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert {r.refusal for r in rows} >= {"none", "empty", "watermark", "punctuation_only", "prolongation_only", "junk", "image_description", "script_mismatch"}


def test_names_are_known():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_closure_covers_all_line_items(spark):
    """The closure reaches what a breadth-first loop reaches."""
    path = "/root/testdata/sf0.001"
    near = {}
    for r in spark.read.parquet(f"{path}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        near.setdefault(f"o{r.l_orderkey}", set()).add(f"p{r.l_partkey}")
        near.setdefault(f"p{r.l_partkey}", set()).add(f"o{r.l_orderkey}")
    seen, front = {"p40"}, {"p40"}
    while front:
        front = {y for x in front for y in near[x]} - seen
        seen |= front
    got = {r.id for r in catalog.queries()["relation_closure_all"](spark, path).collect()}
    assert got == seen and any(x[0] == "p" and int(x[1:]) % 40 for x in got)
