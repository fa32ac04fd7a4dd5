import duckdb

import corpus_pipeline as cp
from lamella.llm import language_id as li
from lamella.llm import line_dedup as ld
from lamella.llm.common import materialize, table
from tests.llm.test_decontaminate import brute_force
from tests.llm.test_near_dedup import brute
from tests.llm.test_tokens import check_pattern_packing


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for name, stage in cp.STAGES:
        out = materialize(stage(spark, docs, sf), "test")
        before, after = docs.collect(), out.collect()
        if name != "best_fit_packing":
            assert out.columns == columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        if name == "language_id":
            model = li.fit(docs)
            want = {r.doc_id for r in before if not model.predict(r.text.encode())[2]}
            assert {r.doc_id for r in after} == want and len(want) >= 0.98 * len(before)
        elif name == "line_dedup":
            pdf = docs.toPandas()
            con = duckdb.connect()
            con.register("documents", pdf)
            assert {r.doc_id: r.text for r in after} == {r[0]: r[4] for r in con.sql(ld.OP1_SQL).fetchall()}
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "minhash_near_dedup":
            groups = brute([(r.doc_id, r.text) for r in before])
            assert {r.doc_id for r in after} == {x for x, (_, c) in groups.items() if x == c}
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
            clean = {x[0] for x in brute_force([(r.doc_id, r.text) for r in before], items) if not x[5]}
            assert {r.doc_id for r in after} == clean and len(clean) < len(before)
        else:
            check_pattern_packing(after, [(r.doc_id, r.text) for r in before])
        docs = out


def test_run(spark, sf):
    assert cp.run(spark, sf).count() > 50
