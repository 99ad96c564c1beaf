"""The registered queries on the smallest tables, against oracle SQL where there is any, and the pipeline's stages."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from obsim.llm import decontam, quality
from obsim.llm.queries import ORACLE_SQL, QUERIES
from obsim.llm.tables import documents, table
from tests.llm import helpers as H
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert {q.split("_")[0] for q in QUERIES} == {"pipeline", *(f"op{n}" for n in range(1, 14))}


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_matches_oracle(spark, name):
    assert compare(QUERIES[name](spark, SMALL), connect(SMALL), ORACLE_SQL[name]) == []


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ORACLE_SQL and q != "pipeline"])
def test_runs_on_whole_table(spark, name):
    out = QUERIES[name](spark, SMALL).toPandas()
    assert len(out) > 0
    if name.startswith(("op1_", "op3_", "op8_", "op10_", "op12_")):
        assert sorted(out.doc_id) == sorted(r.doc_id for r in documents(spark, SMALL).select("doc_id").collect())


def test_pipeline_stages(spark):
    docs = documents(spark, SMALL)
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    good = {r.doc_id for r in quality.judge(docs).filter("kept").select("doc_id").collect()}
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SMALL).cache()
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == good
    one = corpus_pipeline.STAGES[1][1](spark, kept, SMALL).cache()
    rows = kept.orderBy("doc_id").collect()
    groups = H.near_groups([r.text for r in rows])
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {rows[g].doc_id for g in groups}
    clean = corpus_pipeline.STAGES[2][1](spark, one, SMALL).cache()
    leaked = {r.doc_id for r in decontam.leaks(one, table(spark, SMALL, "benchmark")).collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - leaked
    mixed = corpus_pipeline.STAGES[3][1](spark, clean, SMALL).cache()
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in clean.collect()}
    final = corpus_pipeline.run(spark, SMALL).toPandas()
    assert set(final.doc_id) == {r.doc_id for r in mixed.collect()} and set(final.doc_id) <= ids
    assert final.columns.tolist() == [*columns, "shard_bytes", "shard", "slot"]
