"""The pipeline's stages against plain versions of what they promise."""

import duckdb
import pytest

import corpus_pipeline
from marlstone.sources.tables import table


def test_stages(spark, sf_dir, no_docs, odd_docs):
    docs = table(spark, sf_dir, "documents")
    benchmark = [r.text for r in table(spark, sf_dir, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), f"test-{name}")
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(after) <= set(before) and len(after) > 0.5 * len(before)
        if name != "pii":
            assert all(after[k] == before[k] for k in after)
        if name == "decontamination":
            assert set(before) - set(after) == {k for k, r in before.items() if any(b in r.text for b in benchmark)}
        if name == "near_dedup":
            texts = [r.text.lower() for r in after.values()]
            assert len(set(texts)) == len(texts)
        if name == "pii":
            assert all(r.n_chars == len(r.text) for r in after.values() if r.text != before[r.doc_id].text)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(after)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_odd_tables(spark, sf_dir, odd_docs, no_docs, stage):
    assert stage[1](spark, no_docs, sf_dir).count() == 0
    out = stage[1](spark, odd_docs, sf_dir)
    assert out.count() > 0 and (stage[0] == "packing" or out.columns == odd_docs.columns)


def test_sql_gives_the_same_rows(spark, sf_dir):
    from marlstone.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for name in ("documents", "labels", "conversations"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, sf_dir)
        assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"select {', '.join(df.columns)} from ({sql})").fetchall()), name
