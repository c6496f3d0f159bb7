"""The registered queries over the small tables, against their SQL where there is one."""
import os

import oracle
import pytest

from tickloom.llm.queries import ORACLES, QUERIES

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return oracle.connection(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, _, n = oracle.compare(spark, con, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert problem is None, problem
    if name != "op11_spelling_variants":  # a row for each word
        assert n == con.execute(f"SELECT count(*) FROM {'pages' if name.startswith(('op6', 'op12')) else 'documents'}").fetchone()[0]


def test_pipeline_over_the_small_table(spark, con):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.settle(stage(spark, docs, FOLDER), name)
        assert out.columns == docs.columns
        assert out.count() <= before and out.count() > 0.8 * before
        docs, before = out, out.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert out.count() == before and out.where("not round_trip").count() == 0
