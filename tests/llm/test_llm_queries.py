import glob
import os

import duckdb
import pytest

import corpus_pipeline
from vaultline.llm import bpe, oracles, queries
from vaultline.llm.queries import TOKENIZER, table


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    got = queries.queries()[name](spark, sf)
    columns = [d[0] for d in con.execute(f"SELECT * FROM ({queries.oracle_sql()[name]}) LIMIT 0").description]
    assert sorted(got.columns) == sorted(columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(oracles.COLUMNS))
def test_columns_equal_sql(spark, sf, con, name):
    sql = oracles.COLUMNS[name]
    columns = [d[0] for d in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description]
    assert sorted(map(tuple, queries.queries()[name](spark, sf).select(*columns).collect())) == sorted(con.execute(sql).fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline(spark, sf):
    """Each stage by its operator alone, on what the stage before left."""
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        before, docs = docs.count(), spark.read.parquet(path)
        assert 0 < docs.count() <= before
    want = {(r["doc_id"], tuple(r["ids"])) for r in bpe.encode(docs, TOKENIZER).collect()}
    assert {(r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, sf).collect()} == want
