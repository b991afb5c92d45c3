"""Every query against DuckDB on the supplied tables."""

import glob
import os

import duckdb
import pytest

from vaultline.queries import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def comparable(rows):
    return sorted((tuple(str(v) for v in row) for row in rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name, tmp_path):
    got = QUERIES[name](spark, sf)
    if name not in SQL:
        assert len(got.collect()) >= 0 and got.columns
        return
    path = f"{tmp_path}/out"
    got.write.parquet(path)
    columns = ", ".join(f'"{c}"' for c in sorted(d[0] for d in con.execute(f"SELECT * FROM ({SQL[name]}) LIMIT 0").description))
    mine = con.execute(f"SELECT {columns} FROM '{path}/*.parquet'").fetchall()
    assert len(got.columns) == columns.count(",") + 1
    assert comparable(mine) == comparable(con.execute(f"SELECT {columns} FROM ({SQL[name]})").fetchall())
