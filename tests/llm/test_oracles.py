import duckdb
import pytest

from quireframe.llm.contract import ORACLES, QUERIES

KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf).select(*names)
    assert {d[0]: KINDS[str(d[1])] for d in want.description} == dict(got.dtypes) and set(names) == set(QUERIES[name](spark, sf).columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
