"""Every query against its SQL in DuckDB, over the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from quireframe.plans.contract import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Spark's types by the names that DuckDB gives
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v.isoformat() if isinstance(v, datetime.date) else v


def shown(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    rows = [tuple(r) for r in got.collect()]
    assert rows or name not in ORACLES
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        kinds = dict(got.dtypes)
        assert {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in want.description} == kinds
        a, b = shown(rows, got.columns), shown(want.fetchall(), names)
        assert len(a) == len(b)
        assert [x for x in zip(a, b, strict=True) if x[0] != x[1]][:3] == []
