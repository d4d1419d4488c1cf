"""Every query against its SQL in DuckDB."""

import duckdb
import pytest

from veloquy.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == names
    order = lambda rows: sorted(rows, key=lambda r: tuple(map(repr, r)))
    at = [want.columns.index(c) for c in names]
    assert order([tuple(r[c] for c in names) for r in df.collect()]) == order([tuple(r[i] for i in at) for r in want.fetchall()])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
