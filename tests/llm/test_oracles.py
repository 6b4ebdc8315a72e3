"""Queries of the package against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    key = lambda rows: sorted(tuple("null" if v is None else str(v) for v in r) for r in rows)
    assert key(got.select(*columns).collect()) == key(want.fetchall())
