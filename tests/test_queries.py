"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def table(columns, rows):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    got = con.execute(registry.ORACLE_SQL[name])
    want = table([d[0] for d in got.description], got.fetchall())
    assert table(df.columns, rows) == want


def test_quotes_without_an_inner_word(spark, tmp_path):
    documents = [(1, "some words here"), (2, "other words  here"), (3, "nothing"), (4, None)]
    benchmark = [(1, "words"), (2, "words here"), (3, "ther"), (4, "absent"), (5, "some words here"), (6, ""), (7, None)]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL["quote_verify"]).fetchall()
    assert dict(want)[1] == dict(want)[2] == 2
    assert sorted(map(tuple, registry.QUERIES["quote_verify"](spark, str(tmp_path)).collect())) == sorted(want)


def test_entry_serves_every_query():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
