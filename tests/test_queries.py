"""Every query against its SQL in DuckDB."""

import duckdb
import pytest

from cardlake.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return ""
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def kind(arrow):
    """A column's type, as Spark names it."""
    return {"int32": "int", "int64": "bigint", "string": "string", "large_string": "string", "double": "double", "bool": "boolean", "timestamp[us]": "timestamp_ntz"}.get(str(arrow), str(arrow))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = [r.asDict() for r in got.collect()]
    if name not in SQL:
        assert rows
        return
    found = duck.execute(SQL[name]).to_arrow_table()
    assert {f.name: kind(f.type) for f in found.schema} == {n: "timestamp_ntz" if k == "timestamp" else k for n, k in got.dtypes}
    names = sorted(got.columns)
    want = sorted(tuple(plain(r[n]) for n in names) for r in found.to_pylist())
    assert sorted(tuple(plain(r[n]) for n in names) for r in rows) == want
