import glob
import math
import os

import pytest

import __spark_entry__ as entry
from corpuslake.plans.queries import ORACLE, QUERIES


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name in ORACLE:
        cur = duck.execute(ORACLE[name])
        names = [x[0] for x in cur.description]
        at = [names.index(c) for c in sorted(df.columns)]
        assert len(names) == len(df.columns)
        assert sorted(rows) == sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pushdown(spark, data):
    from corpuslake.operators import filters
    from corpuslake.session import read_table

    df = read_table(spark, data, "chunks").where(filters.scope(["a", "b"], ["c"])).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(In(notebook_id" in plan and "content" not in plan.split("ReadSchema")[1]
