"""Every core query against its SQL, on the smallest tables; those without SQL must run and keep their types."""

import math
from pathlib import Path

import duckdb
import pytest

from folio import queries as core

ALL, SQL = core.queries(), core.oracle_sql()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def norm(df):
    def v(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("<NA>", "nan"):
            return "NULL"
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(v, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(name, spark, data, db):
    got = ALL[name](spark, data).toPandas()
    if name in SQL:
        want = db.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert norm(got) == norm(want)


def test_sql_has_no_orphans():
    assert set(SQL) <= set(ALL)


def test_filters_reach_the_scan(spark, data):
    """A filter on another column stays below the reading, and an unused reading is not computed."""
    df = core.read_pages(spark, data)
    plan = df.where("page_id = 5").select("page_id", "url")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "PushedFilters: [IsNotNull(page_id), EqualTo(page_id,5)]" in plan and "html" not in plan.split("ReadSchema")[1]
