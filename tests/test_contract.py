"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(x):
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, int | float):
        return "null" if isinstance(x, float) and math.isnan(x) else repr(round(float(x), 6) + 0.0)
    return str(x)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    d = entry.queries()[name](spark, str(DATA))
    names = sorted(d.columns)
    r = con.execute(entry.oracle_sql()[name])
    heads = [c[0] for c in r.description]
    assert sorted(heads) == names
    want = sorted(tuple(plain(row[heads.index(c)]) for c in names) for row in r.fetchall())
    got = sorted(tuple(plain(row[c]) for c in names) for row in d.collect())
    assert got == want


def test_entry(spark):
    d = entry.entry(spark)
    assert d.columns == ["example_id", "task_type", "querent_context", "ifd_score"] and d.count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql()))
def test_other_queries_run(spark, name):
    entry.queries()[name](spark, str(DATA)).write.format("noop").mode("overwrite").save()


def test_filters_reach_the_scan(spark):
    plan = entry.queries()["rows_filter_page"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert pushed and all("EqualTo(register,warm)" in line for line in pushed)
