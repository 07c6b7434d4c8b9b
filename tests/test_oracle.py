"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, duck

SF = "/root/testdata/sf0.01"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    problems = compare(rows, df.columns, cur.fetchall(), [d[0] for d in cur.description])
    assert not problems, problems


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["discount_bucket", "num_orders", "avg_profit_margin", "total_profit"]
