"""Every registered query of the engine's own operators against its DuckDB SQL."""

import math
import os

import duckdb
import pytest

from memlake.plans.queries import ORACLES, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
#: Queries whose right answer may be empty on the smallest tables.
MAY_BE_EMPTY = {"sole_carriers", "rule_verdicts", "pasted_documents", "anomaly_burst", "anomaly_trivial", "projection_check", "store_violations", "unanswered_sessions", "budget_prefix"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(plain(r[k]) for k in order) for r in found], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows(df.columns, df.collect()), rows(columns, result.fetchall())
    assert len(got) == len(want)
    assert got == want
    assert got or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).collect()
