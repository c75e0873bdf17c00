"""Registered queries against DuckDB at the smallest scale. TIERLINE_FULL=1 adds the long ones;
`check.py` runs everything at any scale."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from check import ordered

FOLDER = "/root/testdata/sf0.001"
PLANS = {
    "income_decile_summary", "agent_base", "coverage_fact", "agent_kpis", "agent_claims", "lapse_watchlist", "lead_list",
    "tier_progress", "policy_ltv", "first_second_product", "agent_assignment", "digital_activity", "recency_flags",
    "client_level", "policy_base_later", "coverage_value", "use_case_targets", "target_waterfall", "customer_features", "agent_customer_mix",
}


def _names():
    sql = contract.oracle_sql()
    from tierline.catalog import base, operator_checks

    single = {n for n, fn in base._QUERIES.items() if fn.__closure__ and any(
        getattr(cell.cell_contents, "__module__", "") == operator_checks.__name__ for cell in fn.__closure__
    )}
    full = os.environ.get("TIERLINE_FULL") == "1"
    return [n for n in sql if full or n in single or n in PLANS]


@pytest.fixture(scope="session")
def con():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", _names())
def test_equals_sql(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(contract.oracle_sql()[name])
    assert ordered(df.columns, rows) == ordered([d[0] for d in cur.description], cur.fetchall())


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    out = contract.entry(spark)
    assert out.columns == ["income_decile", "agent_count", "mean_income_usd"]
    assert out.count() > 0
