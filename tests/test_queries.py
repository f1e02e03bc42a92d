"""Every registered query against its DuckDB oracle at sf0.01 (the driver's check), plus
plan properties: no Python UDF on any registered path, nested-loop joins only where named."""

import os

import pytest

from paths import SF001, SF01

import __spark_entry__ as entry
from ledgerlake.plans.catalog import ORACLE, QUERIES
from tools.oracle_check import digest

NESTED_LOOP_OK = {"learn_rules", "learn_two_batches", "mail_ingest", "mail_ingest_counts", "mail_learns"}  # labels, one-row counts
STREAMING = {"stream_ingest", "stream_ingest_late", "stream_suppressed", "stream_month_type", "stream_daily_totals"}
PYTHON_OK = {"chat_answers"}  # one matrix product per block of questions and documents


@pytest.fixture(scope="module")
def duck():
    import duckdb

    from ledgerlake.session import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF01, t + '.parquet')}')")
    return con


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF01)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLE[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


@pytest.mark.parametrize("key", sorted(set(QUERIES) - STREAMING))
def test_plan_has_no_python_and_no_stray_nested_loops(spark, key):
    plan = QUERIES[key](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    if key in PYTHON_OK:
        return
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    if key not in NESTED_LOOP_OK:
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, key


def test_scan_prunes_columns_and_pushes_filters(spark):
    from ledgerlake.plans.registry import q_dashboard_filter

    plan = q_dashboard_filter(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters: ["):].split("]")[0]
    assert "GreaterThanOrEqual(o_orderdate" in pushed
    assert "o_orderpriority" not in plan  # unused column not read


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["budget_group", "target", "actual", "variance", "variance_pct", "status"]
    assert df.count() == 5
