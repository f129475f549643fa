"""Registered queries against DuckDB, and the shape of their plans."""

import pytest

import __spark_entry__ as entry
from tests.compare import connection, difference
from workload import catalog

SF = "/root/testdata/sf0.001"
ORACLES = catalog.ORACLES
QUERIES = catalog.QUERIES
#: checked by tests.compare at larger scale; each runs streams or several ingests
SLOW = {"K06_archive_inputs", "X01_stream_ingest", "X02_dedup_across_batches", "K08_rebuild_coverage", "K07_dry_run", "S11_scan_staging"}


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("key", [k for k in ORACLES if k not in SLOW])
def test_agrees_with_duckdb(spark, duck, key):
    _, problem = difference(spark, duck, QUERIES[key], ORACLES[key], SF)
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


PLANNED = [k for k in QUERIES if k not in SLOW and k[1].isdigit()]
#: exchanges by key that a plan has at most, before any is reused
EXCHANGES = {
    **{"S01_read_ing_csv": 2, "S05_read_paypal_csv": 4, "S07_stitch_ing": 8, "S08_stitch_bankwest": 8, "S09_stitch_hsbc": 8, "S10_stitch_coles": 8},
    **{"L01_section_detect": 2, "L03_entry_start": 3, "L04_continuation_merge": 4},
}


@pytest.mark.parametrize("key", PLANNED)
def test_plan_stays_in_the_jvm_without_cross_joins(spark, key):
    plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan, plan
    assert plan.count("Exchange hashpartitioning") <= EXCHANGES.get(key, 99)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["A07_year_totals"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01" in plan
    assert "c_name" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
