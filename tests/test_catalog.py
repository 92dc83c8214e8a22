"""Every named query against its SQL, on the smallest data set."""

from __future__ import annotations

import os

import pytest
from compare import difference, duck

from panelloom.catalog import ORACLES, QUERIES

SF = os.environ.get("PANELLOOM_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    rows, message = difference(QUERIES[name](spark, SF), con, ORACLES[name])
    assert message is None, message


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_types(spark, con, name):
    described = con.execute("DESCRIBE " + ORACLES[name]).fetchall()
    expected = {row[0]: str(row[1]) for row in described}
    got = {c: TYPES[t] for c, t in QUERIES[name](spark, SF).dtypes}
    assert got == expected


# Plans that would fall over at scale.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_pairing_of_everything(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [bad for bad in FORBIDDEN if bad in plan]


def _final_plan(df) -> str:
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


ONE_SCAN = ["climatology_fill", "densify_bounds", "gap_inventory", "rollup_dense", "class_fraction", "hourly_months"]


@pytest.mark.parametrize("name", ONE_SCAN)
def test_dense_series_read_their_source_once(spark, name):
    assert _final_plan(QUERIES[name](spark, SF)).count("FileScan") == 1


def test_scan_is_pruned_and_filtered(spark):
    plan = QUERIES["range_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(l_returnflag" in plan
    assert "l_extendedprice" not in plan
