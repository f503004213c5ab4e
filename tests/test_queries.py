"""Registered queries against their SQL on the smallest tables.

The whole list runs with ``python tests/compare.py``; here one query of each
family keeps the suite short.
"""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"

FAMILIES = (
    "sample_balanced",
    "tier_search",
    "tier_content_addressed",
    "trace",
    "parse_result_name",
    "pattern_merge",
    "reward",
    "content_key",
    "asof_system_state",
    "host_energy",
    "energy_between",
    "observation",
    "state_key",
    "route_q",
    "embed",
    "plateau_events",
    "merge_summaries",
    "latency_percentiles",
    "per_backend_metrics",
    "paired_delta",
    "paired_by_log",
    "warmup_boundary",
    "lambda_sweep",
    "cbr_scores",
    "compare_routers",
    "stream_windows",
    "online_cbr",
)


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


@pytest.mark.parametrize("name", FAMILIES)
def test_query(spark, connection, name):
    df = entry.queries()[name](spark, SMALL)
    assert compare(df, connection, entry.oracle_sql()[name]) == ""


def test_checks_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 6
