"""Summaries of hand-made traces."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierflow.operators import summaries
from tierflow.sources import results

TRACE = """log_id long, router string, dataset_name string, destination string, total_latency_ms double,
  success boolean, energy_cpu_pkg_j double, sensitive boolean, compliance_forced boolean"""

ROWS = [
    (1, "a2c", "d", "mysql", 3.0, True, 0.01, False, False),
    (2, "a2c", "d", "elk", 5.0, True, 0.02, True, False),
    (1, "q_learning", "d", "ipfs", 4.0, False, 0.03, False, False),
]


def test_combined_summary(spark):
    row = summaries.combined_summary(spark.createDataFrame(ROWS, TRACE)).first()
    expected = {
        "rows": 3,
        "mean_total_latency_ms": 4.0,
        "median_total_latency_ms": 4.0,
        "p95_total_latency_ms": 4.9,
        "success_rate": 2 / 3,
        "sensitive_fraction": 1 / 3,
        "energy_per_log_j": 0.02,
        "destination_mix_mysql": 1 / 3,
        "destination_mix_elk": 1 / 3,
        "destination_mix_ipfs": 1 / 3,
        "sensitive_total": 1,
        "sensitive_to_ipfs": 0,
        "sensitive_coverage": 0.0,
        "sensitive_leakage": 1,
        "leakage_rate": 1.0,
        "non_sensitive_ipfs_fraction": 0.5,
        "compliance_score": 0.0,
    }
    for name, value in expected.items():
        assert math.isclose(row[name], value, abs_tol=1e-9), name
    assert list(row.asDict())[1:] == list(expected)


def test_backend_metrics_are_those_of_a_plain_loop(spark):
    rows = summaries.per_backend_metrics(spark.createDataFrame(ROWS, TRACE)).collect()
    found = {(r.router, r.tier): r for r in rows}
    groups = {}
    for r in ROWS:
        for key in ((r[1], r[3]), (r[1], "all")):
            groups.setdefault(key, []).append(r)
    assert len(found) == len(groups) == 5
    for (router, tier), members in groups.items():
        row = found[router, tier]
        assert row.logs == len(members)
        assert math.isclose(row.mean_latency_ms, sum(m[4] for m in members) / len(members))
        assert math.isclose(row.p95_latency_ms, np.percentile([m[4] for m in members], 95))


def test_compliance_without_sensitive_rows(spark):
    rows = [r for r in ROWS if not r[7]]
    row = summaries.compliance_metrics(spark.createDataFrame(rows, TRACE), ["dataset_name"]).first()
    assert (row.sensitive_coverage, row.leakage_rate, row.compliance_score) == (1.0, 0.0, 1.0)


def test_all_sensitive_and_all_kept(spark):
    rows = [(i, "r", "d", "ipfs", 1.0, True, 0.0, True, True) for i in range(4)]
    row = summaries.compliance_metrics(spark.createDataFrame(rows, TRACE)).first()
    assert (row.sensitive_coverage, row.sensitive_leakage) == (1.0, 0)
    assert row.non_sensitive_ipfs_fraction == 0.0


def test_empty_trace_has_no_rows(spark):
    empty = spark.createDataFrame([], TRACE)
    assert summaries.combined_summary(empty).count() == 0
    assert summaries.run_summary(empty).count() == 0


def test_run_summary_units(spark):
    row = summaries.run_summary(
        spark.createDataFrame(ROWS, TRACE).where("router = 'a2c'"), 0.5, True, ["token", "login"]
    ).first()
    assert math.isclose(row.TotalEnergyWh, 0.03 / 3600)
    assert math.isclose(row.CarbonEmissionsKg, 0.03 / 3600 / 1000 * 0.5)
    assert math.isclose(row.ThroughputLogsPerSec, 2 / 0.008)
    assert (row.ComplianceEnabled, row.CompliancePatterns) == (True, "token;login")


def test_mix_adds_up_and_pivot_fills(spark):
    df = spark.createDataFrame(ROWS, TRACE)
    for row in summaries.destination_mix(df).collect():
        assert math.isclose(sum(row[f"destination_mix_{t}"] for t in ("mysql", "elk", "ipfs")), 1.0)
    row = summaries.pivot_destination(df).where("router = 'q_learning'").first()
    assert (row.mysql, row.elk, row.ipfs) == (0.0, 0.0, 100.0)


def test_rollup_pools_all_routers(spark):
    rows = summaries.summary_rollup(spark.createDataFrame(ROWS, TRACE)).collect()
    assert sorted((r.router or "", r.pooled, r.rows) for r in rows) == [
        ("", 1, 3),
        ("a2c", 0, 2),
        ("q_learning", 0, 1),
    ]


def test_ci95(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "router string, v double")
    rows = {r.router: r for r in summaries.ci95(df, ["router"], "v").collect()}
    assert math.isclose(rows["a"].ci95, 12.706 * math.sqrt(2) / math.sqrt(2), rel_tol=1e-9)
    assert rows["b"].ci95 is None
    many = spark.createDataFrame([("m", float(i % 2)) for i in range(101)], "router string, v double")
    s = many.agg(F.stddev_samp("v")).first()[0]
    half = summaries.ci95(many, ["router"], "v").first().ci95
    assert math.isclose(half / (s / math.sqrt(101)), 1.98397, abs_tol=1e-3)


def test_paired_delta_hides_leaking_runs(spark):
    schema = """router string, dataset_name string, mean_total_latency_ms double, energy_per_log_j double,
      destination_mix_ipfs double, sensitive_leakage long"""
    off = spark.createDataFrame([("a", "d", 5.0, 1.0, 0.1, 9), ("b", "d", 5.0, 1.0, 0.1, 9)], schema)
    on = spark.createDataFrame([("a", "d", 7.0, 1.5, 0.5, 0), ("b", "d", 7.0, 1.5, 0.5, 1)], schema)
    rows = {r.router: r for r in summaries.paired_delta(off, on).collect()}
    assert rows["a"].delta_mean_latency_ms == 2.0 and rows["a"].leak_free
    assert rows["b"].delta_mean_latency_ms is None and not rows["b"].leak_free


def test_sensitivity_by_one_and_two_parameters(spark):
    df = spark.createDataFrame([(1, "x", 2.0), (1, "y", 4.0), (2, "x", 6.0)], "p int, q string, v double")
    one = {r.p: r.v for r in summaries.sensitivity(df, "p", "v").collect()}
    assert one == {1: 3.0, 2: 6.0}
    two = {r.p: (r.x, r.y) for r in summaries.sensitivity(df, "p", "v", "q", ["x", "y"]).collect()}
    assert two == {1: (2.0, 4.0), 2: (6.0, None)}


def test_markdown_row(spark):
    df = spark.createDataFrame([("d", 3, 0.5, None)], "name string, n long, share double, gap double")
    line = results.markdown_rows(df, ["name", "n", "share", "gap"], 3).first()[0]
    assert line == "| d | 3 | 0.500 |  |"
