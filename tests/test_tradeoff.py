"""The trade-off curve against the argmin at every weight."""

import random

import pytest
from pyspark.sql import functions as F

from tierflow.operators.tradeoff import envelope, look_up, tradeoff_curve
from tierflow.operators.trace import outcomes_by_log
from tierflow.schemas import TIERS

SCHEMA = (
    "log_id long, destination string, success boolean, routing_latency_ms double, "
    "backend_write_latency_ms double, energy_cpu_pkg_j double"
)


def made(seed, logs):
    """Small whole numbers, so that ties and crossings in one point are many."""
    draw = random.Random(seed)
    return {
        i: [(float(draw.randint(0, 6)), float(draw.randint(0, 3))) for _ in TIERS] for i in range(logs)
    }


def frame(spark, costs):
    rows = [
        (i, t, True, 0.0, latency, energy)
        for i, lines in costs.items()
        for t, (latency, energy) in zip(TIERS, lines, strict=True)
    ]
    return outcomes_by_log(spark.createDataFrame(rows, SCHEMA))


def plain(costs, weight):
    """Means just above ``weight``."""
    picked = []
    for lines in costs.values():
        at = [(latency + (weight + 1e-7) * energy, energy, k) for k, (latency, energy) in enumerate(lines)]
        picked.append(lines[min(at)[2]])
    return [sum(p[i] for p in picked) / len(picked) for i in (0, 1)]


@pytest.mark.parametrize("block_rows", [None, 3])
def test_every_change_and_every_weight(spark, block_rows):
    costs = made(5, 60)
    curve = tradeoff_curve(frame(spark, costs), block_rows=block_rows)
    rows = curve.orderBy("weight").collect()
    points = {
        (b[0] - a[0]) / (a[1] - b[1])
        for lines in costs.values()
        for a in lines
        for b in lines
        if b[1] < a[1] and b[0] > a[0]
    }
    points = sorted(points | {0.0})
    assert {r.weight for r in rows} <= set(points) and {r.logs for r in rows} == {60}
    for row in rows:
        assert [row.mean_latency_ms, row.mean_energy_j] == pytest.approx(plain(costs, row.weight))
    # A crossing that is not on the curve changes nothing.
    listed = {r.weight for r in rows}
    for before, point in zip(points, points[1:], strict=False):
        if point not in listed:
            assert plain(costs, point) == pytest.approx(plain(costs, before))
    asked = [0.0, 0.3, 1.0, 2.5, 1e9]
    for row in look_up(curve, asked).collect():
        assert [row.mean_latency_ms, row.mean_energy_j] == pytest.approx(plain(costs, row.weight))


def test_keys_missing_outcomes_and_empty_tables(spark):
    wide = frame(spark, {1: [(1.0, 4.0), (3.0, 2.0), (9.0, 1.0)]})
    steps = [(r.weight, r.tier) for r in envelope(wide).orderBy("weight").collect()]
    assert steps == [(0.0, "mysql"), (1.0, "elk"), (6.0, "ipfs")]
    # A tier without an outcome is a failed write of 1000 ms and no energy.
    lone = outcomes_by_log(spark.createDataFrame([(1, "elk", True, 1.0, 2.0, 4.0)], SCHEMA))
    steps = [(r.weight, r.tier, r.latency) for r in envelope(lone).orderBy("weight").collect()]
    assert steps == [(0.0, "elk", 3.0), (997 / 4, "mysql", 1000.0)]
    assert tradeoff_curve(frame(spark, {}).limit(0)).collect() == []
    keyed = frame(spark, made(2, 20)).withColumn("k", F.col("log_id") % 2)
    curve = tradeoff_curve(keyed, ["k"])
    found = {(r.k, r.weight): r.mean_latency_ms for r in look_up(curve, [0.5], "k").collect()}
    for k in (0, 1):
        part = {i: c for i, c in made(2, 20).items() if i % 2 == k}
        assert found[k, 0.5] == pytest.approx(plain(part, 0.5)[0])
