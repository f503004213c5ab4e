"""Counters and power samples against plain loops."""

import datetime as dt
import math
import random

from tierflow.operators import energy


def plain_energy(samples, t0, t1, period):
    """Trapezoids over the samples near an interval, ends extended flat."""
    if t1 <= t0 or not samples:
        return 0.0
    near = sorted(s for s in samples if t0 - 1.5 * period <= s[0] <= t1 + 1.5 * period)
    if not near:
        before = [s for s in samples if s[0] <= t1]
        return max(0.0, max(before)[1]) * (t1 - t0) if before else 0.0
    points = near
    if near[0][0] > t0:
        points = [(t0, near[0][1]), *points]
    if near[-1][0] < t1:
        points = [*points, (t1, near[-1][1])]
    clipped = [(min(max(t, t0), t1), w) for t, w in points]
    pairs = zip(clipped, clipped[1:])
    return max(0.0, sum(0.5 * (a[1] + b[1]) * (b[0] - a[0]) for a, b in pairs))


def test_energy_between(spark):
    rng = random.Random(5)
    samples = {
        host: [(float(t), float(rng.randint(0, 90))) for t in sorted(rng.sample(range(2_000), n))]
        for host, n in (("h1", 150), ("h2", 12), ("h3", 0))
    }
    intervals = []
    for i in range(300):
        start = rng.uniform(-50, 2_100)
        length = rng.choice([0.0, -3.0, 2.0, 15.0, 120.0])
        intervals.append((i, rng.choice(["h1", "h2", "h3"]), start, start + length))
    rows = [(h, t, w) for h, values in samples.items() for t, w in values]
    got = energy.energy_between(
        spark.createDataFrame(intervals, "interval_id long, host string, t0 double, t1 double"),
        spark.createDataFrame(rows, "host string, ts double, watts double"),
        period_s=10.0,
        block_rows=40,
    ).collect()
    assert len(got) == len(intervals)
    for row in got:
        expected = plain_energy(samples[row.host], row.t0, row.t1, 10.0)
        assert math.isclose(row.energy_j, expected, abs_tol=1e-6), row


READING = "host string, domain string, seq long, ts timestamp_ntz, energy_uj long"


def readings(*values):
    start = dt.datetime(2024, 1, 1)
    return [
        ("h", domain, i, start + dt.timedelta(hours=10 * step), uj)
        for i, (domain, step, uj) in enumerate(values)
    ]


def test_counter_wrap_is_zero_and_invalid(spark):
    df = spark.createDataFrame(
        readings(("package-0", 0, 100), ("package-0", 1, 400), ("package-0", 9, 50), ("package-0", 10, 80)),
        READING,
    )
    rows = energy.counter_deltas(df).orderBy("seq").collect()
    assert [(r.delta_uj, r.energy_valid) for r in rows] == [(300, True), (0, False), (30, True)]


def test_only_top_level_packages_count(spark):
    df = spark.createDataFrame(
        readings(
            *[(d, s, s * 1_000_000) for s in (0, 1) for d in ("package-0", "package-0:core", "package-1", "dram")],
            ("psys", 0, 0),
            ("psys", 1, 5_000_000),
        ),
        READING,
    )
    from pyspark.sql import functions as F

    deltas = energy.counter_deltas(df).withColumn("day", F.lit(1))
    row = energy.host_energy(deltas, "day").first()
    assert (row.cpu_pkg_j, row.psys_j, row.gpu_est_j) == (2.0, 5.0, 3.0)
    without = energy.host_energy(deltas.where("domain <> 'psys'"), "day").first()
    assert (without.psys_j, without.gpu_est_j) == (0.0, 0.0)


def test_energy_rows_stay_linear(spark):
    """Dense samples and long intervals: no row per pair."""
    from pyspark.sql import functions as F

    samples = spark.range(3_000).select(
        F.lit("h").alias("host"), F.col("id").cast("double").alias("ts"), (F.col("id") % 7).cast("double").alias("watts")
    )
    intervals = spark.range(300).select(
        F.col("id").alias("interval_id"), F.lit("h").alias("host"), F.lit(1.0).alias("t0"), F.lit(2_900.0).alias("t1")
    )
    out = energy.energy_between(intervals, samples, period_s=1.0)
    rows = out.collect()
    assert {r.samples for r in rows} == {2_902} and len({round(r.energy_j, 6) for r in rows}) == 1
    expected = plain_energy([(float(i), float(i % 7)) for i in range(3_000)], 1.0, 2_900.0, 1.0)
    assert math.isclose(rows[0].energy_j, expected, abs_tol=1e-6)
