"""Energy from recorded counters and power samples."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.operators.ordered import asof_backward, blocked, neighbour, running


def counter_deltas(readings: DataFrame) -> DataFrame:
    """Increase of each counter since its previous reading.

    A counter that went down has wrapped: the increase is 0 and the row is
    marked with ``energy_valid = false``.
    """
    paired = neighbour(readings, ["host", "domain"], ["ts", "seq"], ["energy_uj"])
    change = F.col("energy_uj") - F.col("prev_energy_uj")
    return paired.where("prev_energy_uj IS NOT NULL").select(
        *readings.columns,
        F.greatest(F.lit(0), change).cast("long").alias("delta_uj"),
        (change >= 0).alias("energy_valid"),
    )


def host_energy(deltas: DataFrame, window_column: str) -> DataFrame:
    """Package, platform and estimated graphics energy per host and window.

    Only top-level package counters are added: a package counter already
    contains its sub-domains.
    """
    package = F.col("domain").startswith("package") & ~F.col("domain").contains(":")
    platform = F.col("domain") == "psys"
    package_uj = F.coalesce(F.sum(F.when(package, F.col("delta_uj"))), F.lit(0))
    platform_uj = F.coalesce(F.sum(F.when(platform, F.col("delta_uj"))), F.lit(0))
    return (
        deltas.groupBy("host", window_column)
        .agg(
            (package_uj / 1e6).alias("cpu_pkg_j"),
            (platform_uj / 1e6).alias("psys_j"),
            F.bool_or(platform).alias("has_psys"),
            F.bool_and("energy_valid").alias("energy_valid"),
        )
        .select(
            "host",
            window_column,
            "cpu_pkg_j",
            "psys_j",
            F.when(
                F.col("has_psys"), F.greatest(F.lit(0.0), F.col("psys_j") - F.col("cpu_pkg_j"))
            )
            .otherwise(0.0)
            .alias("gpu_est_j"),
            "energy_valid",
        )
    )


def cumulative_watts(samples: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Samples ``(host, ts, watts)`` in order: rank, area of the trapezoids
    before each sample, the one that follows, and the next sample.

    Every host also gets a row before all samples, so a time before the first
    sample still leads to it.
    """
    order = ["ts", "watts"]
    paired = blocked(samples, ["host"], order, block_rows)
    paired = neighbour(paired, ["host"], order, order, ahead=True)
    step = 0.5 * (F.col("watts") + F.col("next_watts")) * (F.col("next_ts") - F.col("ts"))
    summed = running(
        paired.withColumn("step", F.coalesce(step, F.lit(0.0))),
        ["host"],
        order,
        {"rank": F.lit(1), "area": F.col("step")},
    ).withColumn("area", F.col("area") - F.col("step"))
    columns = ["host", "ts", "watts", "next_ts", "next_watts", "step", "rank", "area"]
    start = samples.groupBy("host").agg(F.min(F.struct("ts", "watts")).alias("s")).select(
        "host",
        F.lit(float("-inf")).alias("ts"),
        F.lit(None).cast("double").alias("watts"),
        F.col("s.ts").alias("next_ts"),
        F.col("s.watts").alias("next_watts"),
        F.lit(0.0).alias("step"),
        F.lit(0).cast("long").alias("rank"),
        F.lit(0.0).alias("area"),
    )
    return summed.select(*columns).unionByName(start)


def energy_between(
    intervals: DataFrame, samples: DataFrame, period_s: float, block_rows: int | None = None
) -> DataFrame:
    """Joules of each interval ``(interval_id, host, t0, t1)`` by trapezoids.

    Samples within 1.5 periods around the interval count; times are clipped to
    the interval, watts are not interpolated at the clip, and both ends extend
    flat.  Without a sample near, the last reading before ``t1`` holds; without
    any reading the energy is 0.

    Each interval looks up four times in the running area of its host: the two
    ends and the two edges of its margin.  The area between the first and the
    last sample inside is a difference, the end pieces follow from the looked
    up samples and their successors.  Rows stay at four per interval and one
    per sample.
    """
    margin = 1.5 * period_s
    t0, t1 = F.col("t0"), F.col("t1")
    times = {"lo": t0 - margin, "a": t0, "b": t1, "hi": t1 + margin}
    probes = intervals.select(
        "interval_id",
        "host",
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("ts")) for k, t in times.items()])
        ).alias("_probe"),
    ).select("interval_id", "host", "_probe.kind", "_probe.ts")
    watts = cumulative_watts(samples, block_rows)
    values = ["ts", "watts", "next_ts", "next_watts", "step", "rank", "area"]
    found = asof_backward(
        probes,
        watts.withColumn("at", F.struct(*values)),
        "host",
        "ts",
        ["at"],
        tie="rank",
        before=F.col("kind") == "lo",
        block_rows=block_rows,
    )
    by_kind = found.groupBy("interval_id").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("at"))).alias(f"_{k}") for k in times]
    )
    rank = {k: F.coalesce(F.col(f"_{k}.rank"), F.lit(0)) for k in times}
    near, inside = rank["hi"] - rank["lo"], rank["b"] - rank["a"]
    before, behind = rank["a"] - rank["lo"] > 0, rank["hi"] - rank["b"] > 0
    length = t1 - t0
    left, right = F.col("_a"), F.col("_b")
    # From the start of the interval to the first sample inside.
    rise = F.when(before, 0.5 * (left["watts"] + left["next_watts"])).otherwise(left["next_watts"])
    # From the last sample inside to the end.
    fall = F.when(behind, 0.5 * (right["watts"] + right["next_watts"])).otherwise(right["watts"])
    through = (
        F.when(before & behind, 0.5 * (left["watts"] + right["next_watts"]))
        .when(before, left["watts"])
        .otherwise(right["next_watts"])
    )
    joules = F.when(
        inside > 0,
        rise * (left["next_ts"] - t0)
        + (right["area"] - left["area"] - left["step"])
        + fall * (t1 - right["ts"]),
    ).otherwise(through * length)
    hold = F.coalesce(F.greatest(F.lit(0.0), right["watts"]) * length, F.lit(0.0))
    return (
        intervals.join(by_kind, "interval_id", "left")
        .select(
            *intervals.columns,
            F.when(t1 > t0, near).otherwise(0).cast("long").alias("samples"),
            F.when(t1 <= t0, 0.0)
            .otherwise(F.greatest(F.lit(0.0), F.when(near > 0, joules).otherwise(hold)))
            .alias("energy_j"),
        )
    )
