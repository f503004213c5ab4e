"""Aggregates over traces."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierflow.functions.cost import (
    REPORT_KG_PER_KWH,
    RUN_KG_PER_KWH,
    carbon_kg,
    watt_hours,
)
from tierflow.operators.joins import join_keys
from tierflow.operators.ordered import rolling, rolling_medians
from tierflow.operators.percentiles import exact_percentiles, percentile_columns
from tierflow.runtime import cut_lineage
from tierflow.schemas import TIERS

RUN = ("router", "dataset_name")

# Two-sided 95 % quantiles of Student's t for 1 to 30 degrees.
T_975 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228,
    2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086,
    2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)
Z_975 = 1.959964


def share(condition: Column) -> Column:
    """Fraction of rows that meet a condition; an absent value counts 0."""
    return F.avg(condition.cast("double"))


def or_default(numerator: Column, denominator: Column, default: float) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(default)


def destination_shares(prefix: str = "destination_mix_") -> list[Column]:
    return [share(F.col("destination") == t).alias(prefix + t) for t in TIERS]


def compliance_columns() -> list[Column]:
    sensitive = F.col("sensitive")
    immutable = F.col("destination") == "ipfs"
    total = F.count_if(sensitive)
    kept = F.count_if(sensitive & immutable)
    leaked = F.count_if(sensitive & ~immutable)
    other = F.count_if(~sensitive)
    return [
        total.alias("sensitive_total"),
        kept.alias("sensitive_to_ipfs"),
        or_default(kept, total, 1.0).alias("sensitive_coverage"),
        leaked.alias("sensitive_leakage"),
        or_default(leaked, total, 0.0).alias("leakage_rate"),
        or_default(F.count_if(~sensitive & immutable), other, 0.0).alias(
            "non_sensitive_ipfs_fraction"
        ),
        F.when(leaked == 0, 1.0).otherwise(0.0).alias("compliance_score"),
    ]


def additive_columns() -> list[Column]:
    """Every combined metric that needs no order: one pass, map-side combine."""
    return [
        F.count("*").alias("rows"),
        F.avg("total_latency_ms").alias("mean_total_latency_ms"),
        share(F.col("success")).alias("success_rate"),
        share(F.col("sensitive")).alias("sensitive_fraction"),
        F.avg("energy_cpu_pkg_j").alias("energy_per_log_j"),
        *destination_shares(),
        *compliance_columns(),
    ]


# Column order of the combined summary.
COMBINED_COLUMNS = (
    "rows",
    "mean_total_latency_ms",
    "median_total_latency_ms",
    "p95_total_latency_ms",
    "success_rate",
    "sensitive_fraction",
    "energy_per_log_j",
    *[f"destination_mix_{t}" for t in TIERS],
    "sensitive_total",
    "sensitive_to_ipfs",
    "sensitive_coverage",
    "sensitive_leakage",
    "leakage_rate",
    "non_sensitive_ipfs_fraction",
    "compliance_score",
)


def with_percentiles(
    trace: DataFrame,
    keys: Sequence[str],
    measures: Sequence[Column],
    named: Mapping[str, tuple[str, float]],
) -> DataFrame:
    """Aggregates and exact percentiles per key.

    ``named`` maps an output column to the column it ranks and its level.  The
    trace is stored once; aggregates and ranks are read from there.  Both have
    one row per key and are joined.
    """
    stored = cut_lineage(trace)
    ranked = percentile_columns(stored, keys, named)
    return join_keys(stored.groupBy(*keys).agg(*measures), ranked, keys)


def combined_summary(
    trace: DataFrame, keys: Sequence[str] = ("dataset_name",)
) -> DataFrame:
    """All combined metrics per key, pooled over everything else."""
    named = {
        "median_total_latency_ms": ("total_latency_ms", 0.5),
        "p95_total_latency_ms": ("total_latency_ms", 0.95),
    }
    summary = with_percentiles(trace, keys, additive_columns(), named)
    return summary.select(*keys, *COMBINED_COLUMNS)


def summary_rollup(trace: DataFrame) -> DataFrame:
    """The order-free metrics per dataset and router, and per dataset."""
    return trace.groupingSets(
        [["dataset_name", "router"], ["dataset_name"]], "dataset_name", "router"
    ).agg(F.grouping("router").cast("int").alias("pooled"), *additive_columns())


def run_summary(
    trace: DataFrame,
    kg_per_kwh: float = RUN_KG_PER_KWH,
    compliance: bool = False,
    patterns: Sequence[str] = (),
) -> DataFrame:
    """One row per run.  Elapsed time is the sum of latencies: one log at a time."""
    n = F.count("*")
    wh = watt_hours(F.sum("energy_cpu_pkg_j"))
    seconds = F.sum("total_latency_ms") / 1000.0
    return trace.groupBy(*RUN).agg(
        n.alias("LogsProcessed"),
        wh.alias("TotalEnergyWh"),
        (wh / n).alias("EnergyPerLogWh"),
        carbon_kg(wh, kg_per_kwh).alias("CarbonEmissionsKg"),
        F.avg("total_latency_ms").alias("AvgLatencyMs"),
        or_default(n, seconds, 0.0).alias("ThroughputLogsPerSec"),
        F.lit(kg_per_kwh).alias("EmissionsFactorKgPerKWh"),
        F.lit(compliance).alias("ComplianceEnabled"),
        F.lit(";".join(patterns) if compliance else "").alias("CompliancePatterns"),
    )


def results_summary(
    trace: DataFrame, kg_per_kwh: float = REPORT_KG_PER_KWH
) -> DataFrame:
    """Report over a result set, sorted by dataset and method."""
    n = F.count("*")
    wh = watt_hours(F.sum(F.coalesce("energy_cpu_pkg_j", F.lit(0.0))))
    seconds = F.sum("total_latency_ms") / 1000.0
    measures = [
        n.alias("LogsProcessed"),
        wh.alias("TotalEnergyWh"),
        (wh / n).alias("EnergyPerLogWh"),
        carbon_kg(wh, kg_per_kwh).alias("CarbonEmissionsKg"),
        F.avg("total_latency_ms").alias("AvgLatencyMs"),
        or_default(n, seconds, 0.0).alias("ThroughputLogsPerSec"),
        share(F.col("success")).alias("SuccessRate"),
    ]
    return (
        with_percentiles(
            trace, RUN, measures, {"P50LatencyMs": ("total_latency_ms", 0.5)}
        )
        .withColumnsRenamed({"router": "Method", "dataset_name": "Dataset"})
        .orderBy("Dataset", "Method")
    )


def tail_latency(
    trace: DataFrame,
    percents: Sequence[int] = (50, 75, 90, 95, 99),
    keys: Sequence[str] = RUN,
) -> DataFrame:
    levels = [p / 100 for p in percents]
    rows = exact_percentiles(trace, keys, "total_latency_ms", levels)
    return rows.select(
        *keys,
        F.round(F.col("p") * 100).cast("int").alias("percent"),
        F.col("percentile").alias("latency_ms"),
    )


def destination_mix(trace: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    return trace.groupBy(*keys).agg(*destination_shares())


def compliance_metrics(trace: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    return trace.groupBy(*keys).agg(*compliance_columns())


def destination_percent(trace: DataFrame) -> DataFrame:
    """Percent of a run's logs at each tier, tiers without logs left out."""
    run = Window.partitionBy(*RUN)
    return (
        trace.groupBy(*RUN, "destination")
        .agg(F.count("*").alias("logs"))
        .withColumn("percent", F.col("logs") * 100.0 / F.sum("logs").over(run))
    )


def pivot_destination(trace: DataFrame) -> DataFrame:
    """Router by tier matrix of percentages per dataset, 0 where a tier is unused."""
    return (
        destination_percent(trace)
        .groupBy(*RUN)
        .pivot("destination", list(TIERS))
        .agg(F.sum("percent"))
        .na.fill(0.0, list(TIERS))
    )


def per_backend_metrics(trace: DataFrame) -> DataFrame:
    """Latency and energy by router and tier, with the tier ``all`` for every row."""
    tiers = trace.withColumn("tier", F.explode(F.array(F.col("destination"), F.lit("all"))))
    keys = ["router", "tier"]
    measures = [
        F.count("*").alias("logs"),
        F.avg("total_latency_ms").alias("mean_latency_ms"),
        F.avg("energy_cpu_pkg_j").alias("mean_energy_j"),
        share(F.col("compliance_forced")).alias("override_rate"),
    ]
    named = {
        "p95_latency_ms": ("total_latency_ms", 0.95),
        "p99_latency_ms": ("total_latency_ms", 0.99),
        "p95_energy_j": ("energy_cpu_pkg_j", 0.95),
        "p99_energy_j": ("energy_cpu_pkg_j", 0.99),
    }
    return with_percentiles(tiers, keys, measures, named)


RUN_METRICS = ("AvgLatencyMs", "ThroughputLogsPerSec", "EnergyPerLogWh")


def pivot_metrics(summary: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """Router by dataset matrix of the three run metrics, two decimals.

    The dataset names are given, so the pivot needs no extra pass.
    """
    return (
        summary.groupBy("router")
        .pivot("dataset_name", list(datasets))
        .agg(*[F.round(F.avg(m), 2).alias(m) for m in RUN_METRICS])
    )


def is_direct() -> Column:
    return F.col("router").contains("direct")


def improvement_percent(summary: DataFrame) -> DataFrame:
    """How far hybrid routers stay below the direct ones, in percent."""

    def change(metric: str) -> Column:
        direct = F.avg(F.when(is_direct(), F.col(metric)))
        hybrid = F.avg(F.when(~is_direct(), F.col(metric)))
        return ((direct - hybrid) / direct * 100.0).alias(metric)

    return summary.groupBy("dataset_name").agg(*[change(m) for m in RUN_METRICS])


def system_type() -> Column:
    return F.when(is_direct(), "Single-tier").otherwise("Hybrid")


def energy_by_system_type(summary: DataFrame) -> DataFrame:
    """Five-number summary of energy per log over runs, by system type.

    The input has one row per run, so the plain percentile is safe.
    """
    at = [0.0, 0.25, 0.5, 0.75, 1.0]
    names = ["lowest", "lower_quartile", "median", "upper_quartile", "highest"]
    return (
        summary.withColumn("system_type", system_type())
        .groupBy("system_type")
        .agg(
            F.count("*").alias("runs"),
            *[F.percentile("EnergyPerLogWh", F.lit(p)).alias(n) for p, n in zip(at, names)],
        )
    )


def energy_by_run(summary: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """Energy per log by router, one column per dataset, 0 where a run is missing."""
    return (
        summary.groupBy("router")
        .pivot("dataset_name", list(datasets))
        .agg(F.max("EnergyPerLogWh"))
        .na.fill(0.0, list(datasets))
        .withColumn("system_type", system_type())
    )


def scaling_by_size(summary: DataFrame, sizes: DataFrame) -> DataFrame:
    """Run metrics against dataset size, smallest first.

    ``sizes`` has one row per dataset, like the summary it is joined to.
    """
    return summary.join(sizes, "dataset_name", "left").select(
        "router", "dataset_name", "log_count", "AvgLatencyMs", "ThroughputLogsPerSec"
    ).orderBy("router", "log_count")


def sensitivity(
    df: DataFrame, row: str, value: str, column: str | None = None, levels: Sequence = ()
) -> DataFrame:
    """Mean of a metric by one parameter, or as a matrix by two."""
    grouped = df.groupBy(row)
    if column is not None:
        grouped = grouped.pivot(column, list(levels))
    return grouped.agg(F.avg(value).alias(value) if column is None else F.avg(value))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and nulls of each column, in one pass."""
    counted = df.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("n_nulls"))
            for i, c in enumerate(columns)
        ]
    )
    return counted.select("n_rows", F.explode(pairs).alias("_p")).select("_p.*", "n_rows")


def run_inventory(summary: DataFrame) -> DataFrame:
    """Shape of a run table: rows, columns, distinct routers and datasets."""
    names = [F.array_join(F.sort_array(F.collect_set(c)), ",") for c in RUN]
    return summary.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(summary.columns)).alias("n_columns"),
        names[0].alias("routers"),
        names[1].alias("datasets"),
    )


def t_quantile(degrees: Column) -> Column:
    """97.5 % quantile of Student's t; above 30 degrees the usual expansion."""
    table = F.array(*[F.lit(t) for t in T_975])
    z = Z_975
    tail = z + (z**3 + z) / (4.0 * degrees) + (5 * z**5 + 16 * z**3 + 3 * z) / (
        96.0 * degrees * degrees
    )
    return F.when(degrees <= len(T_975), F.get(table, degrees.cast("int") - 1)).otherwise(tail)


def ci95(estimates: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean over runs with a 95 % t-interval; no interval below two runs."""
    k = F.count(value)
    half = t_quantile(F.col("runs") - 1) * F.col("_s") / F.sqrt(F.col("runs").cast("double"))
    return (
        estimates.groupBy(*keys)
        .agg(k.alias("runs"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
        .select(*keys, "runs", "mean", F.when(F.col("runs") >= 2, half).alias("ci95"))
    )


def delta_vs_best_direct(
    summary: DataFrame, metrics: Sequence[str] = ("AvgLatencyMs", "EnergyPerLogWh")
) -> DataFrame:
    """Relative change of each run against the best direct run of its dataset."""
    dataset = Window.partitionBy("dataset_name")

    def change(metric: str) -> Column:
        best = F.min(F.when(is_direct(), F.col(metric))).over(dataset)
        return ((F.col(metric) - best) / best * 100.0).alias(f"{metric}_delta_pct")

    return summary.select(*RUN, *[change(m) for m in metrics])


def paired_delta(baseline: DataFrame, enforced: DataFrame) -> DataFrame:
    """Change of each run when the override is switched on.

    A run that leaks with the override on is not comparable: its deltas are
    null.  Both sides have one row per run.
    """
    metrics = {
        "delta_mean_latency_ms": "mean_total_latency_ms",
        "delta_energy_per_log_j": "energy_per_log_j",
        "delta_ipfs_share": "destination_mix_ipfs",
    }
    off, on = baseline.alias("off"), enforced.alias("on")
    sound = F.col("on.sensitive_leakage") == 0
    return off.join(on, list(RUN)).select(
        *RUN,
        sound.alias("leak_free"),
        *[F.when(sound, F.col(f"on.{m}") - F.col(f"off.{m}")).alias(n) for n, m in metrics.items()],
    )


def paired_by_log(both: DataFrame) -> DataFrame:
    """Change per log when the override is switched on, summed up per run.

    ``both`` holds each log with ``compliance`` off and on.  Replayed traces
    are spread by log id already, so pairing them moves nothing.
    """

    def side(on: bool, column: str) -> Column:
        return F.max(F.when(F.col("compliance") == on, F.col(column)))

    pairs = both.groupBy(*RUN, "log_id").agg(
        (side(True, "total_latency_ms") - side(False, "total_latency_ms")).alias("_ms"),
        (side(True, "energy_cpu_pkg_j") - side(False, "energy_cpu_pkg_j")).alias("_j"),
        F.max(F.col("compliance_forced").cast("int")).alias("_moved"),
    )
    return pairs.groupBy(*RUN).agg(
        F.count("*").alias("pairs"),
        F.sum("_moved").alias("moved"),
        F.avg("_ms").alias("mean_delta_latency_ms"),
        F.stddev_samp("_ms").alias("std_delta_latency_ms"),
        F.avg("_j").alias("mean_delta_energy_j"),
    )


def latency_energy_corr(trace: DataFrame) -> DataFrame:
    return trace.groupBy(*RUN).agg(F.corr("total_latency_ms", "energy_cpu_pkg_j").alias("corr"))


def warmup_boundary(
    positioned: DataFrame, keys: Sequence[str], window: int = 200, tolerance: float = 0.05
) -> DataFrame:
    """First operation whose rolling median is within ``tolerance`` of the
    median of the window before; null if a run never settles.

    ``positioned`` carries ``position``, the rank of the row in its run.
    """

    smooth = rolling_medians(positioned, keys, "position", "total_latency_ms", window)
    settled = (F.col("position") >= 2 * window) & (
        F.abs(F.col("now") - F.col("before")) <= tolerance * F.col("before")
    )
    return smooth.groupBy(*keys).agg(
        F.count("*").alias("logs"),
        F.min(F.when(settled, F.col("position"))).alias("boundary"),
    )


def energy_anomalies(
    positioned: DataFrame, keys: Sequence[str], value: str, window: int = 200, sigmas: float = 6.0
) -> DataFrame:
    """Rows far above the mean of the window before them."""
    smooth = rolling(
        positioned,
        keys,
        "position",
        window,
        {
            "window_mean": lambda w: F.avg(value).over(w.rowsBetween(-window, -1)),
            "window_std": lambda w: F.stddev_pop(value).over(w.rowsBetween(-window, -1)),
        },
    )
    limit = F.col("window_mean") + sigmas * F.col("window_std")
    return smooth.where((F.col("position") > window) & (F.col(value) > limit))
