"""Aggregates over the replayed traces of several routers."""

from pyspark.sql import functions as F

from tierflow.operators import cbr, choices, routing, summaries
from tierflow.operators.ordered import positions
from tierflow.operators.percentiles import exact_percentiles, exact_percentiles_of
from tierflow.operators.tradeoff import look_up, tradeoff_curve
from tierflow.operators.trace import decide, outcomes_by_log, parts_by_rows, replay
from tierflow.plans.learning import fit_tabular, learned_decisions, observed_logs, q_decisions
from tierflow.plans.registry import CHECKS, query, rounded
from tierflow.plans.sql import ADDITIVE, COMBINED, STATIC, check
from tierflow.runtime import cut_lineage, fresh_folder
from tierflow.schemas import TIERS
from tierflow.sources import results, tables

# Log sources of the test tables; each is one data set.
DATASETS = ("Apache", "HDFS", "Linux", "OpenSSH", "Spark")

# Columns whose values are far below one.
WATT_HOURS = ("TotalEnergyWh", "EnergyPerLogWh", "CarbonEmissionsKg")


def rule_routers():
    return {"static": routing.route_static} | {
        f"direct_{t}": routing.get_router(f"direct_{t}") for t in TIERS
    }


def replayed(spark, directory, compliance=(False,), learned=True, with_cheapest=False):
    """Traces of the rule routers and, if asked for, of the adaptive one."""
    logs, outcomes = tables.logs(spark, directory), tables.observations(spark, directory)
    routers = rule_routers()
    if learned:
        routers["cbr"] = cbr.fit_cbr(logs, outcomes).route
    return replay(
        logs,
        outcomes,
        routers,
        F.col("LogSource"),
        compliance,
        with_cheapest=with_cheapest,
        partitions=parts_by_rows(logs),
    )


def run_table(spark, directory):
    return summaries.run_summary(replayed(spark, directory))


# ---- summaries -------------------------------------------------------------
RUN_COLUMNS = """n AS LogsProcessed, (round(wh + 1e-14, 12) + 0e0) AS TotalEnergyWh, (round(per_log + 1e-14, 12) + 0e0) AS EnergyPerLogWh,
  (round(wh / 1000e0 * {kg} + 1e-14, 12) + 0e0) AS CarbonEmissionsKg, (round(lat + 1e-8, 6) + 0e0) AS AvgLatencyMs,
  (round(thr + 1e-8, 6) + 0e0) AS ThroughputLogsPerSec"""


@query(
    "run_summary",
    check(
        f"""SELECT router, dataset_name, {RUN_COLUMNS.format(kg='0.233e0')}, 0.233e0 AS EmissionsFactorKgPerKWh,
  FALSE AS ComplianceEnabled, '' AS CompliancePatterns FROM runs""",
        "runs",
    ),
)
def run_summary(spark, directory):
    return rounded(run_table(spark, directory), fine=WATT_HOURS)


@query(
    "results_summary",
    check(
        """SELECT router AS Method, dataset_name AS Dataset, count(*) AS LogsProcessed,
  (round(sum(energy_cpu_pkg_j) / 3600e0 + 1e-14, 12) + 0e0) AS TotalEnergyWh,
  (round(sum(energy_cpu_pkg_j) / 3600e0 / count(*) + 1e-14, 12) + 0e0) AS EnergyPerLogWh,
  (round(sum(energy_cpu_pkg_j) / 3600e0 / 1000e0 * 0.4e0 + 1e-14, 12) + 0e0) AS CarbonEmissionsKg,
  (round(avg(total_latency_ms) + 1e-8, 6) + 0e0) AS AvgLatencyMs,
  (round(quantile_cont(total_latency_ms, 0.5) + 1e-8, 6) + 0e0) AS P50LatencyMs,
  (round(count(*) / (sum(total_latency_ms) / 1000e0) + 1e-8, 6) + 0e0) AS ThroughputLogsPerSec,
  (round(avg(success::INT) + 1e-8, 6) + 0e0) AS SuccessRate
FROM base GROUP BY router, dataset_name ORDER BY Dataset, Method""",
        "base",
    ),
)
def results_summary(spark, directory):
    return rounded(summaries.results_summary(
            replayed(spark, directory)
        ), fine=WATT_HOURS)


@query(
    "results_files",
    CHECKS["results_summary"],
)
def results_files(spark, directory):
    """The same report from result files, a summary file among them."""
    folder = fresh_folder(spark, "results")
    runs = replayed(spark, directory).drop("compliance")
    name = F.concat_ws("_", "router", "dataset_name")
    named = runs.withColumn("name", F.concat(name, F.lit(".csv")))
    named.write.option("header", True).partitionBy("name").csv(f"{folder}/runs")
    summary = F.lit("summary_static_Apache.csv").alias("name")
    run_table(spark, directory).limit(1).withColumn("name", summary).write.option(
        "header", True
    ).mode("append").partitionBy("name").csv(f"{folder}/runs")
    trace = results.read_trace_csv(spark, f"{folder}/runs/*/*.csv")
    return rounded(summaries.results_summary(trace), fine=WATT_HOURS)


@query(
    "combined_summary",
    check(f"SELECT dataset_name, {COMBINED} FROM base GROUP BY dataset_name", "base"),
)
def combined_summary(spark, directory):
    """Pools the five routers, so a data set may have five rows per log."""
    return rounded(summaries.combined_summary(replayed(spark, directory)))


@query(
    "summary_rollup",
    check(
        f"""SELECT dataset_name, router, CAST(grouping(router) AS INT) AS pooled, {ADDITIVE} FROM base
GROUP BY GROUPING SETS ((dataset_name, router), (dataset_name))""",
        "base",
    ),
)
def summary_rollup(spark, directory):
    return rounded(summaries.summary_rollup(replayed(spark, directory)))


MARKDOWN = ("dataset_name", *summaries.COMBINED_COLUMNS)
MARKDOWN_DOUBLES = {
    c
    for c in summaries.COMBINED_COLUMNS
    if c not in ("rows", "sensitive_total", "sensitive_to_ipfs", "sensitive_leakage")
}


@query(
    "summary_markdown",
    check(
        "SELECT '| ' || concat_ws(' | ', "
        + ", ".join(
            f"CAST(CAST({c} AS DECIMAL(28, 6)) AS VARCHAR)"
            if c in MARKDOWN_DOUBLES
            else f"CAST({c} AS VARCHAR)"
            for c in MARKDOWN
        )
        + f") || ' |' AS line FROM (SELECT dataset_name, {COMBINED} FROM base GROUP BY dataset_name)",
        "base",
    ),
)
def summary_markdown(spark, directory):
    summary = rounded(summaries.combined_summary(replayed(spark, directory)))
    return results.markdown_rows(summary, MARKDOWN)


def summary_side(name, source):
    extra = ", (round(avg(compliance_forced::INT) + 1e-8, 6) + 0e0) AS override_rate" if name == "compliance" else ""
    missing = "" if extra else ", CAST(NULL AS DOUBLE) AS override_rate"
    return f"""SELECT 'eval_{name}/combined_summary_' || dataset_name || '.csv' AS path, dataset_name AS dataset,
  {str(name == 'compliance').upper()} AS compliance, {ADDITIVE}{extra}{missing} FROM {source} GROUP BY dataset_name"""


@query(
    "merge_summaries",
    check(
        summary_side("baseline", "base") + "\nUNION ALL " + summary_side("compliance", "enforced"),
        "base",
        "enforced",
    ),
)
def merge_summaries(spark, directory):
    both = replayed(spark, directory, (False, True))

    def side(name, enforced):
        path = F.concat(F.lit(f"eval_{name}/combined_summary_"), "dataset_name", F.lit(".csv"))
        measures = summaries.additive_columns()
        if enforced:
            rate = summaries.share(F.col("compliance_forced"))
            measures.append(rate.alias("override_rate"))
        rows = both.where(F.col("compliance") == enforced).groupBy("dataset_name").agg(*measures)
        return rows.withColumn("path", path).drop("dataset_name")

    merged = results.merge_summaries([side("baseline", False), side("compliance", True)])
    return rounded(merged)


# ---- percentiles and mixes -------------------------------------------------
@query(
    "latency_percentiles",
    check(
        """SELECT router, count(*) AS n, p, (round(quantile_cont(total_latency_ms, p) + 1e-8, 6) + 0e0) AS percentile
FROM base CROSS JOIN (VALUES (0.0), (0.25), (0.5), (0.9), (0.999), (1.0)) AS t(p) GROUP BY router, p""".replace(
            "quantile_cont(total_latency_ms, p)",
            "CASE p WHEN 0.0 THEN min(total_latency_ms) WHEN 0.25 THEN quantile_cont(total_latency_ms, 0.25)"
            " WHEN 0.5 THEN quantile_cont(total_latency_ms, 0.5) WHEN 0.9 THEN quantile_cont(total_latency_ms, 0.9)"
            " WHEN 0.999 THEN quantile_cont(total_latency_ms, 0.999) ELSE max(total_latency_ms) END",
        ).replace("n, p,", "n, CAST(p AS DOUBLE) AS p,"),
        "base",
    ),
)
def latency_percentiles(spark, directory):
    rows = exact_percentiles(
        replayed(spark, directory),
        ["router"],
        "total_latency_ms",
        [0.0, 0.25, 0.5, 0.9, 0.999, 1.0],
    )
    return rounded(rows)


@query(
    "tail_latency",
    check(
        "\nUNION ALL ".join(
            f"""SELECT router, dataset_name, {p} AS percent, (round(quantile_cont(total_latency_ms, {p / 100}) + 1e-8, 6) + 0e0) AS latency_ms
FROM base GROUP BY router, dataset_name"""
            for p in (50, 75, 90, 95, 99)
        ),
        "base",
    ),
)
def tail_latency(spark, directory):
    return rounded(summaries.tail_latency(replayed(spark, directory)))


@query(
    "destination_mix",
    check(
        """SELECT router, dataset_name, (round(avg((destination = 'mysql')::INT) + 1e-8, 6) + 0e0) AS destination_mix_mysql,
  (round(avg((destination = 'elk')::INT) + 1e-8, 6) + 0e0) AS destination_mix_elk,
  (round(avg((destination = 'ipfs')::INT) + 1e-8, 6) + 0e0) AS destination_mix_ipfs FROM base GROUP BY router, dataset_name""",
        "base",
    ),
)
def destination_mix(spark, directory):
    return rounded(summaries.destination_mix(replayed(spark, directory)))


PERCENT_SQL = """SELECT router, dataset_name, destination, count(*) AS logs,
  count(*) * 100e0 / sum(count(*)) OVER (PARTITION BY router, dataset_name) AS percent
FROM base GROUP BY router, dataset_name, destination"""


@query(
    "destination_pct",
    check(f"SELECT * REPLACE ((round(percent + 1e-8, 6) + 0e0) AS percent) FROM ({PERCENT_SQL})", "base"),
)
def destination_pct(spark, directory):
    return rounded(summaries.destination_percent(replayed(spark, directory)))


@query(
    "pivot_destination",
    check(
        f"""SELECT router, dataset_name, {', '.join(
            f"(round(coalesce(sum(percent) FILTER (WHERE destination = '{t}'), 0e0) + 1e-8, 6) + 0e0) AS {t}" for t in TIERS)}
FROM ({PERCENT_SQL}) GROUP BY router, dataset_name""",
        "base",
    ),
)
def pivot_destination(spark, directory):
    return rounded(summaries.pivot_destination(replayed(spark, directory)))


@query(
    "compliance_metrics",
    check(
        "SELECT * FROM (\n"
        + "\nUNION ALL ".join(
            f"SELECT router, dataset_name, {on} AS compliance, "
            + ADDITIVE[ADDITIVE.index("count(*) FILTER (WHERE sensitive) AS") :]
            + f" FROM {source} GROUP BY router, dataset_name"
            for on, source in (("FALSE", "base"), ("TRUE", "enforced"))
        )
        + ")",
        "base",
        "enforced",
    ),
)
def compliance_metrics(spark, directory):
    both = replayed(spark, directory, (False, True))
    return rounded(
        summaries.compliance_metrics(both, ["router", "dataset_name", "compliance"])
    )


@query(
    "per_backend_metrics",
    check(
        """SELECT router, tier, count(*) AS logs, (round(avg(total_latency_ms) + 1e-8, 6) + 0e0) AS mean_latency_ms,
  (round(avg(energy_cpu_pkg_j) + 1e-8, 6) + 0e0) AS mean_energy_j, (round(avg(compliance_forced::INT) + 1e-8, 6) + 0e0) AS override_rate,
  (round(quantile_cont(total_latency_ms, 0.95) + 1e-8, 6) + 0e0) AS p95_latency_ms,
  (round(quantile_cont(total_latency_ms, 0.99) + 1e-8, 6) + 0e0) AS p99_latency_ms,
  (round(quantile_cont(energy_cpu_pkg_j, 0.95) + 1e-8, 6) + 0e0) AS p95_energy_j,
  (round(quantile_cont(energy_cpu_pkg_j, 0.99) + 1e-8, 6) + 0e0) AS p99_energy_j
FROM (SELECT *, destination AS tier FROM enforced UNION ALL SELECT *, 'all' FROM enforced) GROUP BY router, tier""",
        "enforced",
    ),
)
def per_backend_metrics(spark, directory):
    return rounded(summaries.per_backend_metrics(
            replayed(spark, directory, (True,))
        ))


# ---- run tables ------------------------------------------------------------
METRIC_SQL = {"AvgLatencyMs": "lat", "ThroughputLogsPerSec": "thr", "EnergyPerLogWh": "per_log"}


@query(
    "pivot_metrics",
    check(
        "SELECT router, "
        + ", ".join(
            f"""round(avg({c}) FILTER (WHERE dataset_name = '{d}'), 2) AS "{d}_{m}\""""
            for d in DATASETS
            for m, c in METRIC_SQL.items()
        )
        + " FROM runs GROUP BY router",
        "runs",
    ),
)
def pivot_metrics(spark, directory):
    return summaries.pivot_metrics(run_table(spark, directory), DATASETS)


@query(
    "improvement_pct",
    check(
        "SELECT dataset_name, "
        + ", ".join(
            f"""(round((avg({c}) FILTER (WHERE contains(router, 'direct')) - avg({c}) FILTER (WHERE NOT contains(router, 'direct')))
    / avg({c}) FILTER (WHERE contains(router, 'direct')) * 100e0 + 1e-8, 6) + 0e0) AS {m}"""
            for m, c in METRIC_SQL.items()
        )
        + " FROM runs GROUP BY dataset_name",
        "runs",
    ),
)
def improvement_pct(spark, directory):
    return rounded(summaries.improvement_percent(run_table(spark, directory)))


@query(
    "energy_by_system_type",
    check(
        """SELECT CASE WHEN contains(router, 'direct') THEN 'Single-tier' ELSE 'Hybrid' END AS system_type,
  count(*) AS runs, (round(min(per_log) + 1e-14, 12) + 0e0) AS lowest, (round(quantile_cont(per_log, 0.25) + 1e-14, 12) + 0e0) AS lower_quartile,
  (round(median(per_log) + 1e-14, 12) + 0e0) AS median, (round(quantile_cont(per_log, 0.75) + 1e-14, 12) + 0e0) AS upper_quartile,
  (round(max(per_log) + 1e-14, 12) + 0e0) AS highest FROM runs GROUP BY 1""",
        "runs",
    ),
)
def energy_by_system_type(spark, directory):
    five = ("lowest", "lower_quartile", "median", "upper_quartile", "highest")
    return rounded(summaries.energy_by_system_type(run_table(spark, directory)), fine=five)


@query(
    "energy_by_run",
    check(
        "SELECT router, "
        + ", ".join(
            f"(round(coalesce(max(per_log) FILTER (WHERE dataset_name = '{d}'), 0e0) + 1e-14, 12) + 0e0) AS {d}"
            for d in DATASETS
        )
        + """, CASE WHEN contains(router, 'direct') THEN 'Single-tier' ELSE 'Hybrid' END AS system_type
FROM runs GROUP BY router""",
        "runs",
    ),
)
def energy_by_run(spark, directory):
    return rounded(summaries.energy_by_run(run_table(spark, directory), DATASETS), fine=DATASETS)


@query(
    "scaling_by_size",
    check(
        """SELECT r.router, r.dataset_name, s.log_count, (round(r.lat + 1e-8, 6) + 0e0) AS AvgLatencyMs,
  (round(r.thr + 1e-8, 6) + 0e0) AS ThroughputLogsPerSec
FROM runs r LEFT JOIN (SELECT LogSource AS dataset_name, count(*) AS log_count FROM logs GROUP BY 1) s
  ON r.dataset_name = s.dataset_name""",
        "runs",
        "logs",
    ),
)
def scaling_by_size(spark, directory):
    sizes = tables.logs(spark, directory).groupBy(F.col("LogSource").alias("dataset_name")).agg(
        F.count("*").alias("log_count")
    )
    return rounded(summaries.scaling_by_size(run_table(spark, directory), sizes))


@query(
    "null_profile",
    check(
        "\nUNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_nulls, count(*) AS n_rows FROM logs"
            for c in ("Level", "Component", "LogSource", "Node", "Content", "EventTemplate")
        ),
        "logs",
    ),
)
def null_profile(spark, directory):
    columns = ["Level", "Component", "LogSource", "Node", "Content", "EventTemplate"]
    return summaries.null_profile(tables.logs(spark, directory), columns)


@query(
    "run_inventory",
    check(
        """SELECT count(*) AS n_rows, 11 AS n_columns, string_agg(DISTINCT router, ',' ORDER BY router) AS routers,
  string_agg(DISTINCT dataset_name, ',' ORDER BY dataset_name) AS datasets FROM runs""",
        "runs",
    ),
)
def run_inventory(spark, directory):
    return summaries.run_inventory(run_table(spark, directory))


@query(
    "ci95",
    check(
        """SELECT router, count(*) AS runs, (round(avg(lat) + 1e-8, 6) + 0e0) AS mean,
  (round(2.776e0 * stddev_samp(lat) / sqrt(count(*)) + 1e-8, 6) + 0e0) AS ci95 FROM runs GROUP BY router""",
        "runs",
    ),
)
def ci95(spark, directory):
    return rounded(summaries.ci95(run_table(spark, directory), ["router"], "AvgLatencyMs"))


@query(
    "delta_vs_best_direct",
    check(
        """SELECT router, dataset_name, (round((lat - bl) / bl * 100e0 + 1e-8, 6) + 0e0) AS AvgLatencyMs_delta_pct,
  (round((per_log - be) / be * 100e0 + 1e-8, 6) + 0e0) AS EnergyPerLogWh_delta_pct FROM (SELECT *,
    min(lat) FILTER (WHERE contains(router, 'direct')) OVER (PARTITION BY dataset_name) AS bl,
    min(per_log) FILTER (WHERE contains(router, 'direct')) OVER (PARTITION BY dataset_name) AS be FROM runs)""",
        "runs",
    ),
)
def delta_vs_best_direct(spark, directory):
    return rounded(summaries.delta_vs_best_direct(run_table(spark, directory)))


PAIR_SIDE = """SELECT router, dataset_name, avg(total_latency_ms) AS lat, avg(energy_cpu_pkg_j) AS j,
  avg((destination = 'ipfs')::INT) AS share, count(*) FILTER (WHERE sensitive AND destination <> 'ipfs') AS leak
  FROM {} GROUP BY router, dataset_name"""


@query(
    "paired_delta",
    check(
        f"""SELECT b.router, b.dataset_name, e.leak = 0 AS leak_free,
  CASE WHEN e.leak = 0 THEN (round(e.lat - b.lat + 1e-8, 6) + 0e0) END AS delta_mean_latency_ms,
  CASE WHEN e.leak = 0 THEN (round(e.j - b.j + 1e-8, 6) + 0e0) END AS delta_energy_per_log_j,
  CASE WHEN e.leak = 0 THEN (round(e.share - b.share + 1e-8, 6) + 0e0) END AS delta_ipfs_share
FROM ({PAIR_SIDE.format('base')}) b JOIN ({PAIR_SIDE.format('enforced')}) e
  ON b.router = e.router AND b.dataset_name = e.dataset_name""",
        "base",
        "enforced",
    ),
)
def paired_delta(spark, directory):
    both = replayed(spark, directory, (False, True))
    sides = both.groupBy("router", "dataset_name", "compliance").agg(*summaries.additive_columns())
    return rounded(
        summaries.paired_delta(sides.where("NOT compliance"), sides.where("compliance"))
    )


@query(
    "paired_by_log",
    check(
        """SELECT b.router, b.dataset_name, count(*) AS pairs, count(*) FILTER (WHERE e.compliance_forced) AS moved,
  (round(avg(e.total_latency_ms - b.total_latency_ms) + 1e-8, 6) + 0e0) AS mean_delta_latency_ms,
  (round(stddev_samp(e.total_latency_ms - b.total_latency_ms) + 1e-8, 6) + 0e0) AS std_delta_latency_ms,
  (round(avg(e.energy_cpu_pkg_j - b.energy_cpu_pkg_j) + 1e-8, 6) + 0e0) AS mean_delta_energy_j
FROM base b JOIN enforced e ON b.router = e.router AND b.log_id = e.log_id GROUP BY b.router, b.dataset_name""",
        "base",
        "enforced",
    ),
)
def paired_by_log(spark, directory):
    return rounded(summaries.paired_by_log(replayed(spark, directory, (False, True))))


@query(
    "latency_energy_corr",
    check(
        """SELECT router, dataset_name, (round(corr(total_latency_ms, energy_cpu_pkg_j) + 1e-8, 6) + 0e0) AS corr
FROM base GROUP BY router, dataset_name""",
        "base",
    ),
)
def latency_energy_corr(spark, directory):
    return rounded(summaries.latency_energy_corr(replayed(spark, directory)))


# ---- rows in run order -----------------------------------------------------
WARMUP_SQL = """SELECT router, dataset_name, count(*) AS logs,
  min(position) FILTER (WHERE position >= 400 AND abs(now - before) <= 0.05e0 * before) AS boundary
FROM (SELECT router, dataset_name, row_number() OVER w AS position,
    quantile_cont(total_latency_ms, 0.5) OVER (PARTITION BY router, dataset_name ORDER BY log_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS now,
    quantile_cont(total_latency_ms, 0.5) OVER (PARTITION BY router, dataset_name ORDER BY log_id ROWS BETWEEN 399 PRECEDING AND 200 PRECEDING) AS before
  FROM base WINDOW w AS (PARTITION BY router, dataset_name ORDER BY log_id)) GROUP BY router, dataset_name"""


@query("warmup_boundary", check(WARMUP_SQL, "base"))
def warmup_boundary(spark, directory):
    """Every run of every router."""
    run = ["router", "dataset_name"]
    rows = replayed(spark, directory).select(*run, "log_id", "total_latency_ms")
    return summaries.warmup_boundary(positions(rows, run, "log_id"), run)


@query(
    "energy_anomalies",
    """SELECT host, event_id, position, (round(watts + 1e-8, 6) + 0e0) AS watts, (round(m + 1e-8, 6) + 0e0) AS window_mean, (round(s + 1e-8, 6) + 0e0) AS window_std
FROM (SELECT 'node-' || CAST(user_id % 10 AS VARCHAR) AS host, event_id, value AS watts,
    row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS position,
    avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM events
  WINDOW w AS (PARTITION BY user_id % 10 ORDER BY event_id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING))
WHERE position > 200 AND watts > m + 6 * s""",
)
def energy_anomalies(spark, directory):
    readings = tables.table(spark, directory, "events").select(
        F.concat(F.lit("node-"), (F.col("user_id") % 10).cast("string")).alias("host"),
        "event_id",
        F.col("value").alias("watts"),
    )
    ranked = positions(readings, ["host"], "event_id")
    flagged = summaries.energy_anomalies(ranked, ["host"], "watts")
    return rounded(
        flagged.select("host", "event_id", "position", "watts", "window_mean", "window_std")
    )


# ---- choices ---------------------------------------------------------------
@query(
    "policy_confusion",
    check(
        """SELECT b.router, f.static_dest AS desired, b.destination, count(*) AS logs FROM base b
JOIN flagged f ON b.log_id = f.log_id GROUP BY ALL""",
        "base",
        "flagged",
    ),
)
def policy_confusion(spark, directory):
    logs, outcomes = tables.logs(spark, directory), tables.observations(spark, directory)
    routers = rule_routers() | {"cbr": cbr.fit_cbr(logs, outcomes).route}
    runs = F.array(
        *[
            F.struct(F.lit(r).alias("router"), F.col(f"raw_{r}").alias("destination"))
            for r in routers
        ]
    )
    decided = decide(logs, routers).select(
        routing.static_destination().alias("desired"), F.explode(runs).alias("_run")
    )
    return choices.policy_confusion(decided.select("desired", "_run.*"))


@query(
    "regret",
    check(
        """SELECT b.router, count(*) AS logs, (round(avg(b.total_latency_ms - c.least) + 1e-8, 6) + 0e0) AS mean_regret_ms,
  (round(max(b.total_latency_ms - c.least) + 1e-8, 6) + 0e0) AS max_regret_ms,
  (round(avg((b.total_latency_ms - c.least <= 1e-9)::INT) + 1e-8, 6) + 0e0) AS optimal_share
FROM base b JOIN (SELECT log_id, min(routing_latency_ms + backend_write_latency_ms) AS least FROM outcomes GROUP BY log_id) c
  ON b.log_id = c.log_id GROUP BY b.router""",
        "base",
        "outcomes",
    ),
)
def regret(spark, directory):
    return rounded(choices.regret(replayed(spark, directory, with_cheapest=True)))


SWEEP_SQL = """SELECT {keys}, count(*) AS logs, (round(avg(lat) + 1e-8, 6) + 0e0) AS mean_latency_ms, (round(avg(j) + 1e-8, 6) + 0e0) AS mean_energy_j
FROM (SELECT w.*, o.lat, o.j, row_number() OVER (PARTITION BY o.log_id, w.lw, w.ew
    ORDER BY w.lw * o.lat + w.ew * o.j, CASE o.destination WHEN 'mysql' THEN 1 WHEN 'elk' THEN 2 ELSE 3 END) AS r
  FROM (SELECT log_id, destination, routing_latency_ms + backend_write_latency_ms AS lat, energy_cpu_pkg_j AS j FROM obs) o
  CROSS JOIN {weights}) WHERE r = 1 GROUP BY ALL"""
LAMBDAS = (0.0, 10.0, 100.0, 1000.0, 10000.0)


@query(
    "lambda_sweep",
    check(
        SWEEP_SQL.format(
            keys="(round(ew + 1e-8, 6) + 0e0) AS lambda, balanced",
            weights="(SELECT 1e0 AS lw, ew, FALSE AS balanced FROM (VALUES "
            + ", ".join(f"({x}::DOUBLE)" for x in LAMBDAS)
            + """) AS v(ew) UNION ALL SELECT 1e0, median(total_latency_ms) / median(energy_cpu_pkg_j), TRUE
    FROM base WHERE router = 'static') w""",
        ),
        "base",
        "obs",
    ),
)
def lambda_sweep(spark, directory):
    logs, outcomes = tables.logs(spark, directory), tables.observations(spark, directory)
    static = replay(logs, outcomes, {"static": routing.route_static}, F.col("LogSource"))

    ranked = ("total_latency_ms", "energy_cpu_pkg_j")
    medians = exact_percentiles_of(static, ["router"], ranked, [0.5]).collect()
    latency, joules = (next(r["percentile"] for r in medians if r["column"] == c) for c in ranked)
    balance = latency / joules
    pairs = [(x, False) for x in LAMBDAS] + [(balance, True)]
    weights = F.array(
        *[
            F.struct(
                F.lit(1.0).alias("latency_weight"),
                F.lit(x).alias("energy_weight"),
                F.lit(is_balance).alias("balanced"),
            )
            for x, is_balance in pairs
        ]
    )
    chosen = choices.weight_sweep(outcomes_by_log(outcomes), weights)
    swept = chosen.groupBy(
        F.col("energy_weight").alias("lambda"), (F.col("energy_weight") == balance).alias("balanced")
    )
    return rounded(
        swept.agg(
            F.count("*").alias("logs"),
            F.avg("latency_ms").alias("mean_latency_ms"),
            F.avg("energy_j").alias("mean_energy_j"),
        )
    )


CURVE_SQL = """SELECT (round(w + 1e-8, 6) + 0e0) AS weight, CAST(moved AS BIGINT) AS moved, CAST(sum(logs) OVER along AS BIGINT) AS logs,
  (round(CAST(sum(dl) OVER along AS DOUBLE) / sum(logs) OVER along + 1e-8, 6) + 0e0) AS mean_latency_ms,
  (round(CAST(sum(dj) OVER along AS DOUBLE) / sum(logs) OVER along + 1e-8, 6) + 0e0) AS mean_energy_j
FROM (SELECT w, count(*) FILTER (WHERE k0 IS NULL) AS logs, count(k0) AS moved,
    sum(CAST(lat AS DECIMAL(28,9)) - coalesce(CAST(lat0 AS DECIMAL(28,9)), 0)) AS dl,
    sum(CAST(j AS DECIMAL(28,9)) - coalesce(CAST(j0 AS DECIMAL(28,9)), 0)) AS dj
  FROM (SELECT *, lag(k) OVER log AS k0, lag(lat) OVER log AS lat0, lag(j) OVER log AS j0
    FROM (SELECT c.log_id, w, k, lat, j, row_number() OVER (PARTITION BY c.log_id, w ORDER BY lat + middle * j, j, k) AS r
      FROM (SELECT log_id, w, coalesce((w + lead(w) OVER (PARTITION BY log_id ORDER BY w)) / 2, 2 * w + 1) AS middle
        FROM (SELECT log_id, 0e0 AS w FROM choice UNION SELECT a.log_id, (b.lat - a.lat) / (a.j - b.j)
          FROM choice a JOIN choice b ON a.log_id = b.log_id AND b.j < a.j AND b.lat > a.lat)) c
      JOIN choice o ON o.log_id = c.log_id)
    WHERE r = 1 WINDOW log AS (PARTITION BY log_id ORDER BY w))
  WHERE k0 IS NULL OR k0 <> k GROUP BY w)
WINDOW along AS (ORDER BY w)"""


@query("tradeoff_curve", check(CURVE_SQL, "choice"))
def tradeoff_curve_of_logs(spark, directory):
    """Every weight of energy at which a log changes its cheapest tier."""
    return rounded(tradeoff_curve(outcomes_by_log(tables.observations(spark, directory))))


@query(
    "tradeoff_grid",
    check(
        """SELECT w AS weight, count(*) AS logs, (round(avg(lat) + 1e-8, 6) + 0e0) AS mean_latency_ms,
  (round(avg(j) + 1e-8, 6) + 0e0) AS mean_energy_j
FROM (SELECT *, row_number() OVER (PARTITION BY log_id, w ORDER BY lat + w * j, j, k) AS r
  FROM choice CROSS JOIN (VALUES """
        + ", ".join(f"({x}::DOUBLE)" for x in LAMBDAS)
        + ") AS v(w)) WHERE r = 1 GROUP BY w",
        "choice",
    ),
)
def tradeoff_grid(spark, directory):
    """The means at a grid of weights, looked up in the curve."""
    curve = tradeoff_curve(outcomes_by_log(tables.observations(spark, directory)))
    return rounded(look_up(curve, LAMBDAS))


LATENCY_WEIGHTS = (0.5, 1.0, 2.0)
ENERGY_WEIGHTS = (100.0, 1000.0, 5000.0)


@query(
    "param_sensitivity",
    check(
        "SELECT lw AS latency_weight, "
        + ", ".join(
            f"max(mean_latency_ms) FILTER (WHERE ew = {e}) AS energy_{int(e)}" for e in ENERGY_WEIGHTS
        )
        + " FROM ("
        + SWEEP_SQL.format(
            keys="lw, ew",
            weights="(SELECT lw, ew FROM (VALUES "
            + ", ".join(f"({x}::DOUBLE)" for x in LATENCY_WEIGHTS)
            + ") AS a(lw) CROSS JOIN (VALUES "
            + ", ".join(f"({x}::DOUBLE)" for x in ENERGY_WEIGHTS)
            + ") AS b(ew)) w",
        )
        + ") GROUP BY lw",
        "obs",
    ),
)
def param_sensitivity(spark, directory):
    weights = F.array(
        *[
            F.struct(F.lit(a).alias("latency_weight"), F.lit(b).alias("energy_weight"))
            for a in LATENCY_WEIGHTS
            for b in ENERGY_WEIGHTS
        ]
    )
    outcomes = outcomes_by_log(tables.observations(spark, directory))
    chosen = choices.weight_sweep(outcomes, weights)
    matrix = summaries.sensitivity(
        chosen, "latency_weight", "latency_ms", "energy_weight", ENERGY_WEIGHTS
    )
    return rounded(matrix.toDF("latency_weight", *[f"energy_{int(e)}" for e in ENERGY_WEIGHTS]))


# ---- adaptive router -------------------------------------------------------
STATS_SQL = """SELECT attr, bucket, destination, count(*) AS n, (round(sum(cost) + 1e-8, 6) + 0e0) AS sum_cost,
  round(sum(cost * cost) + 1e-6, 4) AS sum_sq FROM cbr_rows GROUP BY ALL"""


def stats_rounded(stats):
    return stats.select(
        "attr",
        "bucket",
        "destination",
        "n",
        F.round(F.col("n") * F.col("mean") + 1e-8, 6).alias("sum_cost"),
        F.round(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean") + 1e-6, 4).alias("sum_sq"),
    )


def cbr_feedback(spark, directory):
    return cbr.feedback(tables.logs(spark, directory), tables.observations(spark, directory))


@query("cbr_stats", check(STATS_SQL, "cbr_rows"))
def cbr_stats(spark, directory):
    return stats_rounded(cbr.bucket_stats(cbr_feedback(spark, directory)))


@query("cbr_state_merge", check(STATS_SQL, "cbr_rows"))
def cbr_state_merge(spark, directory):
    rows = cbr_feedback(spark, directory)
    first = cbr.bucket_stats(rows.where("log_id % 2 = 0"))
    second = cbr.bucket_stats(rows.where("log_id % 2 <> 0"))
    return stats_rounded(cbr.merge_stats(first, second))


@query(
    "cbr_expected",
    check(
        "SELECT attr, bucket, destination, (round(mean_cost + 1e-8, 6) + 0e0) AS mean_cost FROM cbr_means", "cbr_means"
    ),
)
def cbr_expected(spark, directory):
    return rounded(cbr.expected_costs(cbr.bucket_stats(cbr_feedback(spark, directory))))


@query(
    "cbr_scores",
    check(
        """SELECT attr, (round(score + 1e-8, 6) + 0e0) AS score, attr = (SELECT attr FROM cbr_choice) AS classifier
FROM cbr_scored""",
        "cbr_scored",
        "cbr_choice",
    ),
)
def cbr_scores(spark, directory):
    logs, outcomes = tables.logs(spark, directory), tables.observations(spark, directory)
    model = cbr.fit_cbr(logs, outcomes)
    scores = cbr.attribute_scores(model.stats)
    return rounded(scores.withColumn("classifier", F.col("attr") == model.classifier))


@query(
    "cbr_global_best",
    check("SELECT destination AS best_destination FROM cbr_overall", "cbr_overall"),
)
def cbr_global_best(spark, directory):
    return cbr.global_best(cbr.bucket_stats(cbr_feedback(spark, directory)))


@query("route_cbr", check("SELECT log_id, raw AS raw_destination FROM cbr_route", "cbr_route"))
def route_cbr(spark, directory):
    logs = tables.logs(spark, directory)
    model = cbr.fit_cbr(logs, tables.observations(spark, directory))
    return model.route(logs).select("log_id", "raw_destination")


# ---- every router ----------------------------------------------------------
@query(
    "compare_routers",
    check(f"SELECT router, {COMBINED} FROM all_base GROUP BY router", "all_base"),
)
def compare_routers(spark, directory):
    """All rule, adaptive and tabular routers over the same logs in one job."""
    logs, outcomes = tables.logs(spark, directory), tables.observations(spark, directory)
    model = cbr.fit_cbr(logs, outcomes)
    steps, q = fit_tabular(spark, directory, policy_only=True)
    rows = replay(
        logs,
        outcomes,
        rule_routers() | {"cbr": model.route},
        F.col("LogSource"),
        decisions={"q_learning": q_decisions(steps, q)},
        partitions=parts_by_rows(logs),
    )
    return rounded(
        summaries.combined_summary(rows, ["router"])
    )


@query("compare_learned")
def compare_learned(spark, directory):
    """The learned policy next to the rule and adaptive routers.

    Without SQL: the classifier's weights depend on the order of summation.
    """
    logs, outcomes = tables.logs(spark, directory), tables.observations(spark, directory)
    model = cbr.fit_cbr(logs, outcomes)
    rewarded = choices.rewards(logs, outcomes)
    decided = cut_lineage(
        learned_decisions(observed_logs(spark, directory), rewarded, 10).select(
            "log_id", "raw_destination"
        )
    )
    rows = replay(
        logs,
        outcomes,
        rule_routers() | {"cbr": model.route},
        F.col("LogSource"),
        decisions={"learned": decided},
        partitions=parts_by_rows(logs),
    )
    return summaries.combined_summary(rows, ["router"])
