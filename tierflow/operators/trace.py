"""Decisions joined with measured outcomes: one trace row per log and router."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.functions.cost import FAILED_WRITE_MS
from tierflow.functions.text import is_sensitive, payload_bytes
from tierflow.operators.routing import Router, enforce
from tierflow.schemas import TIERS, TRACE_SCHEMA

MEASURES = ("success", "routing_latency_ms", "backend_write_latency_ms", "energy_cpu_pkg_j")

# Logs that meet their outcomes in one task; each is multiplied by its routers there.
PART_LOGS = 200_000


def measured(success: Column, routing: Column, write: Column, energy: Column) -> list[Column]:
    """Outcome columns of a decision; an outcome that is missing is a failure."""
    routing = F.coalesce(routing, F.lit(0.0))
    write = F.coalesce(write, F.lit(FAILED_WRITE_MS))
    return [
        F.coalesce(success, F.lit(False)).alias("success"),
        routing.alias("routing_latency_ms"),
        write.alias("backend_write_latency_ms"),
        (routing + write).alias("total_latency_ms"),
        F.coalesce(energy, F.lit(0.0)).alias("energy_cpu_pkg_j"),
    ]


def decision_rows(
    decided: DataFrame, router: str, dataset: Column | str, extra: Sequence[str] = ()
) -> DataFrame:
    """What a trace keeps of decisions: texts stop here, only their size goes on."""
    name = dataset if isinstance(dataset, Column) else F.lit(dataset)
    return decided.select(
        "log_id",
        F.lit(router).alias("router"),
        name.alias("dataset_name"),
        "destination",
        "raw_destination",
        "compliance_forced",
        payload_bytes(F.col("Content")).alias("payload_bytes"),
        "sensitive",
        *extra,
    )


def trace(
    decided: DataFrame, observations: DataFrame, router: str, dataset: Column | str
) -> DataFrame:
    """Full trace of one router.

    ``decided`` carries ``raw_destination``, ``destination``, ``sensitive`` and
    ``compliance_forced``.
    """
    narrow = decision_rows(decided, router, dataset)
    extras = [c for c in ("proc_cpu_pct", "proc_rss_mb") if c in observations.columns]
    outcomes = observations.select("log_id", "destination", *MEASURES, *extras)
    joined = narrow.join(outcomes, ["log_id", "destination"], "left")
    for column in ("proc_cpu_pct", "proc_rss_mb"):
        if column not in extras:
            joined = joined.withColumn(column, F.lit(None).cast("double"))
    kept = [f.name for f in TRACE_SCHEMA if f.name not in (*MEASURES, "total_latency_ms")]
    return joined.select(*kept, *measured(*[F.col(m) for m in MEASURES])).select(
        *[f.name for f in TRACE_SCHEMA]
    )


def outcomes_within(logs: DataFrame, observations: DataFrame) -> DataFrame:
    """Outcomes in the id range of ``logs``, a stored batch.

    The range reaches the scan as a filter, so a batch of neighbouring ids does
    not read the outcomes of all the others.
    """
    low, high = logs.agg(F.min("log_id"), F.max("log_id")).first()
    if low is None:
        return observations.where(F.lit(False))
    return observations.where(F.col("log_id").between(low, high))


def outcomes_by_log(observations: DataFrame) -> DataFrame:
    """One row per log with the outcome at each tier side by side.

    Plain maxima over primitive columns: a hash aggregate with map-side combine.
    """
    here = {t: F.col("destination") == t for t in TIERS}
    return observations.groupBy("log_id").agg(
        *[F.max(F.when(here[t], F.col(m))).alias(f"{m}_{t}") for t in TIERS for m in MEASURES]
    )


def outcomes_of(logs: DataFrame, observations: DataFrame) -> DataFrame:
    """``logs`` times tiers with the outcome there; a missing one is a failure.

    Logs meet their outcomes once, side by side, before they are multiplied.
    Energy that was not measured stays null.
    """
    wide = logs.join(outcomes_by_log(observations), "log_id", "left")

    def outcome(tier: str) -> Column:
        found = [F.col(f"{m}_{tier}") for m in MEASURES]
        energy = found[-1].alias(MEASURES[-1])
        return F.struct(F.lit(tier).alias("destination"), *measured(*found)[:-1], energy)

    tiers = F.array(*[outcome(t) for t in TIERS])
    return wide.select(*logs.columns, F.explode(tiers).alias("_tier")).select(
        *logs.columns, "_tier.*"
    )


def parts_by_rows(logs: DataFrame, each: int = PART_LOGS) -> int | None:
    """Partitions of ``each`` logs for ``replay``; None if one would hold them all.

    A task that pairs or sums logs of one id keeps all of its part, so the
    number of parts must grow with the logs.
    """
    count = logs.count()
    if count <= each:
        return None
    return max(-(-count // each), logs.sparkSession.sparkContext.defaultParallelism)


def cheapest_ms() -> Column:
    """Lowest latency of a log with its outcomes side by side."""
    return F.least(*[measured(*[F.col(f"{m}_{t}") for m in MEASURES])[3] for t in TIERS])


def decide(logs: DataFrame, routers: dict[str, Router]) -> DataFrame:
    """One decision column ``raw_<router>`` per router, in one pass."""
    for name, route in routers.items():
        logs = route(logs).withColumnRenamed("raw_destination", f"raw_{name}")
    return logs


def replay(
    logs: DataFrame,
    observations: DataFrame,
    routers: dict[str, Router],
    dataset: Column | str,
    compliance: Sequence[bool] = (False,),
    patterns: Sequence[str] | None = None,
    decisions: dict[str, DataFrame] | None = None,
    with_cheapest: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Traces of many routers over the same logs, with and without the override.

    Every router decides on the log row first.  Logs then meet their outcomes
    in one join by log id; only afterwards is the row multiplied by router, so
    the shuffle does not grow with the number of routers.  ``decisions`` are
    routers that decided elsewhere, as tables ``log_id, raw_destination``; they
    join by log id too, after the texts are gone.  ``with_cheapest`` adds
    ``cheapest_ms``, the lowest latency any tier would have had.  ``partitions``
    is the number of parts in which logs meet their outcomes and stay; by default
    the session's, or that of bucketed tables.
    """
    decisions = decisions or {}
    names = [*routers, *decisions]
    name = dataset if isinstance(dataset, Column) else F.lit(dataset)
    decided = logs.withColumn("dataset_name", name).withColumn("sensitive", is_sensitive(patterns))
    decided = decide(decided, routers)
    narrow = decided.select(
        "log_id",
        "dataset_name",
        "sensitive",
        payload_bytes(F.col("Content")).alias("payload_bytes"),
        *[f"raw_{r}" for r in routers],
    )
    if partitions is not None:
        narrow = narrow.repartition(partitions, "log_id")
        observations = observations.repartition(partitions, "log_id")
    runs = F.array(
        *[
            F.struct(
                F.lit(r).alias("router"),
                F.lit(on).alias("compliance"),
                F.col(f"raw_{r}").alias("raw_destination"),
            )
            for r in names
            for on in compliance
        ]
    )
    wide = narrow.join(outcomes_by_log(observations), "log_id", "left")
    for router, table in decisions.items():
        chosen_there = table.select("log_id", F.col("raw_destination").alias(f"raw_{router}"))
        wide = wide.join(chosen_there, "log_id", "left")
    if with_cheapest:
        wide = wide.withColumn("cheapest_ms", cheapest_ms())
    long = wide.withColumn("_run", F.explode(runs)).withColumn(
        "destination", enforce(F.col("_run.raw_destination"), F.col("sensitive"), F.col("_run.compliance"))
    )

    def chosen(measure: str) -> Column:
        first, *rest = TIERS
        pick = F.when(F.col("destination") == first, F.col(f"{measure}_{first}"))
        for tier in rest:
            pick = pick.when(F.col("destination") == tier, F.col(f"{measure}_{tier}"))
        return pick

    return long.select(
        "log_id",
        "_run.router",
        "dataset_name",
        "_run.compliance",
        "destination",
        "_run.raw_destination",
        (F.col("destination") != F.col("_run.raw_destination")).alias("compliance_forced"),
        "payload_bytes",
        "sensitive",
        *measured(*[chosen(m) for m in MEASURES]),
        *["cheapest_ms"] * with_cheapest,
    )
