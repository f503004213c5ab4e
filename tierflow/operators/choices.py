"""Decisions judged against the outcomes of the tiers not chosen."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.functions.cost import reward, routing_cost
from tierflow.functions.text import is_sensitive_for_reward
from tierflow.operators.routing import static_destination
from tierflow.operators.trace import MEASURES, measured, outcomes_of
from tierflow.schemas import TIERS


def judged() -> list[Column]:
    """What the reward needs to know of a log; the static rules are the teacher."""
    return [
        static_destination().alias("desired"),
        is_sensitive_for_reward().alias("sensitive"),
    ]


def with_reward(joined: DataFrame) -> DataFrame:
    """Add the reward to rows with an outcome, a destination and a judged log."""
    columns = ("success", "backend_write_latency_ms", "energy_cpu_pkg_j", "destination")
    return joined.withColumn(
        "reward", reward(*[F.col(c) for c in columns], F.col("desired"), F.col("sensitive"))
    )


def rewards(logs: DataFrame, observations: DataFrame) -> DataFrame:
    """Reward of every log at every tier; a missing outcome is a failed write."""
    joined = outcomes_of(logs.select("log_id", *judged()), observations)
    return with_reward(joined).select("log_id", "destination", "desired", "sensitive", "reward")


def best_action(rewarded: DataFrame) -> DataFrame:
    """Destination with the highest reward of each log, ties to the earlier tier."""
    found = {t: F.max(F.when(F.col("destination") == t, F.col("reward"))) for t in TIERS}
    wide = rewarded.groupBy("log_id").agg(*[found[t].alias(t) for t in TIERS])
    top = F.greatest(*[F.col(t) for t in TIERS])
    return wide.select("log_id", first_tier([F.col(t) == top for t in TIERS]).alias("best_destination"))


def first_tier(conditions: Sequence[Column]) -> Column:
    pick = F.when(conditions[0], TIERS[0])
    for tier, condition in zip(TIERS[1:], conditions[1:]):
        pick = pick.when(condition, tier)
    return pick


def policy_confusion(decided: DataFrame) -> DataFrame:
    """Counts of desired against actual destination per router."""
    return decided.groupBy("router", "desired", "destination").agg(F.count("*").alias("logs"))


def regret(replayed: DataFrame, keys: Sequence[str] = ("router",)) -> DataFrame:
    """Mean and largest cost above the cheapest tier of the same log.

    ``replayed`` carries the cheapest cost of its log.
    """
    gap = F.col("total_latency_ms") - F.col("cheapest_ms")
    return replayed.groupBy(*keys).agg(
        F.count("*").alias("logs"),
        F.avg(gap).alias("mean_regret_ms"),
        F.max(gap).alias("max_regret_ms"),
        F.avg((gap <= 1e-9).cast("double")).alias("optimal_share"),
    )


def weight_sweep(outcomes: DataFrame, weights: Column) -> DataFrame:
    """For each weight pair, the measures of the tier with the least combined cost.

    ``weights`` is an array of ``(latency_weight, energy_weight)`` structs.
    Returns one row per log and pair; callers aggregate.
    """
    spread = outcomes.withColumn("_w", F.explode(weights))
    found = {t: measured(*[F.col(f"{m}_{t}") for m in MEASURES]) for t in TIERS}
    latency = {t: found[t][3] for t in TIERS}
    energy = {t: found[t][4] for t in TIERS}
    cost = {
        t: F.col("_w.latency_weight") * latency[t] + F.col("_w.energy_weight") * energy[t]
        for t in TIERS
    }
    least = F.least(*cost.values())
    pick = first_tier([cost[t] == least for t in TIERS])
    chosen = spread.withColumn("destination", pick)

    def of(measure: dict[str, Column]) -> Column:
        return F.coalesce(*[F.when(F.col("destination") == t, measure[t]) for t in TIERS])

    return chosen.select(
        "log_id",
        "_w.latency_weight",
        "_w.energy_weight",
        "destination",
        of(latency).alias("latency_ms"),
        of(energy).alias("energy_j"),
    )


def cost_metrics(observations: DataFrame) -> DataFrame:
    """The three cost metrics of every measured write."""
    latency, energy = F.col("backend_write_latency_ms"), F.col("energy_cpu_pkg_j")
    return observations.select(
        "log_id",
        "destination",
        *[routing_cost(m, latency, energy).alias(f"{m}_cost") for m in ("latency", "energy", "combined")],
    )
