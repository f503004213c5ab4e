"""Costs, rewards and emissions as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cost of a write that never came back, default weights of the
# combined cost, and carbon intensities in kg per kWh of the two reports.
FAILED_WRITE_MS = 1000.0
LATENCY_WEIGHT = 1.0
ENERGY_WEIGHT = 1000.0
RUN_KG_PER_KWH = 0.233
REPORT_KG_PER_KWH = 0.4


def routing_cost(
    metric: str,
    latency_ms: Column,
    energy_j: Column,
    latency_weight: float = LATENCY_WEIGHT,
    energy_weight: float = ENERGY_WEIGHT,
) -> Column:
    """Cost of one write under the metric ``latency``, ``energy`` or ``combined``."""
    if metric == "latency":
        return latency_ms
    if metric == "energy":
        return F.coalesce(energy_j, latency_ms)
    if metric == "combined":
        return latency_weight * latency_ms + energy_weight * F.coalesce(energy_j, F.lit(0.0))
    raise ValueError(f"unknown cost metric: {metric}")


def reward(
    success: Column,
    latency_ms: Column,
    energy_j: Column,
    destination: Column,
    desired: Column,
    sensitive: Column,
) -> Column:
    """Reward of a write: policy agreement, tier fit, latency, energy.

    Fixed values: the weights below.  A failed write is not clipped.
    """
    slow = F.least(latency_ms / 1000.0, F.lit(1.0))
    drain = 0.05 * F.greatest(F.lit(0.0), energy_j)
    failed = -1.0 - 0.3 * slow - drain
    agreement = F.when(destination == desired, 1.2).otherwise(-0.8)
    misplaced = (
        F.when(sensitive & (destination != "ipfs"), -0.8)
        .when(~sensitive & (destination == "ipfs"), -0.2)
        .otherwise(0.0)
    )
    earned = agreement + misplaced + 0.3 * (1.0 - slow) - drain
    clipped = F.least(F.lit(2.0), F.greatest(F.lit(-2.0), earned))
    return F.when(success, clipped).otherwise(failed)


def watt_hours(joules: Column) -> Column:
    return joules / 3600.0


def carbon_kg(wh: Column, kg_per_kwh: float) -> Column:
    """Emissions; the factor is per kilowatt hour."""
    return wh / 1000.0 * kg_per_kwh
