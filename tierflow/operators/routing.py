"""Rule routers and the compliance override.

A router is a function ``DataFrame -> DataFrame`` that adds ``raw_destination``.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.functions.text import is_sensitive, safe_lower
from tierflow.schemas import ACTION_CODES, TIERS

Router = Callable[[DataFrame], DataFrame]


def static_destination() -> Column:
    """First matching rule wins.

    Fixed values: the sources, components, levels and words below.
    """
    level = safe_lower(F.col("Level"))
    content = safe_lower(F.col("Content"))
    return (
        F.when(safe_lower(F.col("LogSource")) == "openssh", "ipfs")
        .when(safe_lower(F.col("Component")) == "kernel", "ipfs")
        .when(level.isin("crit", "alert", "emerg"), "ipfs")
        .when(level.isin("err", "error", "warn"), "elk")
        .when(content.contains("fail") | content.contains("denied"), "elk")
        .otherwise("mysql")
    )


def route_static(logs: DataFrame) -> DataFrame:
    return logs.withColumn("raw_destination", static_destination())


def check_tier(name: str) -> str:
    tier = (name or "").lower()
    if tier not in TIERS:
        raise ValueError(f"unknown destination: {name}")
    return tier


def route_direct(destination: str) -> Router:
    """Router that sends every log to one tier."""
    tier = check_tier(destination)
    return lambda logs: logs.withColumn("raw_destination", F.lit(tier))


# Routers by name; callers may add their own.
ROUTERS: dict[str, Router] = {
    "static": route_static,
    **{f"direct_{tier}": route_direct(tier) for tier in TIERS},
}


def register_router(name: str, router: Router) -> None:
    ROUTERS[name] = router


def get_router(name: str) -> Router:
    if name not in ROUTERS:
        raise ValueError(f"unknown router: {name}")
    return ROUTERS[name]


def action_code(destination: Column) -> Column:
    pairs = [F.lit(x) for pair in ACTION_CODES.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[destination], F.lit(0))


def action_destination(code: Column) -> Column:
    """Tier of an action code; an unknown code means the first tier."""
    chain = F.when(code == 1, "elk").when(code == 2, "ipfs")
    return chain.otherwise("mysql")


def enforce(destination: Column, sensitive: Column, enabled: Column | bool = True) -> Column:
    """Sensitive logs go to the immutable tier when the override is on."""
    on = enabled if isinstance(enabled, Column) else F.lit(enabled)
    return F.when(on & sensitive, "ipfs").otherwise(destination)


def apply_compliance(
    routed: DataFrame, enabled: bool = True, patterns: Sequence[str] | None = None
) -> DataFrame:
    """Add ``sensitive``, ``destination`` and ``compliance_forced``.

    ``sensitive`` is computed with the override off as well, so that a baseline
    run reports what it would leak.
    """
    flagged = routed
    if "sensitive" not in routed.columns:
        flagged = routed.withColumn("sensitive", is_sensitive(patterns))
    return flagged.withColumn(
        "destination", enforce(F.col("raw_destination"), F.col("sensitive"), enabled)
    ).withColumn("compliance_forced", F.col("destination") != F.col("raw_destination"))
