"""The whole trade-off of latency against energy, as the weight of energy grows.

A log's cost at a tier is ``latency + weight * energy``: a line over the weight.
The cheapest tier at every weight is the lower envelope of a log's lines, which
changes at most once fewer than there are tiers.  All changes of all logs, in
order of the weight, with running sums, give the mean latency and energy at any
weight, exactly, without trying a grid.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.operators.ordered import asof_backward, running
from tierflow.operators.trace import MEASURES, measured
from tierflow.schemas import TIERS

# Sums are kept in decimals, so that no running sum carries the error of
# another order of addition.
EXACT = "decimal(28,9)"
SUMS = ("logs", "latency", "energy")


def _choices(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, log_id, _c``: the choices of a log in order of the weight."""
    lines = []
    for rank, tier in enumerate(TIERS):
        found = measured(*[F.col(f"{m}_{tier}") for m in MEASURES])
        lines.append(
            F.struct(found[3].alias("latency"), found[4].alias("energy"), F.lit(rank).alias("rank"))
        )
    rows = outcomes.select(*keys, "log_id", F.array(*lines).alias("_lines"))

    def choice(weight: Column, line: Column) -> Column:
        # Least weight first, then least energy: where lines cross in one
        # point, the one that is lowest beyond it.
        return F.struct(
            weight.alias("weight"),
            line["energy"].alias("energy"),
            line["rank"].alias("rank"),
            line["latency"].alias("latency"),
        )

    def crossings(now: Column) -> Column:
        return F.transform(
            F.filter("_lines", lambda line: line["energy"] < now["energy"]),
            lambda line: choice(
                (line["latency"] - now["latency"]) / (now["energy"] - line["energy"]), line
            ),
        )

    rows = rows.withColumn("_0", choice(F.lit(0.0), F.array_min("_lines")))
    for step in range(1, len(TIERS)):
        rows = rows.withColumn(f"_{step}", F.array_min(crossings(F.col(f"_{step - 1}"))))
    choices = F.array(*[F.col(f"_{step}") for step in range(len(TIERS))])
    return rows.select(*keys, "log_id", F.array_compact(choices).alias("_c"))


def envelope(outcomes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, log_id, weight, tier, latency, energy``: each log's choices.

    ``outcomes`` has a log's outcomes side by side.  A choice holds from its
    weight on, up to the next choice's.  Equal costs go to the tier with less
    energy, then to the earlier one; a missing outcome is a failed write.
    """
    rows = _choices(outcomes, keys).select(*keys, "log_id", F.explode("_c").alias("_c"))
    tier = F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("_c.rank") + 1)
    return rows.select(*keys, "log_id", "_c.weight", tier.alias("tier"), "_c.latency", "_c.energy")


def tradeoff_curve(
    outcomes: DataFrame, keys: Sequence[str] = (), block_rows: int | None = None
) -> DataFrame:
    """``keys, weight, moved, logs, mean_latency_ms, mean_energy_j``: every change.

    A row holds from its weight up to the next row's; ``moved`` logs change
    their tier there.  Changes at one weight are added up before they are
    ordered, and are ordered in blocks, so no key or weight is one task's work.
    """
    measures = ("latency", "energy")

    def step(choice: Column, place: Column) -> Column:
        before = F.get("_c", place - 1)
        gain = {
            c: choice[c].cast(EXACT) - F.coalesce(before[c].cast(EXACT), F.lit(0).cast(EXACT))
            for c in measures
        }
        return F.struct(
            choice["weight"].alias("weight"),
            (place == 0).cast("long").alias("logs"),
            (place > 0).cast("long").alias("moved"),
            *[gain[c].alias(c) for c in measures],
        )

    choices = _choices(outcomes, keys)
    steps = choices.select(*keys, F.explode(F.transform("_c", step)).alias("_s")).select(*keys, "_s.*")
    changes = steps.groupBy(*keys, "weight").agg(*[F.sum(c).alias(f"{c}_change") for c in ("moved", *SUMS)])
    summed = running(changes, keys, ["weight"], {c: F.col(f"{c}_change") for c in SUMS}, block_rows)
    return summed.select(
        *keys,
        "weight",
        F.col("moved_change").alias("moved"),
        F.col("logs").cast("long").alias("logs"),
        (F.col("latency").cast("double") / F.col("logs")).alias("mean_latency_ms"),
        (F.col("energy").cast("double") / F.col("logs")).alias("mean_energy_j"),
    )


def look_up(curve: DataFrame, weights: Sequence[float], key: str | None = None) -> DataFrame:
    """The curve's means at each of ``weights``, per ``key`` if it has one."""
    values = ["logs", "mean_latency_ms", "mean_energy_j"]
    spark = curve.sparkSession
    grid = spark.createDataFrame([(float(w),) for w in weights], "weight double")
    if key is None:
        rows = curve.withColumn("_key", F.lit(0))
        return asof_backward(grid.withColumn("_key", F.lit(0)), rows, "_key", "weight", values).drop("_key")
    keys = curve.select(key).distinct()
    asked = F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("weight")
    return asof_backward(keys.select(key, asked), curve, key, "weight", values)
