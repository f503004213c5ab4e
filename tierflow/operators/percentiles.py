"""Exact percentiles of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one
task.  Here a sketch only chooses cut points close to the wanted ranks; counting
the rows between the cuts then tells exactly which short stretch holds each
rank, and only the rows of those stretches are ordered.  A poor sketch makes a
stretch longer, never the result wrong.  All ranked columns go through the same
passes.
"""

from collections.abc import Mapping, Sequence
from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierflow.operators.joins import join_keys
from tierflow.runtime import cut_lineage


def exact_percentiles_of(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    probabilities: Sequence[float],
    accuracy: int | None = None,
) -> DataFrame:
    """One row per key, column and probability: ``column, p, percentile, n``.

    Linear interpolation between the two order statistics around
    ``(n - 1) * p``.  Nulls and NaN are left out.

    ``accuracy`` is the number of ranks the sketch tells apart.  It is twice the
    root of the counted rows of the largest group, so that neither the sketch
    nor the stretch to be ordered outgrows a task.
    """
    pairs = F.array(
        *[F.struct(F.lit(v).alias("column"), F.col(v).cast("double").alias("v")) for v in values]
    )
    long = df.select(*keys, F.explode(pairs).alias("_pair"))
    clean = cut_lineage(
        long.select(*keys, F.col("_pair.column").alias("_column"), F.col("_pair.v").alias("_v"))
        .where("_v IS NOT NULL AND NOT isnan(_v)")
    )
    keys = [*keys, "_column"]
    largest = clean.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    accuracy = accuracy or 2 * isqrt(largest) + 16
    margin = 2.0 / accuracy
    cuts = sorted(
        {min(1.0, max(0.0, p + side * margin)) for p in probabilities for side in (-1, 1)}
    )
    sketch = cut_lineage(
        clean.groupBy(*keys).agg(F.percentile_approx("_v", cuts, accuracy).alias("_cuts"))
    )
    above = [(F.col("_v") > F.col("_cuts")[i]).cast("int") for i in range(len(cuts))]
    placed = join_keys(clean, sketch, keys, "inner").select(
        *keys, "_v", reduce(Column.__add__, above).alias("_s")
    )

    # One row per key and stretch, at most 2 * len(cuts) + 1 of them per key.
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    stretches = cut_lineage(
        placed.groupBy(*keys, "_s")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("n", F.sum("_rows").over(whole))
        .withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        .withColumn("_rank", (F.col("n") - 1) * F.col("p"))
        .withColumn("_low", F.floor("_rank"))
        .withColumn("_high", F.ceil("_rank"))
        .where("_low < _before + _rows AND _high >= _before")
    )

    # Only the stretches that hold a wanted rank are ordered.
    wanted = stretches.select(*keys, "_s", "_before").distinct()
    upto = (
        Window.partitionBy(*keys, "_s")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ordered = (
        join_keys(placed, wanted, [*keys, "_s"], "inner")
        .groupBy(*keys, "_s", "_before", "_v")
        .agg(F.count("*").alias("_times"))
        .withColumn("_end", F.col("_before") + F.sum("_times").over(upto))
        .withColumn("_start", F.col("_end") - F.col("_times"))
        .drop("_before")
    )
    low = F.max(F.when(F.col("_low").between(F.col("_start"), F.col("_end") - 1), F.col("_v")))
    high = F.max(F.when(F.col("_high").between(F.col("_start"), F.col("_end") - 1), F.col("_v")))
    share = F.col("_rank") - F.floor("_rank")
    return (
        join_keys(ordered, stretches.drop("_rows", "_before"), [*keys, "_s"], "inner")
        .where(
            F.col("_low").between(F.col("_start"), F.col("_end") - 1)
            | F.col("_high").between(F.col("_start"), F.col("_end") - 1)
        )
        .groupBy(*keys, "p", "n", "_rank")
        .agg(low.alias("_a"), high.alias("_b"))
        .select(
            *keys[:-1],
            F.col("_column").alias("column"),
            "p",
            "n",
            (F.col("_a") + (F.col("_b") - F.col("_a")) * share).alias("percentile"),
        )
    )


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    accuracy: int | None = None,
) -> DataFrame:
    """The same for one column: ``p, percentile, n`` per key and probability."""
    return exact_percentiles_of(df, keys, [value], probabilities, accuracy).drop("column")


def percentile_columns(
    df: DataFrame, keys: Sequence[str], named: Mapping[str, tuple[str, float]]
) -> DataFrame:
    """One row per key; ``named`` maps a column to what it ranks and its level."""
    values = list(dict.fromkeys(v for v, _ in named.values()))
    levels = sorted({p for _, p in named.values()})
    rows = exact_percentiles_of(df, keys, values, levels)

    def one(value: str, p: float) -> Column:
        here = (F.col("column") == value) & (F.col("p") == float(p))
        return F.max(F.when(here, F.col("percentile")))

    return rows.groupBy(*keys).agg(*[one(*v).alias(n) for n, v in named.items()])
