"""Reward histories of policy fitting.

A history has one row per run and episode, already summed over steps, so the
rows of a run are as many as its episodes and a window per run is small.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moving_average(history: DataFrame, window: int = 20) -> DataFrame:
    """Mean of the last ``window`` rewards, null until there are so many."""
    run = Window.partitionBy("run").orderBy("episode")
    last = run.rowsBetween(-(window - 1), 0)
    return history.withColumn("step", F.row_number().over(run)).withColumn(
        "moving_avg", F.when(F.col("step") >= window, F.avg("reward").over(last))
    )


def plateau_events(
    history: DataFrame,
    window: int = 20,
    patience: int = 3,
    drop: float = 0.7,
    min_episodes: int = 10,
    eps_start: float = 1.0,
    eps_end: float = 0.05,
    tolerance: float = 1e-6,
) -> DataFrame:
    """Exploration cuts: every ``patience``-th average without improvement.

    An average improves if it exceeds the best earlier one.  Averages between
    two improvements form an island; every ``patience``-th of them is a cut.
    """
    run = Window.partitionBy("run").orderBy("step")
    earlier = run.rowsBetween(Window.unboundedPreceding, -1)
    so_far = run.rowsBetween(Window.unboundedPreceding, 0)
    rated = (
        moving_average(history, window)
        .where((F.col("step") >= min_episodes) & F.col("moving_avg").isNotNull())
        .withColumn("_best", F.max("moving_avg").over(earlier))
        .withColumn(
            "_better",
            F.col("_best").isNull() | (F.col("moving_avg") > F.col("_best") + tolerance),
        )
        .withColumn("_island", F.sum(F.col("_better").cast("int")).over(so_far))
    )
    island = Window.partitionBy("run", "_island").orderBy("step")
    cuts = (
        rated.where("NOT _better")
        .withColumn("_stale", F.row_number().over(island))
        .where(F.col("_stale") % patience == 0)
        .withColumn("_cuts", F.row_number().over(run))
    )

    def after(count):
        return F.greatest(F.lit(eps_end), eps_start * F.pow(F.lit(drop), count))

    return (
        cuts.withColumn("epsilon", after(F.col("_cuts")))
        .where(F.col("epsilon") < after(F.col("_cuts") - 1))
        .select("run", "step", "episode", "moving_avg", "epsilon")
    )


def reward_stats(history: DataFrame) -> DataFrame:
    return history.groupBy("run").agg(
        F.count("*").alias("episodes"),
        F.avg("reward").alias("reward_mean"),
        F.percentile("reward", F.lit(0.5)).alias("reward_median"),
        F.stddev_pop("reward").alias("reward_std"),
        F.min("reward").alias("reward_min"),
        F.max("reward").alias("reward_max"),
    )
