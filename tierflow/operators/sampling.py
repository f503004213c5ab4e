"""Stream orders and limits of a run: head, random, balanced."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierflow.operators.ordered import positions


def head_order(logs: DataFrame) -> DataFrame:
    """Original order."""
    return logs.orderBy("log_id")


def random_order(logs: DataFrame, seed: str = "0") -> DataFrame:
    """A shuffle that a rerun repeats: order by a seeded hash of the id."""
    text = F.concat(F.col("log_id").cast("string"), F.lit("|" + seed))
    return logs.withColumn("shuffle_key", F.md5(text)).orderBy("shuffle_key")


def balanced_order(logs: DataFrame, group: str = "LogSource") -> DataFrame:
    """Round robin over groups, groups in order of first appearance.

    A row without a group counts as ``unknown``.
    """
    filled = logs.withColumn(group, F.coalesce(F.col(group), F.lit("unknown")))
    ranked = positions(filled, [group], "log_id", name="round")
    return ranked.withColumnRenamed("first_log_id", "first_id").orderBy("round", "first_id")


def first_rows(logs: DataFrame, group: str, limit: int) -> DataFrame:
    """Of every group the first ``limit`` rows, which hold any balanced sample
    of that size; kept map-side before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy("log_id"))
    return logs.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def sample(
    logs: DataFrame,
    mode: str = "head",
    limit: int = 0,
    seed: str = "0",
    group: str = "LogSource",
) -> DataFrame:
    """Ordered stream of a run; ``limit`` 0 keeps every row."""
    if mode == "head":
        ordered = head_order(logs)
    elif mode == "random":
        ordered = random_order(logs, seed)
    elif mode == "balanced":
        ordered = balanced_order(first_rows(logs, group, limit) if limit > 0 else logs, group)
    else:
        raise ValueError(f"unknown sample mode: {mode}")
    return ordered.limit(limit) if limit > 0 else ordered
