"""Scoring intervals finer than a micro-batch, routed in one job.

Where every tier's outcome is seen, what an interval learns does not hang on
where its logs went.  The statistics of each interval are then summed first,
and running sums over the intervals give the state before each: all intervals
of a batch are scored side by side and every log is routed by the state its
own interval started with, as a loop over the intervals would.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.functions.text import hash_bucket
from tierflow.operators.cbr import (
    attribute_scores,
    bucket_stats,
    cheapest_by_bucket,
    classifier_attribute,
    global_best,
)
from tierflow.operators.joins import join_keys
from tierflow.operators.ordered import positions, running
from tierflow.operators.routing import static_destination
from tierflow.runtime import cut_lineage
from tierflow.schemas import CBR_ATTRIBUTES

KEYS = ["attr", "bucket", "destination"]
SLICE = ["slice"]


def sliced(logs: DataFrame, interval: int) -> DataFrame:
    """``logs`` with ``slice``: which run of ``interval`` logs, in id order."""
    numbered = positions(logs.withColumn("_all", F.lit(0)), ["_all"], "log_id", "_place")
    return cut_lineage(
        numbered.withColumn("slice", F.floor((F.col("_place") - 1) / interval)).select(
            *logs.columns, "slice"
        )
    )


def slice_stats(seen: DataFrame, num_buckets: int, metric: str) -> DataFrame:
    """Statistics of each interval's own outcomes."""
    return bucket_stats(seen, num_buckets, metric, by=SLICE)


def centres(stats: DataFrame) -> DataFrame:
    """``_centre``, the mean cost of each key over all intervals."""
    mean = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    return stats.where("n > 0").groupBy(*KEYS).agg(mean.alias("_centre"))


def total_stats(stats: DataFrame) -> DataFrame:
    """Statistics of all intervals together; ``stats`` is stored.

    As ``pooled``, which sends all rows of a key to one task: a key has a row in
    each interval, so they are combined before they move, twice.
    """
    away = F.col("mean") - F.col("_centre")
    about = join_keys(stats.where("n > 0"), cut_lineage(centres(stats)), KEYS, "inner")
    return about.groupBy(*KEYS).agg(
        F.sum("n").alias("n"),
        F.max("_centre").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * away * away).alias("m2"),
    )


def states_before(start: DataFrame, stats: DataFrame, slices: int) -> DataFrame:
    """Statistics ``slice, attr, bucket, destination, n, mean, m2`` before each interval.

    Squares are summed about the key's mean over all intervals, so no large
    sums are subtracted.
    """
    every = cut_lineage(
        stats.unionByName(start.select(F.lit(-1).cast("long").alias("slice"), *KEYS, "n", "mean", "m2"))
    )
    centre = centres(every)
    # Every key stands in every interval: at most attributes x buckets x tiers rows each.
    grid = centre.withColumn("slice", F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(slices - 1).cast("long"))))
    away = F.col("mean") - F.col("_centre")
    filled = grid.join(every, [*KEYS, "slice"], "left").select(
        *KEYS,
        "slice",
        "_centre",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce(F.col("n") * away, F.lit(0.0)).alias("first"),
        F.coalesce(F.col("m2") + F.col("n") * away * away, F.lit(0.0)).alias("second"),
    )
    sums = running(
        filled,
        KEYS,
        SLICE,
        {"n_to": F.col("n"), "first_to": F.col("first"), "second_to": F.col("second")},
    )
    n, first, second = (F.col(f"{c}_to") - F.col(c) for c in ("n", "first", "second"))
    return sums.where((F.col("slice") >= 0) & (n > 0)).select(
        "slice",
        *KEYS,
        n.alias("n"),
        (F.col("_centre") + first / n).alias("mean"),
        F.greatest(F.lit(0.0), second - first * first / n).alias("m2"),
    )


def route_slices(
    logs: DataFrame, states: DataFrame, num_buckets: int, least_samples: int = 0
) -> DataFrame:
    """``raw_destination`` of every log by the state before its interval.

    An interval that starts with fewer samples than ``least_samples`` has no
    classifier yet.
    """
    stored = cut_lineage(states)
    samples = (
        stored.where(F.col("attr") == CBR_ATTRIBUTES[0]).groupBy("slice").agg(F.sum("n").alias("samples"))
    )
    chosen = classifier_attribute(attribute_scores(stored, SLICE), SLICE)
    warm = F.when(F.col("samples") >= least_samples, F.col("classifier"))
    heads = cut_lineage(
        samples.join(chosen, "slice", "left")
        .join(global_best(stored, SLICE), "slice", "left")
        .select("slice", warm.alias("_classifier"), F.col("best_destination").alias("_fallback"))
    )
    policy = cut_lineage(
        cheapest_by_bucket(stored, SLICE)
        .join(heads, "slice")
        .where("attr = _classifier")
        .select("slice", F.col("bucket").alias("_bucket"), "best_destination")
    )
    bucket = F.coalesce(
        *[F.when(F.col("_classifier") == a, hash_bucket(F.col(a), num_buckets)) for a in CBR_ATTRIBUTES]
    )
    return (
        logs.join(heads, "slice", "left")
        .withColumn("_bucket", bucket)
        .join(policy, ["slice", "_bucket"], "left")
        .withColumn(
            "raw_destination", F.coalesce("best_destination", "_fallback", static_destination())
        )
        .drop("_bucket", "_classifier", "_fallback", "best_destination")
    )
