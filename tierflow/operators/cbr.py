"""Adaptive content-based router on sufficient statistics.

The router samples measured costs, groups them by a hashed attribute value, and
routes by the attribute whose buckets explain most of the cost variance.  Its
state is a table of counts, means and squares about the mean with at most
attributes x buckets x tiers rows, whatever the number of logs.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierflow.functions.cost import ENERGY_WEIGHT, LATENCY_WEIGHT, routing_cost
from tierflow.functions.text import hash_bucket, hash_sample
from tierflow.operators.routing import static_destination
from tierflow.operators.trace import outcomes_of
from tierflow.runtime import cut_lineage
from tierflow.schemas import CBR_ATTRIBUTES, CBR_STATE_SCHEMA, TIERS

# Defaults of the adaptive router.
NUM_BUCKETS = 24
SAMPLE_PROB = 0.06
WARM_SAMPLES = 150
RECOMPUTE_INTERVAL = 200
MIN_SAMPLES = 5
MIN_VARIANCE = 1e-9


def tier_rank(destination: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), destination)


def attribute_rank(attr: Column) -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in CBR_ATTRIBUTES]), attr)


def attribute_buckets(logs: DataFrame, num_buckets: int = NUM_BUCKETS) -> DataFrame:
    """One row per log and attribute: ``log_id, attr, bucket``."""
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("attr"), hash_bucket(F.col(a), num_buckets).alias("bucket"))
            for a in CBR_ATTRIBUTES
        ]
    )
    return logs.select("log_id", F.explode(pairs).alias("_pair")).select("log_id", "_pair.*")


def feedback(
    logs: DataFrame,
    observations: DataFrame,
    sample_prob: float = SAMPLE_PROB,
    seed: str = "cbr",
) -> DataFrame:
    """Outcomes of the sampled logs with the classifying attributes.

    A missing outcome is a failed write.
    """
    drawn = hash_sample(sample_prob, seed, F.col("log_id"))
    sampled = logs.where(drawn).select("log_id", *CBR_ATTRIBUTES)
    return outcomes_of(sampled, observations.where(drawn))


def bucket_stats(
    outcomes: DataFrame,
    num_buckets: int = NUM_BUCKETS,
    metric: str = "latency",
    latency_weight: float = LATENCY_WEIGHT,
    energy_weight: float = ENERGY_WEIGHT,
    by: Sequence[str] = (),
) -> DataFrame:
    """Count, mean and squares about the mean of cost by attribute, bucket, tier.

    A value shared by most logs is combined before the shuffle.  ``by`` names
    columns that keep statistics apart, here and in the functions below.
    """
    cost = routing_cost(
        metric,
        F.col("backend_write_latency_ms"),
        F.col("energy_cpu_pkg_j"),
        latency_weight,
        energy_weight,
    )
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("attr"), hash_bucket(F.col(a), num_buckets).alias("bucket"))
            for a in CBR_ATTRIBUTES
        ]
    )
    return (
        outcomes.select(*by, "destination", cost.alias("_cost"), F.explode(pairs).alias("_pair"))
        .groupBy(*by, "_pair.attr", "_pair.bucket", "destination")
        .agg(
            F.count("_cost").alias("n"),
            F.avg("_cost").alias("mean"),
            (F.var_pop("_cost") * F.count("_cost")).alias("m2"),
        )
        .where("n > 0")
    )


def merge_stats(*states: DataFrame) -> DataFrame:
    """Statistics of all states together."""
    merged = states[0]
    for state in states[1:]:
        merged = merged.unionByName(state)
    return pooled(merged, ["attr", "bucket", "destination"])


def pooled(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Statistics by fewer keys, or of several tables: ``n, mean, m2``.

    Squares are taken about the pooled mean, never as a difference of large
    sums.
    """
    per = Window.partitionBy(*keys)
    about = stats.where("n > 0").withColumn(
        "_mean", F.sum(F.col("n") * F.col("mean")).over(per) / F.sum("n").over(per)
    )
    between = F.col("n") * F.pow(F.col("mean") - F.col("_mean"), 2)
    return about.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.max("_mean").alias("mean"),
        F.sum(F.col("m2") + between).alias("m2"),
    )


def expected_costs(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return stats.where("n > 0").select(
        *by, "attr", "bucket", "destination", F.col("mean").alias("mean_cost")
    )


def attribute_scores(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of the cost variance that each attribute's buckets explain.

    Every attribute has seen every sample, so each one's own totals give the
    overall variance and no second table is needed.  The first gate counts a
    sample once per attribute.
    """
    usable = F.col("n") >= 2
    per_bucket = pooled(stats, [*by, "attr", "bucket"])
    within = per_bucket.groupBy(*by, "attr").agg(
        F.sum(F.when(usable, F.col("m2"))).alias("_within"),
        F.sum(F.when(usable, F.col("n")).otherwise(0)).alias("_used"),
    )
    overall = F.col("m2") / F.col("n")
    return (
        pooled(per_bucket, [*by, "attr"])
        .join(within, [*by, "attr"])
        .where(F.col("n") * len(CBR_ATTRIBUTES) >= MIN_SAMPLES)
        .where((overall > MIN_VARIANCE) & (F.col("_used") >= MIN_SAMPLES))
        .select(
            *by,
            "attr",
            (F.greatest(F.lit(0.0), overall - F.col("_within") / F.col("_used")) / overall).alias("score"),
        )
    )


def classifier_attribute(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row: the best attribute, null if none qualifies."""
    order = F.struct("score", (-attribute_rank(F.col("attr"))).alias("rank"))
    return scores.groupBy(*by).agg(F.max_by("attr", order).alias("classifier"))


def cheapest_by_bucket(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cheapest tier of each attribute bucket; ties go to the earlier tier."""
    order = F.struct("mean_cost", tier_rank(F.col("destination")).alias("rank"))
    return (
        expected_costs(stats, by)
        .groupBy(*by, "attr", "bucket")
        .agg(F.min_by("destination", order).alias("best_destination"))
    )


def global_best(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row: the tier with the lowest mean cost over all samples."""
    first = CBR_ATTRIBUTES[0]
    order = F.struct("mean_cost", tier_rank(F.col("destination")).alias("rank"))
    return (
        stats.where(F.col("attr") == first)
        .groupBy(*by, "destination")
        .agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean_cost"))
        .groupBy(*by)
        .agg(F.min_by("destination", order).alias("best_destination"))
    )


@dataclass(frozen=True)
class CbrModel:
    """Statistics and what follows from them: attribute, policy, fallback."""

    stats: DataFrame
    num_buckets: int
    classifier: str | None
    fallback: str | None
    policy: DataFrame

    def route(self, logs: DataFrame) -> DataFrame:
        """Cheapest tier of the log's bucket, else the overall best, else rules.

        The policy has at most ``num_buckets`` rows and is broadcast, so logs
        stay where they are.
        """
        rest = static_destination() if self.fallback is None else F.lit(self.fallback)
        if self.classifier is None:
            return logs.withColumn("raw_destination", rest)
        return (
            logs.withColumn("_bucket", hash_bucket(F.col(self.classifier), self.num_buckets))
            .join(F.broadcast(self.policy), "_bucket", "left")
            .withColumn("raw_destination", F.coalesce("best_destination", rest))
            .drop("_bucket", "best_destination")
        )


def model_from_stats(stats: DataFrame, num_buckets: int = NUM_BUCKETS) -> CbrModel:
    """Score the attributes and fix the policy.

    The statistics table is stored first.  It has at most attributes x buckets
    x tiers rows, so it is read as one partition and scored without a shuffle.
    Two one-row results, the name of the best attribute and of the overall best
    tier, become parameters.
    """
    stored = cut_lineage(stats).coalesce(1)
    classifier = classifier_attribute(attribute_scores(stored)).first()["classifier"]
    fallback = global_best(stored).first()["best_destination"]
    policy = (
        cheapest_by_bucket(stored)
        .where(F.col("attr") == F.lit(classifier))
        .select(F.col("bucket").alias("_bucket"), "best_destination")
    )
    return CbrModel(stored, num_buckets, classifier, fallback, policy)


def fit_cbr(
    logs: DataFrame,
    observations: DataFrame,
    num_buckets: int = NUM_BUCKETS,
    sample_prob: float = SAMPLE_PROB,
    metric: str = "latency",
    latency_weight: float = LATENCY_WEIGHT,
    energy_weight: float = ENERGY_WEIGHT,
    seed: str = "cbr",
) -> CbrModel:
    """Fit on sampled outcomes."""
    outcomes = feedback(logs, observations, sample_prob, seed)
    stats = bucket_stats(outcomes, num_buckets, metric, latency_weight, energy_weight)
    return model_from_stats(stats, num_buckets)


def save_state(stats: DataFrame, num_buckets: int, path: str) -> None:
    stats.withColumn("num_buckets", F.lit(num_buckets)).coalesce(1).write.mode(
        "overwrite"
    ).parquet(path)


def load_state(spark: SparkSession, path: str, num_buckets: int = NUM_BUCKETS) -> DataFrame:
    """Saved statistics; another bucket count is refused."""
    stored = spark.read.parquet(path)
    missing = set(CBR_STATE_SCHEMA.names) - set(stored.columns)
    if missing:
        raise ValueError(f"state lacks {', '.join(sorted(missing))}")
    other = stored.where(F.col("num_buckets") != num_buckets).select("num_buckets").head(1)
    if other:
        raise ValueError(f"state has {other[0][0]} buckets, not {num_buckets}")
    return stored.select(*CBR_STATE_SCHEMA.names)


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CBR_STATE_SCHEMA)
