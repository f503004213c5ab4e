"""The tabular policy as one object: fit, route, save, load."""

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.ml.feature import PCAModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.operators import qpolicy, states
from tierflow.runtime import cut_lineage

STEPS_SCHEMA = """mean array<double>, std array<double>, signs array<double>, offset array<double>,
  edges array<array<double>>, metadata string"""


@dataclass(frozen=True)
class StateSteps:
    """Scaling, projection and bins that turn a vector into a state."""

    scaler: states.Scaler
    projection: states.Projection
    bins: states.QuantileBins

    def apply(self, df: DataFrame, vector: str) -> DataFrame:
        """Add ``state``."""
        reduced = self.projection.apply(df, vector, "_reduced")
        components = [F.col("_reduced")[i] for i in range(self.projection.size)]
        key = states.state_key(self.bins.apply(components))
        return reduced.withColumn("state", key).drop("_reduced")


def fit_steps(
    df: DataFrame,
    vector: str,
    components: int = qpolicy.PCA_COMPONENTS,
    n_bins: int = qpolicy.N_BINS,
) -> StateSteps:
    """Fit all three steps.  ``df`` is read a few times; store it if it is costly."""
    scaler = states.fit_scaler(df, vector)
    projection = states.fit_projection(df, vector, scaler, components)
    reduced = projection.apply(df.select(vector), vector, "_reduced")
    columns = [F.col("_reduced")[i] for i in range(projection.size)]
    return StateSteps(scaler, projection, states.fit_bins(reduced, columns, n_bins))


@dataclass(frozen=True)
class TabularPolicy:
    """Fitted steps, the table ``state, action, q`` and free-form metadata."""

    steps: StateSteps
    q: DataFrame
    metadata: dict = field(default_factory=dict)

    @property
    def usable(self) -> bool:
        return states.compatible(
            self.steps.scaler, self.metadata.get("obs_dim"), self.metadata.get("version")
        )

    def route(self, logs: DataFrame, vector: str) -> DataFrame:
        """Greedy action of the log's state; rules where the model does not fit."""
        if not self.usable:
            return qpolicy.route_or_degrade(logs, None, False)
        stated = self.steps.apply(logs, vector)
        return qpolicy.route_or_degrade(stated, qpolicy.greedy_policy(self.q), True)


def fit_policy(
    logs: DataFrame,
    vector: str,
    rewarded: DataFrame,
    components: int = qpolicy.PCA_COMPONENTS,
    n_bins: int = qpolicy.N_BINS,
    gamma: float = qpolicy.GAMMA,
    prior_bonus: float = qpolicy.PRIOR_BONUS,
    tolerance: float = qpolicy.TOLERANCE,
) -> TabularPolicy:
    """Fit states on the logs' vectors and values on the measured rewards.

    ``logs`` has ``log_id, Node, ts, desired`` and the vector; ``rewarded`` has
    the reward of every log and destination.
    """
    steps = fit_steps(logs, vector, components, n_bins)
    stated = cut_lineage(
        steps.apply(logs, vector).select(
            "log_id", "Node", "ts", "state", F.col("desired").alias("teacher")
        )
    )
    moves = qpolicy.transitions(stated, rewarded)
    q = qpolicy.fit_q(
        qpolicy.transition_counts(moves),
        qpolicy.teacher_by_state(stated),
        gamma,
        prior_bonus,
        tolerance,
    )
    metadata = {
        "version": states.NEWEST_VERSION,
        "obs_dim": len(steps.scaler.mean),
        "pca_components": steps.projection.size,
        "n_bins": n_bins,
        "tolerance": tolerance,
        "gamma": gamma,
        "prior_bonus": prior_bonus,
    }
    return TabularPolicy(steps, cut_lineage(q), metadata)


def save_policy(policy: TabularPolicy, path: str) -> None:
    """Three datasets under ``path``: values, axes, and the numbers of the steps."""
    steps = policy.steps
    row = (
        list(steps.scaler.mean),
        list(steps.scaler.std),
        list(steps.projection.signs),
        list(steps.projection.offset),
        [list(e) for e in steps.bins.edges],
        json.dumps(policy.metadata),
    )
    spark = policy.q.sparkSession
    policy.q.write.mode("overwrite").parquet(f"{path}/q")
    steps.projection.model.write().overwrite().save(f"{path}/axes")
    numbers = spark.createDataFrame([row], STEPS_SCHEMA)
    numbers.coalesce(1).write.mode("overwrite").json(f"{path}/steps")


def load_policy(spark: SparkSession, path: str) -> TabularPolicy | None:
    """The saved policy, or None if there is none at the path."""
    try:
        row = spark.read.schema(STEPS_SCHEMA).json(f"{path}/steps").first()
        q = spark.read.parquet(f"{path}/q")
    except AnalysisException:
        return None
    std = tuple(row["std"])
    projection = states.Projection(
        PCAModel.load(f"{path}/axes"), std, tuple(row["signs"]), tuple(row["offset"])
    )
    bins = states.QuantileBins(tuple(tuple(e) for e in row["edges"]))
    steps = StateSteps(states.Scaler(tuple(row["mean"]), std), projection, bins)
    return TabularPolicy(steps, q, json.loads(row["metadata"]))


def route_with(policy: TabularPolicy | None, logs: DataFrame, vector: str) -> DataFrame:
    """Route by the policy, or by the rules when there is no policy."""
    if policy is None:
        return qpolicy.route_or_degrade(logs, None, False)
    return policy.route(logs, vector)
