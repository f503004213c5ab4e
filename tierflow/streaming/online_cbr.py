"""The adaptive router on a stream.

Between two scorings the live router is a frozen lookup.  A batch therefore
routes with the state left by the batch before, then adds its own sampled
outcomes to the statistics and stores them under its id.  A scoring interval is
one micro-batch, or a number of decisions where every tier's outcome is seen.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tierflow.functions.text import hash_sample
from tierflow.operators.cbr import (
    NUM_BUCKETS,
    SAMPLE_PROB,
    WARM_SAMPLES,
    CbrModel,
    attribute_scores,
    bucket_stats,
    empty_state,
    load_state,
    merge_stats,
    model_from_stats,
    save_state,
)
from tierflow.operators.routing import apply_compliance
from tierflow.operators.trace import outcomes_of, outcomes_within
from tierflow.runtime import cut_lineage
from tierflow.schemas import CBR_ATTRIBUTES
from tierflow.streaming.intervals import (
    route_slices,
    slice_stats,
    sliced,
    states_before,
    total_stats,
)


@dataclass(frozen=True)
class OnlineCbr:
    """Settings of the online router.

    ``counterfactual`` learns from the outcome at every tier; otherwise only
    the tier a log went to is seen, as in a live system.  ``strict_warmup``
    holds the classifier back until enough samples were taken.  ``interval`` is
    the number of decisions between two scorings; None scores once a batch.
    """

    out: str
    num_buckets: int = NUM_BUCKETS
    sample_prob: float = SAMPLE_PROB
    metric: str = "latency"
    warm_samples: int = WARM_SAMPLES
    strict_warmup: bool = False
    counterfactual: bool = False
    compliance: bool = False
    start_state: str | None = None
    seed: str = "cbr"
    interval: int | None = None

    def __post_init__(self):
        if self.interval is not None and not self.counterfactual:
            # What an interval learns would hang on how the one before was routed.
            raise ValueError("intervals need the outcome at every tier")

    def state_path(self, batch_id: int) -> str:
        return f"{self.out}/state/batch_id={batch_id}"

    def state_before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id > 0:
            return load_state(spark, self.state_path(batch_id - 1), self.num_buckets)
        if self.start_state:
            return load_state(spark, self.start_state, self.num_buckets)
        return empty_state(spark)

    def model(self, stats: DataFrame) -> CbrModel:
        """The frozen lookup of one batch."""
        model = model_from_stats(stats, self.num_buckets)
        if self.strict_warmup and samples_collected(model.stats) < self.warm_samples:
            return CbrModel(model.stats, self.num_buckets, None, model.fallback, model.policy)
        return model

    def step(
        self, batch: DataFrame, observations: DataFrame, batch_id: int
    ) -> tuple[DataFrame, CbrModel]:
        """Decisions of one batch; stores the state after it."""
        spark = batch.sparkSession
        if self.interval is not None:
            return self.sliced_step(batch, observations, batch_id)
        model = self.model(self.state_before(spark, batch_id))
        decided = apply_compliance(model.route(batch), self.compliance)
        drawn = hash_sample(self.sample_prob, self.seed, F.col("log_id"))
        sampled = decided.where(drawn).select(
            "log_id", F.col("destination").alias("_went"), *CBR_ATTRIBUTES
        )
        seen = outcomes_of(sampled, observations.where(drawn))
        if not self.counterfactual:
            seen = seen.where("destination = _went")
        fresh = bucket_stats(seen, self.num_buckets, self.metric)
        merged = merge_stats(model.stats, fresh)
        save_state(merged, self.num_buckets, self.state_path(batch_id))
        return decided, model

    def sliced_step(
        self, batch: DataFrame, observations: DataFrame, batch_id: int
    ) -> tuple[DataFrame, CbrModel]:
        """The same with a state for every interval of the batch."""
        spark = batch.sparkSession
        model = self.model(self.state_before(spark, batch_id))
        logs = sliced(batch, self.interval)
        last = logs.agg(F.max("slice")).first()[0]
        drawn = hash_sample(self.sample_prob, self.seed, F.col("log_id"))
        sampled = logs.where(drawn).select("log_id", "slice", *CBR_ATTRIBUTES)
        seen = outcomes_of(sampled, observations.where(drawn))
        stats = cut_lineage(slice_stats(seen, self.num_buckets, self.metric))
        states = states_before(model.stats, stats, 0 if last is None else last + 1)
        least = self.warm_samples if self.strict_warmup else 0
        decided = apply_compliance(
            route_slices(logs, states, self.num_buckets, least), self.compliance
        )
        merged = merge_stats(model.stats, total_stats(stats))
        save_state(merged, self.num_buckets, self.state_path(batch_id))
        return decided, model

    def start(
        self,
        logs: DataFrame,
        observations: DataFrame,
        checkpoint: str,
        after_batch: Callable[[int, CbrModel], None] | None = None,
    ) -> StreamingQuery:
        """Run over a log stream until it is drained."""

        def process(batch: DataFrame, batch_id: int) -> None:
            kept = batch.persist()
            try:
                outcomes = outcomes_within(kept, observations)
                decided, model = self.step(kept, outcomes, batch_id)
                decided.write.mode("overwrite").parquet(f"{self.out}/decisions/batch_id={batch_id}")
                if after_batch:
                    after_batch(batch_id, model)
            finally:
                kept.unpersist()

        return (
            logs.writeStream.foreachBatch(process)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def samples_collected(stats: DataFrame) -> int:
    """Sampled outcomes so far; each is counted once per attribute."""
    row = stats.where(F.col("attr") == CBR_ATTRIBUTES[0]).agg(F.sum("n")).first()
    return row[0] or 0


def diagnostics(model: CbrModel, batch_id: int) -> DataFrame:
    """One row that describes the router after a batch."""
    scores = attribute_scores(model.stats).agg(
        F.map_from_entries(F.collect_list(F.struct("attr", "score"))).alias("attr_scores")
    )
    return scores.select(
        F.lit(batch_id).alias("batch_id"),
        F.lit(model.classifier).cast("string").alias("classifier_attr"),
        "attr_scores",
        F.lit(samples_collected(model.stats)).cast("long").alias("samples_collected"),
    )


def dump_diagnostics(path: str, every: int = 1, mode: str = "overwrite"):
    """Callback that writes diagnostics every few batches.

    ``overwrite`` keeps the last snapshot, ``append`` keeps one of each batch
    under the batch's id, and ``timestamp`` writes a folder per batch.  A batch
    that runs again replaces what it wrote.
    """
    if mode not in ("overwrite", "append", "timestamp"):
        raise ValueError(f"unknown dump mode: {mode}")

    def dump(batch_id: int, model: CbrModel) -> None:
        if every <= 0 or (batch_id + 1) % every:
            return
        named = {"timestamp": f"{path}_{batch_id}", "append": f"{path}/batch={batch_id}"}
        diagnostics(model, batch_id).write.mode("overwrite").json(named.get(mode, path))

    return dump
