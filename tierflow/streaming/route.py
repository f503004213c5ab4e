"""Continuous routing: every micro-batch to its tiers and to the trace."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tierflow.operators.routing import Router, apply_compliance
from tierflow.operators.trace import outcomes_within, trace
from tierflow.schemas import LOG_COLUMNS
from tierflow.sources.tiers import write_tier_shapes


def route_stream(
    logs: DataFrame,
    observations: DataFrame,
    router: Router,
    name: str,
    dataset: Column | str,
    out: str,
    checkpoint: str,
    compliance: bool = True,
    patterns: Sequence[str] | None = None,
) -> StreamingQuery:
    """Route a log stream until it is drained.

    Every batch writes to a folder named after its id and replaces it, so a
    batch that runs again leaves the same files.  Each log goes to its tier in
    that tier's shape.  The decisions are kept for the writes of a batch and
    released after it.
    """
    columns = [c for c in LOG_COLUMNS if c in logs.columns]
    decided = apply_compliance(router(logs), compliance, patterns)

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            part = f"batch_id={batch_id}"
            write_tier_shapes(kept, columns, f"{out}/tiers", part)
            outcomes = outcomes_within(kept, observations)
            trace(kept, outcomes, name, dataset).write.mode("overwrite").parquet(
                f"{out}/trace/batch_id={batch_id}"
            )
        finally:
            kept.unpersist()

    return (
        decided.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def mix_by_window(
    decided: DataFrame, width: str = "1 day", delay: str = "1 hour", event_time: str = "ts"
) -> DataFrame:
    """Destination mix and sensitive rate per tumbling window.

    A log seen twice within the delay counts once; late windows close when the
    watermark passes them.
    """
    destination = F.col("destination")
    return (
        decided.withWatermark(event_time, delay)
        .dropDuplicatesWithinWatermark(["log_id"])
        .groupBy(F.window(event_time, width))
        .agg(
            F.count("*").alias("logs"),
            *[F.count_if(destination == t).alias(f"{t}_logs") for t in ("mysql", "elk", "ipfs")],
            F.count_if("sensitive").alias("sensitive_logs"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "logs",
            "mysql_logs",
            "elk_logs",
            "ipfs_logs",
            "sensitive_logs",
        )
    )
