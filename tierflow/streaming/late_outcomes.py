"""Decisions and outcomes as two streams: an outcome may come after its log.

A decision waits for its outcome in the state of a stream-stream left outer
join.  An outcome counts if it was measured within a time bound of the
decision; only when the watermark has passed that bound is a missing outcome a
failed write.  State is dropped at the same moment, so it holds the decisions
of the bound and of the allowed disorder, not of the whole stream.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tierflow.operators.trace import MEASURES, decision_rows, measured
from tierflow.schemas import TRACE_SCHEMA


def late_trace(
    decided: DataFrame,
    outcomes: DataFrame,
    router: str,
    dataset: Column | str,
    within: str = "2 hours",
    disorder: str = "3 hours",
    decided_at: str = "ts",
    measured_at: str = "measured_at",
) -> DataFrame:
    """Trace of a stream of decisions and a stream of their outcomes.

    ``within`` is how long after its decision an outcome counts, ``disorder``
    how far rows of either stream may come out of order.  An outcome that is
    delivered again counts once.
    """
    left = decision_rows(decided, router, dataset, [decided_at]).withWatermark(
        decided_at, disorder
    )
    right = (
        outcomes.select("log_id", "destination", *MEASURES, measured_at)
        .withWatermark(measured_at, disorder)
        .dropDuplicatesWithinWatermark(["log_id", "destination"])
        .withColumnsRenamed({"log_id": "_id", "destination": "_tier"})
    )
    meets = (
        (F.col("log_id") == F.col("_id"))
        & (F.col("destination") == F.col("_tier"))
        & (F.col(measured_at) >= F.col(decided_at))
        & (F.col(measured_at) <= F.col(decided_at) + F.expr(f"INTERVAL {within}"))
    )
    joined = left.join(right, meets, "left_outer")
    kept = [f.name for f in TRACE_SCHEMA if f.name in left.columns]
    rows = joined.select(*kept, *measured(*[F.col(m) for m in MEASURES]))
    for field in TRACE_SCHEMA:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    return rows.select(*[f.name for f in TRACE_SCHEMA])


def write_late_trace(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append trace rows as they become final, until the streams are drained."""
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
