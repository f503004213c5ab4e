"""Sliding and session windows over a stream, with the rows that came too late.

Spark's own stateful windows drop a row behind the watermark without a trace.
Here every micro-batch splits its rows at the watermark of the batches before
it: rows in time go to their windows, the others to a table of late rows, so
that windows and late rows together account for all of the input.

Every table of a batch goes to a folder named after its id and replaces it: a
batch that runs again reads the state of the batch before and leaves the same
files.  Only open windows are carried on, so the state does not grow with the
stream.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

BOUNDS = ("window_start", "window_end")


@dataclass(frozen=True)
class Sliding:
    """Windows of ``width``, one every ``slide``; a row lies in several.

    A row is late for a window that the watermark has passed, and may be in
    time for the next: it is then in both tables, once for each window.
    """

    width: str
    slide: str

    def assigned(self, rows: DataFrame, time: str) -> DataFrame:
        """A row for each row and window."""
        return _bounded(rows.withColumn("_window", F.window(time, self.width, self.slide)))

    def late(self, time: str, watermark: Column) -> Column:
        return F.col("window_end") <= watermark

    def merged(self, parts: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
        return parts.groupBy(*keys, *BOUNDS).agg(*[F.sum(s).alias(s) for s in sums])


@dataclass(frozen=True)
class Sessions:
    """Rows of a key that follow each other within ``gap``.

    A row behind the watermark is late: a session it would belong to may be
    closed.  A row in time never touches a closed session.
    """

    gap: str

    def assigned(self, rows: DataFrame, time: str) -> DataFrame:
        end = F.col(time) + F.expr(f"INTERVAL {self.gap}")
        return rows.withColumn("window_start", F.col(time)).withColumn("window_end", end)

    def late(self, time: str, watermark: Column) -> Column:
        return F.col(time) <= watermark

    def merged(self, parts: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
        """Parts that overlap or touch become one session, from first to last bound."""
        length = F.unix_micros("window_end") - F.unix_micros("window_start")
        spread = F.concat(length.cast("string"), F.lit(" microseconds"))
        window = F.session_window("window_start", spread).alias("_window")
        merged = parts.groupBy(*keys, window).agg(*[F.sum(s).alias(s) for s in sums])
        return _bounded(merged).select(*keys, *BOUNDS, *sums)


def _bounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {"window_start": F.col("_window.start"), "window_end": F.col("_window.end")}
    ).drop("_window")


def _saved(spark: SparkSession, path: str, schema: StructType, batch_id: int) -> DataFrame:
    if batch_id < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch_id={batch_id}")


CLOCK = StructType().add("watermark", "timestamp")


def window_stream(
    rows: DataFrame,
    windows: Sliding | Sessions,
    counts: dict[str, Column],
    out: str,
    checkpoint: str,
    keys: Sequence[str] = (),
    delay: str = "1 hour",
    time: str = "ts",
) -> StreamingQuery:
    """Count into windows until the stream is drained.

    ``counts`` are whole numbers per row, summed per key and window.  The
    watermark is the latest ``time`` of all batches before, less ``delay``; the
    first batch has none.  Rows without a time belong to no window and are
    late.  Results are read by ``read_windows`` and ``read_late``.
    """
    spark = rows.sparkSession
    schema = window_schema(rows, counts, keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        clock = _saved(session, f"{out}/clock", CLOCK, batch_id - 1).first()
        watermark = F.lit(clock.watermark if clock else None).cast("timestamp")

        def save(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")

        kept = batch.persist()
        try:
            timed = windows.assigned(kept.where(F.col(time).isNotNull()), time)
            behind = F.coalesce(windows.late(time, watermark), F.lit(False))
            untimed = kept.where(F.col(time).isNull()).withColumns(
                {b: F.lit(None).cast("timestamp") for b in BOUNDS}
            )
            save(timed.where(behind).unionByName(untimed), "late")
            parts = timed.where(~behind).select(*keys, *BOUNDS, *[c.cast("long").alias(n) for n, c in counts.items()])
            # Rows of one batch are added up before they meet the open windows.
            now = windows.merged(parts, keys, list(counts))
            opened = _saved(session, f"{out}/open", schema, batch_id - 1)
            merged = windows.merged(opened.unionByName(now), keys, list(counts)).persist()
            try:
                latest = F.max(time) - F.expr(f"INTERVAL {delay}")
                save(kept.agg(F.greatest(watermark, latest).alias("watermark")), "clock")
                passed = _saved(session, f"{out}/clock", CLOCK, batch_id).first().watermark
                closed = F.coalesce(F.col("window_end") <= F.lit(passed).cast("timestamp"), F.lit(False))
                save(merged.where(closed), "closed")
                save(merged.where(~closed), "open")
            finally:
                merged.unpersist()
        finally:
            kept.unpersist()

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def window_schema(rows: DataFrame, counts: dict[str, Column], keys: Sequence[str] = ()) -> StructType:
    """Schema of the windows of ``rows``."""
    schema = StructType([rows.schema[k] for k in keys])
    for bound in BOUNDS:
        schema.add(bound, "timestamp")
    for name in counts:
        schema.add(name, "long")
    return schema


def read_windows(spark: SparkSession, out: str, schema: StructType, last: int) -> DataFrame:
    """Every window with ``closed``; those still open stand as of batch ``last``."""
    closed = spark.read.schema(schema).parquet(f"{out}/closed").drop("batch_id")
    opened = _saved(spark, f"{out}/open", schema, last)
    return closed.withColumn("closed", F.lit(True)).unionByName(opened.withColumn("closed", F.lit(False)))


def read_late(spark: SparkSession, out: str) -> DataFrame:
    """Rows that came too late, with the window they missed, and rows without a time."""
    return spark.read.parquet(f"{out}/late").drop("batch_id")
