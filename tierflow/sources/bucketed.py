"""Logs and outcomes laid out so that replays need no shuffle.

Both tables are bucketed and sorted by log id with the same bucket count.  The
outcome aggregate and the join by log id then read matching buckets in place.
"""

from pyspark.sql import DataFrame, SparkSession


def write_bucketed(
    df: DataFrame, name: str, buckets: int, path: str | None = None, key: str = "log_id"
) -> None:
    """Save as a table of the catalog; ``path`` puts its files elsewhere."""
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
