"""Stored intermediate tables: where they go and how long they live."""

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Folders of tables stored by this driver and not yet removed.
_STORED: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Only a local session without the setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tierflow-checkpoint-"))
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new shared folder of this driver; ``release`` removes it."""
    path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    _STORED.append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there on.

    A lost executor then costs a reread, not a recomputation, and the planner
    knows the size of the table: it broadcasts it in a join only if it is small.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, "tierflow")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove stored tables, the newest first, down to the first ``since``.

    Results that were not yet read from them cannot be read any more.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    settings = spark._jsc.hadoopConfiguration()
    while len(_STORED) > since:
        path = hadoop(_STORED.pop())
        path.getFileSystem(settings).delete(path, True)


@contextmanager
def stored_steps(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside the block live until its end."""
    since = len(_STORED)
    try:
        yield
    finally:
        release(spark, since)
