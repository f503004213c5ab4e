"""Where intermediate tables go, and what may be broadcast."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tierflow import runtime
from tierflow.operators.trace import outcomes_within


def fake(master, configured=None, current=None):
    context = SimpleNamespace(
        master=master,
        getCheckpointDir=lambda: current,
        setCheckpointDir=lambda path: pytest.fail(f"made {path}"),
    )
    conf = SimpleNamespace(get=lambda key, default: configured if "checkpoint" in key else default)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_the_cluster_names_the_folder():
    assert runtime.shared_folder(fake("yarn", configured="hdfs:/c")) == "hdfs:/c"
    assert runtime.shared_folder(fake("local[2]", configured="/c")) == "/c"
    assert runtime.shared_folder(fake("yarn", current="hdfs:/set")) == "hdfs:/set"


def test_a_cluster_without_a_folder_is_an_error():
    with pytest.raises(RuntimeError):
        runtime.shared_folder(fake("yarn"))


def test_stored_table_is_read_from_files(spark):
    df = spark.range(5).withColumn("x", F.rand())
    stored = runtime.cut_lineage(df)
    assert stored.collect() == stored.collect()
    assert "parquet" in stored._jdf.queryExecution().executedPlan().toString()


def test_the_planner_broadcasts_small_stored_tables_only(spark):
    small = runtime.cut_lineage(spark.range(100))
    large = runtime.cut_lineage(spark.range(100_000).withColumn("x", F.rand()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        plans = [
            runtime.cut_lineage(spark.range(200_000).withColumn("y", F.rand()))
            .join(side, "id")
            ._jdf.queryExecution()
            .executedPlan()
            .toString()
            for side in (small, large)
        ]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]


def test_stored_steps_are_removed(spark):
    from pathlib import Path

    with runtime.stored_steps(spark):
        kept = runtime.cut_lineage(spark.range(3))
        assert kept.count() == 3
        path = Path(kept.inputFiles()[0].removeprefix("file:")).parent
        assert path.exists()
    assert not path.exists()


def test_outcomes_of_a_batch(spark):
    outcomes = spark.range(100).withColumnRenamed("id", "log_id")
    batch = spark.createDataFrame([(7,), (9,)], "log_id long")
    assert outcomes_within(batch, outcomes).count() == 3
    assert outcomes_within(batch.where("log_id > 50"), outcomes).count() == 0
