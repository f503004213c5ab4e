"""Shapes of physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from tierflow.operators import cbr, choices, embedding, qpolicy, routing, sampling, summaries
from tierflow.operators.trace import outcomes_by_log, parts_by_rows, replay
from tierflow.sources import tables
from tierflow.sources.bucketed import read_bucketed, write_bucketed

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_auto_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rules_read_only_what_they_need(spark):
    text = plan(tables.logs(spark, SMALL).select("log_id", routing.static_destination()))
    assert "Exchange" not in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "ts" not in [c.split(":")[0] for c in schema.split(",")]


def test_adaptive_route_moves_no_logs(spark, no_auto_broadcast):
    logs = tables.logs(spark, SMALL)
    model = cbr.fit_cbr(logs, tables.observations(spark, SMALL), sample_prob=0.5)
    text = plan(model.route(logs).select("log_id", "raw_destination"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_policy_route_moves_no_logs(spark):
    logs = tables.logs(spark, SMALL).withColumn("state", F.col("EventId"))
    policy = spark.createDataFrame([("E1", 1), ("E2", 2)], "state string, action int")
    text = plan(qpolicy.route_q(logs, policy).select("log_id", "raw_destination"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_no_window_over_all_rows(spark):
    steps = tables.logs(spark, SMALL).select("log_id", "Node", "ts", F.col("Level").alias("state"))
    for df in (
        qpolicy.next_states(steps),
        sampling.balanced_order(tables.logs(spark, SMALL).select("log_id", "LogSource")),
    ):
        assert "SinglePartition" not in plan(df)


def test_replay_shuffles_each_side_once(spark, no_auto_broadcast):
    rows = replay(
        tables.logs(spark, SMALL), tables.observations(spark, SMALL), routing.ROUTERS, F.col("LogSource")
    )
    text = plan(rows.select("router", "total_latency_ms"))
    assert text.count("Exchange hashpartitioning") == 2
    assert "Content" not in text.split("SortMergeJoin")[0]


def test_pairing_by_log_adds_no_shuffle_of_logs(spark, no_auto_broadcast):
    rows = replay(
        tables.logs(spark, SMALL),
        tables.observations(spark, SMALL),
        {"static": routing.route_static},
        F.col("LogSource"),
        (False, True),
    )
    text = plan(summaries.paired_by_log(rows))
    # both sides of the join by log id, and the few runs at the end
    assert text.count("Exchange hashpartitioning") == 3


def test_sampled_feedback_filters_both_scans(spark, no_auto_broadcast):
    rows = cbr.feedback(tables.logs(spark, SMALL), tables.observations(spark, SMALL))
    assert len(re.findall(r"Filter \(.*% 10000", plan(rows))) == 2


def test_bucketed_tables_join_in_place(spark, tmp_path, no_auto_broadcast):
    logs = tables.logs(spark, SMALL)
    outcomes = tables.observations(spark, SMALL)
    write_bucketed(logs, "logs_b", 4, str(tmp_path / "logs"))
    write_bucketed(outcomes, "outcomes_b", 4, str(tmp_path / "outcomes"))
    stored, found = read_bucketed(spark, "logs_b"), read_bucketed(spark, "outcomes_b")
    assert "Exchange" not in plan(outcomes_by_log(found))
    routers = {"static": routing.route_static}
    in_place = replay(stored, found, routers, F.col("LogSource"))
    assert "Exchange" not in plan(in_place)
    shuffled = replay(logs, outcomes, routers, F.col("LogSource"))
    assert sorted(map(str, in_place.collect())) == sorted(map(str, shuffled.collect()))
    spark.sql("DROP TABLE logs_b")
    spark.sql("DROP TABLE outcomes_b")


def test_regret_reads_logs_and_outcomes_once(spark, no_auto_broadcast):
    rows = replay(
        tables.logs(spark, SMALL),
        tables.observations(spark, SMALL),
        routing.ROUTERS,
        F.col("LogSource"),
        with_cheapest=True,
    )
    text = plan(choices.regret(rows))
    assert text.count("FileScan parquet") == 2


def test_default_encoder_is_native_and_moves_texts_once(spark):
    texts = spark.createDataFrame([(1, "a b a"), (2, None), (3, "a b a")], "id long, t string")
    vectors = embedding.embed_texts(texts, F.col("t"), "n", embedding.hashed_words(8))
    text = plan(vectors)
    assert "Python" not in text and text.count("Exchange") == 1
    rows = {tuple(r["embedding"]) for r in vectors.collect()}
    assert len(rows) == 2 and tuple([0.0] * 8) in rows
    assert all(abs(sum(v) - 1) < 1e-6 or sum(v) == 0 for v in rows)


def test_cache_encodes_each_text_once(spark, tmp_path):
    path, seen = str(tmp_path / "cache"), []

    def encoder(texts):
        seen.append(texts.count())
        return embedding.hashed_words(4)(texts)

    first = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    second = spark.createDataFrame([(1, "b"), (2, "c")], "id long, t string")
    for df in (first, second, second):
        cache = embedding.append_to_cache(spark, path, df, F.col("t"), "n", encoder)
    assert seen == [2, 1, 0] and cache.count() == 3


def test_parts_of_a_replay_grow_with_logs(spark, no_auto_broadcast):
    logs, outcomes = tables.logs(spark, SMALL), tables.observations(spark, SMALL)
    count = logs.count()
    assert parts_by_rows(logs, count) is None
    parts = parts_by_rows(logs, -(-count // 40))
    assert parts >= 39 and parts_by_rows(logs.where("log_id IS NULL")) is None
    routers = {"static": routing.route_static}
    rows = replay(logs, outcomes, routers, F.col("LogSource"), (False, True), partitions=parts)
    paired = summaries.paired_by_log(rows)
    assert plan(paired).count("Exchange hashpartitioning(log_id") == 2
    assert plan(paired).count(f", {parts}), REPARTITION_BY_NUM") == 2
    plain = replay(logs, outcomes, routers, F.col("LogSource"), (False, True))
    assert sorted(map(str, rows.collect())) == sorted(map(str, plain.collect()))
