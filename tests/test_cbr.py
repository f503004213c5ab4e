"""Adaptive router against a plain model of the same rules."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierflow.operators import cbr
from tierflow.streaming import intervals

ROW = """log_id long, Level string, Component string, LogSource string, Content string, destination string,
  backend_write_latency_ms double, energy_cpu_pkg_j double"""


def outcomes(spark, rows):
    return spark.createDataFrame(rows, ROW)


def split_by_level(n):
    return [
        (i, "WARN" if i % 2 else "INFO", "app", "linux", "x", "mysql", 1.0 if i % 2 else 10.0, 0.0)
        for i in range(n)
    ]


def test_no_samples_falls_back_to_rules(spark):
    model = cbr.model_from_stats(cbr.empty_state(spark))
    assert model.classifier is None and model.fallback is None
    log = outcomes(spark, [(1, "crit", "app", "linux", "x", "mysql", 0.0, 0.0)])
    assert model.route(log).first()["raw_destination"] == "ipfs"


def test_level_is_chosen_when_it_splits_the_cost(spark):
    stats = cbr.bucket_stats(outcomes(spark, split_by_level(5)))
    model = cbr.model_from_stats(stats)
    assert model.classifier == "Level"
    scores = {r.attr: r.score for r in cbr.attribute_scores(model.stats).collect()}
    assert scores["Level"] == pytest.approx(1.0) and scores["Component"] == pytest.approx(0.0)
    assert all(0.0 <= s <= 1.0 for s in scores.values())


def test_two_samples_choose_only_the_fallback(spark):
    model = cbr.model_from_stats(cbr.bucket_stats(outcomes(spark, split_by_level(2))))
    assert model.classifier is None and model.fallback == "mysql"


def plain_scores(rows, num_buckets, spark):
    costs = [r[6] for r in rows]
    overall = statistics.pvariance(costs)
    result = {}
    for position, attr in enumerate(("Level", "Component", "LogSource"), start=1):
        values = {r[position] or "" for r in rows}
        frame = spark.createDataFrame([(v,) for v in values], "v string")
        from tierflow.functions.text import hash_bucket

        bucket = {r.v: r.b for r in frame.select("v", hash_bucket(F.col("v"), num_buckets).alias("b")).collect()}
        groups = {}
        for r in rows:
            groups.setdefault(bucket[r[position] or ""], []).append(r[6])
        used = [g for g in groups.values() if len(g) >= 2]
        total = sum(map(len, used))
        if total >= 5:
            within = sum(len(g) * statistics.pvariance(g) for g in used) / total
            result[attr] = max(0.0, overall - within) / overall
    return result


def test_scores_match_the_definition(spark):
    rows = [
        (
            i,
            [None, "INFO", "WARN", "ERROR"][i % 4],
            f"c{i % 7}",
            f"s{i % 3}",
            "x",
            ["mysql", "elk", "ipfs"][i % 3],
            float((i * 37) % 50 + (20 if i % 4 == 3 else 0)),
            None,
        )
        for i in range(120)
    ]
    for buckets in (2, 24):
        stats = cbr.bucket_stats(outcomes(spark, rows), buckets)
        got = {r.attr: r.score for r in cbr.attribute_scores(stats).collect()}
        expected = plain_scores(rows, buckets, spark)
        assert got.keys() == expected.keys()
        for attr, score in expected.items():
            assert got[attr] == pytest.approx(score, abs=1e-9)


def test_equal_means_go_to_the_earlier_tier(spark):
    rows = [(i, "INFO", "a", "b", "x", t, 5.0, 0.0) for i, t in enumerate(["ipfs", "elk", "mysql"] * 2)]
    stats = cbr.bucket_stats(outcomes(spark, rows))
    assert cbr.global_best(stats).first()[0] == "mysql"
    assert {r.best_destination for r in cbr.cheapest_by_bucket(stats).collect()} == {"mysql"}


def test_state_round_trip_and_merge(spark, tmp_path):
    rows = split_by_level(20)
    whole = cbr.bucket_stats(outcomes(spark, rows))
    path = str(tmp_path / "state")
    cbr.save_state(cbr.bucket_stats(outcomes(spark, rows[:8])), 24, path)
    merged = cbr.merge_stats(cbr.load_state(spark, path), cbr.bucket_stats(outcomes(spark, rows[8:])))
    for ours, theirs in zip(sorted(merged.collect()), sorted(whole.collect())):
        assert ours[:4] == theirs[:4]
        assert ours["mean"] == pytest.approx(theirs["mean"]) and ours["m2"] == pytest.approx(theirs["m2"])
    with pytest.raises(ValueError):
        cbr.load_state(spark, path, num_buckets=12)


def test_unseen_bucket_uses_the_overall_best(spark):
    rows = split_by_level(40) + [
        (100 + i, "INFO", "app", "linux", "x", "elk", 0.5, 0.0) for i in range(10)
    ]
    model = cbr.model_from_stats(cbr.bucket_stats(outcomes(spark, rows)))
    other = outcomes(spark, [(1, "never seen", "app", "linux", "x", None, None, None)])
    assert model.route(other).first()["raw_destination"] == model.fallback == "elk"


@pytest.mark.parametrize("shift", [0.0, 1e9])
def test_scores_of_shifted_costs(spark, shift):
    """Costs that differ little from a large mean score as if they were small."""
    rows = [
        (i, "WARN" if i % 2 else "INFO", f"c{i % 5}", "linux", "x", "mysql", shift + i % 2, 0.0)
        for i in range(60)
    ]
    halves = [cbr.bucket_stats(outcomes(spark, rows[k::2])) for k in (0, 1)]
    scores = {r.attr: r.score for r in cbr.attribute_scores(cbr.merge_stats(*halves)).collect()}
    assert scores["Level"] == pytest.approx(1.0, abs=1e-9)
    assert all(0.0 <= s <= 1.0 for s in scores.values()) and scores["Component"] < 0.5


def test_old_state_is_refused(spark, tmp_path):
    old = spark.createDataFrame([("Level", 0, "mysql", 1, 1.0, 1.0, 24)], "attr string, bucket long, destination string, n long, sum_cost double, sum_sq double, num_buckets int")
    old.write.parquet(str(tmp_path / "old"))
    with pytest.raises(ValueError):
        cbr.load_state(spark, str(tmp_path / "old"))


def test_missing_outcomes_count_as_failures(spark):
    from tierflow.operators import choices, routing
    from tierflow.operators.trace import replay

    columns = ["Level", "Component", "LogSource", "Content", "EventTemplate"]
    logs = spark.createDataFrame([(i, "INFO", "app", "linux", "x", "t") for i in range(3)], "log_id long, " + ", ".join(f"{c} string" for c in columns))
    found = [(i, t, True, 0.0, 5.0, 0.1) for i in (0, 1) for t in ("mysql", "elk", "ipfs")]
    seen = spark.createDataFrame(found[:-1], "log_id long, destination string, success boolean, routing_latency_ms double, backend_write_latency_ms double, energy_cpu_pkg_j double")
    rewarded = choices.rewards(logs, seen).collect()
    assert len(rewarded) == 9
    assert {round(r.reward, 6) for r in rewarded if r.log_id == 2} == {-1.3}
    runs = replay(logs, seen, {"static": routing.route_static}, "d", with_cheapest=True)
    row = choices.regret(runs).first()
    assert row.logs == 3 and row.max_regret_ms == 0.0
    sampled = cbr.feedback(logs, seen, sample_prob=1.0)
    assert sampled.count() == 9 and sampled.where("NOT success").count() == 4


def test_statistics_of_many_intervals_meet_in_no_window(spark):
    rng = np.random.default_rng(8)
    rows = [
        (s, a, b, "elk", int(rng.integers(0, 4)), float(1e6 + rng.random()), float(rng.random()))
        for s in range(40)
        for a in ("Level", "Component")
        for b in (0, 1, None)
    ]
    schema = "slice long, attr string, bucket int, destination string, n long, mean double, m2 double"
    stats = spark.createDataFrame(rows, schema)
    total = intervals.total_stats(stats)
    assert "Window" not in total._jdf.queryExecution().executedPlan().toString()
    got = {tuple(r[:3]): tuple(r[3:]) for r in total.collect()}
    want = {tuple(r[:3]): tuple(r[3:]) for r in cbr.pooled(stats, intervals.KEYS).collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == pytest.approx(values, rel=1e-12)
