"""Scaling, bins, tabular policy and reward histories against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierflow.operators import learned, qpolicy, rewards, states, tabular


def vectors(spark, array):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(array)]
    return spark.createDataFrame(rows, "id long, v array<double>")


def test_scaler(spark):
    data = np.random.default_rng(0).normal(3, 2, (50, 6))
    data[:, 5] = 4.0
    df = vectors(spark, data)
    scaler = states.fit_scaler(df, "v")
    assert np.allclose(scaler.mean, data.mean(axis=0))
    assert np.allclose(scaler.std, data.std(axis=0) + 1e-8)
    assert states.fit_scaler(df, "v", floor=True).std[5] == 1e-6
    got = np.array([r[0] for r in df.orderBy("id").select(scaler.apply(F.col("v"))).collect()])
    assert np.allclose(got, (data - data.mean(axis=0)) / (data.std(axis=0) + 1e-8))
    short = vectors(spark, [[1.0, 2.0]])
    assert short.select(scaler.apply(F.col("v"))).first()[0] == [1.0, 2.0]


def test_projection_is_principal_axes(spark):
    data = np.random.default_rng(1).normal(2, 1, size=(80, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    data[:, 1] += data[:, 0]
    df = vectors(spark, data)
    scaler = states.fit_scaler(df, "v")
    fitted = states.fit_projection(df, "v", scaler, 9)
    assert fitted.size == 5
    got = np.array([r.p for r in fitted.apply(df, "v", "p").orderBy("id").collect()])
    scaled = (data - data.mean(axis=0)) / (data.std(axis=0) + 1e-8)
    _, _, axes = np.linalg.svd(scaled, full_matrices=False)
    turned = np.array([a if a.max() >= -a.min() else -a for a in axes])
    assert np.allclose(got, scaled @ turned.T, atol=1e-6)
    with pytest.raises(ValueError):
        states.fit_projection(df, "v", scaler, 0)


def test_policy_survives_saving(spark, tmp_path):
    import datetime as dt

    rng = np.random.default_rng(6)
    start = dt.datetime(2024, 1, 1)
    rows = [
        (i, f"n{i % 2}", start + dt.timedelta(minutes=i), "elk", [float(x) for x in rng.normal(size=4)])
        for i in range(80)
    ]
    logs = spark.createDataFrame(
        rows, "log_id long, Node string, ts timestamp_ntz, desired string, v array<double>"
    ).withColumns({c: F.lit("") for c in ("Level", "LogSource", "Component", "Content")})
    rewarded = spark.createDataFrame(
        [(i, t, 1.0 if t == "ipfs" else -1.0) for i in range(80) for t in ("mysql", "elk", "ipfs")],
        "log_id long, destination string, reward double",
    )
    policy = tabular.fit_policy(logs, "v", rewarded, components=1, n_bins=2, tolerance=1e-3)
    assert policy.metadata["obs_dim"] == 4 and policy.usable
    routed = policy.route(logs, "v").orderBy("log_id").collect()
    assert {r.raw_destination for r in routed} == {"ipfs"}
    assert not any(r.router_degraded for r in routed)

    tabular.save_policy(policy, str(tmp_path / "m"))
    loaded = tabular.load_policy(spark, str(tmp_path / "m"))
    again = loaded.route(logs, "v").orderBy("log_id").collect()
    assert [(r.state, r.raw_destination) for r in again] == [
        (r.state, r.raw_destination) for r in routed
    ]
    assert loaded.metadata == policy.metadata

    other = tabular.TabularPolicy(loaded.steps, loaded.q, {"obs_dim": 999})
    assert all(r.router_degraded for r in other.route(logs, "v").collect())
    assert tabular.load_policy(spark, str(tmp_path / "none")) is None
    assert tabular.route_with(None, logs, "v").first()["raw_destination"] == "mysql"


def plain_bins(values, n):
    edges = sorted(set(np.percentile(values, np.linspace(0, 100, n + 1))))
    return [sum(v >= e for e in edges[1:-1]) for v in values], edges


def test_quantile_bins_and_collapsed_edges(spark):
    rng = np.random.default_rng(2)
    data = np.column_stack([rng.normal(size=60), np.r_[np.zeros(45), rng.integers(1, 4, 15)]])
    df = vectors(spark, data)
    components = [F.col("v")[0], F.col("v")[1]]
    bins = states.fit_bins(df, components, 4)
    got = [r[0] for r in df.orderBy("id").select(bins.apply(components)).collect()]
    for i in (0, 1):
        assert [b[i] for b in got] == plain_bins(data[:, i], 4)[0]
    outside = vectors(spark, [[-99.0, -1.0], [99.0, 50.0]])
    low, high = [r[0] for r in outside.orderBy("id").select(bins.apply(components)).collect()]
    assert low == [0, 0] and high[0] == 3


def test_compatibility():
    scaler = states.Scaler((0.0,) * 4, (1.0,) * 4)
    assert states.compatible(scaler, 4) and states.compatible(scaler, None)
    with pytest.warns(UserWarning):
        assert states.compatible(scaler, 4, version=9)
    assert not states.compatible(scaler, 999)
    assert not states.compatible(None, 4)
    assert not states.compatible(states.Scaler((), ()), None)


def plain_fit(moves, teachers, sweeps, gamma, bonus):
    codes = {"mysql": 0, "elk": 1, "ipfs": 2}
    q = {(s, a): bonus if codes[t] == a else 0.0 for s, t in teachers.items() for a in range(3)}
    for _ in range(sweeps):
        value = {s: max(q[s, a] for a in range(3)) for s in teachers}
        new = dict(q)
        for pair in q:
            seen = [(r, n) for s, a, r, n in moves if (s, a) == pair]
            if seen:
                new[pair] = sum(r + gamma * (value[n] if n else 0.0) for r, n in seen) / len(seen)
        q = new
    return q


@pytest.mark.parametrize("block_moves", [qpolicy.BLOCK_MOVES, 45])
def test_fitted_values(spark, block_moves):
    """The fixed point of a plain loop, from one block of states or many."""
    rng = random.Random(3)
    names = [f"{a},{b}" for a in range(4) for b in range(3)]
    teachers = {s: rng.choice(["mysql", "elk", "ipfs"]) for s in names}
    moves = [
        (rng.choice(names), rng.randrange(3), rng.uniform(-1, 1), rng.choice([*names, None]))
        for _ in range(150)
    ]
    df = spark.createDataFrame(moves, "state string, action int, reward double, next_state string")
    table = spark.createDataFrame(list(teachers.items()), "state string, teacher string")
    counts = qpolicy.transition_counts(df)
    q = qpolicy.fit_q(counts, table, tolerance=1e-6, block_moves=block_moves)
    got = {(r.state, r.action): r.q for r in q.collect()}
    expected = plain_fit(moves, teachers, 2_000, 0.98, 0.3)
    assert got.keys() == expected.keys()
    for pair, value in expected.items():
        assert got[pair] == pytest.approx(value, abs=1e-4)
    policy = {r.state: r.action for r in qpolicy.greedy_policy(q).collect()}
    quick = qpolicy.fit_q(counts, table, block_moves=block_moves, policy_only=True)
    early = {r.state: r.action for r in qpolicy.greedy_policy(quick).collect()}
    for s in names:
        assert policy[s] == early[s] == int(np.argmax([expected[s, a] for a in range(3)]))


def test_policy_routes_known_states_and_falls_back(spark):
    logs = spark.createDataFrame(
        [(1, "0,0", "info", "a", "b", "x"), (2, "9,9", "crit", "a", "b", "x")],
        "log_id long, state string, Level string, LogSource string, Component string, Content string",
    )
    policy = spark.createDataFrame([("0,0", 1)], "state string, action int")
    routed = {r.log_id: r.raw_destination for r in qpolicy.route_q(logs, policy).collect()}
    assert routed == {1: "elk", 2: "ipfs"}
    bad = qpolicy.route_or_degrade(logs, policy, usable=False).orderBy("log_id").collect()
    assert [(r.raw_destination, r.router_degraded) for r in bad] == [("mysql", True), ("ipfs", True)]
    good = qpolicy.route_or_degrade(logs, policy, usable=True).collect()
    assert not any(r.router_degraded for r in good)


def test_first_action_wins_ties(spark):
    q = spark.createDataFrame([("s", 2, 1.0), ("s", 1, 1.0), ("s", 0, 0.5)], "state string, action int, q double")
    assert qpolicy.greedy_policy(q).first()["action"] == 1


def test_values_that_do_not_settle_are_an_error(spark):
    moves = spark.createDataFrame([("s", 0, 1.0, "s")], "state string, action int, reward double, next_state string")
    teachers = spark.createDataFrame([("s", "mysql")], "state string, teacher string")
    counts = qpolicy.transition_counts(moves)
    q = qpolicy.fit_q(counts, teachers, tolerance=1e-6).where("action = 0").first()["q"]
    assert q == pytest.approx(50.0, abs=1e-4)
    with pytest.raises(RuntimeError):
        qpolicy.fit_q(counts, teachers, max_steps=1)


def plain_plateau(values, window, patience, drop, least, start, end):
    eps, best, stale, events = start, -1e9, 0, []
    for episode in range(1, len(values) + 1):
        if episode < least or episode < window:
            continue
        average = float(np.mean(values[episode - window : episode]))
        if average > best + 1e-6:
            best, stale = average, 0
            continue
        stale += 1
        if stale >= patience:
            lower = max(end, eps * drop)
            if lower < eps:
                events.append((episode, round(lower, 9)))
            eps, stale = lower, 0
    return events


def test_plateau_events_match_the_loop(spark):
    rng = random.Random(11)
    runs, expected = [], {}
    settings = dict(window=5, patience=3, drop=0.7)
    for run in range(40):
        drift = rng.choice([-1, 0, 1]) * rng.random()
        values = [float(rng.randint(-20, 20) + drift * i) for i in range(rng.randint(3, 60))]
        runs += [(str(run), i + 1, v) for i, v in enumerate(values)]
        expected[str(run)] = plain_plateau(values, least=8, start=1.0, end=0.05, **settings)
    df = spark.createDataFrame(runs, "run string, episode long, reward double")
    got = {run: [] for run in expected}
    rows = rewards.plateau_events(df, min_episodes=8, **settings).orderBy("run", "step").collect()
    for row in rows:
        got[row.run].append((row.episode, round(row.epsilon, 9)))
    assert got == expected


def test_reward_stats(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([1.0, 2.0, 6.0])], "run string, episode long, reward double")
    row = rewards.reward_stats(df).first()
    assert (row.reward_mean, row.reward_median, row.reward_min, row.reward_max) == (3.0, 2.0, 1.0, 6.0)
    assert row.reward_std == pytest.approx(np.std([1.0, 2.0, 6.0]))


def test_learned_policy_separates_easy_classes(spark):
    rng = np.random.default_rng(4)
    rows = [
        (i, [float(x) for x in rng.normal(5 * (i % 3), 0.3, 2)], ["mysql", "elk", "ipfs"][i % 3])
        for i in range(150)
    ]
    df = spark.createDataFrame(rows, "log_id long, vector array<double>, best_destination string")
    model = learned.fit_classifier(df, "vector", 2, hidden=(8,), max_iter=60)
    routed = learned.route_learned(df, F.col("vector"), model)
    right = routed.where(F.col("raw_destination") == F.col("best_destination")).count()
    assert right >= 145
