"""Blocked operators against plain pandas, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tierflow.operators import ordered, percentiles, sampling, summaries
from tierflow.operators.joins import join_keys


def skewed(rows=900, seed=1):
    rng = np.random.default_rng(seed)
    keys = rng.choice(["hot", "a", "b", "c"], size=rows, p=[0.7, 0.1, 0.1, 0.1])
    return pd.DataFrame(
        {
            "k": keys,
            "id": np.arange(rows),
            "t": np.sort(rng.integers(0, 5_000, rows)),
            "x": np.round(rng.exponential(50, rows), 1),
        }
    )


@pytest.mark.parametrize("rows", [30, 10**6])
@pytest.mark.parametrize("ahead", [False, True])
def test_neighbour(spark, ahead, rows):
    pdf = skewed()
    expected = pdf.copy()
    expected["n"] = expected.sort_values(["t", "id"]).groupby("k").x.shift(-1 if ahead else 1)
    got = ordered.neighbour(
        spark.createDataFrame(pdf),
        ["k"],
        ["t", "id"],
        ["x"],
        ahead,
        block_rows=rows,
    ).toPandas()
    name = "next_x" if ahead else "prev_x"
    merged = expected.merge(got[["id", name]], on="id")
    assert merged.n.fillna(-1).tolist() == merged[name].fillna(-1).tolist()


def test_positions(spark):
    pdf = skewed()
    expected = pdf.sort_values("id").groupby("k").cumcount() + 1
    got = ordered.positions(spark.createDataFrame(pdf), ["k"], "id", block_rows=37).toPandas()
    got = got.sort_values("id")
    assert got.position.tolist() == expected.tolist()
    lows = pdf.groupby("k").id.min()
    assert (got.first_id == got.k.map(lows)).all()


def test_rolling_over_chunk_edges(spark):
    pdf = skewed()
    pdf["position"] = pdf.groupby("k").cumcount() + 1
    got = ordered.rolling(
        spark.createDataFrame(pdf),
        ["k"],
        "position",
        9,
        {"m": lambda w: F.avg("x").over(w.rowsBetween(-9, 0))},
        chunk_rows=20,
    ).toPandas()
    expected = pdf.groupby("k").x.rolling(10, min_periods=1).mean().reset_index(level=0, drop=True)
    merged = got.sort_values("id").m.to_numpy()
    assert np.allclose(merged, expected.sort_index().to_numpy())
    assert len(got) == len(pdf)


def test_blocks_hold_few_rows_whatever_the_order_values(spark):
    """One stamp far away and one key with most rows do not make a large block."""
    rows = 300_000
    df = spark.range(rows).select(
        F.when(F.col("id") % 20 == 0, "rare").otherwise("hot").alias("k"),
        "id",
        F.when(F.col("id") == 7, 0).otherwise(F.col("id") + 1_700_000_000).alias("t"),
    )
    cut = ordered.blocked(df, ["k"], ["t", "id"], rows=10_000)
    sizes = [r["count"] for r in cut.groupBy("_block").count().collect()]
    assert len(sizes) == 30 and max(sizes) <= 2 * 10_000
    ends = cut.where("k = 'hot'").groupBy("_block").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    found = sorted((r["a"], r["b"]) for r in ends.collect())
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_carry_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FAN", 3)
    rng = np.random.default_rng(3)
    rows = [
        (k, b, int(rng.integers(1, 9)) if rng.random() < 0.6 else None)
        for k in ("a", None)
        for b in range(40)
        if rng.random() < 0.7
    ]
    df = spark.createDataFrame(rows, "k string, _block int, v long")
    for how in ("before", "after", "sum"):
        got = {(r["k"], r["_block"]): r["_carried"] for r in ordered.carried(df, ["k"], "v", how).collect()}
        assert len(got) == len(rows)
        for k, b, _ in rows:
            other = [(x, v) for j, x, v in rows if j == k and (x > b if how == "after" else x < b)]
            seen = [v for _, v in sorted(other) if v is not None]
            want = {"sum": sum(seen), "before": seen[-1] if seen else None, "after": seen[0] if seen else None}
            assert got[k, b] == want[how]


def test_running_sums(spark):
    pdf = skewed()
    expected = pdf.sort_values("id").groupby("k").x.cumsum()
    got = ordered.running(
        spark.createDataFrame(pdf), ["k"], ["id"], {"s": F.col("x"), "n": F.lit(1)}, block_rows=50
    ).toPandas().sort_values("id")
    assert np.allclose(got.s, expected.sort_index())
    assert got.n.tolist() == (pdf.groupby("k").cumcount() + 1).tolist()


@pytest.mark.parametrize("rows", [40, 10**6])
def test_asof_carries_over_empty_blocks(spark, rows):
    left = skewed()[["k", "id", "t"]]
    right = skewed(60, seed=2)[["k", "t", "x"]].drop_duplicates(["k", "t"])
    frames = spark.createDataFrame(left), spark.createDataFrame(right)
    got = ordered.asof_backward(*frames, "k", "t", ["x"], block_rows=rows).toPandas()
    expected = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="k")
    both = expected.merge(got, on="id", suffixes=("_e", "_g"))
    assert len(got) == len(left)
    assert both.x_e.fillna(-1).tolist() == both.x_g.fillna(-1).tolist()
    strict = ordered.asof_backward(
        *frames, "k", "t", ["x"], before=F.col("id") >= 0, block_rows=rows
    ).toPandas()
    expected = pd.merge_asof(
        left.sort_values("t"), right.sort_values("t"), on="t", by="k", allow_exact_matches=False
    )
    both = expected.merge(strict, on="id", suffixes=("_e", "_g"))
    assert both.x_e.fillna(-1).tolist() == both.x_g.fillna(-1).tolist()


@pytest.mark.parametrize("accuracy", [5, 200, None])
def test_exact_percentiles_do_not_depend_on_the_sketch(spark, accuracy):
    pdf = pd.concat([skewed(800, seed=s) for s in range(3)])
    pdf.loc[pdf.index[::5], "x"] = 7.0  # many equal values
    pdf.loc[pdf.index[::90], "x"] = np.nan
    levels = [0.0, 0.05, 0.5, 0.95, 0.99, 1.0]
    df = spark.createDataFrame(pdf[["k", "x"]])
    rows = percentiles.exact_percentiles(df, ["k"], "x", levels, accuracy).collect()
    assert len(rows) == 4 * len(levels)
    for row in rows:
        values = pdf[pdf.k == row.k].x.dropna()
        assert row.n == len(values)
        assert np.isclose(row.percentile, np.percentile(values, row.p * 100), atol=1e-9)


def test_percentiles_of_several_columns_and_a_null_key(spark):
    pdf = skewed().rename(columns={"t": "y"})
    df = spark.createDataFrame(pdf).withColumn("k", F.nullif("k", F.lit("a")))
    named = {"x50": ("x", 0.5), "y95": ("y", 0.95), "y10": ("y", 0.1)}
    for row in percentiles.percentile_columns(df, ["k"], named).collect():
        group = pdf[pdf.k == (row.k or "a")]
        for name, (column, p) in named.items():
            assert np.isclose(row[name], np.percentile(group[column], p * 100), atol=1e-9)


def test_percentile_of_tiny_groups(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("b", 2.0)], "k string, x double")
    rows = percentiles.percentile_columns(
        df, ["k"], {"median": ("x", 0.5), "p95": ("x", 0.95)}
    ).collect()
    found = {r.k: (r.median, round(r.p95, 6)) for r in rows}
    assert found == {"a": (3.0, 3.0), "b": (1.5, 1.95)}


def test_balanced_order(spark):
    rows = [(0, "B"), (1, "B"), (2, "A"), (3, "B"), (4, None), (5, "A")]
    df = spark.createDataFrame(rows, "log_id long, LogSource string")
    got = sampling.sample(df, "balanced").collect()
    assert [r.log_id for r in got] == [0, 2, 4, 1, 5, 3]
    assert [r.log_id for r in sampling.sample(df, "balanced", limit=3).collect()] == [0, 2, 4]
    assert [r.log_id for r in sampling.sample(df, "head", limit=2).collect()] == [0, 1]
    shuffled = [r.log_id for r in sampling.sample(df, "random", seed="3").collect()]
    assert sorted(shuffled) == list(range(6))
    assert shuffled == [r.log_id for r in sampling.sample(df, "random", seed="3").collect()]
    with pytest.raises(ValueError):
        sampling.sample(df, "middle")


def test_join_keeps_null_keys(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, y int")
    rows = {tuple(r) for r in join_keys(left, right, ["k"]).select("k", "x", "y").collect()}
    assert rows == {("a", 1, 10), (None, 2, 20), ("c", 3, None)}


def test_warmup_boundary(spark):
    values = [100.0 - i for i in range(60)] + [40.0] * 60
    df = spark.createDataFrame(
        [("r", i + 1, v) for i, v in enumerate(values)], "run string, position long, total_latency_ms double"
    )
    row = summaries.warmup_boundary(df, ["run"], window=10).first()
    expected = next(
        i + 1
        for i in range(19, 120)
        if abs(np.median(values[i - 9 : i + 1]) - np.median(values[i - 19 : i - 9]))
        <= 0.05 * np.median(values[i - 19 : i - 9])
    )
    assert row.boundary == expected


def test_anomalies_need_a_full_window(spark):
    values = [1.0, 50.0] + [1.0 + (i % 3) / 10 for i in range(30)] + [9.0, 1.0]
    df = spark.createDataFrame(
        [("h", i + 1, v) for i, v in enumerate(values)], "host string, position long, watts double"
    )
    found = summaries.energy_anomalies(df, ["host"], "watts", window=20).collect()
    assert [r.position for r in found] == [33]


def test_rolling_medians_as_the_exact_percentile(spark):
    rng = np.random.default_rng(4)
    odd = lambda x: None if x < 0.1 else float("nan") if x < 0.2 else float("inf") if x < 0.3 else float(x)
    rows = [(k, i + 1, odd(x)) for k in ("a", None) for i, x in enumerate(rng.random(90))]
    rows += [("b", i + 1, None) for i in range(12)] + [("c", i + 1, i * 1.5) for i in range(70)]
    df = spark.createDataFrame(rows, "k string, position long, v double").repartition(3)

    def median(first, last):
        return lambda w: F.percentile("v", F.lit(0.5)).over(w.rowsBetween(first, last))

    for window in (4, 7):
        want = ordered.rolling(
            df,
            ["k"],
            "position",
            2 * window - 1,
            {"now": median(1 - window, 0), "before": median(1 - 2 * window, -window)},
            chunk_rows=20,
        ).select("k", "position", "now", "before")
        got = ordered.rolling_medians(df, ["k"], "position", "v", window, chunk_rows=20)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_warmup_sorts_no_frame_anew(spark):
    df = spark.createDataFrame([("r", 1, 1.0)], "run string, position long, total_latency_ms double")
    plan = summaries.warmup_boundary(df, ["run"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "Window" not in plan
