"""Streams against the same work in batches."""

import json

import pytest
from pyspark.sql import functions as F

from tierflow.operators import cbr, routing
from tierflow.operators.trace import trace
from tierflow.sources import logs as log_files
from tierflow.sources import tables
from tierflow.sources.tiers import read_tier
from tierflow.streaming.online_cbr import OnlineCbr, dump_diagnostics, samples_collected
from tierflow.streaming.route import route_stream

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The logs as four CSV files, one per stretch of ids, in file order."""
    import os

    folder = tmp_path_factory.mktemp("parts")
    rows = tables.logs(spark, SMALL).select("log_id", *log_files.LOG_COLUMNS).toPandas()
    rows = rows.sort_values("log_id").drop(columns="log_id")
    size = -(-len(rows) // 4)
    for i in range(4):
        path = folder / f"part{i}.csv"
        rows.iloc[i * size : (i + 1) * size].to_csv(path, index=False)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def batch_logs(spark):
    return log_files.select_log_columns(tables.logs(spark, SMALL)).na.fill("")


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_stream_equals_batch_and_replays(spark, parts, tmp_path):
    outcomes = tables.observations(spark, SMALL)
    out = str(tmp_path / "out")

    def run(checkpoint):
        route_stream(
            log_files.stream_logs(spark, parts, ids="line"),
            outcomes,
            routing.route_static,
            "static",
            "set",
            out,
            str(tmp_path / checkpoint),
        ).awaitTermination()
        return rows_of(spark.read.parquet(f"{out}/trace").drop("batch_id"))

    decided = routing.apply_compliance(routing.route_static(batch_logs(spark)))
    expected = rows_of(trace(decided, outcomes, "static", "set"))
    assert run("first") == expected
    # a run that starts over writes the same batches to the same folders
    assert run("second") == expected
    counts = {r.destination: r["count"] for r in decided.groupBy("destination").count().collect()}
    kept = {"mysql": "relational", "elk": "search", "ipfs": "references"}
    assert counts == {t: read_tier(spark, f"{out}/tiers", n).count() for t, n in kept.items()}


def test_online_router_equals_its_steps(spark, parts, tmp_path):
    outcomes = tables.observations(spark, SMALL)
    online = OnlineCbr(out=str(tmp_path / "stream"), sample_prob=0.5)
    dump = dump_diagnostics(str(tmp_path / "diag"), mode="append")
    online.start(
        log_files.stream_logs(spark, parts, ids="line"), outcomes, str(tmp_path / "c"), after_batch=dump
    ).awaitTermination()
    streamed = spark.read.parquet(f"{online.out}/decisions").select("log_id", "raw_destination")

    steps = OnlineCbr(out=str(tmp_path / "steps"), sample_prob=0.5)
    size = -(-batch_logs(spark).count() // 4)
    decided = []
    for i in range(4):
        part = batch_logs(spark).where(F.floor(F.col("log_id") / size) == i)
        rows, _ = steps.step(part, outcomes, i)
        decided += rows.select("log_id", "raw_destination").collect()
    assert rows_of(streamed) == sorted(map(str, decided))
    ours = cbr.load_state(spark, online.state_path(3))
    theirs = cbr.load_state(spark, steps.state_path(3))
    rounded = [F.round("mean", 6).alias("s"), "attr", "bucket", "destination", "n"]
    assert rows_of(ours.select(*rounded)) == rows_of(theirs.select(*rounded))

    lines = []
    for path in (tmp_path / "diag").glob("batch=*/part-*"):
        if path.suffix == ".json":
            lines += [json.loads(x) for x in path.read_text().splitlines()]
    assert sorted(x["batch_id"] for x in lines) == [0, 1, 2, 3]
    assert max(x["samples_collected"] for x in lines) > 0


def test_a_repeated_step_leaves_the_same_state(spark, tmp_path):
    outcomes = tables.observations(spark, SMALL)
    online = OnlineCbr(out=str(tmp_path / "o"), sample_prob=0.5, counterfactual=True)
    part = batch_logs(spark)
    for _ in range(2):
        online.step(part, outcomes, 0)
    sampled = samples_collected(cbr.load_state(spark, online.state_path(0)))
    once = cbr.bucket_stats(cbr.feedback(part, outcomes, 0.5))
    assert sampled == samples_collected(once)


def test_strict_warmup_holds_the_classifier_back(spark, tmp_path):
    stats = cbr.bucket_stats(cbr.feedback(batch_logs(spark), tables.observations(spark, SMALL), 0.5))
    relaxed = OnlineCbr(out="unused", warm_samples=10**9).model(stats)
    strict = OnlineCbr(out="unused", warm_samples=10**9, strict_warmup=True).model(stats)
    assert relaxed.classifier is not None
    assert strict.classifier is None and strict.fallback == relaxed.fallback


def test_dump_modes(spark, tmp_path):
    stats = cbr.bucket_stats(cbr.feedback(batch_logs(spark), tables.observations(spark, SMALL), 0.5))
    model = cbr.model_from_stats(stats)
    for mode, every, expected in (
        ("overwrite", 1, {"d"}),
        ("append", 1, {"d"}),
        ("timestamp", 2, {"d_1", "d_3"}),
    ):
        base = tmp_path / mode
        base.mkdir()
        dump = dump_diagnostics(str(base / "d"), every, mode)
        for batch in range(4):
            dump(batch, model)
        assert {p.name for p in base.iterdir()} == expected
    dump_diagnostics(str(tmp_path / "none"), 0)(0, model)
    assert not (tmp_path / "none").exists()
    with pytest.raises(ValueError):
        dump_diagnostics("x", mode="other")


def test_intervals_are_a_loop_over_slices(spark, tmp_path):
    """Two batches in intervals of 37 logs against one step per interval."""
    logs = tables.logs(spark, SMALL).limit(200).orderBy("log_id").persist()
    outcomes = tables.observations(spark, SMALL)
    settings = dict(counterfactual=True, sample_prob=0.3, warm_samples=60, strict_warmup=True)
    ids = [r[0] for r in logs.select("log_id").collect()]
    batches = [ids[:120], ids[120:]]
    loop = OnlineCbr(out=str(tmp_path / "loop"), **settings)
    expected, number = {}, 0
    for batch in batches:
        for i in range(0, len(batch), 37):
            rows = logs.where(F.col("log_id").isin(batch[i : i + 37]))
            decided, _ = loop.step(rows, outcomes, number)
            expected |= {r.log_id: r.raw_destination for r in decided.collect()}
            number += 1
    router = OnlineCbr(out=str(tmp_path / "once"), interval=37, **settings)
    found = {}
    for k, batch in enumerate(batches):
        decided, _ = router.step(logs.where(F.col("log_id").isin(batch)), outcomes, k)
        found |= {r.log_id: r.raw_destination for r in decided.collect()}
    assert found == expected
    assert len(set(found.values())) > 1
    ends = [
        {
            (r.attr, r.bucket, r.destination): (r.n, pytest.approx(r.mean), pytest.approx(r.m2, abs=1e-6))
            for r in cbr.load_state(spark, path).collect()
        }
        for path in (router.state_path(1), loop.state_path(number - 1))
    ]
    assert ends[0].keys() == ends[1].keys()
    assert all(ends[0][k][0] == ends[1][k][0] for k in ends[0])
    logs.unpersist()


def test_intervals_need_all_outcomes(tmp_path):
    with pytest.raises(ValueError):
        OnlineCbr(out=str(tmp_path), interval=200)


def test_late_outcomes(spark, tmp_path):
    """Late, repeated, too late and missing outcomes, in three steps of files."""
    from tierflow.streaming.late_outcomes import late_trace, write_late_trace

    def at(minute):
        return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"

    decided = [(i, at(i), "mysql", "mysql", False, "text", False) for i in range(1, 7)]
    names = "log_id long, ts string, destination string, raw_destination string, compliance_forced boolean, Content string, sensitive boolean"
    measured = [
        (1, "mysql", True, 1.0, 2.0, 0.1, at(1)),
        (2, "mysql", True, 1.0, 3.0, 0.1, at(50)),
        (2, "mysql", True, 1.0, 3.0, 0.1, at(50)),
        (3, "elk", True, 1.0, 4.0, 0.1, at(5)),
        (4, "mysql", False, 1.0, 5.0, 0.1, at(4 + 61)),
        (5, "mysql", False, None, 6.0, None, at(5 + 60)),
    ]
    far = [(-1, "2099-01-01 00:00:00", "mysql", "mysql", False, "", False)]
    far_measured = [(-2, "mysql", True, 1.0, 1.0, 0.1, "2099-01-01 00:00:00")]
    kinds = "log_id long, destination string, success boolean, routing_latency_ms double, backend_write_latency_ms double, energy_cpu_pkg_j double, measured_at string"
    left, right = str(tmp_path / "left"), str(tmp_path / "right")
    for logs, outcomes in ((decided, []), ([], measured), (far, far_measured)):
        a = spark.createDataFrame(logs, names).withColumn("ts", F.col("ts").cast("timestamp"))
        b = spark.createDataFrame(outcomes, kinds).withColumn("measured_at", F.col("measured_at").cast("timestamp"))
        a.write.mode("append").parquet(left)
        b.write.mode("append").parquet(right)
        streams = [spark.readStream.schema(d.schema).parquet(p) for d, p in ((a, left), (b, right))]
        rows = late_trace(*streams, "static", "set", within="1 hour", disorder="2 hours")
        write_late_trace(rows, str(tmp_path / "out"), str(tmp_path / "point")).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "out")).where("log_id > 0").orderBy("log_id").collect()
    assert [(r.log_id, r.success, r.backend_write_latency_ms) for r in kept] == [
        (1, True, 2.0),
        (2, True, 3.0),
        (3, False, 1000.0),
        (4, False, 1000.0),
        (5, False, 6.0),
        (6, False, 1000.0),
    ]
