"""Windows with late rows against a plain loop over the batches."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tierflow.streaming.open_windows import (
    Sessions,
    Sliding,
    read_late,
    read_windows,
    window_schema,
    window_stream,
)

START = datetime(2024, 1, 1)


def counts():
    return {"n": F.lit(1), "total": F.col("value")}


def minutes(time):
    return (time - START).total_seconds() / 60


def made(seed):
    """Four batches; some rows are far behind, one has no time, one repeats."""
    draw = random.Random(seed)
    batches = []
    for b in range(4):
        rows = []
        for i in range(30):
            at = b * 120 + draw.randint(0, 120) - (draw.choice([0, 60, 300]) if i % 5 == 0 else 0)
            rows.append((draw.choice(["a", "b", None]), START + timedelta(minutes=at + 600), b * 30 + i))
        batches.append(rows)
    batches[2] += [batches[2][0], ("a", None, 7)]
    return batches


def drained(spark, folder, batches, windows, delay):
    schema = "k string, ts timestamp, value long"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        window_stream(stream, windows, counts(), f"{folder}/out", f"{folder}/c", ["k"], delay).awaitTermination()
    found = read_windows(spark, f"{folder}/out", window_schema(stream, counts(), ["k"]), len(batches) - 1)
    rows = {(r.k, minutes(r.window_start), minutes(r.window_end), r.n, r.total, r.closed) for r in found.collect()}
    assert len(rows) == found.count()
    return rows, [(r.k, r.ts, r.value) for r in read_late(spark, f"{folder}/out").collect()]


def marks(batches, delay):
    """The watermark before each batch, in minutes, and after the last."""
    mark, before = None, []
    for rows in batches:
        before.append(mark)
        latest = max(minutes(t) for _, t, _ in rows if t) - delay
        mark = latest if mark is None else max(mark, latest)
    return before, mark


def test_sliding(spark, tmp_path):
    batches = made(1)
    rows, late = drained(spark, str(tmp_path), batches, Sliding("60 minutes", "20 minutes"), "30 minutes")
    before, last = marks(batches, 30)
    windows, missed = defaultdict(lambda: [0, 0]), []
    for mark, part in zip(before, batches, strict=True):
        for k, time, value in part:
            if time is None:
                missed.append((k, time, value))
                continue
            for step in range(3):
                start = minutes(time) // 20 * 20 - step * 20
                if mark is not None and start + 60 <= mark:
                    missed.append((k, time, value))
                else:
                    windows[k, start, start + 60][0] += 1
                    windows[k, start, start + 60][1] += value
    assert rows == {(*w, n, total, w[2] <= last) for w, (n, total) in windows.items()}
    assert sorted(map(repr, late)) == sorted(map(repr, missed)) and len(missed) > 3
    # Windows and late rows account for every row and window.
    timed = sum(1 for part in batches for r in part if r[1])
    assert sum(r[3] for r in rows) + len(late) == 3 * timed + 1


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions(spark, tmp_path, seed):
    batches = made(seed)
    rows, late = drained(spark, str(tmp_path), batches, Sessions("15 minutes"), "30 minutes")
    before, last = marks(batches, 30)
    kept, missed = defaultdict(list), []
    for mark, part in zip(before, batches, strict=True):
        for k, time, value in part:
            behind = time is None or mark is not None and minutes(time) <= mark
            (missed if behind else kept[k]).append((k, time, value))
    wanted = set()
    for k, part in kept.items():
        times = sorted((minutes(t), v) for _, t, v in part)
        runs = [[times[0]]]
        for one in times[1:]:
            if one[0] <= runs[-1][-1][0] + 15:
                runs[-1].append(one)
            else:
                runs.append([one])
        for run in runs:
            end = run[-1][0] + 15
            wanted.add((k, run[0][0], end, len(run), sum(v for _, v in run), end <= last))
    assert rows == wanted
    assert sorted(map(repr, late)) == sorted(map(repr, missed))
    assert sum(r[3] for r in rows) + len(late) == sum(map(len, batches))


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    batches = made(3)
    again = str(tmp_path / "two")
    drained(spark, again, batches[:3], Sessions("15 minutes"), "30 minutes")
    # Lost before its end was noted: the last batch's commit goes, its files stay.
    (tmp_path / "two" / "c" / "commits" / "2").unlink()
    crc = tmp_path / "two" / "c" / "commits" / ".2.crc"
    if crc.exists():
        crc.unlink()
    schema = "k string, ts timestamp, value long"
    stream = spark.readStream.schema(schema).parquet(f"{again}/in")
    window_stream(
        stream, Sessions("15 minutes"), counts(), f"{again}/out", f"{again}/c", ["k"], "30 minutes"
    ).awaitTermination()
    found = read_windows(spark, f"{again}/out", window_schema(stream, counts(), ["k"]), 2)
    part = str(tmp_path / "three")
    wanted, _ = drained(spark, part, batches[:3], Sessions("15 minutes"), "30 minutes")
    assert {
        (r.k, minutes(r.window_start), minutes(r.window_end), r.n, r.total, r.closed) for r in found.collect()
    } == wanted
