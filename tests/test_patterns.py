"""A pattern table against a plain search of every pattern in every log."""

import random

from tierflow.operators import patterns

SCHEMA = "log_id long, Content string, EventTemplate string, Component string, Level string"


def texts(rows):
    return {r[0]: " ".join(x or "" for x in r[1:4]).lower() for r in rows}


def plain(rows, given):
    named = {}
    for p in given:
        if p:
            named[p.lower()] = min(p, named.get(p.lower(), p))
    return sorted((i, p) for i, t in texts(rows).items() for k, p in named.items() if k in t)


def found(spark, rows, given):
    logs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    table = spark.createDataFrame([(p,) for p in given], "pattern string")
    return sorted(tuple(r) for r in patterns.pattern_matches(logs, table).collect())


def test_random_patterns(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab%_\\ .\nÉé\U0001f600") for _ in range(n))
    rows = [(i, word(rng.randrange(25)), word(rng.randrange(4)), None, "info") for i in range(120)]
    given = [word(rng.randrange(1, 7)) for _ in range(300)] + ["", None, "A", "a", "AB", "(?s).*", "zzz"]
    assert found(spark, rows, given) == plain(rows, given)


def test_gaps_nulls_and_levels(spark):
    rows = [
        (1, "the end", "Start here", "app", "info"),
        (2, None, None, None, "CRIT"),
        (3, "", "", "", None),
        (4, "x" * 20_000 + "needle", "", "kernel", "info"),
    ]
    given = ["end start", "here app", "  ", "NEEDLE kernel", "needle  kernel"]
    assert found(spark, rows, given) == plain(rows, given)
    logs = spark.createDataFrame(rows, SCHEMA)
    table = spark.createDataFrame([("needle",)], "pattern string")
    flags = {r.log_id: r.sensitive for r in patterns.flag_by_table(logs, table).collect()}
    assert flags == {1: False, 2: True, 3: False, 4: True}


def test_no_patterns(spark):
    assert found(spark, [(1, "a", "b", "c", "info")], ["", None]) == []


def test_many_patterns_need_no_cross_join(spark):
    """100,000 patterns over 300 logs; the plan pairs rows by equal keys only."""
    rows = [(i, f"request {i * 337} of user {i}", "t", "c", "info") for i in range(300)]
    given = [f"request {k} " for k in range(100_000)]
    logs = spark.createDataFrame(rows, SCHEMA)
    table = spark.range(100_000).selectExpr("concat('request ', id, ' ') AS pattern")
    result = patterns.pattern_matches(logs, table)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = sorted((i, f"request {i * 337} ") for i in range(300) if i * 337 < 100_000)
    assert sorted(tuple(r) for r in result.collect()) == want
    assert given[337] == want[1][1]


def test_shared_runs_make_no_pairs(spark):
    """Every run of three is in every text and in most patterns; each place still cuts one string."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    rows = [(i, word(60), None, None, "info") for i in range(40)] + [(None, "a" * 12, "", "", "info")]
    given = [f"{k:012b}".replace("0", "a").replace("1", "b") for k in range(4_096)]
    assert found(spark, rows, given) == plain(rows[:-1], given)
    texts = spark.createDataFrame([(r[0], r[1]) for r in rows[:-1]], "log_id long, text string")
    keys = spark.createDataFrame([(p,) for p in given], "key string")
    strings = patterns.cut_strings(texts, patterns.starts_of(keys))
    assert strings.count() == 40 * (60 - 12 + 1)


def test_long_texts_are_cut_without_loss(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("ab\U0001f600") for _ in range(5_000))
    rows = [(1, long, "", "", "info"), (2, long[::-1], "", "", "info")]
    given = [long[i : i + n] for i in range(900, 1_100, 7) for n in (1, 2, 3, 9, 1_500)]
    assert found(spark, rows, given) == plain(rows, given)
