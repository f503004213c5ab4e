"""Hand-made rows for the text rules, routers, override and reward."""

import math

import pytest
from pyspark.sql import functions as F

from tierflow.functions import cost, text
from tierflow.operators import choices, routing
from tierflow.operators.trace import replay, trace
from tierflow.schemas import TRACE_SCHEMA

LOG = "log_id long, Level string, LogSource string, Component string, Content string, EventTemplate string"


def logs(spark, *rows):
    return spark.createDataFrame(list(rows), LOG)


@pytest.mark.parametrize(
    "row, expected",
    [
        ((None, "oPeNsSh", None, None), "ipfs"),
        ((None, None, "KERNEL", None), "ipfs"),
        (("Crit", None, None, None), "ipfs"),
        (("ALERT", None, None, None), "ipfs"),
        (("emerg", None, None, None), "ipfs"),
        (("err", None, None, None), "elk"),
        (("ERROR", None, None, "fine"), "elk"),
        (("warn", None, None, None), "elk"),
        (("warning", None, None, None), "mysql"),
        (("fatal", None, None, None), "mysql"),
        (("info", "Linux", "app", "Job FAILED"), "elk"),
        (("info", "Linux", "app", "access Denied"), "elk"),
        (("nan", "NaN", "nan", ""), "mysql"),
        ((None, None, None, None), "mysql"),
    ],
)
def test_static_rules(spark, row, expected):
    level, source, component, content = row
    df = logs(spark, (1, level, source, component, content, None))
    assert routing.route_static(df).first()["raw_destination"] == expected


def test_safe_lower_of_number(spark):
    df = spark.createDataFrame([(float("nan"),), (1.5,), (None,)], "x double")
    values = [r[0] for r in df.select(text.safe_lower(F.col("x"))).collect()]
    assert values == ["", "1.5", ""]


def test_direct_router(spark):
    df = logs(spark, (1, "crit", None, None, None, None))
    assert routing.get_router("direct_elk")(df).first()["raw_destination"] == "elk"
    with pytest.raises(ValueError):
        routing.route_direct("tape")
    with pytest.raises(ValueError):
        routing.get_router("unknown")


def test_action_codes(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (9,)], "a int")
    names = [r[0] for r in df.select(routing.action_destination(F.col("a"))).collect()]
    assert names == ["mysql", "elk", "ipfs", "mysql"]
    back = df.select(routing.action_code(routing.action_destination(F.col("a")))).collect()
    assert [r[0] for r in back] == [0, 1, 2, 0]


def test_pattern_merge_keeps_first_spelling():
    merged = text.merge_patterns([" Token ", "", "Card No", "CARD NO", "  "])
    assert merged == [*text.DEFAULT_PATTERNS, "Card No"]


def test_pattern_table_agrees_with_list(spark):
    given = [" Token ", "", "Card No", "CARD NO", "x", "  "]
    df = spark.createDataFrame(list(enumerate(given)), "ord long, pattern string")
    merged = text.merge_pattern_table(df).orderBy("ord").collect()
    assert [r["pattern"] for r in merged] == text.merge_patterns(given)


def test_compliance_text_keeps_the_gaps(spark):
    df = logs(
        spark,
        (1, None, None, "app", "a tok", "en b"),  # the gap separates the pattern
        (2, None, None, "key", "secret", None),  # two gaps, one for the empty template
        (3, None, None, None, "permission", "denied"),  # spans content and template
        (4, "Error", None, None, None, None),
        (5, "warn", None, None, "LOGIN ok", None),
        (6, None, None, None, None, None),
    )
    flags = [r[0] for r in df.orderBy("log_id").select(text.is_sensitive()).collect()]
    assert flags == [False, False, True, True, True, False]


def test_user_pattern_is_literal(spark):
    df = logs(spark, (1, None, None, None, "100% sure", None), (2, None, None, None, "100 sure", None))
    patterns = text.merge_patterns(["0% s", "a_b"])
    flags = [r[0] for r in df.orderBy("log_id").select(text.is_sensitive(patterns)).collect()]
    assert flags == [True, False]
    hits = df.where("log_id = 1").select(text.matching_patterns(patterns)).first()[0]
    assert hits == ["0% s"]


def test_the_two_sensitivity_rules_differ(spark):
    df = logs(spark, (1, None, None, "kernel", "x", None), (2, None, None, "app", "login", None))
    rows = df.orderBy("log_id").select(
        text.is_sensitive().alias("a"), text.is_sensitive_for_reward().alias("b")
    )
    assert [(r.a, r.b) for r in rows.collect()] == [(False, True), (True, False)]


def test_override_and_its_repetition(spark):
    df = logs(spark, (1, "error", None, None, None, None), (2, "info", None, None, None, None))
    routed = routing.route_direct("mysql")(df)
    on = routing.apply_compliance(routed, True).orderBy("log_id").collect()
    assert [(r.destination, r.compliance_forced) for r in on] == [("ipfs", True), ("mysql", False)]
    off = routing.apply_compliance(routed, False).orderBy("log_id").collect()
    assert [(r.destination, r.sensitive) for r in off] == [("mysql", True), ("mysql", False)]
    again = routing.apply_compliance(
        routing.apply_compliance(routed, True).drop("sensitive", "compliance_forced")
    )
    assert sorted(r.destination for r in again.collect()) == ["ipfs", "mysql"]


def plain_reward(success, latency, energy, dest, desired, sensitive):
    if not success:
        return -1 - 0.3 * min(latency / 1000, 1) - 0.05 * max(0, energy)
    total = 1.2 if dest == desired else -0.8
    if sensitive and dest != "ipfs":
        total -= 0.8
    if not sensitive and dest == "ipfs":
        total -= 0.2
    total += 0.3 * (1 - min(latency / 1000, 1)) - 0.05 * max(0, energy)
    return max(-2.0, min(2.0, total))


def test_reward(spark):
    rows = [
        (ok, latency, energy, dest, desired, sensitive)
        for ok in (True, False)
        for latency in (0.0, 250.0, 5000.0)
        for energy in (-1.0, 0.5, 90.0)
        for dest in ("mysql", "ipfs")
        for desired in ("ipfs", "elk")
        for sensitive in (True, False)
    ]
    df = spark.createDataFrame(
        rows,
        "ok boolean, latency double, energy double, dest string, desired string, sensitive boolean",
    )
    got = df.select("*", cost.reward(*[F.col(c) for c in df.columns]).alias("r")).collect()
    for row in got:
        assert math.isclose(row.r, plain_reward(*row[:6]), abs_tol=1e-12)


def test_cost_metric_falls_back_to_latency(spark):
    df = spark.createDataFrame([(3.0, None), (3.0, 0.5)], "l double, e double")
    metrics = [
        cost.routing_cost(m, F.col("l"), F.col("e")).alias(m) for m in ("latency", "energy", "combined")
    ]
    assert [tuple(r) for r in df.select(*metrics).collect()] == [(3.0, 3.0, 3.0), (3.0, 0.5, 503.0)]
    with pytest.raises(ValueError):
        cost.routing_cost("price", F.col("l"), F.col("e"))


def test_payload_is_utf8_length(spark):
    df = spark.createDataFrame([("äß€",), (None,), ("",)], "c string")
    assert [r[0] for r in df.select(text.payload_bytes(F.col("c"))).collect()] == [7, 0, 0]


def test_content_key_ignores_spacing_only(spark):
    import hashlib

    df = spark.createDataFrame([(" a b \n c ",), ("a b c",), ("abc",)], "c string")
    keys = [r[0] for r in df.select(text.content_key(F.col("c"), "ns")).collect()]
    assert keys[0] == keys[1] == hashlib.sha1(b"ns\na b c").hexdigest()
    assert keys[2] != keys[0]


def test_bad_numbers_and_flags(spark):
    df = spark.createDataFrame([("1.5", "TRUE"), ("x", "yes"), ("nan", None)], "n string, b string")
    rows = df.select(text.safe_double(F.col("n")), text.safe_bool(F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(1.5, True), (None, False), (None, False)]


OUTCOME = """log_id long, destination string, success boolean, routing_latency_ms double,
  backend_write_latency_ms double, energy_cpu_pkg_j double"""


def test_trace_defaults_for_a_missing_outcome(spark):
    df = logs(spark, (1, "error", "A", None, "ab", None), (2, None, "B", None, None, None))
    outcomes = spark.createDataFrame([(1, "ipfs", True, 0.5, 2.0, 0.25)], OUTCOME)
    decided = routing.apply_compliance(routing.route_direct("mysql")(df))
    table = trace(decided, outcomes, "direct_mysql", F.col("LogSource"))
    assert table.columns == [f.name for f in TRACE_SCHEMA]
    first, second = table.orderBy("log_id").collect()
    assert (first.destination, first.total_latency_ms, first.success) == ("ipfs", 2.5, True)
    assert (first.payload_bytes, first.compliance_forced) == (2, True)
    assert (second.destination, second.success) == ("mysql", False)
    assert (second.backend_write_latency_ms, second.total_latency_ms) == (1000.0, 1000.0)
    assert second.energy_cpu_pkg_j == 0.0


def test_replay_equals_single_traces(spark):
    df = logs(
        spark,
        *[(i, ["error", "info", None][i % 3], "S", "app", "login" if i % 4 == 0 else "x", None) for i in range(40)],
    )
    outcomes = spark.createDataFrame(
        [(i, t, i % 7 != 0, float(i % 5), float(i * k), i / 100) for i in range(40) for k, t in enumerate(("mysql", "elk", "ipfs"))],
        OUTCOME,
    )
    routers = {"static": routing.route_static, "direct_elk": routing.route_direct("elk")}
    both = replay(df, outcomes, routers, "set", (False, True))
    for name, route in routers.items():
        for enforced in (False, True):
            alone = trace(routing.apply_compliance(route(df), enforced), outcomes, name, "set")
            columns = [c for c in alone.columns if not c.startswith("proc_")]
            part = both.where((F.col("router") == name) & (F.col("compliance") == enforced))
            assert sorted(map(str, part.select(columns).collect())) == sorted(
                map(str, alone.select(columns).collect())
            )


def test_best_action_prefers_the_earlier_tier(spark):
    rows = [(1, "elk", 1.0), (1, "mysql", 1.0), (1, "ipfs", 0.5), (2, "ipfs", 2.0), (2, "elk", 1.0)]
    df = spark.createDataFrame(rows, "log_id long, destination string, reward double")
    best = {r.log_id: r.best_destination for r in choices.best_action(df).collect()}
    assert best == {1: "mysql", 2: "ipfs"}
