"""Streaming queries: each drains a file stream and returns what it wrote."""

from pyspark.sql import functions as F

from tierflow.operators import cbr, routing
from tierflow.plans.registry import query, rounded
from tierflow.plans.rows import TRACE_SQL
from tierflow.plans.sql import RANK, STATIC, bucket, check, part
from tierflow.runtime import cut_lineage, fresh_folder
from tierflow.schemas import LOG_COLUMNS
from tierflow.sources import tables
from tierflow.sources.tiers import read_tier, write_tier_shapes
from tierflow.streaming.late_outcomes import late_trace, write_late_trace
from tierflow.streaming.online_cbr import OnlineCbr
from tierflow.streaming.open_windows import Sessions, Sliding, read_late, read_windows, window_schema, window_stream
from tierflow.streaming.route import mix_by_window, route_stream


PARTS = 4
# Decisions between two scorings, as the live router has it.
INTERVAL = 200


def routed_stream(spark, directory):
    """Folder of the continuous router after four micro-batches of new files.

    Each step of arriving files continues the stream from its checkpoint.
    """
    folder = fresh_folder(spark, "stream")
    outcomes = tables.observations(spark, directory)
    for _, events in tables.arriving(spark, directory, f"{folder}/in", PARTS):
        route_stream(
            tables.as_logs(events),
            outcomes,
            routing.route_static,
            "static",
            F.col("LogSource"),
            folder,
            f"{folder}/checkpoint",
        ).awaitTermination()
    return folder


@query("stream_trace", check(TRACE_SQL, "flagged", "obs"))
def stream_trace(spark, directory):
    """Trace written by the continuous router."""
    folder = routed_stream(spark, directory)
    return rounded(spark.read.parquet(f"{folder}/trace").drop("batch_id"))


LATE_SQL = """SELECT f.log_id, 'static' AS router, f.dataset_name, f.destination, f.static_dest AS raw_destination,
  f.destination <> f.static_dest AS compliance_forced, (round(coalesce(o.routing_latency_ms, 0) + 1e-8, 6) + 0e0) AS routing_latency_ms,
  (round(coalesce(o.backend_write_latency_ms, 1000) + 1e-8, 6) + 0e0) AS backend_write_latency_ms,
  (round(coalesce(o.routing_latency_ms, 0) + coalesce(o.backend_write_latency_ms, 1000) + 1e-8, 6) + 0e0) AS total_latency_ms,
  coalesce(o.success, FALSE) AS success, (round(coalesce(o.energy_cpu_pkg_j, 0) + 1e-8, 6) + 0e0) AS energy_cpu_pkg_j,
  f.payload_bytes, f.sensitive, CAST(NULL AS DOUBLE) AS proc_cpu_pct, CAST(NULL AS DOUBLE) AS proc_rss_mb
FROM (SELECT *, CASE WHEN sensitive THEN 'ipfs' ELSE static_dest END AS destination FROM flagged) f
LEFT JOIN obs o ON o.log_id = f.log_id AND o.destination = f.destination AND f.log_id % 23 <> 0 AND f.log_id % 5 <> 4"""


def measured_later(spark, directory):
    """Outcomes with the time they were measured, up to 160 minutes after the log.

    Those of every 23rd log were never measured.
    """
    times = tables.logs(spark, directory).select("log_id", F.col("ts").cast("timestamp").alias("ts"))
    delay = F.make_dt_interval(mins=(F.col("log_id") % 5 * 40).cast("int"))
    return (
        tables.observations(spark, directory)
        .where("log_id % 23 <> 0")
        .join(times, "log_id")
        .withColumn("measured_at", F.col("ts") + delay)
        .drop("ts")
    )


@query("stream_late_trace", check(LATE_SQL, "flagged", "obs"))
def stream_late_trace(spark, directory):
    """Trace of decisions whose outcomes arrive a step later, too late, or never.

    The last step closes the streams with a row of each far in the future, so
    that the watermark passes every decision.
    """
    folder = fresh_folder(spark, "late")
    logs = tables.logs(spark, directory).withColumn("ts", F.col("ts").cast("timestamp"))
    decided = cut_lineage(routing.apply_compliance(routing.route_static(logs)))
    outcomes = cut_lineage(measured_later(spark, directory))
    low, high = decided.agg(F.min("log_id"), F.max("log_id")).first()
    slices = F.floor((F.col("log_id") - F.lit(low)) * PARTS / F.lit((high or 0) - (low or 0) + 1))
    end = F.lit("2999-01-01").cast("timestamp")
    close_logs = decided.limit(1).withColumns({"log_id": F.lit(-1).cast("long"), "ts": end})
    close_outcomes = outcomes.limit(1).withColumns({"log_id": F.lit(-2).cast("long"), "measured_at": end})
    paths = f"{folder}/in/logs", f"{folder}/in/outcomes"
    for step in range(PARTS + 2):
        come = decided.where(slices == step), outcomes.where(slices == step - 1)
        if step == PARTS + 1:
            come = close_logs, close_outcomes
        for rows, path in zip(come, paths, strict=True):
            rows.write.mode("append").parquet(path)
        streams = [
            spark.readStream.schema(rows.schema).parquet(path)
            for rows, path in zip((decided, outcomes), paths, strict=True)
        ]
        rows = late_trace(*streams, "static", F.col("LogSource"))
        write_late_trace(rows, f"{folder}/trace", f"{folder}/checkpoint").awaitTermination()
    return rounded(spark.read.schema(rows.schema).parquet(f"{folder}/trace").where("log_id >= 0"))


TIERS_SQL = """SELECT CASE WHEN sensitive THEN 'ipfs' ELSE static_dest END AS destination, count(*) AS logs,
  CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes FROM flagged GROUP BY 1"""


def read_back(spark, path):
    """Rows and bytes of each tier, from the shapes it keeps."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    rows = read_tier(spark, path, "relational").unionByName(
        read_tier(spark, path, "relational_rejects")
    ).select(F.lit("mysql").alias("destination"), F.col("log_message").alias("text"))
    found = read_tier(spark, path, "search").select(
        F.lit("elk").alias("destination"), F.get_json_object("document", "$.Content").alias("text")
    )
    kept = read_tier(spark, path, "references").join(
        read_tier(spark, path, "content").dropDuplicates(["cid"]), "cid"
    ).select(F.lit("ipfs").alias("destination"), F.col("content").alias("text"))
    return (
        rows.unionByName(found)
        .unionByName(kept)
        .groupBy("destination")
        .agg(F.count("*").alias("logs"), F.sum(size).alias("payload_bytes"))
    )


@query("stream_tiers", check(TIERS_SQL, "flagged"))
def stream_tiers(spark, directory):
    """What the continuous router wrote to each tier, read back from its shape."""
    return read_back(spark, f"{routed_stream(spark, directory)}/tiers")


@query("batch_tiers", check(TIERS_SQL, "flagged"))
def batch_tiers(spark, directory):
    """The same in one batch."""
    folder = fresh_folder(spark, "tiers")
    decided = cut_lineage(
        routing.apply_compliance(routing.route_static(tables.logs(spark, directory)))
    )
    columns = [c for c in LOG_COLUMNS if c in decided.columns]
    write_tier_shapes(decided, columns, folder)
    return read_back(spark, folder)


WINDOW_SQL = """SELECT date_trunc('day', l.ts) AS window_start, date_trunc('day', l.ts) + INTERVAL 1 DAY AS window_end,
  count(*) AS logs, count(*) FILTER (WHERE destination = 'mysql') AS mysql_logs,
  count(*) FILTER (WHERE destination = 'elk') AS elk_logs, count(*) FILTER (WHERE destination = 'ipfs') AS ipfs_logs,
  count(*) FILTER (WHERE sensitive) AS sensitive_logs
FROM (SELECT *, CASE WHEN sensitive THEN 'ipfs' ELSE static_dest END AS destination FROM flagged) f
JOIN logs l ON f.log_id = l.log_id
GROUP BY 1, 2 HAVING date_trunc('day', l.ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""


@query("stream_windows", check(WINDOW_SQL, "flagged", "logs"))
def stream_windows(spark, directory):
    """Daily mix of the windows that the watermark has closed."""
    folder = fresh_folder(spark, "windows")
    logs = tables.as_logs(tables.table_stream(spark, directory, "events"))
    decided = routing.apply_compliance(
        routing.route_static(logs.withColumn("ts", F.col("ts").cast("timestamp")))
    )
    mixed = mix_by_window(decided)
    mixed.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(mixed.schema).parquet(f"{folder}/out")
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn(
        "window_end", F.col("window_end").cast("timestamp_ntz")
    )


# ---- windows with late rows: every seventh log arrives a step later ---------
STEPPED = f"""SELECT l.log_id, l.ts, l.Node, f.sensitive, (l.log_id - lo) * {PARTS} // (hi - lo + 1) + CAST(l.log_id % 7 = 3 AS BIGINT) AS step
  FROM logs l JOIN flagged f ON f.log_id = l.log_id CROSS JOIN (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events)"""
TIMED = f"""SELECT s.*, mark FROM ({STEPPED}) s
  JOIN (SELECT step, max(max(ts)) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 3 DAY AS mark
    FROM ({STEPPED}) GROUP BY step) m ON m.step = s.step"""
COUNTED = """count(*) AS logs, count(*) FILTER (WHERE sensitive) AS sensitive_logs"""
CLOSED = "window_end <= (SELECT max(ts) - INTERVAL 3 DAY FROM events)"
SLIDING_SQL = f"""WITH p AS (SELECT *, coalesce(window_end <= mark, FALSE) AS late FROM (
    SELECT *, b - k * INTERVAL 6 HOUR AS window_start, b - k * INTERVAL 6 HOUR + INTERVAL 1 DAY AS window_end
    FROM (SELECT *, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS b FROM timed) CROSS JOIN range(4) AS r(k)))
SELECT Node, 'window' AS kind, window_start, window_end, {COUNTED}, {CLOSED} AS closed FROM p WHERE NOT late GROUP BY ALL
UNION ALL SELECT Node, 'late', window_start, window_end, {COUNTED}, TRUE FROM p WHERE late GROUP BY ALL"""
SESSION_SQL = f"""WITH s AS (SELECT *, sum(fresh) OVER (PARTITION BY Node ORDER BY ts, log_id) AS n FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY Node ORDER BY ts, log_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh
    FROM timed WHERE coalesce(ts > mark, TRUE)))
SELECT Node, kind, window_start, window_end, logs, sensitive_logs, {CLOSED} AS closed FROM (
  SELECT Node, n, 'window' AS kind, min(ts) AS window_start, max(ts) + INTERVAL 1 HOUR AS window_end, {COUNTED} FROM s GROUP BY Node, n)
UNION ALL SELECT Node, 'late', ts, ts + INTERVAL 1 HOUR, {COUNTED}, TRUE FROM timed WHERE ts <= mark GROUP BY Node, ts"""
part("timed", TIMED, "logs", "flagged")


def windowed_logs(spark, directory, windows):
    """Windows of a stream in which some logs arrive late, and the late logs."""
    folder = fresh_folder(spark, "open-windows")
    logs = tables.logs(spark, directory).withColumn("ts", F.col("ts").cast("timestamp"))
    decided = cut_lineage(
        routing.apply_compliance(routing.route_static(logs)).select("log_id", "ts", "Node", "sensitive")
    )
    low, high = decided.agg(F.min("log_id"), F.max("log_id")).first()
    place = (F.col("log_id") - F.lit(low)) * PARTS / F.lit((high or 0) - (low or 0) + 1)
    step = F.floor(place) + (F.col("log_id") % 7 == 3).cast("int")
    counts = {"logs": F.lit(1), "sensitive_logs": F.col("sensitive").cast("int")}
    for arriving in range(PARTS + 1):
        decided.where(step == arriving).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(decided.schema).parquet(f"{folder}/in")
        running = window_stream(
            stream, windows, counts, f"{folder}/out", f"{folder}/checkpoint", ["Node"], "3 days"
        )
        running.awaitTermination()
    schema = window_schema(decided, counts, ["Node"])
    rows = read_windows(spark, f"{folder}/out", schema, PARTS).withColumn("kind", F.lit("window"))
    late = read_late(spark, f"{folder}/out").groupBy("Node", "window_start", "window_end").agg(
        F.count("*").alias("logs"), F.count_if("sensitive").alias("sensitive_logs")
    )
    late = late.withColumns({"kind": F.lit("late"), "closed": F.lit(True)})
    bounds = {b: F.col(b).cast("timestamp_ntz") for b in ("window_start", "window_end")}
    return rows.unionByName(late).withColumns(bounds)


@query("stream_sliding_late", check(SLIDING_SQL, "timed").replace("\nWITH p AS", ",\np AS"))
def stream_sliding_late(spark, directory):
    """Days, one every six hours, and the rows that missed one of theirs."""
    return windowed_logs(spark, directory, Sliding("1 day", "6 hours"))


@query("stream_sessions_late", check(SESSION_SQL, "timed").replace("\nWITH s AS", ",\ns AS"))
def stream_sessions_late(spark, directory):
    """Sessions of a node, ended by an hour without a log, and the late rows."""
    return windowed_logs(spark, directory, Sessions("1 hour"))


# ---- online adaptive router, one micro-batch per step of arriving files -----
def interval_parts(name, numbered):
    """SQL parts of the adaptive router before each interval ``k`` of numbered logs."""
    part(f"{name}_logs", numbered, "logs")
    part(
        f"{name}_rows",
        "SELECT k, r.attr, r.bucket, r.destination, r.cost FROM ("
        + "\nUNION ALL ".join(
            f"SELECT l.epoch, '{a}' AS attr, {bucket('l.' + a)} AS bucket, o.destination, o.backend_write_latency_ms AS cost"
            f" FROM {name}_logs l JOIN cbr_logs s ON l.log_id = s.log_id JOIN outcomes o ON l.log_id = o.log_id"
            for a in ("Level", "Component", "LogSource")
        )
        + f") r JOIN (SELECT DISTINCT epoch AS k FROM {name}_logs) ON r.epoch < k",
        f"{name}_logs",
        "cbr_logs",
        "outcomes",
    )
    part(
        f"{name}_scored",
        f"""SELECT w.k, w.attr, greatest(0e0, g.v - sum(w.n * w.v) / sum(w.n)) / g.v AS score
      FROM (SELECT k, attr, bucket, count(*) AS n, var_pop(cost) AS v FROM {name}_rows GROUP BY ALL) w
      JOIN (SELECT k, count(*) AS n, var_pop(cost) AS v FROM {name}_rows WHERE attr = 'Level' GROUP BY k) g ON w.k = g.k
      WHERE w.n >= 2 AND 3 * g.n >= 5 AND g.v > 1e-9 GROUP BY w.k, w.attr, g.v HAVING sum(w.n) >= 5""",
        f"{name}_rows",
    )
    part(
        f"{name}_choice",
        f"""SELECT k, attr FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC,
      CASE attr WHEN 'Level' THEN 1 WHEN 'Component' THEN 2 ELSE 3 END) AS r FROM {name}_scored) WHERE r = 1""",
        f"{name}_scored",
    )
    part(
        f"{name}_policy",
        f"""SELECT k, attr, bucket, destination FROM (SELECT k, attr, bucket, destination, row_number() OVER (PARTITION BY k, attr, bucket
      ORDER BY avg(cost), {RANK.format('destination')}) AS r FROM {name}_rows GROUP BY k, attr, bucket, destination) WHERE r = 1""",
        f"{name}_rows",
    )
    part(
        f"{name}_overall",
        f"""SELECT k, destination FROM (SELECT k, destination, row_number() OVER (PARTITION BY k
      ORDER BY avg(cost), {RANK.format('destination')}) AS r FROM {name}_rows WHERE attr = 'Level' GROUP BY k, destination) WHERE r = 1""",
        f"{name}_rows",
    )


def interval_sql(name):
    return f"""SELECT l.log_id, CAST(l.epoch AS INT) AS epoch, coalesce(p.destination, g.destination, l.static_dest) AS raw_destination
FROM (SELECT *, {STATIC} AS static_dest FROM {name}_logs) l
LEFT JOIN {name}_choice c ON c.k = l.epoch
LEFT JOIN {name}_policy p ON p.k = l.epoch AND p.attr = c.attr AND p.bucket = CASE c.attr
  WHEN 'Level' THEN {bucket('l.Level')} WHEN 'Component' THEN {bucket('l.Component')} ELSE {bucket('l.LogSource')} END
LEFT JOIN {name}_overall g ON g.k = l.epoch"""


def interval_check(name):
    return check(interval_sql(name), *[f"{name}_{p}" for p in ("logs", "choice", "policy", "overall")])


interval_parts(
    "epoch",
    f"""SELECT *, floor((log_id - (SELECT min(log_id) FROM logs)) * {PARTS}
    / ((SELECT max(log_id) - min(log_id) FROM logs) + 1)) AS epoch FROM logs""",
)
interval_parts("slice", f"SELECT *, (row_number() OVER (ORDER BY log_id) - 1) // {INTERVAL} AS epoch FROM logs")


@query("online_cbr", interval_check("epoch"))
def online_cbr(spark, directory):
    """Each micro-batch routed with the statistics of those before it."""
    folder = fresh_folder(spark, "online")
    router = OnlineCbr(out=folder, counterfactual=True)
    outcomes = tables.observations(spark, directory)
    for _, events in tables.arriving(spark, directory, f"{folder}/in", PARTS):
        router.start(tables.as_logs(events), outcomes, f"{folder}/checkpoint").awaitTermination()
    decided = spark.read.parquet(f"{folder}/decisions")
    return decided.select("log_id", F.col("batch_id").cast("int").alias("epoch"), "raw_destination")


@query("online_intervals", interval_check("slice"))
def online_intervals(spark, directory):
    """One batch routed in intervals of 200 decisions, each with the state before it."""
    folder = fresh_folder(spark, "online")
    router = OnlineCbr(out=folder, counterfactual=True, interval=INTERVAL)
    events = tables.table_stream(spark, directory, "events")
    router.start(
        tables.as_logs(events), tables.observations(spark, directory), f"{folder}/checkpoint"
    ).awaitTermination()
    decided = spark.read.parquet(f"{folder}/decisions")
    return decided.select("log_id", F.col("slice").cast("int").alias("epoch"), "raw_destination")


@query(
    "online_resumed",
    check(
        """SELECT attr, bucket, destination, count(*) AS n, (round(sum(cost) + 1e-8, 6) + 0e0) AS sum_cost
FROM cbr_rows GROUP BY ALL""",
        "cbr_rows",
    ),
)
def online_resumed(spark, directory):
    """Statistics of a stream of odd logs that starts with those of even ones."""
    folder = fresh_folder(spark, "online")
    logs, outcomes = tables.logs(spark, directory), tables.observations(spark, directory)
    even = cbr.bucket_stats(cbr.feedback(logs.where("log_id % 2 = 0"), outcomes))
    cbr.save_state(even, cbr.NUM_BUCKETS, f"{folder}/start")
    router = OnlineCbr(
        out=folder, counterfactual=True, start_state=f"{folder}/start", strict_warmup=True
    )
    events = tables.table_stream(spark, directory, "events").where("event_id % 2 <> 0")
    stream = router.start(tables.as_logs(events), outcomes, f"{folder}/checkpoint")
    stream.awaitTermination()
    state = cbr.load_state(spark, router.state_path(stream.lastProgress["batchId"]))
    return state.select(
        "attr",
        "bucket",
        "destination",
        "n",
        F.round(F.col("n") * F.col("mean") + 1e-8, 6).alias("sum_cost"),
    )


@query(
    "online_state",
    check(
        """SELECT attr, bucket, destination, count(*) AS n, (round(sum(cost) + 1e-8, 6) + 0e0) AS sum_cost
FROM cbr_rows GROUP BY ALL""",
        "cbr_rows",
    ),
)
def online_state(spark, directory):
    """Statistics after a stream of all logs, every tier observed."""
    folder = fresh_folder(spark, "online")
    events = tables.table_stream(spark, directory, "events")
    router = OnlineCbr(out=folder, counterfactual=True)
    stream = router.start(
        tables.as_logs(events), tables.observations(spark, directory), f"{folder}/checkpoint"
    )
    stream.awaitTermination()
    last = stream.lastProgress["batchId"]
    state = spark.read.parquet(router.state_path(last))
    return cut_lineage(
        state.select(
            "attr", "bucket", "destination", "n", F.round(F.col("n") * F.col("mean") + 1e-8, 6).alias("sum_cost")
        )
    )
