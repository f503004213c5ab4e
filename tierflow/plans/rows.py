"""Scans, sinks, scalar rules and samples."""

from pyspark.sql import functions as F

from tierflow.functions import text
from tierflow.operators import cbr, choices, patterns, routing, sampling
from tierflow.operators.trace import trace
from tierflow.plans.registry import query, rounded
from tierflow.plans.sql import (
    ATTRIBUTES,
    PATTERNS,
    SENSITIVE,
    SENSITIVE_RL,
    STATIC,
    TEXT,
    bucket,
    check,
    sl,
)
from tierflow.schemas import CBR_ATTRIBUTES, LOG_COLUMNS
from tierflow.runtime import fresh_folder
from tierflow.sources import results, tables, tiers
from tierflow.sources.logs import LINE_BITS, read_logs
from tierflow.sources.mixed import read_mixed

NAMESPACE = "hashed-words|whole-text"


@query("scan_logs", check(f"SELECT log_id, {', '.join(LOG_COLUMNS)} FROM logs", "logs"))
def scan_logs(spark, directory):
    return tables.logs(spark, directory).select("log_id", *LOG_COLUMNS)


@query(
    "scan_log_files",
    check(
        "SELECT event_id AS log_id, (event_id % 3) * 1099511627776 + event_id // 3 AS scanned_id, "
        + ", ".join(f"coalesce({c}, '') AS {c}" for c in LOG_COLUMNS if c != "LineId")
        + " FROM (SELECT *, log_id AS event_id FROM logs)",
        "logs",
    ),
)
def scan_log_files(spark, directory):
    """Three CSV files with columns in another order, each counting its lines anew."""
    folder = fresh_folder(spark, "csv")
    logs = tables.logs(spark, directory)
    part = (F.col("log_id") % 3).alias("part")
    line = F.floor(F.col("log_id") / 3).cast("string").alias("LineId")
    turned = [c for c in reversed(LOG_COLUMNS) if c != "LineId"]
    files = logs.select(*turned, line, part).repartition("part").write.partitionBy("part")
    files.option("header", True).option("escape", '"').csv(folder)
    rows = read_logs(spark, f"{folder}/part=*")
    number = F.shiftright("log_id", LINE_BITS)
    original = (F.col("LineId").cast("long") * 3 + number).alias("log_id")
    others = [c for c in LOG_COLUMNS if c != "LineId"]
    return rows.select(original, F.col("log_id").alias("scanned_id"), *others)


LACKED = ("Node", "EventTemplate")


@query(
    "scan_mixed_files",
    check(
        "SELECT log_id, 'read' AS outcome, "
        + ", ".join(
            f"CASE WHEN log_id % 3 = 2 THEN '' ELSE coalesce({c}, '') END AS {c}" if c in LACKED else f"coalesce({c}, '') AS {c}"
            for c in LOG_COLUMNS
        )
        + " FROM logs UNION ALL SELECT NULL, 'lacks LineId', "
        + ", ".join("NULL" for _ in LOG_COLUMNS)
        + " WHERE EXISTS (SELECT 1 FROM logs)",
        "logs",
    ),
)
def scan_mixed_files(spark, directory):
    """Files of three layouts and one without ids, read in one call."""
    folder = fresh_folder(spark, "mixed")
    logs = tables.logs(spark, directory).withColumn("Extra", F.lit("x,y"))
    layouts = [
        LOG_COLUMNS,
        list(reversed(LOG_COLUMNS)),
        ["Extra", *[c for c in LOG_COLUMNS if c not in LACKED]],
    ]
    for part, columns in enumerate(layouts):
        rows = logs.where(F.col("log_id") % 3 == part).select(*columns)
        rows.write.option("header", True).option("escape", '"').csv(f"{folder}/{part}")
    without = logs.drop("log_id", "LineId").coalesce(1).write.option("header", True)
    without.option("escape", '"').csv(f"{folder}/3")
    scan = read_mixed(spark, f"{folder}/*/*.csv", LOG_COLUMNS, needed=["LineId"])
    read = scan.rows.select(
        F.col("LineId").cast("long").alias("log_id"),
        F.lit("read").alias("outcome"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in LOG_COLUMNS],
    )
    aside = scan.files_aside.where("reason <> 'empty'").select(F.col("reason").alias("outcome"))
    return read.unionByName(aside, allowMissingColumns=True)


@query("sample_head", check("SELECT log_id, LogSource FROM logs ORDER BY log_id", "logs"))
def sample_head(spark, directory):
    return sampling.sample(tables.logs(spark, directory).select("log_id", "LogSource"), "head")


@query(
    "sample_random",
    check(
        "SELECT log_id, md5(CAST(log_id AS VARCHAR) || '|7') AS shuffle_key FROM logs ORDER BY shuffle_key",
        "logs",
    ),
)
def sample_random(spark, directory):
    return sampling.sample(tables.logs(spark, directory).select("log_id"), "random", seed="7")


BALANCED = """SELECT log_id, LogSource, row_number() OVER (PARTITION BY LogSource ORDER BY log_id) AS round,
  min(log_id) OVER (PARTITION BY LogSource) AS first_id FROM logs ORDER BY round, first_id"""


@query("sample_balanced", check(BALANCED, "logs"))
def sample_balanced(spark, directory):
    rows = tables.logs(spark, directory).select("log_id", "LogSource")
    return sampling.balanced_order(rows)


@query("sample_limit", check(BALANCED + " LIMIT 500", "logs"))
def sample_limit(spark, directory):
    rows = tables.logs(spark, directory).select("log_id", "LogSource")
    return sampling.sample(rows, "balanced", limit=500)


@query(
    "tier_relational",
    check(
        """SELECT log_id, nullif(Time, '') AS log_timestamp, nullif(Level, '') AS log_level,
  nullif(Node, '') AS source_host, nullif(Component, '') AS service_name, nullif(Content, '') AS log_message,
  coalesce(length(Time) > 255, FALSE) OR coalesce(length(Level) > 32, FALSE) OR coalesce(length(Node) > 255, FALSE)
  OR coalesce(length(Component) > 128, FALSE) OR coalesce(octet_length(encode(Content)) > 65535, FALSE) AS overflow
FROM logs""",
        "logs",
    ),
)
def tier_relational(spark, directory):
    return tiers.relational_rows(tables.logs(spark, directory))


@query(
    "tier_relational_documents",
    """SELECT doc_id AS log_id, NULL::VARCHAR AS log_timestamp, lang AS log_level, source AS source_host,
  NULL::VARCHAR AS service_name, nullif(text, '') AS log_message,
  coalesce(length(lang) > 32, FALSE) OR coalesce(length(source) > 255, FALSE)
  OR coalesce(octet_length(encode(text)) > 65535, FALSE) AS overflow FROM documents""",
)
def tier_relational_documents(spark, directory):
    documents = tables.table(spark, directory, "documents").select(
        F.col("doc_id").alias("log_id"),
        F.lit("").alias("Time"),
        F.col("lang").alias("Level"),
        F.col("source").alias("Node"),
        F.lit("").alias("Component"),
        F.col("text").alias("Content"),
    )
    return tiers.relational_rows(documents)


@query(
    "tier_search",
    check(
        f"""SELECT log_id, CAST(to_json(struct_pack({', '.join(f'{c} := {c}' for c in LOG_COLUMNS)})) AS VARCHAR) AS document,
  {', '.join(f'CASE WHEN length({c}) <= {w} THEN {c} END AS {c.lower()}_keyword'
             for c, w in (('Date', 512), ('Time', 512), ('Level', 256), ('Component', 512), ('LogSource', 512)))}
FROM logs""",
        "logs",
    ),
)
def tier_search(spark, directory):
    return tiers.search_documents(tables.logs(spark, directory), list(LOG_COLUMNS))


@query(
    "tier_content_addressed",
    """SELECT substr(sha256(coalesce(text, '')), 1, 46) AS cid, octet_length(encode(coalesce(text, ''))) AS payload_bytes,
  md5(coalesce(text, '')) AS digest, count(*) AS logs FROM documents GROUP BY ALL""",
)
def tier_content_addressed(spark, directory):
    documents = tables.table(spark, directory, "documents").select(
        F.col("doc_id").alias("log_id"), F.col("text").alias("Content")
    )
    counted = tiers.content_references(documents).groupBy("cid", "payload_bytes").agg(
        F.count("*").alias("logs")
    )
    stored = tiers.content_store(documents).select("cid", F.md5("content").alias("digest"))
    return stored.join(counted, "cid").select("cid", "payload_bytes", "digest", "logs")


@query(
    "content_references",
    check(
        """SELECT log_id, substr(sha256(coalesce(Content, '')), 1, 46) AS cid,
  octet_length(encode(coalesce(Content, ''))) AS payload_bytes FROM logs""",
        "logs",
    ),
)
def content_references(spark, directory):
    return tiers.content_references(tables.logs(spark, directory))


@query(
    "tier_counts",
    check(
        """SELECT CASE WHEN sensitive THEN 'ipfs' ELSE static_dest END AS destination, count(*) AS logs,
  CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes,
  count(*) FILTER (WHERE sensitive AND static_dest <> 'ipfs') AS forced FROM flagged GROUP BY 1""",
        "flagged",
    ),
)
def tier_counts(spark, directory):
    routed = routing.route_static(tables.logs(spark, directory))
    return tiers.tier_counts(routing.apply_compliance(routed))


TRACE_SQL = """SELECT f.log_id, 'static' AS router, f.dataset_name, f.destination, f.static_dest AS raw_destination,
  f.destination <> f.static_dest AS compliance_forced, (round(o.routing_latency_ms + 1e-8, 6) + 0e0) AS routing_latency_ms,
  (round(o.backend_write_latency_ms + 1e-8, 6) + 0e0) AS backend_write_latency_ms,
  (round(o.routing_latency_ms + o.backend_write_latency_ms + 1e-8, 6) + 0e0) AS total_latency_ms, o.success,
  (round(o.energy_cpu_pkg_j + 1e-8, 6) + 0e0) AS energy_cpu_pkg_j, f.payload_bytes, f.sensitive,
  CAST(NULL AS DOUBLE) AS proc_cpu_pct, CAST(NULL AS DOUBLE) AS proc_rss_mb
FROM (SELECT *, CASE WHEN sensitive THEN 'ipfs' ELSE static_dest END AS destination FROM flagged) f
JOIN obs o ON o.log_id = f.log_id AND o.destination = f.destination"""


@query("trace", check(TRACE_SQL, "flagged", "obs"))
def static_trace(spark, directory):
    decided = routing.apply_compliance(routing.route_static(tables.logs(spark, directory)))
    return rounded(
        trace(decided, tables.observations(spark, directory), "static", F.col("LogSource"))
    )


NAMES_SQL = """SELECT CASE WHEN event_id % 2 = 0 THEN 'summary_' ELSE '' END
    || CASE event_id % 7 WHEN 0 THEN 'static' WHEN 1 THEN 'direct_mysql' WHEN 2 THEN 'direct_elk'
      WHEN 3 THEN 'direct_ipfs' WHEN 4 THEN 'cbr' WHEN 5 THEN 'q_learning' ELSE 'a2c' END
    || '_' || event_type || '_Logs.csv' AS name FROM events"""


@query(
    "parse_result_name",
    f"""SELECT name, starts_with(name, 'summary_') AS summary,
  regexp_extract(name, '^(?:summary_)?(direct_(?:mysql|elk|ipfs)|q_learning|[^_]+)_(.+)\\.csv$', 1) AS router,
  regexp_extract(name, '^(?:summary_)?(direct_(?:mysql|elk|ipfs)|q_learning|[^_]+)_(.+)\\.csv$', 2) AS dataset_name,
  count(*) AS files FROM ({NAMES_SQL}) GROUP BY ALL""",
)
def parse_result_name(spark, directory):
    code = F.col("event_id") % 7
    routers = ["static", "direct_mysql", "direct_elk", "direct_ipfs", "cbr", "q_learning", "a2c"]
    router = F.element_at(F.array(*[F.lit(r) for r in routers]), (code + 1).cast("int"))
    prefix = F.when(F.col("event_id") % 2 == 0, "summary_").otherwise("")
    name = F.concat(prefix, router, F.lit("_"), "event_type", F.lit("_Logs.csv"))
    named = tables.table(spark, directory, "events").groupBy(name.alias("name")).agg(
        F.count("*").alias("files")
    )
    column = F.col("name")
    return named.select(
        "name",
        results.is_summary_name(column).alias("summary"),
        results.result_router(column).alias("router"),
        results.result_dataset(column).alias("dataset_name"),
        "files",
    )


@query(
    "safe_lower",
    check(
        f"""SELECT log_id, {sl('Level')} AS level_lower, {sl('Component')} AS component_lower,
  {sl('LogSource')} AS source_lower, {sl('Content')} AS content_lower FROM logs""",
        "logs",
    ),
)
def safe_lower(spark, directory):
    fields = {"Level": "level", "Component": "component", "LogSource": "source", "Content": "content"}
    return tables.logs(spark, directory).select(
        "log_id", *[text.safe_lower(F.col(c)).alias(f"{n}_lower") for c, n in fields.items()]
    )


@query("route_static", check(f"SELECT log_id, {STATIC} AS raw_destination FROM logs", "logs"))
def route_static(spark, directory):
    return routing.route_static(tables.logs(spark, directory)).select("log_id", "raw_destination")


@query(
    "route_direct",
    check(
        """SELECT log_id, 'direct_' || d.x AS router, d.x AS raw_destination FROM logs
CROSS JOIN (VALUES ('mysql'), ('elk'), ('ipfs')) AS d(x)""",
        "logs",
    ),
)
def route_direct(spark, directory):
    logs = tables.logs(spark, directory).select("log_id")
    routed = [
        routing.get_router(f"direct_{t}")(logs).withColumn("router", F.lit(f"direct_{t}"))
        for t in ("mysql", "elk", "ipfs")
    ]
    return routed[0].unionByName(routed[1]).unionByName(routed[2])


MERGE_SQL = f"""WITH given AS (
  SELECT i - {len(PATTERNS)} AS ord, p AS pattern FROM (VALUES
    {', '.join(f"({i}, '{p}')" for i, p in enumerate(PATTERNS))}) AS t(i, p)
  UNION ALL SELECT event_id, CASE event_id % 3 WHEN 0 THEN '  ' || upper(event_type) || ' ' WHEN 1 THEN ' Token'
    ELSE props END FROM events),
trimmed AS (SELECT ord, trim(pattern) AS pattern FROM given WHERE trim(pattern) <> '')
SELECT ord, pattern FROM (SELECT *, row_number() OVER (PARTITION BY lower(pattern) ORDER BY ord) AS r
  FROM trimmed) WHERE r = 1"""


@query("pattern_merge", MERGE_SQL)
def pattern_merge(spark, directory):
    code = F.col("event_id") % 3
    given = (
        F.when(code == 0, F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")))
        .when(code == 1, " Token")
        .otherwise(F.col("props"))
    )
    given_patterns = tables.table(spark, directory, "events").select(
        F.col("event_id").alias("ord"), given.alias("pattern")
    )
    return text.merge_pattern_table(given_patterns)


@query("sensitive_flag", check(f"SELECT log_id, {SENSITIVE} AS sensitive FROM logs", "logs"))
def sensitive_flag(spark, directory):
    return tables.logs(spark, directory).select("log_id", text.is_sensitive().alias("sensitive"))


@query(
    "pattern_hits",
    check(
        f"""SELECT p AS pattern, count(*) AS logs FROM logs
JOIN (VALUES {', '.join(f"('{p}')" for p in PATTERNS)}) AS t(p) ON contains({TEXT}, p) GROUP BY p""",
        "logs",
    ),
)
def pattern_hits(spark, directory):
    hits = tables.logs(spark, directory).select(
        F.explode(text.matching_patterns()).alias("pattern")
    )
    return hits.groupBy("pattern").agg(F.count("*").alias("logs"))


# A table of one pattern per customer, in changing case, next to short and odd ones.
TABLE_PATTERNS = """SELECT CASE WHEN c_custkey % 2 = 0 THEN 'User ' ELSE 'by user ' END || CAST(c_custkey AS VARCHAR) || ' {' AS p
  FROM customer UNION ALL SELECT 'sessionid=' || CAST(c_custkey AS VARCHAR) FROM customer
  UNION ALL SELECT n_name FROM nation UNION ALL SELECT t FROM (VALUES ('%'), ('7'), ('"k'), ('denied'), ('')) AS v(t)"""


def pattern_table(spark, directory):
    key = F.col("c_custkey").cast("string")
    customers = tables.table(spark, directory, "customer")
    start = F.when(F.col("c_custkey") % 2 == 0, "User ").otherwise("by user ")
    rows = customers.select(F.concat(start, key, F.lit(" {")).alias("pattern"))
    rows = rows.unionByName(customers.select(F.concat(F.lit("sessionid="), key).alias("pattern")))
    rows = rows.unionByName(tables.table(spark, directory, "nation").select(F.col("n_name").alias("pattern")))
    odd = spark.createDataFrame([("%",), ("7",), ('"k',), ("denied",), ("",)], "pattern string")
    return rows.unionByName(odd)


@query(
    "pattern_table_hits",
    check(
        f"""SELECT p AS pattern, count(*) AS logs FROM logs JOIN (SELECT min(p) AS p FROM ({TABLE_PATTERNS}) WHERE p <> ''
  GROUP BY lower(p)) ON contains({TEXT}, lower(p)) GROUP BY p""",
        "logs",
    ),
)
def pattern_table_hits(spark, directory):
    """Logs of each pattern of a table with two patterns per customer."""
    hits = patterns.pattern_matches(tables.logs(spark, directory), pattern_table(spark, directory))
    return hits.groupBy("pattern").agg(F.count("*").alias("logs"))


@query(
    "sensitive_by_table",
    check(
        f"""SELECT log_id, lower(coalesce(Level, '')) IN ('error', 'crit', 'alert', 'emerg') OR EXISTS (
  SELECT 1 FROM ({TABLE_PATTERNS}) WHERE length(p) > 2 AND contains({TEXT}, lower(p))) AS sensitive FROM logs""",
        "logs",
    ),
)
def sensitive_by_table(spark, directory):
    """Compliance predicate with the longer patterns of the table."""
    longer = pattern_table(spark, directory).where("length(pattern) > 2")
    return patterns.flag_by_table(tables.logs(spark, directory), longer).select("log_id", "sensitive")


@query("sensitive_rl", check(f"SELECT log_id, {SENSITIVE_RL} AS sensitive FROM logs", "logs"))
def sensitive_rl(spark, directory):
    return tables.logs(spark, directory).select(
        "log_id", text.is_sensitive_for_reward().alias("sensitive")
    )


@query(
    "compliance_override",
    check(
        """SELECT log_id, static_dest AS raw_destination, sensitive,
  CASE WHEN sensitive THEN 'ipfs' ELSE static_dest END AS destination,
  sensitive AND static_dest <> 'ipfs' AS compliance_forced FROM flagged""",
        "flagged",
    ),
)
def compliance_override(spark, directory):
    routed = routing.route_static(tables.logs(spark, directory))
    return routing.apply_compliance(routed).select(
        "log_id", "raw_destination", "sensitive", "destination", "compliance_forced"
    )


@query(
    "payload_bytes",
    "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS payload_bytes FROM documents",
)
def payload_bytes(spark, directory):
    return tables.table(spark, directory, "documents").select(
        "doc_id", text.payload_bytes(F.col("text")).alias("payload_bytes")
    )


@query(
    "cost_metrics",
    check(
        """SELECT log_id, destination, (round(backend_write_latency_ms + 1e-8, 6) + 0e0) AS latency_cost,
  (round(energy_cpu_pkg_j + 1e-8, 6) + 0e0) AS energy_cost,
  (round(backend_write_latency_ms + 1000e0 * energy_cpu_pkg_j + 1e-8, 6) + 0e0) AS combined_cost FROM obs""",
        "obs",
    ),
)
def cost_metrics(spark, directory):
    return rounded(choices.cost_metrics(tables.observations(spark, directory)))


@query(
    "reward",
    check(
        "SELECT log_id, destination, desired, sensitive, (round(reward + 1e-8, 6) + 0e0) AS reward FROM rewarded",
        "rewarded",
    ),
)
def reward(spark, directory):
    logs, outcomes = tables.logs(spark, directory), tables.observations(spark, directory)
    return rounded(choices.rewards(logs, outcomes))


@query(
    "safe_parse",
    """SELECT event_id, TRY_CAST(raw AS DOUBLE) AS number, lower(flag) = 'true' AS flag FROM (
  SELECT event_id, CASE event_type WHEN 'click' THEN 'n/a' WHEN 'view' THEN '' ELSE CAST(value AS VARCHAR) END AS raw,
    CASE event_id % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'TRUE' ELSE 'no' END AS flag FROM events)""",
)
def safe_parse(spark, directory):
    kind, code = F.col("event_type"), F.col("event_id") % 3
    raw = F.when(kind == "click", "n/a").when(kind == "view", "").otherwise(
        F.col("value").cast("string")
    )
    flag = F.when(code == 0, "True").when(code == 1, "TRUE").otherwise("no")
    return tables.table(spark, directory, "events").select(
        "event_id", text.safe_double(raw).alias("number"), text.safe_bool(flag).alias("flag")
    )


SPACES = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]+"


@query(
    "content_key",
    rf"""SELECT doc_id, sha1('{NAMESPACE}' || chr(10) || trim(regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g'))) AS key,
  sha1(coalesce(text, '')) AS raw_key FROM documents""",
)
def content_key(spark, directory):
    column = F.col("text")
    return tables.table(spark, directory, "documents").select(
        "doc_id",
        text.content_key(column, NAMESPACE).alias("key"),
        text.raw_content_key(column).alias("raw_key"),
    )


@query(
    "cbr_bucket",
    check(
        "\nUNION ALL ".join(
            f"SELECT log_id, '{a}' AS attr, {bucket(a)} AS bucket FROM logs" for a in ATTRIBUTES
        ),
        "logs",
    ),
)
def cbr_bucket(spark, directory):
    return cbr.attribute_buckets(tables.logs(spark, directory).select("log_id", *CBR_ATTRIBUTES))
