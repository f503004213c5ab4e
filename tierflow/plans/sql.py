"""Parts of the checking SQL, written apart from the DataFrame code."""

TIERS = "(VALUES (0, 'mysql'), (1, 'elk'), (2, 'ipfs')) AS d(k, destination)"


def sl(column: str) -> str:
    return f"coalesce(nullif(lower({column}), 'nan'), '')"


def hashed(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def uniform(salt: str, column: str = "log_id") -> str:
    return f"({hashed(f"'{salt}|' || {column}")} % 10000)"


def bucket(column: str, n: int = 24) -> str:
    return f"({hashed(f"coalesce({column}, '')")} % {n})"


STATIC = f"""CASE WHEN {sl('LogSource')} = 'openssh' THEN 'ipfs'
    WHEN {sl('Component')} = 'kernel' THEN 'ipfs'
    WHEN {sl('Level')} IN ('crit', 'alert', 'emerg') THEN 'ipfs'
    WHEN {sl('Level')} IN ('err', 'error', 'warn') THEN 'elk'
    WHEN contains({sl('Content')}, 'fail') OR contains({sl('Content')}, 'denied') THEN 'elk'
    ELSE 'mysql' END"""

PATTERNS = ("sessionid", "token", "secret key", "permission denied", "login", "/home/")

TEXT = (
    "lower(coalesce(Content, '') || ' ' || coalesce(EventTemplate, '') || ' ' || coalesce(Component, ''))"
)

SENSITIVE = (
    "(lower(coalesce(Level, '')) IN ('error', 'crit', 'alert', 'emerg') OR "
    + " OR ".join(f"contains({TEXT}, '{p}')" for p in PATTERNS)
    + ")"
)

SENSITIVE_RL = (
    f"({sl('Level')} IN ('error', 'crit', 'alert', 'emerg') OR {sl('Component')} = 'kernel' OR "
    + " OR ".join(
        f"contains({sl('Content')}, '{w}')"
        for w in ("sshd", "kernel", "denied", "fail", "unauthorized", "forbidden")
    )
    + ")"
)

ACTION = "CASE {0} WHEN 'mysql' THEN 0 WHEN 'elk' THEN 1 WHEN 'ipfs' THEN 2 ELSE 0 END"
RANK = "CASE {0} WHEN 'mysql' THEN 1 WHEN 'elk' THEN 2 ELSE 3 END"
ATTRIBUTES = ("Level", "Component", "LogSource")

# Every part and the parts it reads.
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def part(name: str, text: str, *reads: str) -> None:
    PARTS[name] = (text, reads)


def check(body: str, *reads: str) -> str:
    """A query with the parts it needs, each once, in order of use."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for other in PARTS[name][1]:
                visit(other)
            ordered.append(name)

    for name in reads:
        visit(name)
    if not ordered:
        return body
    kept = {n: "MATERIALIZED " if n in ("move_counts", "q0") else "" for n in ordered}
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {kept[n]}({PARTS[n][0]})" for n in ordered) + "\n" + body


part(
    "logs",
    """SELECT event_id AS log_id, ts, CAST(event_id AS VARCHAR) AS LineId,
  strftime(ts, '%H:%M:%S') AS Time, strftime(ts, '%Y-%m-%d') AS Date,
  CASE event_type WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'crit' ELSE 'ERROR' END
    WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'notice' WHEN 'view' THEN 'INFO' ELSE NULL END AS Level,
  CASE user_id % 7 WHEN 0 THEN 'kernel' WHEN 1 THEN 'sshd' WHEN 2 THEN 'dfs.DataNode' ELSE 'app' END AS Component,
  CASE user_id % 6 WHEN 0 THEN 'OpenSSH' WHEN 1 THEN 'Apache' WHEN 2 THEN 'HDFS' WHEN 3 THEN 'Linux' ELSE 'Spark' END AS LogSource,
  'node-' || CAST(user_id % 10 AS VARCHAR) AS Node,
  'E' || CAST(event_id % 50 AS VARCHAR) AS EventId,
  event_type || ' <*> by <*>' AS EventTemplate,
  CASE event_id % 17 WHEN 0 THEN 'Login attempt by user ' || CAST(user_id AS VARCHAR)
    WHEN 3 THEN 'open /home/app/cfg: Permission denied'
    WHEN 5 THEN 'request failed props=' || props
    WHEN 7 THEN 'sessionId=' || CAST(user_id AS VARCHAR)
    ELSE event_type || ' by user ' || CAST(user_id AS VARCHAR) || ' ' || props END AS Content
  FROM events""",
)
part(
    "obs",
    f"""SELECT e.event_id AS log_id, d.destination,
  (e.event_id * 13 + d.k) % 101 <> 0 AS success,
  CAST((e.event_id * 7 + d.k) % 40 AS DOUBLE) / 100e0 AS routing_latency_ms,
  e.value * CASE d.k WHEN 0 THEN CASE WHEN e.event_type = 'error' THEN 3e0 ELSE 1e0 END
    WHEN 1 THEN CASE WHEN e.event_type = 'error' THEN 1e0 ELSE 2e0 END ELSE 25e-1 END AS backend_write_latency_ms,
  CAST((e.event_id * 31 + d.k * 17) % 1000 AS DOUBLE) / 10000e0 AS energy_cpu_pkg_j
  FROM events e CROSS JOIN {TIERS}""",
)
# Every log at every tier; a write without an outcome failed after a second.
part(
    "outcomes",
    f"""SELECT l.log_id, d.destination, coalesce(o.success, FALSE) AS success,
  coalesce(o.routing_latency_ms, 0e0) AS routing_latency_ms,
  coalesce(o.backend_write_latency_ms, 1000e0) AS backend_write_latency_ms, o.energy_cpu_pkg_j
  FROM logs l CROSS JOIN {TIERS} LEFT JOIN obs o ON o.log_id = l.log_id AND o.destination = d.destination""",
    "logs",
    "obs",
)
part(
    "flagged",
    f"""SELECT log_id, LogSource AS dataset_name, {STATIC} AS static_dest, {SENSITIVE} AS sensitive,
  octet_length(encode(coalesce(Content, ''))) AS payload_bytes FROM logs""",
    "logs",
)

# ---- adaptive router -------------------------------------------------------
part("cbr_logs", f"SELECT * FROM logs WHERE {uniform('cbr')} < 600", "logs")
part(
    "cbr_rows",
    "\nUNION ALL ".join(
        f"SELECT '{a}' AS attr, {bucket('l.' + a)} AS bucket, o.destination, o.backend_write_latency_ms AS cost"
        " FROM cbr_logs l JOIN outcomes o ON l.log_id = o.log_id"
        for a in ATTRIBUTES
    ),
    "cbr_logs",
    "outcomes",
)
part(
    "cbr_total",
    "SELECT count(*) AS n, var_pop(cost) AS v FROM cbr_rows WHERE attr = 'Level'",
    "cbr_rows",
)
part(
    "cbr_within",
    "SELECT attr, bucket, count(*) AS n, var_pop(cost) AS v FROM cbr_rows GROUP BY attr, bucket",
    "cbr_rows",
)
part(
    "cbr_scored",
    """SELECT attr, greatest(0e0, (SELECT v FROM cbr_total) - sum(n * v) / sum(n)) / (SELECT v FROM cbr_total) AS score
  FROM cbr_within WHERE n >= 2 GROUP BY attr
  HAVING sum(n) >= 5 AND (SELECT 3 * n >= 5 AND v > 1e-9 FROM cbr_total)""",
    "cbr_total",
    "cbr_within",
)
part(
    "cbr_choice",
    """SELECT attr FROM cbr_scored ORDER BY score DESC,
  CASE attr WHEN 'Level' THEN 1 WHEN 'Component' THEN 2 ELSE 3 END LIMIT 1""",
    "cbr_scored",
)
part(
    "cbr_means",
    "SELECT attr, bucket, destination, avg(cost) AS mean_cost FROM cbr_rows GROUP BY ALL",
    "cbr_rows",
)
part(
    "cbr_policy",
    f"""SELECT attr, bucket, destination FROM (SELECT *, row_number() OVER (PARTITION BY attr, bucket
  ORDER BY mean_cost, {RANK.format('destination')}) AS r FROM cbr_means) WHERE r = 1""",
    "cbr_means",
)
part(
    "cbr_overall",
    f"""SELECT destination FROM cbr_rows WHERE attr = 'Level' GROUP BY destination
  ORDER BY avg(cost), {RANK.format('destination')} LIMIT 1""",
    "cbr_rows",
)
part(
    "cbr_route",
    f"""SELECT l.log_id, coalesce(p.destination, (SELECT destination FROM cbr_overall), l.static_dest) AS raw
  FROM (SELECT *, {STATIC} AS static_dest, CASE (SELECT attr FROM cbr_choice)
    WHEN 'Level' THEN {bucket('Level')} WHEN 'Component' THEN {bucket('Component')}
    ELSE {bucket('LogSource')} END AS b FROM logs) l
  LEFT JOIN cbr_policy p ON p.attr = (SELECT attr FROM cbr_choice) AND p.bucket = l.b""",
    "logs",
    "cbr_choice",
    "cbr_policy",
    "cbr_overall",
)

# ---- replay ----------------------------------------------------------------
part(
    "decisions",
    """SELECT log_id, 'static' AS router, static_dest AS raw FROM flagged
  UNION ALL SELECT log_id, 'direct_' || d.destination, d.destination FROM flagged
    CROSS JOIN (VALUES ('mysql'), ('elk'), ('ipfs')) AS d(destination)
  UNION ALL SELECT log_id, 'cbr', raw FROM cbr_route""",
    "flagged",
    "cbr_route",
)


def replay(decisions: str, enforced: str) -> str:
    destination = f"CASE WHEN f.sensitive AND {enforced} THEN 'ipfs' ELSE r.raw END"
    return f"""SELECT f.log_id, r.router, f.dataset_name, {destination} AS destination,
    r.raw AS raw_destination, {destination} <> r.raw AS compliance_forced, f.payload_bytes, f.sensitive,
    coalesce(o.success, FALSE) AS success,
    coalesce(o.routing_latency_ms, 0e0) AS routing_latency_ms,
    coalesce(o.backend_write_latency_ms, 1000e0) AS backend_write_latency_ms,
    coalesce(o.routing_latency_ms, 0e0) + coalesce(o.backend_write_latency_ms, 1000e0) AS total_latency_ms,
    coalesce(o.energy_cpu_pkg_j, 0e0) AS energy_cpu_pkg_j
  FROM flagged f JOIN {decisions} r ON f.log_id = r.log_id
  LEFT JOIN obs o ON o.log_id = f.log_id AND o.destination = {destination}"""


part("base", replay("decisions", "FALSE"), "flagged", "decisions", "obs")
part("enforced", replay("decisions", "TRUE"), "flagged", "decisions", "obs")

ADDITIVE = """count(*) AS rows, (round(avg(total_latency_ms) + 1e-8, 6) + 0e0) AS mean_total_latency_ms,
  (round(avg(success::INT) + 1e-8, 6) + 0e0) AS success_rate, (round(avg(sensitive::INT) + 1e-8, 6) + 0e0) AS sensitive_fraction,
  (round(avg(energy_cpu_pkg_j) + 1e-8, 6) + 0e0) AS energy_per_log_j,
  (round(avg((destination = 'mysql')::INT) + 1e-8, 6) + 0e0) AS destination_mix_mysql,
  (round(avg((destination = 'elk')::INT) + 1e-8, 6) + 0e0) AS destination_mix_elk,
  (round(avg((destination = 'ipfs')::INT) + 1e-8, 6) + 0e0) AS destination_mix_ipfs,
  count(*) FILTER (WHERE sensitive) AS sensitive_total,
  count(*) FILTER (WHERE sensitive AND destination = 'ipfs') AS sensitive_to_ipfs,
  (round(coalesce(count(*) FILTER (WHERE sensitive AND destination = 'ipfs')::DOUBLE
    / nullif(count(*) FILTER (WHERE sensitive), 0), 1) + 1e-8, 6) + 0e0) AS sensitive_coverage,
  count(*) FILTER (WHERE sensitive AND destination <> 'ipfs') AS sensitive_leakage,
  (round(coalesce(count(*) FILTER (WHERE sensitive AND destination <> 'ipfs')::DOUBLE
    / nullif(count(*) FILTER (WHERE sensitive), 0), 0) + 1e-8, 6) + 0e0) AS leakage_rate,
  (round(coalesce(count(*) FILTER (WHERE NOT sensitive AND destination = 'ipfs')::DOUBLE
    / nullif(count(*) FILTER (WHERE NOT sensitive), 0), 0) + 1e-8, 6) + 0e0) AS non_sensitive_ipfs_fraction,
  CASE WHEN count(*) FILTER (WHERE sensitive AND destination <> 'ipfs') = 0 THEN 1e0 ELSE 0e0 END AS compliance_score"""

COMBINED = (
    ADDITIVE
    + """, (round(quantile_cont(total_latency_ms, 0.5) + 1e-8, 6) + 0e0) AS median_total_latency_ms,
  (round(quantile_cont(total_latency_ms, 0.95) + 1e-8, 6) + 0e0) AS p95_total_latency_ms"""
)

part(
    "runs",
    """SELECT router, dataset_name, count(*) AS n, sum(energy_cpu_pkg_j) / 3600e0 AS wh,
  avg(total_latency_ms) AS lat, count(*) / (sum(total_latency_ms) / 1000e0) AS thr,
  sum(energy_cpu_pkg_j) / 3600e0 / count(*) AS per_log FROM base GROUP BY router, dataset_name""",
    "base",
)

# ---- rewards and outcomes side by side ------------------------------------
REWARD = """CASE WHEN NOT o.success THEN -1e0 - 0.3e0 * least(o.backend_write_latency_ms / 1000e0, 1e0)
      - 0.05e0 * greatest(0e0, o.energy_cpu_pkg_j)
    ELSE least(2e0, greatest(-2e0, CASE WHEN o.destination = l.desired THEN 1.2e0 ELSE -0.8e0 END
      + CASE WHEN l.sensitive AND o.destination <> 'ipfs' THEN -0.8e0
             WHEN NOT l.sensitive AND o.destination = 'ipfs' THEN -0.2e0 ELSE 0e0 END
      + 0.3e0 * (1e0 - least(o.backend_write_latency_ms / 1000e0, 1e0))
      - 0.05e0 * greatest(0e0, o.energy_cpu_pkg_j))) END"""
part(
    "rewarded",
    f"""SELECT o.log_id, o.destination, l.desired, l.sensitive, {REWARD} AS reward
  FROM outcomes o JOIN (SELECT log_id, {STATIC} AS desired, {SENSITIVE_RL} AS sensitive FROM logs) l
    ON o.log_id = l.log_id""",
    "logs",
    "outcomes",
)

# ---- system state, features, tabular policy --------------------------------
part(
    "metrics",
    """SELECT 'node-' || CAST(user_id % 10 AS VARCHAR) AS node, date_trunc('hour', ts) + INTERVAL 1 HOUR AS ts,
  round(avg(value) + 1e-6, 4) AS cpu_pct, max(value) AS mem_pct, CAST(count(*) AS DOUBLE) AS active_jobs,
  CAST(count(*) FILTER (WHERE event_type = 'view') AS DOUBLE) AS load_relational,
  CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) AS load_search,
  CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS load_content
  FROM events GROUP BY 1, 2""",
)
part(
    "sys",
    """SELECT l.log_id, m.cpu_pct, m.mem_pct, m.active_jobs, m.load_relational, m.load_search, m.load_content
  FROM logs l ASOF LEFT JOIN metrics m ON l.Node = m.node AND l.ts >= m.ts""",
    "logs",
    "metrics",
)
READINGS = ("cpu_pct", "mem_pct", "active_jobs", "load_relational", "load_search", "load_content")
part(
    "features",
    "SELECT l.log_id, l.Node, l.ts, f.static_dest AS teacher, CAST(f.payload_bytes AS DOUBLE) AS f0, "
    + ", ".join(f"coalesce(s.{c}, 0e0) AS f{i}" for i, c in enumerate(READINGS, start=1))
    + " FROM logs l JOIN flagged f ON l.log_id = f.log_id JOIN sys s ON l.log_id = s.log_id",
    "logs",
    "flagged",
    "sys",
)
part(
    "edges",
    "\nUNION ALL ".join(
        f"""SELECT {i} AS dim, e FROM (SELECT DISTINCT unnest(quantile_cont(f{i}, [0, 0.25, 0.5, 0.75, 1])) AS e
    FROM features) QUALIFY e > min(e) OVER () AND e < max(e) OVER ()"""
        for i in range(7)
    ),
    "features",
)
part(
    "states",
    "SELECT f.*, "
    + " || ',' || ".join(
        f"(SELECT count(*) FROM edges WHERE dim = {i} AND e <= f.f{i})::VARCHAR" for i in range(7)
    )
    + " AS state FROM features f",
    "features",
    "edges",
)
part(
    "behaviour",
    f"""SELECT s.*, {ACTION.format('o.destination')} AS action FROM states s
  JOIN obs o ON o.log_id = s.log_id""",
    "states",
    "obs",
)
part(
    "following",
    "SELECT log_id, state, lead(state) OVER (PARTITION BY Node ORDER BY ts, log_id) AS next_state FROM states",
    "states",
)
part(
    "moves",
    f"""SELECT f.log_id, f.state, CAST({ACTION.format('r.destination')} AS INT) AS action, r.reward, f.next_state
  FROM following f JOIN rewarded r ON f.log_id = r.log_id""",
    "following",
    "rewarded",
)
part(
    "move_counts",
    "SELECT state, action, next_state, count(*) AS n, sum(reward) AS sum_reward FROM moves GROUP BY ALL",
    "moves",
)
part(
    "teachers",
    f"""SELECT state, teacher FROM (SELECT state, teacher, row_number() OVER (PARTITION BY state
    ORDER BY count(*) DESC, {RANK.format('teacher')}) AS r FROM states GROUP BY state, teacher) WHERE r = 1""",
    "states",
)
part(
    "q0",
    f"""SELECT state, {', '.join(f"CASE WHEN {ACTION.format('teacher')} = {k} THEN 0.3e0 ELSE 0e0 END AS q{k}" for k in range(3))}
  FROM teachers""",
    "teachers",
)
# As many sweeps as bring 0.98 ** n below one part in ten thousand million.
SWEEPS = 1200


def mean_target(k: int) -> str:
    return f"""sum(c.sum_reward + 0.98e0 * c.n * coalesce(v.v, 0e0)) FILTER (WHERE c.action = {k})
    / sum(c.n) FILTER (WHERE c.action = {k}) AS q{k}"""


part(
    "q_all",
    f"""SELECT 0 AS i, state, q0, q1, q2 FROM q0 UNION ALL
  SELECT u.i + 1, p.state, {', '.join(f'coalesce(u.q{k}, p.q{k})' for k in range(3))}
  FROM q0 p JOIN (SELECT n.i, c.state, {', '.join(map(mean_target, range(3)))}
    FROM (SELECT max(i) AS i FROM q_all) n CROSS JOIN move_counts c
    LEFT JOIN (SELECT state, greatest(q0, q1, q2) AS v FROM q_all) v ON c.next_state = v.state
    GROUP BY n.i, c.state) u ON p.state = u.state WHERE u.i < {SWEEPS}""",
    "q0",
    "move_counts",
)
part(
    "q_end",
    f"""SELECT state, unnest([0, 1, 2]) AS action, unnest([q0, q1, q2]) AS q FROM q_all WHERE i = {SWEEPS}""",
    "q_all",
)
part(
    "q_policy",
    """SELECT state, action FROM (SELECT state, action, row_number() OVER (PARTITION BY state
    ORDER BY q DESC, action) AS r FROM q_end) WHERE r = 1""",
    "q_end",
)
part(
    "q_route",
    """SELECT s.log_id, s.state, coalesce(CASE p.action WHEN 0 THEN 'mysql' WHEN 1 THEN 'elk'
    WHEN 2 THEN 'ipfs' END, s.teacher) AS raw FROM states s LEFT JOIN q_policy p ON s.state = p.state""",
    "states",
    "q_policy",
)
part(
    "all_decisions",
    "SELECT * FROM decisions UNION ALL SELECT log_id, 'q_learning', raw FROM q_route",
    "decisions",
    "q_route",
)
part("all_base", replay("all_decisions", "FALSE"), "flagged", "all_decisions", "obs")

part(
    "choice",
    f"""SELECT log_id, {RANK.format('destination')} AS k, routing_latency_ms + backend_write_latency_ms AS lat,
  energy_cpu_pkg_j AS j FROM obs""",
    "obs",
)
