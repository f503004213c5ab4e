"""Features, offline policies, embeddings, reward histories."""

from pyspark.sql import functions as F

from tierflow.functions.text import payload_bytes
from tierflow.operators import (
    choices,
    embedding,
    energy,
    learned,
    qpolicy,
    rewards,
    routing,
    states,
    tabular,
)
from tierflow.operators.ordered import asof_backward
from tierflow.plans.registry import query, rounded
from tierflow.plans.rows import NAMESPACE, SPACES
from tierflow.plans.sql import ACTION, check
from tierflow.runtime import cut_lineage
from tierflow.sources import tables

# Columns of the system state in vector order.
SYSTEM = ("cpu_pct", "mem_pct", "active_jobs", "load_relational", "load_search", "load_content")
STATE_BINS = 4


def system_state(spark, directory, logs):
    """Logs with the latest readings of their node."""
    metrics = tables.system_metrics(spark, directory).withColumnRenamed("node", "Node")
    return asof_backward(logs, metrics, "Node", "ts", SYSTEM)


def rewarded_logs(spark, directory):
    return choices.rewards(tables.logs(spark, directory), tables.observations(spark, directory))


def log_steps(spark, directory):
    """One row per log: teacher and discrete state of payload and all readings."""
    logs = tables.logs(spark, directory).select(
        "log_id",
        "Node",
        "ts",
        routing.static_destination().alias("teacher"),
        payload_bytes(F.col("Content")).cast("double").alias("f0"),
    )
    # The features are read once per fitted edge set and again for every use of
    # the states, so the as-of join is stored.
    names = [f"f{i}" for i in range(len(SYSTEM) + 1)]
    readings = [F.coalesce(c, F.lit(0.0)).alias(n) for c, n in zip(SYSTEM, names[1:])]
    featured = cut_lineage(
        system_state(spark, directory, logs).select("log_id", "Node", "ts", "teacher", "f0", *readings)
    )
    components = [F.col(n) for n in names]
    bins = states.fit_bins(featured, components, STATE_BINS)
    return cut_lineage(
        featured.select(
            "log_id", "Node", "ts", "teacher", states.state_key(bins.apply(components)).alias("state")
        )
    )


def fit_tabular(spark, directory, policy_only=False):
    """Steps of all logs, and the values fitted on every measured outcome."""
    steps = log_steps(spark, directory)
    moves = qpolicy.transitions(steps, rewarded_logs(spark, directory))
    counts = qpolicy.transition_counts(moves)
    return steps, qpolicy.fit_q(counts, qpolicy.teacher_by_state(steps), policy_only=policy_only)


def q_decisions(steps, q):
    return qpolicy.route_q(steps, qpolicy.greedy_policy(q), F.col("teacher")).select(
        "log_id", "state", "raw_destination"
    )


# ---- system state and energy ----------------------------------------------
@query(
    "asof_system_state",
    check(
        f"SELECT log_id, {', '.join(SYSTEM)} FROM sys",
        "sys",
    ),
)
def asof_system_state(spark, directory):
    logs = tables.logs(spark, directory).select("log_id", "Node", "ts")
    return system_state(spark, directory, logs).select("log_id", *SYSTEM)


COUNTER_SQL = """SELECT *, energy_uj - prev AS change FROM (SELECT *, lag(energy_uj) OVER
    (PARTITION BY host, domain ORDER BY ts, seq) AS prev FROM (
  SELECT 'node-' || CAST(user_id % 10 AS VARCHAR) AS host, CASE event_type WHEN 'view' THEN 'package-0'
      WHEN 'click' THEN 'package-0:core' WHEN 'error' THEN 'package-1' WHEN 'signup' THEN 'psys' ELSE 'dram' END AS domain,
    event_id AS seq, ts, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)
      * CASE event_type WHEN 'signup' THEN 900 ELSE 370 END % 50000000 AS energy_uj FROM events))
  WHERE prev IS NOT NULL"""


@query(
    "counter_delta",
    f"""SELECT host, domain, seq, ts, energy_uj, greatest(0, change) AS delta_uj, change >= 0 AS energy_valid
FROM ({COUNTER_SQL})""",
)
def counter_delta(spark, directory):
    return energy.counter_deltas(tables.counter_readings(spark, directory))


@query(
    "host_energy",
    f"""SELECT host, day, (round(pkg + 1e-8, 6) + 0e0) AS cpu_pkg_j, (round(psys + 1e-8, 6) + 0e0) AS psys_j,
  (round(CASE WHEN has THEN greatest(0e0, psys - pkg) ELSE 0e0 END + 1e-8, 6) + 0e0) AS gpu_est_j, energy_valid FROM (
  SELECT host, strftime(ts, '%Y-%m-%d') AS day,
    coalesce(sum(greatest(0, change)) FILTER (WHERE domain IN ('package-0', 'package-1')), 0) / 1e6 AS pkg,
    coalesce(sum(greatest(0, change)) FILTER (WHERE domain = 'psys'), 0) / 1e6 AS psys,
    bool_or(domain = 'psys') AS has, bool_and(change >= 0) AS energy_valid
  FROM ({COUNTER_SQL}) GROUP BY 1, 2)""",
)
def host_energy(spark, directory):
    deltas = energy.counter_deltas(tables.counter_readings(spark, directory))
    daily = deltas.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rounded(energy.host_energy(daily, "day"))


ENERGY_SQL = """WITH s AS (SELECT 'node-' || CAST(user_id % 10 AS VARCHAR) AS host, epoch_us(ts) / 1e6 AS ts, value AS watts FROM events),
i AS (SELECT event_id AS interval_id, 'node-' || CAST(user_id % 10 AS VARCHAR) AS host, epoch_us(ts) / 1e6 - 900 AS t0,
  epoch_us(ts) / 1e6 - 900 + CASE event_id % 4 WHEN 0 THEN 0 ELSE 60 * value END AS t1 FROM events),
p AS (SELECT i.*, s.ts, s.watts, least(greatest(s.ts, i.t0), i.t1) AS t FROM i JOIN s ON i.host = s.host
  AND s.ts BETWEEN i.t0 - 900 AND i.t1 + 900 WHERE i.t1 > i.t0),
w AS (SELECT *, lag(t) OVER q AS pt, lag(watts) OVER q AS pw, lead(t) OVER q IS NULL AS final FROM p
  WINDOW q AS (PARTITION BY interval_id ORDER BY ts, watts)),
e AS (SELECT interval_id, count(*) AS samples, sum(CASE WHEN pt IS NULL THEN CASE WHEN ts > t0 THEN watts * (t - t0) ELSE 0 END
    ELSE 0.5e0 * (pw + watts) * (t - pt) END + CASE WHEN final AND ts < t1 THEN watts * (t1 - t) ELSE 0 END) AS j
  FROM w GROUP BY interval_id),
h AS (SELECT i.*, s.watts FROM i ASOF LEFT JOIN s ON i.host = s.host AND i.t1 >= s.ts)
SELECT h.interval_id, coalesce(e.samples, 0) AS samples, round(CASE WHEN h.t1 <= h.t0 THEN 0e0
  ELSE greatest(0e0, coalesce(e.j, greatest(0e0, h.watts) * (h.t1 - h.t0), 0e0)) END, 3) AS energy_j
FROM h LEFT JOIN e ON h.interval_id = e.interval_id"""


@query("energy_between", ENERGY_SQL)
def energy_between(spark, directory):
    start = tables.seconds("ts") - 900
    length = F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(60 * F.col("value"))
    intervals = tables.table(spark, directory, "events").select(
        F.col("event_id").alias("interval_id"),
        F.concat(F.lit("node-"), (F.col("user_id") % 10).cast("string")).alias("host"),
        start.alias("t0"),
        (start + length).alias("t1"),
    )
    samples = tables.power_samples(spark, directory)
    joules = energy.energy_between(intervals, samples, period_s=600.0)
    return joules.select("interval_id", "samples", F.round("energy_j", 3).alias("energy_j"))


# ---- vectors ---------------------------------------------------------------
VECTOR_STEPS = "SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings"


def vectors(spark, directory):
    return tables.table(spark, directory, "embeddings")


def long_form(df, vector, value="x"):
    return df.select("vec_id", F.posexplode(vector)).select(
        "vec_id", F.col("pos").cast("long").alias("dim"), F.col("col").alias(value)
    )


@query(
    "observation",
    check(
        f"""SELECT v.vec_id, d.dim, CASE d.dim {' '.join(f'WHEN {i} THEN coalesce(s.{c}, 0e0)' for i, c in enumerate(SYSTEM))}
  ELSE v.embedding[d.dim - 5]::DOUBLE END AS value
FROM embeddings v JOIN sys s ON s.log_id = v.vec_id, (SELECT unnest(range(70)) AS dim) d""",
        "sys",
    ),
)
def observation(spark, directory):
    """Each vector belongs to the log with its number."""
    logs = tables.logs(spark, directory).select("log_id", "Node", "ts")
    attached = vectors(spark, directory).join(
        system_state(spark, directory, logs), F.col("vec_id") == F.col("log_id")
    )
    return long_form(attached, states.observation(SYSTEM, "embedding"), "value")


@query(
    "scaler_fit",
    f"""SELECT dim, (round(avg(x) + 1e-8, 6) + 0e0) AS mean, (round(stddev_pop(x) + 1e-8, 6) + 0e0) AS std,
  (round(greatest(stddev_pop(x), 1e-6) + 1e-8, 6) + 0e0) AS floored_std FROM ({VECTOR_STEPS}) GROUP BY dim""",
)
def scaler_fit(spark, directory):
    frame = vectors(spark, directory)
    scaler = states.fit_scaler(frame, "embedding")
    plain = [std - states.STD_OFFSET for std in scaler.std]
    rows = [
        (dim, mean, std, max(std, states.STD_FLOOR))
        for dim, (mean, std) in enumerate(zip(scaler.mean, plain))
    ]
    fitted = spark.createDataFrame(rows, "dim long, mean double, std double, floored_std double")
    return rounded(fitted)


SCALED = f"""SELECT vec_id, dim, (x - avg(x) OVER d) / (stddev_pop(x) OVER d + 1e-8) AS z
  FROM ({VECTOR_STEPS}) WINDOW d AS (PARTITION BY dim)"""


@query("scaler_apply", f"SELECT vec_id, dim, (round(z + 1e-8, 6) + 0e0) AS z FROM ({SCALED})")
def scaler_apply(spark, directory):
    frame = vectors(spark, directory)
    scaler = states.fit_scaler(frame, "embedding")
    return rounded(long_form(frame, scaler.apply(states.doubles("embedding")), "z"))


BIN_EDGES = f"""SELECT dim, unnest(quantile_cont(z, [0, 0.25, 0.5, 0.75, 1])) AS e FROM ({SCALED}) GROUP BY dim"""
BINNED = f"""SELECT z.vec_id, z.dim, count(e.e) AS bin FROM ({SCALED}) z
LEFT JOIN (SELECT DISTINCT dim, e FROM ({BIN_EDGES}) QUALIFY e > min(e) OVER (PARTITION BY dim) AND e < max(e) OVER (PARTITION BY dim)) e
  ON z.dim = e.dim AND e.e <= z.z GROUP BY z.vec_id, z.dim"""


def binned(spark, directory):
    """All scaled components in quantile bins."""
    frame = vectors(spark, directory)
    scaler = states.fit_scaler(frame, "embedding")
    scaled = frame.select("vec_id", scaler.apply(states.doubles("embedding")).alias("z"))
    components = [F.col("z")[i] for i in range(len(scaler.mean))]
    bins = states.fit_bins(cut_lineage(scaled), components, 4)
    return scaled.select("vec_id", bins.apply(components).alias("bins"))


@query("quantile_bins", BINNED)
def quantile_bins(spark, directory):
    rows = long_form(binned(spark, directory), F.col("bins"), "bin")
    return rows.withColumn("bin", F.col("bin").cast("long"))


@query(
    "state_key",
    f"SELECT vec_id, string_agg(bin::VARCHAR, ',' ORDER BY dim) AS state FROM ({BINNED}) GROUP BY vec_id",
)
def state_key(spark, directory):
    return binned(spark, directory).select("vec_id", states.state_key(F.col("bins")).alias("state"))


@query("pca")
def pca(spark, directory):
    """State of each vector after scaling, projection and binning."""
    frame = vectors(spark, directory).select("vec_id", "embedding")
    steps = tabular.fit_steps(frame, "embedding")
    reduced = steps.projection.apply(frame, "embedding", "reduced")
    return steps.apply(reduced, "embedding").select("vec_id", "reduced", "state")


# ---- tabular policy --------------------------------------------------------
@query(
    "behaviour_actions",
    check("SELECT log_id, state, teacher, CAST(action AS INT) AS action FROM behaviour", "behaviour"),
)
def behaviour_actions(spark, directory):
    """The action of every measured outcome, with the state it was taken in."""
    taken = tables.observations(spark, directory).select(
        "log_id", routing.action_code(F.col("destination")).alias("action")
    )
    return log_steps(spark, directory).join(taken, "log_id").select(
        "log_id", "state", "teacher", "action"
    )


@query(
    "transitions",
    check(
        """SELECT log_id, state, action, (round(reward + 1e-8, 6) + 0e0) AS reward, next_state, next_state IS NULL AS done
FROM moves""",
        "moves",
    ),
)
def transitions(spark, directory):
    moves = qpolicy.transitions(log_steps(spark, directory), rewarded_logs(spark, directory))
    return rounded(moves.select("log_id", "state", "action", "reward", "next_state", "done"))


@query("q_fit", check("SELECT state, action, (round(q + 1e-6, 4) + 0e0) AS q FROM q_end", "q_end"))
def q_fit(spark, directory):
    q = fit_tabular(spark, directory)[1]
    return q.select("state", "action", F.round(F.col("q") + 1e-6, 4).alias("q"))


@query("q_policy", check("SELECT state, action FROM q_policy", "q_policy"))
def q_policy(spark, directory):
    return qpolicy.greedy_policy(fit_tabular(spark, directory, policy_only=True)[1])


@query("route_q", check("SELECT log_id, state, raw AS raw_destination FROM q_route", "q_route"))
def route_q(spark, directory):
    return q_decisions(*fit_tabular(spark, directory, policy_only=True))


@query(
    "unseen_states",
    check(
        """SELECT state, count(*) AS logs FROM states WHERE state NOT IN
  (SELECT state FROM states WHERE Node = 'node-0') GROUP BY state""",
        "states",
    ),
)
def unseen_states(spark, directory):
    """States that one node never met, over the logs of all nodes."""
    steps = log_steps(spark, directory)
    met = qpolicy.teacher_by_state(steps.where("Node = 'node-0'"))
    known = qpolicy.by_action(qpolicy.initial_q(met))
    return qpolicy.unseen_states(steps, known)


@query(
    "degraded_fallback",
    check(
        "SELECT log_id, static_dest AS raw_destination, TRUE AS router_degraded FROM flagged", "flagged"
    ),
)
def degraded_fallback(spark, directory):
    """A scaler of 64 dimensions does not fit a model of 999: rules take over."""
    scaler = states.fit_scaler(vectors(spark, directory), "embedding")
    usable = states.compatible(scaler, 999)
    routed = qpolicy.route_or_degrade(tables.logs(spark, directory), None, usable)
    return routed.select("log_id", "raw_destination", "router_degraded")


@query(
    "policy_in_use",
    check(
        "SELECT log_id, raw AS raw_destination, FALSE AS router_degraded FROM q_route", "q_route"
    ),
)
def policy_in_use(spark, directory):
    """A fitted policy whose steps fit its observations routes by itself."""
    steps, q = fit_tabular(spark, directory)
    stated = steps.select("log_id", "state").join(tables.logs(spark, directory), "log_id")
    routed = qpolicy.route_or_degrade(stated, qpolicy.greedy_policy(q), True)
    return routed.select("log_id", "raw_destination", "router_degraded")


# ---- learned policy and embeddings ----------------------------------------
@query(
    "best_action",
    check(
        """SELECT log_id, destination AS best_destination FROM (SELECT log_id, destination, row_number() OVER
  (PARTITION BY log_id ORDER BY reward DESC, """
        + ACTION.format("destination")
        + ") AS r FROM rewarded) WHERE r = 1",
        "rewarded",
    ),
)
def best_action(spark, directory):
    rewarded = choices.rewards(
        tables.logs(spark, directory), tables.observations(spark, directory)
    )
    return choices.best_action(rewarded)


def observed_logs(spark, directory, dim=32):
    """Logs with the vector of system state and content, stored once."""
    logs = tables.logs(spark, directory).select(
        "log_id", "Node", "ts", "Content", routing.static_destination().alias("desired")
    )
    encoder = embedding.hashed_words(dim)
    content = F.col("Content")
    texts = cut_lineage(embedding.embed_texts(logs, content, NAMESPACE, encoder))
    embedded = embedding.attach_embeddings(logs, content, NAMESPACE, texts)
    return cut_lineage(
        system_state(spark, directory, embedded.drop("Content", "key")).select(
            "log_id",
            "Node",
            "ts",
            "desired",
            states.observation(SYSTEM, "embedding").alias("vector"),
        )
    )


def learned_decisions(observed, rewarded, max_iter):
    """Best-rewarded and predicted destination of every log."""
    labelled = observed.join(choices.best_action(rewarded), "log_id")
    scaler = states.fit_scaler(observed, "vector", floor=True)
    scaled = cut_lineage(
        labelled.select("log_id", "best_destination", scaler.apply(F.col("vector")).alias("vector"))
    )
    model = learned.fit_classifier(scaled, "vector", len(scaler.mean), max_iter=max_iter)
    return learned.route_learned(scaled, F.col("vector"), model)


@query("mlp_policy")
def mlp_policy(spark, directory):
    """Confusion of the learned policy with the best-rewarded destination."""
    rewarded = choices.rewards(
        tables.logs(spark, directory), tables.observations(spark, directory)
    )
    routed = learned_decisions(observed_logs(spark, directory), rewarded, 20)
    return routed.groupBy("best_destination", "raw_destination").agg(F.count("*").alias("logs"))


@query("tabular_policy")
def tabular_policy(spark, directory):
    """Destinations of the policy fitted on projected observations."""
    observed = observed_logs(spark, directory)
    rewarded = choices.rewards(
        tables.logs(spark, directory), tables.observations(spark, directory)
    )
    policy = tabular.fit_policy(observed, "vector", rewarded, components=3, n_bins=4)
    routed = policy.steps.apply(observed, "vector").withColumnRenamed("desired", "teacher")
    return q_decisions(routed, policy.q)


KEYED = rf"""SELECT doc_id, sha1('{NAMESPACE}' || chr(10) || t) AS key, lower(t) AS t FROM (SELECT doc_id,
  trim(regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g')) AS t FROM documents)"""


def embedding_cache(spark, directory, dim=32):
    """Vectors of the labelled documents, as a cache left by an earlier run."""
    documents = tables.table(spark, directory, "documents")
    labelled = documents.join(
        tables.table(spark, directory, "labels").select("doc_id"), "doc_id", "left_semi"
    )
    return cut_lineage(
        embedding.embed_texts(labelled, F.col("text"), NAMESPACE, embedding.hashed_words(dim))
    )


@query(
    "embedding_misses",
    f"""WITH k AS ({KEYED}) SELECT DISTINCT key FROM k WHERE key NOT IN
  (SELECT k.key FROM k JOIN labels USING (doc_id))""",
)
def embedding_misses(spark, directory):
    documents = tables.table(spark, directory, "documents")
    texts = embedding.distinct_texts(documents, F.col("text"), NAMESPACE)
    labelled = documents.join(
        tables.table(spark, directory, "labels").select("doc_id"), "doc_id", "left_semi"
    )
    cache = embedding.distinct_texts(labelled, F.col("text"), NAMESPACE)
    return embedding.missing(texts, cache).select("key")


@query(
    "embed",
    f"""WITH k AS (SELECT DISTINCT key, t FROM ({KEYED})),
w AS (SELECT key, unnest(string_split(t, ' ')) AS word FROM k WHERE t <> ''),
n AS (SELECT key, count(*) AS words FROM w GROUP BY key)
SELECT w.key, ('0x' || substr(md5(word), 1, 8))::BIGINT % 32 AS dim,
  (round(CAST(count(*) / any_value(n.words) AS FLOAT)::DOUBLE + 1e-8, 6) + 0e0) AS weight
FROM w JOIN n ON w.key = n.key GROUP BY 1, 2""",
)
def embed(spark, directory):
    """Non-zero weights of every distinct document, some from the cache."""
    documents = tables.table(spark, directory, "documents")
    vectors_by_key = embedding.embed_texts(
        documents,
        F.col("text"),
        NAMESPACE,
        embedding.hashed_words(32),
        embedding_cache(spark, directory),
    )
    weights = vectors_by_key.select("key", F.posexplode(states.doubles("embedding")))
    return rounded(
        weights.where("col <> 0").select(
            "key", F.col("pos").cast("long").alias("dim"), F.col("col").alias("weight")
        )
    )


@query(
    "attach_embeddings",
    f"""WITH k AS ({KEYED}) SELECT doc_id, key, t <> '' AS has_words FROM k""",
)
def attach_embeddings(spark, directory):
    """Every document with its vector; whether any weight is set."""
    documents = tables.table(spark, directory, "documents").select("doc_id", "text")
    text = F.col("text")
    encoded = embedding.embed_texts(documents, text, NAMESPACE, embedding.hashed_words(32))
    joined = embedding.attach_embeddings(documents, text, NAMESPACE, encoded)
    return joined.select(
        "doc_id", "key", (F.array_max("embedding") > 0).alias("has_words")
    )


# ---- reward histories ------------------------------------------------------
HISTORY = """SELECT event_type AS run, CAST(floor(epoch_us(ts) / 1e6 / 3600) AS BIGINT) AS episode,
  round(sum(value), 4) AS reward FROM events GROUP BY 1, 2"""
MOVING = f"""SELECT run, episode, reward, step, CASE WHEN step >= 20 THEN a END AS moving_avg FROM (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY episode) AS step, avg(reward) OVER
    (PARTITION BY run ORDER BY episode ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS a FROM ({HISTORY}))"""


@query(
    "reward_moving_avg",
    f"SELECT run, episode, (round(reward + 1e-8, 6) + 0e0) AS reward, step, (round(moving_avg + 1e-8, 6) + 0e0) AS moving_avg FROM ({MOVING})",
)
def reward_moving_avg(spark, directory):
    return rounded(rewards.moving_average(tables.reward_history(spark, directory)))


@query(
    "plateau_events",
    f"""WITH a AS (SELECT *, max(moving_avg) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
  FROM ({MOVING}) WHERE moving_avg IS NOT NULL AND step >= 10),
b AS (SELECT *, best IS NULL OR moving_avg > best + 1e-6 AS better FROM a),
c AS (SELECT *, sum(better::INT) OVER (PARTITION BY run ORDER BY step) AS island FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY step) AS stale FROM c WHERE NOT better),
e AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS cuts FROM d WHERE stale % 3 = 0)
SELECT run, step, episode, (round(moving_avg + 1e-8, 6) + 0e0) AS moving_avg, (round(greatest(0.05e0, pow(0.7e0, cuts)) + 1e-8, 6) + 0e0) AS epsilon
FROM e WHERE greatest(0.05e0, pow(0.7e0, cuts)) < greatest(0.05e0, pow(0.7e0, cuts - 1))""",
)
def plateau_events(spark, directory):
    return rounded(rewards.plateau_events(tables.reward_history(spark, directory)))


@query(
    "reward_stats",
    f"""SELECT run, count(*) AS episodes, (round(avg(reward) + 1e-8, 6) + 0e0) AS reward_mean, (round(median(reward) + 1e-8, 6) + 0e0) AS reward_median,
  (round(stddev_pop(reward) + 1e-8, 6) + 0e0) AS reward_std, (round(min(reward) + 1e-8, 6) + 0e0) AS reward_min, (round(max(reward) + 1e-8, 6) + 0e0) AS reward_max
FROM ({HISTORY}) GROUP BY run""",
)
def reward_stats(spark, directory):
    return rounded(rewards.reward_stats(tables.reward_history(spark, directory)))
