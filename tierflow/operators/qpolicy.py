"""Tabular policy fitted offline on measured transitions.

Every measured outcome of a log at a tier is a transition: the log's state, the
tier as action, the reward, and the state of the node's next log.  Accelerated
sweeps over the summed transitions run until the values stand still: the fixed
point of the table, independent of row order.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tierflow.operators.ordered import neighbour
from tierflow.operators.routing import action_code, action_destination, static_destination
from tierflow.runtime import cut_lineage
from tierflow.schemas import TIERS

# Defaults of the tabular policy.
GAMMA = 0.98
PRIOR_BONUS = 0.3
PCA_COMPONENTS = 8
N_BINS = 6

# How far values may be from the fixed point, and steps at most.
TOLERANCE = 1e-9
MAX_STEPS = 500
# Steps that are mixed, and mixed steps without a smaller change before plain ones.
MEMORY = 10
PATIENCE = 5
# Transitions of a block, and sweeps over a block in one step.
BLOCK_MOVES = 1_000_000
BLOCK_SWEEPS = 5_000


def next_states(steps: DataFrame) -> DataFrame:
    """Add the state of the next log of the same node; ``done`` if there is none.

    ``steps`` has ``Node, ts, log_id, state``.
    """
    paired = neighbour(steps, ["Node"], ["ts", "log_id"], ["state"], ahead=True)
    return paired.withColumn("done", F.col("next_state").isNull())


def transitions(steps: DataFrame, rewarded: DataFrame) -> DataFrame:
    """One transition for every log and tier: ``steps`` with ``action, reward``.

    ``rewarded`` has the reward of each log at each tier.
    """
    taken = rewarded.select("log_id", action_code(F.col("destination")).alias("action"), "reward")
    return next_states(steps).join(taken, "log_id")


def transition_counts(moves: DataFrame) -> DataFrame:
    """Transitions summed by state, action and next state: small and sweep-ready."""
    return moves.groupBy("state", "action", "next_state").agg(
        F.count("*").alias("n"), F.sum("reward").alias("sum_reward")
    )


def teacher_by_state(steps: DataFrame) -> DataFrame:
    """Most frequent static choice of each state, ties to the earlier tier."""
    counted = steps.groupBy("state", "teacher").agg(F.count("*").alias("n"))
    order = F.struct("n", (-action_code(F.col("teacher"))).alias("rank"))
    return counted.groupBy("state").agg(F.max_by("teacher", order).alias("teacher"))


def value_column(action: int) -> str:
    return f"q_{action}"


VALUES = tuple(value_column(a) for a in range(len(TIERS)))


def initial_q(teachers: DataFrame, prior_bonus: float = PRIOR_BONUS) -> DataFrame:
    """One row per state: zero per action, a bonus on the teacher's action."""
    taught = action_code(F.col("teacher"))
    return teachers.select(
        "state",
        *[F.when(taught == a, prior_bonus).otherwise(0.0).alias(v) for a, v in enumerate(VALUES)],
    )


def fit_q(
    counts: DataFrame,
    teachers: DataFrame,
    gamma: float = GAMMA,
    prior_bonus: float = PRIOR_BONUS,
    tolerance: float = TOLERANCE,
    max_steps: int = MAX_STEPS,
    policy_only: bool = False,
    block_moves: int = BLOCK_MOVES,
) -> DataFrame:
    """Table ``state, action, q`` at the fixed point.

    States are cut into blocks of a bounded number of transitions.  A step
    solves every block for itself, with the values of the states outside as
    they stand, and is one job.  Steps are combined by Anderson's method: the
    next values are the mix of the last few steps whose changes cancel best,
    from inner products that the job itself observes.  Mixes that do not lower
    the change are given up for plain steps from the best values, which always
    lower it.  A table of one block takes two steps, any other a few more.

    Solved values are at most the largest change times ``gamma / (1 - gamma)``
    away from the fixed point.  Steps end when that is within the tolerance, or,
    for the policy alone, below half the gap between the best and the second
    action of every state.  Values that do not settle raise an error.
    """
    moves, now = _moves_and_start(counts, teachers, prior_bonus, block_moves)
    factor = gamma / (1.0 - gamma)
    before, mix, depth = now, [], 0
    best, least, worse = now, float("inf"), 0
    for _ in range(max_steps):
        table, seen = _step(before, moves, gamma, mix, depth)
        change = seen["change"]
        enough = change is None or factor * change <= tolerance
        if enough or (policy_only and 2 * factor * change < seen["gap"]):
            return by_action(table)
        worse = 0 if change < least else worse + 1
        if change < least:
            best, least = table, change
        if worse >= PATIENCE:
            before, mix, depth, worse = best, [], 0, 0
            continue
        depth = min(depth + 1, MEMORY)
        before, mix = table, _mix(seen)
    raise RuntimeError(f"values still change by {change} after {max_steps} steps")


def _moves_and_start(
    counts: DataFrame, teachers: DataFrame, prior_bonus: float, block_moves: int
) -> tuple[DataFrame, DataFrame]:
    """Transitions with the actions side by side, and the first values of all states.

    Both have the block of the state.  Rewards and counts of a state do not
    change from step to step and stand with its values.
    """
    stored = cut_lineage(counts)
    each = range(len(TIERS))

    def of(action: int, column: str) -> Column:
        return F.sum(F.when(F.col("action") == action, F.col(column)))

    moves = cut_lineage(
        stored.filter("next_state IS NOT NULL")
        .groupBy("state", "next_state")
        .agg(*[F.coalesce(of(a, "n"), F.lit(0)).alias(f"_n{a}") for a in each])
    )
    blocks = max(1, -(-moves.count() // block_moves))
    # Rows of one state are in one range.
    moves = cut_lineage(
        moves.repartitionByRange(blocks, "state").withColumn("_block", F.spark_partition_id())
    )
    homes = moves.groupBy("state").agg(F.max("_block").alias("_block"))
    totals = stored.groupBy("state").agg(
        *[of(a, "n").alias(f"_n{a}") for a in each], *[of(a, "sum_reward").alias(f"_r{a}") for a in each]
    )
    prior = initial_q(teachers, prior_bonus)
    start = (
        prior.join(totals, "state", "left")
        .join(homes, "state", "left")
        .withColumns(
            {f"_p{a}": F.col(v) for a, v in enumerate(VALUES)}
            | {"_v": F.greatest(*VALUES), "_g": F.greatest(*VALUES)}
            | {"_block": F.coalesce("_block", F.lit(0))}
        )
    )
    return moves, cut_lineage(start)


def solve_block(states: pa.Table, moves: pa.Table, gamma: float) -> pa.Table:
    """Action values of a block's states, the values of other states held fixed.

    Sweeps over the block, mixed by Anderson's method, until they stand still as
    far as the numbers go.  An action never tried in a state keeps its prior.
    """
    each = range(len(TIERS))
    size = states.num_rows
    names = states.column("state")
    column = lambda t, c: t.column(c).to_numpy(zero_copy_only=False).astype(float)
    tried = np.nan_to_num(np.stack([column(states, f"_n{a}") for a in each]))
    reward = np.nan_to_num(np.stack([column(states, f"_r{a}") for a in each]))
    prior = np.stack([column(states, f"_p{a}") for a in each])
    at = pc.index_in(moves.column("state"), value_set=names).to_numpy(zero_copy_only=False)
    to = pc.index_in(moves.column("next_state"), value_set=names)
    inside = np.asarray(to.is_valid().combine_chunks())
    to = to.fill_null(0).to_numpy()
    n = np.stack([column(moves, f"_n{a}") for a in each])
    following = column(moves, "_next")

    def sums(rows: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(at[rows], n[a][rows] * value, size) for a in each])

    fixed = sums(~inside, following[~inside])
    inner = np.flatnonzero(inside)

    def swept(value: np.ndarray) -> np.ndarray:
        target = reward + gamma * (fixed + sums(inner, value[to[inner]]))
        return np.where(tried > 0, target / np.maximum(tried, 1), prior)

    value = column(states, "_v")
    past: list[tuple[np.ndarray, np.ndarray]] = []
    least, calm = np.inf, 0
    for _ in range(BLOCK_SWEEPS):
        q = swept(value)
        new = q.max(axis=0)
        change = new - value
        largest = np.abs(change).max(initial=0)
        # No smaller change for a while: what is left is rounding.
        calm = 0 if largest < 0.9 * least else calm + 1
        least = min(least, largest)
        if largest == 0 or (calm > MEMORY and largest <= 1e-13 * max(1.0, np.abs(new).max())):
            break
        past = [(change, new), *past[: 2 * MEMORY]]
        value = new
        if len(past) > 1 and calm <= 3 * MEMORY:
            f = np.stack([x[0] - y[0] for x, y in zip(past, past[1:])])
            g = np.stack([x[1] - y[1] for x, y in zip(past, past[1:])])
            value = new - _shares(f @ f.T, f @ change) @ g
        elif calm > 3 * MEMORY:
            past, calm = [], 0
    return pa.table({"state": names, **dict(zip(VALUES, q, strict=True))})


def _step(
    before: DataFrame, moves: DataFrame, gamma: float, mix: list[float], depth: int
) -> tuple[DataFrame, dict]:
    """All blocks solved once from mixed values, stored, and what was observed.

    ``_v`` are the values of a state before, ``_g`` after it; ``_df0, _dg0, ...``
    how changes and new values differed from step to step.
    """
    each = range(len(TIERS))
    mixed = F.col("_g")
    for i, part in enumerate(mix):
        mixed = mixed - F.lit(float(part)) * F.col(f"_dg{i}")
    older = range(min(depth, MEMORY) - 1) if depth > 1 else range(0)
    fixed = ["_block", "state", *[f"_{k}{a}" for k in "prn" for a in each]]
    values = before.select(
        *fixed,
        *[f"_d{k}{i}" for i in older for k in "fg"],
        mixed.alias("_v"),
        (F.col("_g") - F.col("_v")).alias("_f_was"),
        F.col("_g").alias("_g_was"),
    )
    following = values.select(F.col("state").alias("next_state"), F.col("_v").alias("_next"))
    asked = values.select(*fixed, "_v").groupBy("_block")
    around = moves.join(following, "next_state").groupBy("_block")
    solved = asked.cogroup(around).applyInArrow(
        lambda states, moved: solve_block(states, moved, gamma),
        "state string, " + ", ".join(f"{v} double" for v in VALUES),
    )
    swept = values.join(solved, "state").withColumn("_g", F.greatest(*VALUES))
    columns = {}
    if depth:
        columns = {
            "_df0": F.col("_g") - F.col("_v") - F.col("_f_was"),
            "_dg0": F.col("_g") - F.col("_g_was"),
        }
        columns |= {f"_d{k}{i + 1}": F.col(f"_d{k}{i}") for i in older for k in "fg"}
    result = swept.select(*fixed, *VALUES, "_v", "_g", *[c.alias(n) for n, c in columns.items()])
    differences = [F.col(f"_df{i}") for i in range(len(columns) // 2)]
    change = F.col("_g") - F.col("_v")
    ordered = F.sort_array(F.array(*VALUES), asc=False)
    measures = [
        F.max(F.abs(change)).alias("change"),
        F.min(ordered[0] - ordered[1]).alias("gap"),
        *[F.sum(d * change).alias(f"b{i}") for i, d in enumerate(differences)],
        *[
            F.sum(d * differences[j]).alias(f"a{i}_{j}")
            for i, d in enumerate(differences)
            for j in range(i + 1)
        ],
    ]
    observed = Observation()
    table = cut_lineage(result.observe(observed, *measures))
    return table, observed.get


def _shares(products: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Shares of the last differences that cancel a change best."""
    shares = np.zeros(len(targets))
    # Two equal changes differ by nothing, which cancels nothing.
    used = np.flatnonzero(np.diag(products) > 0)
    if not len(used):
        return shares
    # Differences shrink from step to step: solve for them at equal length.
    scale = np.sqrt(np.diag(products)[used])
    equal = products[np.ix_(used, used)] / np.outer(scale, scale)
    shares[used] = np.linalg.lstsq(equal, targets[used] / scale, rcond=1e-13)[0] / scale
    return shares if np.isfinite(shares).all() else np.zeros(len(targets))


def _mix(seen: dict) -> list[float]:
    """Shares of the differences that a step has observed."""
    size = sum(1 for k in seen if k.startswith("b"))
    if not size:
        return []
    a = np.array([[seen[f"a{max(i, j)}_{min(i, j)}"] for j in range(size)] for i in range(size)])
    return _shares(a, np.array([seen[f"b{i}"] for i in range(size)])).tolist()


def by_action(q: DataFrame) -> DataFrame:
    """One row per state and action."""
    return q.unpivot("state", list(VALUES), "_value", "q").select(
        "state", F.substring("_value", 3, 9).cast("int").alias("action"), "q"
    )


def greedy_policy(q: DataFrame) -> DataFrame:
    """Best action per state, ties to the lower code."""
    order = F.struct("q", (-F.col("action")).alias("rank"))
    return q.groupBy("state").agg(F.max_by("action", order).alias("action"))


def route_q(logs: DataFrame, policy: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Greedy action of a known state, the static rules for an unknown one.

    The policy has one row per state.  It is stored, so the planner broadcasts
    it if it is small.  ``fallback`` is the static choice where the rows carry
    it already.
    """
    unknown = static_destination() if fallback is None else fallback
    named = policy.select("state", action_destination(F.col("action")).alias("_learned"))
    return (
        logs.join(cut_lineage(named), "state", "left")
        .withColumn("raw_destination", F.coalesce("_learned", unknown))
        .drop("_learned")
    )


def unseen_states(states: DataFrame, q: DataFrame) -> DataFrame:
    """States without an entry in the table, with their number of logs."""
    counted = states.groupBy("state").agg(F.count("*").alias("logs"))
    return counted.join(q.select("state").distinct(), "state", "left_anti")


def route_or_degrade(logs: DataFrame, policy: DataFrame | None, usable: bool) -> DataFrame:
    """Policy route, or the static rules with ``router_degraded`` set."""
    if usable and policy is not None:
        return route_q(logs, policy).withColumn("router_degraded", F.lit(False))
    return logs.withColumn("raw_destination", static_destination()).withColumn(
        "router_degraded", F.lit(True)
    )
