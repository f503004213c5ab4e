"""Ordered operators that never put one whole key into one task.

A window over ``(key)`` alone sends every row of a hot key to a single task.
Each operator here first cuts the rows, ordered by key and order, into blocks
of about equal numbers of rows: ranges whose bounds come from the rows
themselves, whatever their spread.  It then windows over ``(key, block)`` and
carries what crosses a block edge through a table with one row per key and
block, in two levels, so that this table is never in one task either.
"""

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tierflow.operators.joins import join_keys
from tierflow.runtime import cut_lineage

# Rows of a block, as near as sampled bounds meet it.
BLOCK_ROWS = 500_000
# Every table is cut into so many blocks at least, so small and large ones take
# the same way.
LEAST_BLOCKS = 4
# Blocks whose edges are carried together.
FAN = 1_024


def blocked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | None = None
) -> DataFrame:
    """``df``, stored, with ``_block``: ranges of ``(keys, order)``.

    Rows that agree in all these columns share a block, so ``order`` should end
    in something that differs.  A table that has blocks keeps them.
    """
    if "_block" in df.columns:
        return df
    stored = cut_lineage(df)
    count = max(LEAST_BLOCKS, -(-stored.count() // (rows or BLOCK_ROWS)))
    ranged = stored.repartitionByRange(count, *keys, *order)
    return cut_lineage(ranged.withColumn("_block", F.spark_partition_id()))


def carried(edges: DataFrame, keys: Sequence[str], value: str, how: str) -> DataFrame:
    """Add ``_carried`` to a table with one row per key and block.

    ``before`` is the last value of earlier blocks that is not null, ``after``
    the first one of later blocks, ``sum`` the sum over earlier blocks.
    """
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    span = (1, last) if how == "after" else (first, -1)
    at = F.when(F.col(value).isNotNull(), F.col("_block"))
    pick, edge = {
        "before": (lambda c: F.last(c, ignorenulls=True), F.max_by(value, at)),
        "after": (lambda c: F.first(c, ignorenulls=True), F.min_by(value, at)),
        "sum": (F.sum, F.sum(value)),
    }[how]
    grouped = edges.withColumn("_group", F.floor(F.col("_block") / FAN))
    inside = Window.partitionBy(*keys, "_group").orderBy("_block").rowsBetween(*span)
    across = Window.partitionBy(*keys).orderBy("_group").rowsBetween(*span)
    groups = (
        grouped.groupBy(*keys, "_group")
        .agg(edge.alias("_edge"))
        .select(*keys, "_group", pick("_edge").over(across).alias("_far"))
    )
    near = grouped.withColumn("_near", pick(value).over(inside))
    found = (
        F.coalesce("_near", F.lit(0)) + F.coalesce("_far", F.lit(0))
        if how == "sum"
        else F.coalesce("_near", "_far")
    )
    joined = join_keys(near, groups, [*keys, "_group"])
    return joined.withColumn("_carried", found).drop("_group", "_near", "_far")


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    ahead: bool = False,
    prefix: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Add the previous (or next) row's ``values`` within ``keys``.

    The names get the prefix ``prev_`` or ``next_``.
    """
    prefix = prefix or ("next_" if ahead else "prev_")
    step = F.lead if ahead else F.lag
    edge = F.min_by if ahead else F.max_by
    payload = F.struct(*values)
    rows = blocked(df, keys, order, block_rows)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    edges = rows.groupBy(*keys, "_block").agg(edge(payload, F.struct(*order)).alias("_payload"))
    edges = carried(edges, keys, "_payload", "after" if ahead else "before").drop("_payload")
    near = F.coalesce("_near", "_carried")
    return join_keys(
        rows.withColumn("_near", step(payload).over(inside)), edges, [*keys, "_block"]
    ).select(*df.columns, *[near[v].alias(prefix + v) for v in values])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    block_rows: int | None = None,
) -> DataFrame:
    """Add sums over the key's rows up to and with each row."""
    rows = blocked(df, keys, order, block_rows)
    named = rows.withColumns({f"_{n}": c for n, c in sums.items()})
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    totals = named.groupBy(*keys, "_block").agg(*[F.sum(f"_{n}").alias(n) for n in sums])
    result = named.withColumns({f"_{n}": F.sum(f"_{n}").over(inside) for n in sums})
    for n in sums:
        edges = carried(totals.select(*keys, "_block", n), keys, n, "sum").drop(n)
        result = join_keys(result, edges.withColumnRenamed("_carried", f"_before_{n}"), [*keys, "_block"])
    return result.select(*df.columns, *[(F.col(f"_before_{n}") + F.col(f"_{n}")).alias(n) for n in sums])


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str = "position",
    block_rows: int | None = None,
) -> DataFrame:
    """Add the 1-based rank of each row within ``keys`` along ``order``.

    Also adds ``first_<order>``, the smallest order value of the key.
    """
    rows = blocked(df, keys, [order], block_rows)
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    counts = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_rows"))
    before = carried(counts, keys, "_rows", "sum").drop("_rows")
    lows = rows.groupBy(*keys).agg(F.min(order).alias(f"first_{order}"))
    ranked = rows.withColumn("_inside", F.row_number().over(inside))
    joined = join_keys(join_keys(ranked, before, [*keys, "_block"]), lows, keys)
    return joined.select(
        *df.columns, (F.col("_carried") + F.col("_inside")).alias(name), f"first_{order}"
    )


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    reach: int,
    measures: dict[str, Callable[[WindowSpec], Column]],
    chunk_rows: int = 100_000,
) -> DataFrame:
    """Add sliding aggregates that look back at most ``reach`` rows.

    Each measure gets the window of its chunk, in position order, and sets its
    own frame.  Rows are cut into chunks of ``chunk_rows`` positions; the last
    ``reach`` rows of a chunk are copied into the next one, so that every frame
    is complete inside its chunk.
    """
    chunk = Window.partitionBy(*keys, "_chunk").orderBy(position)
    return (
        chunked(df, position, reach, chunk_rows)
        .select("*", *[measure(chunk).alias(n) for n, measure in measures.items()])
        .where(F.col("_chunk") == F.col("_own"))
        .drop("_own", "_chunk")
    )


def chunked(df: DataFrame, position: str, reach: int, chunk_rows: int) -> DataFrame:
    """Add the chunk of a row, ``_own``, and each chunk that needs it, ``_chunk``."""
    if chunk_rows < reach:
        raise ValueError("a chunk must hold at least one frame")
    index = F.col(position) - 1
    own = F.floor(index / chunk_rows)
    near_end = index % chunk_rows >= chunk_rows - reach
    homes = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_own", own).withColumn("_chunk", F.explode(homes))


def rolling_medians(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    window: int,
    chunk_rows: int = 100_000,
) -> DataFrame:
    """``keys, position`` with the medians of the last ``window`` rows, ``now``,
    and of the ``window`` rows before these, ``before``.

    As ``rolling`` with the exact percentile, which sorts a frame anew for each
    row and each measure; here the frames of a chunk are halved by numpy, and
    the window before is the median of ``window`` rows ago.  Nulls do not count,
    NaN is above all numbers.
    """
    spread = chunked(
        df.select(*keys, position, F.col(value).cast("double").alias("_value")),
        position,
        2 * window - 1,
        chunk_rows,
    )
    names = [*keys, position]

    def medians(group: pa.Table) -> pa.Table:
        group = group.sort_by(position)
        column = group.column("_value")
        median, held = sliding_median(
            np.array(column.to_numpy(), np.float64), np.array(column.is_valid()), window
        )
        before = np.concatenate([np.full(window, np.nan), median])[: len(median)]
        held_before = np.concatenate([np.zeros(window, bool), held])[: len(median)]
        now = pa.array(median, pa.float64(), mask=~held)
        then = pa.array(before, pa.float64(), mask=~held_before)
        out = group.select(names).append_column("now", now).append_column("before", then)
        return out.filter(np.array(group.column("_own")) == np.array(group.column("_chunk")))

    doubles = [StructField(n, DoubleType()) for n in ("now", "before")]
    schema = StructType([*[StructField(n, df.schema[n].dataType) for n in names], *doubles])
    return spread.groupBy(*keys, "_chunk").applyInArrow(medians, schema)


def sliding_median(
    values: np.ndarray, held: np.ndarray, window: int, step: int = 4_096
) -> tuple[np.ndarray, np.ndarray]:
    """Median of the ``window`` values up to each one, and where there is any.

    Values that are not ``held`` are left out.
    """
    edge = window - 1
    padded = np.concatenate([np.full(edge, np.nan), np.where(held, values, np.nan)])
    ends = np.concatenate([np.zeros(window, np.int64), np.cumsum(held)])
    counts = ends[window:] - ends[: len(values)]
    out = np.empty(len(values))
    for a in range(0, len(values), step):
        n = counts[a : a + step]
        frames = np.lib.stride_tricks.sliding_window_view(padded[a : a + len(n) + edge], window)
        low, high = np.maximum(n - 1, 0) // 2, np.minimum(n // 2, edge)
        if (n == window).all():
            frames = np.partition(frames, (low[0], high[0]), axis=1)
        else:
            frames = np.sort(frames, axis=1)
        row = np.arange(len(n))
        left, right = frames[row, low], frames[row, high]
        out[a : a + len(n)] = np.where(left == right, left, 0.5 * left + 0.5 * right)
    return out, counts > 0


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    key: str,
    ts: str,
    values: Sequence[str],
    tie: str | None = None,
    before: Column | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Add the ``values`` of the latest right row at or before each left row.

    Both sides share the key and time column names.  Of right rows with equal
    time the one with the largest ``tie`` counts.  Left rows where ``before``
    holds look at strictly earlier rows only.  Rows without an earlier right
    row get nulls.
    """
    after = F.lit(1) if before is None else F.when(before, -1).otherwise(1)
    left_rows = left.select(
        key,
        ts,
        after.alias("_side"),
        F.xxhash64(*left.columns).cast("double").alias("_tie"),
        F.struct(*left.columns).alias("_row"),
    )
    rank = F.xxhash64(*values) if tie is None else F.col(tie)
    right_rows = right.select(
        key,
        ts,
        F.lit(0).alias("_side"),
        rank.cast("double").alias("_tie"),
        F.struct(*values).alias("_reading"),
    )
    order = [ts, "_side", "_tie"]
    both = blocked(
        left_rows.unionByName(right_rows, allowMissingColumns=True), [key], order, block_rows
    )
    inside = (
        Window.partitionBy(key, "_block")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    reading_order = F.when(F.col("_side") == 0, F.struct(ts, "_tie"))
    edges = both.groupBy(key, "_block").agg(F.max_by("_reading", reading_order).alias("_edge"))
    edges = carried(edges, [key], "_edge", "before").drop("_edge")
    found = F.coalesce("_near", "_carried")
    near = both.withColumn("_near", F.last("_reading", ignorenulls=True).over(inside))
    return join_keys(near.where("_side <> 0"), edges, [key, "_block"]).select(
        "_row.*", *[found[v].alias(v) for v in values]
    )
