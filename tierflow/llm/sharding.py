"""Histogram sort: shards of near equal bytes from exact counts.

Rows are ordered by a 64-bit hash of their text and then by id, so equal texts
stand together.  For every cut some candidate boundaries are probed by counting
the exact bytes below them in every partition; the interval that holds the cut
narrows until a boundary meets the tolerance or no row is left between its
ends.  While an interval spans several texts the probes stand between texts, so
a run of equal texts is cut only if it is larger than the tolerance.  Then the
rows move once, each to its bin of known size.

The counts that reach the driver have one row per probe, at most
``PROBES_A_PASS``.  A bin is a part of a shard; the place of a row is its rank
in the bin plus the rows of the shard's earlier bins, so no task sorts a whole
shard.

Defined results: a null text counts no bytes beyond the fixed ones; repeated
rows take places one after another; an empty table gives no rows; other columns
of the input are not read.  Null ids are ordered first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierflow.llm.tables import pieces_for, text_size
from tierflow.runtime import cut_lineage

ROW_BYTES = 16
PROBES_A_PASS = 1 << 15
# A boundary may miss its cut by this part of a shard.
TOLERANCE = 0.002
# Payload of a bin; its sorted rows hold keys only, some dozens of bytes each.
BIN_BYTES = 1 << 30

LOWEST = -(1 << 63)

Edge = tuple[int, int]


def _slots(edges: list[Edge], h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How many of the sorted edges are at or below each row."""
    keys = np.array([e[0] for e in edges], np.int64)
    docs = np.array([e[1] for e in edges], np.int64)
    first = np.searchsorted(keys, h, side="left")
    last = np.searchsorted(keys, h, side="right")
    out = last.copy()
    same = np.flatnonzero(first < last)
    for key in np.unique(h[same]):
        rows = same[h[same] == key]
        a, b = first[rows[0]], last[rows[0]]
        out[rows] = a + np.searchsorted(docs[a:b], doc[rows], side="right")
    return out


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _below(rows: DataFrame, edges: list[Edge]) -> dict[Edge, tuple[int, int]]:
    """Exact bytes and rows below every edge."""

    def count(batches):
        total = np.zeros((2, len(edges) + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                h, doc, size = _columns(batch, "h", "at", "size")
                slot = _slots(edges, h, doc)
                order = np.argsort(slot, kind="stable")
                ends = np.concatenate([[0], np.cumsum(size[order])])
                per = np.bincount(slot, minlength=len(edges) + 1)
                last = np.cumsum(per)
                total[0] += ends[last] - ends[last - per]
                total[1] += per
        seen = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(total[0][seen]), pa.array(total[1][seen])],
            ["slot", "bytes", "n"],
        )

    counted = (
        rows.select("h", "at", "size")
        .mapInArrow(count, "slot long, bytes long, n long")
        .groupBy("slot")
        .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        .collect()
    )
    per = np.zeros((2, len(edges) + 1), np.int64)
    for row in counted:
        per[0][row["slot"]], per[1][row["slot"]] = row["bytes"], row["n"]
    sums = np.cumsum(per, axis=1)
    return {e: (int(sums[0][i]), int(sums[1][i])) for i, e in enumerate(edges)}


def splitters(rows: DataFrame, targets: list[int], slack: int) -> list[Edge]:
    """For every target the edge (hash, id) that has nearly so many bytes below.

    ``rows`` has ``h``, ``at`` (the id, without nulls) and ``size``.
    """
    least, most, total, n = rows.agg(
        F.min("at"), F.max("at"), F.sum("size"), F.count("*")
    ).first()
    width = most - least + 1
    # One number orders (hash, id); its multiples of ``width`` start a hash.
    edge = lambda v: (v // width + LOWEST, v % width + least)
    end = (1 << 64) * width - 1
    low, high = [(0, 0, 0)] * len(targets), [(end, total, n)] * len(targets)
    done: list[int | None] = [None] * len(targets)
    while open_cuts := [i for i, d in enumerate(done) if d is None]:
        each = max(1, min(64, PROBES_A_PASS // len(open_cuts)))
        wanted: dict[int, list[int]] = {}
        for i in open_cuts:
            a, b = low[i][0], high[i][0]
            probes = {a + (b - a) * (k + 1) // (each + 1) for k in range(each)}
            if b - a > 2 * width:
                probes = {p - p % width if p - p % width > a else p for p in probes}
            wanted[i] = sorted(p for p in probes if a < p < b)
        below = _below(rows, sorted({edge(p) for ps in wanted.values() for p in ps}))
        for i, probes in wanted.items():
            points = [low[i], *[(p, *below[edge(p)]) for p in probes], high[i]]
            best = min(points, key=lambda x: (abs(x[1] - targets[i]), x[0]))
            low[i] = [x for x in points if x[1] <= targets[i]][-1]
            high[i] = [x for x in points if x[1] > targets[i]][0]
            if abs(best[1] - targets[i]) <= slack or high[i][2] - low[i][2] <= 1 or not probes:
                done[i] = best[0]
    return [edge(d) for d in done]


def shard_by_bytes(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text: str = "text",
    tolerance: float = TOLERANCE,
    bin_bytes: int = BIN_BYTES,
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row."""
    body = F.coalesce(docs[text], F.lit(""))
    narrow = cut_lineage(
        docs.select(
            docs[id_col].cast("long").alias("doc_id"),
            F.coalesce(docs[id_col].cast("long"), F.lit(LOWEST)).alias("at"),
            (text_size(docs[text]) + ROW_BYTES).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("h"),
        )
    )
    total = narrow.agg(F.sum("size")).first()[0] or 0
    per_shard = pieces_for(total / shards, bin_bytes)
    bins = shards * per_shard
    targets = [round(total * k / bins) for k in range(1, bins)]
    edges = sorted(splitters(narrow, targets, int(total / shards * tolerance))) if total else []

    def place(batches):
        for batch in batches:
            bin_ = _slots(edges, *_columns(batch, "h", "at"))
            yield batch.append_column("bin", pa.array(bin_, pa.int64()))

    schema = ", ".join(f"{n} {t}" for n, t in narrow.dtypes)
    placed = narrow.mapInArrow(place, schema + ", bin long")
    # The one exchange: both the ranks and the counts below use it.
    order = Window.partitionBy("bin").orderBy("h", "at")
    ranked = placed.withColumn("rank", F.row_number().over(order) - 1)
    shard = F.floor(F.col("bin") / per_shard).cast("int")
    counts = placed.groupBy("bin").agg(F.count("*").alias("n")).withColumn("shard", shard)
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "bin", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    return ranked.join(starts, "bin").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank")).alias("slot")
    )
