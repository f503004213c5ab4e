"""Bounded-space online best-fit packing of token pieces into sequences.

A document's tokens stay together unless they exceed a sequence; then they are
cut into whole sequences, and the first piece takes what is over.  Pieces
are dealt by hash to groups of counted size, and every group packs its pieces
in one pass, longest first.  At most ``OPEN_BINS`` sequences are open; a bitset
has a bit for every amount of free space that some open sequence has, so the
fullest one with room is found by shifting.  When a new one is needed and all
are open, the fullest closes.

Only lengths move; a group holds lengths of a bounded number of tokens, so
memory does not grow with the input, and the share of unfilled last sequences
does not either.

Defined results: a null or empty text is one piece with the end id alone;
repeated rows are packed one by one; an empty table gives no rows; other
columns are not read.  Null ids are allowed and kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm.columnar import chunks, give_back, spread, table
from tierflow.llm.encoding import ENCODED_BYTES, encoder
from tierflow.llm.tables import pieces_for
from tierflow.runtime import cut_lineage

SEQUENCE = 2048
OPEN_BINS = 4096
# Tokens one group packs.
GROUP_TOKENS = 1 << 25
# Sequences of a group are numbered below this.
GROUP_NUMBERS = 1 << 32

_FIELDS = [
    ("doc_id", pa.int64()),
    ("piece", pa.int32()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
]


def cut_lengths(tokens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of every piece; only the first may be shorter."""
    pieces = np.maximum(1, -(-tokens // size))
    rows = np.repeat(np.arange(len(tokens)), pieces)
    number = spread(np.zeros(len(tokens), np.int64), pieces)
    first = tokens - (pieces - 1) * size
    start = np.where(number == 0, 0, first[rows] + (number - 1) * size)
    length = np.where(number == 0, first[rows], size)
    return rows, start, length


def token_pieces(
    docs: DataFrame,
    path: str,
    end: int,
    id_col: str = "doc_id",
    text: str = "text",
    size: int = SEQUENCE,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of every document's tokens; with their ids if asked for."""
    fields = [*_FIELDS, ("ids", pa.list_(pa.int32()))] if with_ids else _FIELDS
    schema = pa.schema(fields)

    def work(batches):
        for batch in chunks(batches, "text", ENCODED_BYTES):
            ids, bounds = encoder(path).encode(batch.column("text"), end)
            rows, start, length = cut_lengths(np.diff(bounds), size)
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            at = bounds[:-1][rows] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(rows)),
                "piece": np.arange(len(rows)) - first[rows],
                "start": start,
                "length": length,
                "ids_crc32": [
                    zlib.crc32(raw[4 * a : 4 * (a + n)])
                    for a, n in zip(at.tolist(), length.tolist(), strict=True)
                ],
            }
            if with_ids:
                ends = np.concatenate([at, [len(ids)]]).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))
            yield table(schema, **columns)
        give_back()

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text].alias("text")
    ).mapInArrow(work, ddl + ", ids array<int>" * with_ids)


def best_fit(
    lengths: Iterable[int], size: int = SEQUENCE, open_bins: int = OPEN_BINS
) -> Iterator[tuple[int, int]]:
    """(sequence, offset) for every length, in the order they come."""
    free_bits = 0  # bit f: an open sequence has f tokens free
    bins: dict[int, list[int]] = {}
    open_now = made = 0
    for length in lengths:
        fitting = free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            stack = bins[free]
            number = stack.pop()
            if not stack:
                free_bits &= ~(1 << free)
            open_now -= 1
        else:
            if open_now >= open_bins:
                least = (free_bits & -free_bits).bit_length() - 1
                bins[least].pop()
                if not bins[least]:
                    free_bits &= ~(1 << least)
                open_now -= 1
            number, free = made, size
            made += 1
        yield number, size - free
        left = free - length
        if left:
            bins.setdefault(left, []).append(number)
            free_bits |= 1 << left
            open_now += 1


def pack(
    pieces: DataFrame,
    size: int = SEQUENCE,
    open_bins: int = OPEN_BINS,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    stored = cut_lineage(pieces)
    total = stored.agg(F.sum("length")).first()[0]
    groups = pieces_for(total, group_tokens)
    names = [n for n, _ in pieces.dtypes]
    dealt = stored.withColumn(
        "__group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups))
    )

    def work(group: pa.Table) -> pa.Table:
        number = group.column("__group")[0].as_py() * GROUP_NUMBERS
        group = group.drop_columns("__group").sort_by(
            [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]
        )
        placed = np.array(
            list(best_fit(group.column("length").to_pylist(), size, open_bins)), np.int64
        )
        group = group.append_column("sequence_id", pa.array(placed[:, 0] + number))
        return group.append_column("offset", pa.array(placed[:, 1]))

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return (
        dealt.groupBy("__group")
        .applyInArrow(work, schema + ", sequence_id long, offset long")
        .select(*names, "sequence_id", "offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence with its ids; needs pieces with ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids")
    )
