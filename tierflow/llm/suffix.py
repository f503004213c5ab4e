"""Repeated 50-byte strings removed, found in a distributed sparse suffix array.

Which suffixes are sorted.  A position is an anchor if the hash of its 24 bytes
is the least among the 27 such hashes of some 50-byte string.  Anchors depend
on content alone, so two equal 50-byte strings hold the same anchor at the same
place; it is enough to sort the suffixes that start at anchors, about one
position in fourteen, and of these only the ones whose 24 bytes occur in
another document as well.

How they are sorted.  Documents are dealt to blocks by a hash of their id.  A
block sorts the suffixes of its anchors (50 bytes each, with the 26 bytes
before), drops all but the smallest document of those with equal surroundings,
and sends them as front-coded runs: the bytes each suffix shares with the one
before are counted, not sent.  Runs meet by a hash of their first 24 bytes.  A
loser tree merges the runs of a bucket; a suffix that lost a match remembers
how many bytes it shares with the winner, and only bytes after those are ever
compared.  The merge yields the order and the common prefixes of neighbours.

What is removed.  Strings that start o bytes before an anchor are equal if the
suffixes share 50 - o bytes and the o bytes before are equal.  For every o the
classes of equal strings are read off the common prefixes and the order of the
bytes before; all members but those of the smallest document are spans to
remove.  Spans go back to their blocks, where bytes are removed.

Copies of a whole text are told by an MD5 first: every byte of a copy of at
least 50 bytes is covered by strings of the smallest document with that text.

Defined results: null and empty texts have no bytes and nothing is removed;
rows with a null id neither lose bytes nor cause a removal; rows that repeat an
id do not remove each other's bytes, and each is a copy or not by its own text;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm.columnar import chunks, freed, mixed, spread, table, text_bytes
from tierflow.llm.tables import pieces_for, text_size

LENGTH = 50
GRAM = 24
BEFORE = LENGTH - GRAM
# Text of a block, and text whose anchors one bucket sorts.
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 32 << 20
# Suffixes whose bytes are gathered at once.
STRETCH = 1 << 14
# Positions that are hashed at once; each takes about 30 bytes meanwhile.
HASHED = 1 << 20

_PRIME = [np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


# ---- anchors ----


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over every run of ``width`` values."""
    out, have = values, 1
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = pick(out[:-rest], out[rest:])
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors in the joined texts, and the hash of their bytes."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # Strings that cross the end of a text count for nothing.
    valid = np.ones(n, bool)
    inner = offsets[1:-1]
    if len(inner):
        first = np.maximum(np.concatenate([[0], inner[:-1]]), inner - LENGTH + 1)
        crossing = spread(first, np.maximum(inner - first, 0))
        valid[crossing[crossing < n]] = False
    found = []
    # A position hangs on the strings it can stand in, so on the bytes around it.
    for start in range(0, len(data) - GRAM + 1, HASHED):
        low, high = max(0, start - BEFORE), start + HASHED + LENGTH - 1
        at, h = _anchors(data[low:high], valid[low : high - LENGTH + 1])
        own = slice(*np.searchsorted(at, [start - low, start - low + HASHED]))
        found.append((at[own] + low, h[own]))
    at, h = zip(*found, strict=True)
    return np.concatenate(at), np.concatenate(h)


def _anchors(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the strings of a stretch, told of each if it counts."""
    words = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))
    grams = len(data) - GRAM + 1
    h = words[:grams] * _PRIME[0]
    h ^= h >> np.uint64(29)
    h += words[8 : grams + 8] * _PRIME[1]
    h *= _PRIME[2]
    h ^= h >> np.uint64(32)
    h += words[16 : grams + 16]
    h *= _PRIME[0]
    h ^= h >> np.uint64(29)
    h *= _PRIME[1]
    order = (h >> np.uint64(32)).astype(np.uint32)
    least = _sliding(order, BEFORE + 1, np.minimum)
    least = np.where(valid, least, 0)
    edge = np.zeros(BEFORE, np.uint32)
    most = _sliding(np.concatenate([edge, least, edge]), BEFORE + 1, np.maximum)
    # A hash of 0 would meet the mark of crossing strings; that string is rare
    # and then the position is an anchor more, which does no harm.
    at = np.flatnonzero(most[:grams] == order)
    return at, mixed(h[at])


class Block:
    """The documents of a block in a fixed order, and their anchors."""

    def __init__(self, docs: pa.Table, copies: set[tuple[int, int]], with_anchors: bool = True):
        docs = docs.sort_by([("doc_id", "ascending"), ("h", "ascending")]).combine_chunks()
        self.docs = docs
        ids = docs.column("doc_id")
        self.known = ids.is_valid().to_numpy()
        self.ids = ids.fill_null(-1).to_numpy()
        text = docs.column("text")
        self.data, self.offsets = text_bytes(text)
        # Rows that repeat an id may have different texts: a copy is an id and a text.
        pairs = zip(self.ids.tolist(), docs.column("h").to_pylist(), strict=True)
        self.copy = np.fromiter((p in copies for p in pairs), bool, len(self.ids)) & self.known
        if not with_anchors:
            return
        at, h = anchors(self.data, self.offsets)
        doc = np.searchsorted(self.offsets, at, side="right") - 1
        use = (self.known & ~self.copy)[doc]
        self.at, self.hash, self.doc = at[use], h[use], doc[use]


def repeated_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a block, the last bit set if two documents have it."""
    order = np.lexsort((block.ids[block.doc], block.hash))
    h, ids = block.hash[order] & ~np.uint64(1), block.ids[block.doc][order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    other = np.zeros(len(h), np.uint64)
    other[1:] = ~new[1:] & (ids[1:] != ids[:-1])
    starts = np.flatnonzero(new)
    if not len(starts):
        return h, h
    return h[starts], np.maximum.reduceat(other, starts)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, positions of its rows in their order)."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return [
        (int(bucket[order[a]]), order[a:b])
        for a, b in zip(starts, [*starts[1:], len(order)], strict=True)
    ]


# ---- runs ----


def windows(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, step: int = 1):
    """Bytes from each start on, in either direction, zero beyond the lengths."""
    out = np.zeros((len(starts), width), np.uint8)
    # In stretches: the places take eight times the memory of the bytes.
    for a in range(0, len(starts), STRETCH):
        at = starts[a : a + STRETCH, None] + step * np.arange(width)
        inside = np.arange(width) < lengths[a : a + STRETCH, None]
        out[a : a + STRETCH] = np.where(inside, data[np.where(inside, at, 0)], 0)
    return out


def row_order(*matrices: np.ndarray) -> np.ndarray:
    """Order of the rows of bytes, the first matrix first."""
    keys = []
    for m in matrices:
        width = -(-m.shape[1] // 8) * 8
        padded = np.zeros((len(m), width), np.uint8)
        padded[:, : m.shape[1]] = m
        words = padded.view(">u8").astype(np.uint64)
        keys += [words[:, k] for k in range(words.shape[1])]
    return np.lexsort(keys[::-1])


def shared(rows: np.ndarray) -> np.ndarray:
    """Bytes each row shares with the one before; none for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


RUN = pa.schema(
    [
        ("bucket", pa.int64()),
        ("block", pa.int64()),
        ("spans", pa.bool_()),
        ("n", pa.int64()),
        ("shared", pa.binary()),
        ("rest", pa.binary()),
        ("before", pa.binary()),
        ("room", pa.binary()),
        ("ids", pa.binary()),
        ("doc", pa.binary()),
        ("at", pa.binary()),
        ("stop", pa.binary()),
    ]
)
RUN_DDL = (
    "bucket long, block long, spans boolean, n long, shared binary, rest binary, "
    "before binary, room binary, ids binary, doc binary, at binary, stop binary"
)


def _row(**values) -> dict:
    return {f.name: None for f in RUN} | values


def span_row(block: int, bucket: int, doc: np.ndarray, at: np.ndarray, stop: np.ndarray) -> dict:
    """Bytes ``at`` to ``stop`` of documents, by their number in the block."""
    return _row(
        bucket=bucket,
        block=block,
        spans=True,
        n=len(doc),
        doc=doc.astype("<i4").tobytes(),
        at=at.astype("<i8").tobytes(),
        stop=stop.astype("<i8").tobytes(),
    )


def make_runs(block: Block, number: int, hashes: np.ndarray, buckets: int) -> list[dict]:
    """Front-coded sorted runs of a block's repeated anchors, and the spans
    that the block can tell by itself."""
    if not len(hashes) or not len(block.at):
        return []
    where = np.minimum(np.searchsorted(hashes, block.hash & ~np.uint64(1)), len(hashes) - 1)
    use = hashes[where] == block.hash & ~np.uint64(1)
    at, doc, h = block.at[use], block.doc[use], block.hash[use]
    start, end = block.offsets[doc], block.offsets[doc + 1]
    left, right = np.minimum(BEFORE, at - start), np.minimum(LENGTH, end - at)
    fits = left + right >= LENGTH
    at, doc, h, start, left, right = (x[fits] for x in (at, doc, h, start, left, right))
    suffix = windows(block.data, at, right, LENGTH)
    before = windows(block.data, at - 1, left, BEFORE, -1)
    room = np.stack([left, right], axis=1).astype(np.uint8)
    ids = block.ids[doc]
    # Equal surroundings stand together, the smallest document first.
    order = row_order(suffix, np.concatenate([before, room], axis=1))
    both = np.concatenate([suffix, before, room], axis=1)[order]
    new = np.ones(len(order), bool)
    new[1:] = (both[1:] != both[:-1]).any(axis=1)
    group = np.cumsum(new) - 1
    if not len(order):
        return []
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[group]
    late = ids[order] > least
    out = []
    gone = order[late]
    if len(gone):
        place = at[gone] - start[gone]
        out.append(
            span_row(number, number % buckets, doc[gone], place - left[gone], place + right[gone])
        )
    kept = order[~late]
    for bucket, some in by_bucket(bucket_of(h[kept], buckets)):
        rows = kept[some]
        lead = shared(suffix[rows])
        tail = np.arange(LENGTH) >= lead[:, None]
        out.append(
            _row(
                bucket=bucket,
                block=number,
                spans=False,
                n=len(rows),
                shared=lead.astype(np.uint8).tobytes(),
                rest=suffix[rows][tail].tobytes(),
                before=before[rows].tobytes(),
                room=room[rows].tobytes(),
                ids=ids[rows].astype("<i8").tobytes(),
                doc=doc[rows].astype("<i4").tobytes(),
                at=(at[rows] - start[rows]).astype("<i8").tobytes(),
            )
        )
    return out


# ---- merge ----


def read_run(shared_: memoryview, rest: memoryview):
    """(bytes shared with the one before, suffix as a number) of a run."""
    value, at = 0, 0
    for lead in shared_:
        size = LENGTH - lead
        bits = 8 * size
        value = value >> bits << bits | int.from_bytes(rest[at : at + size], "big")
        at += size
        yield lead, value


def merge_runs(runs: list[tuple[memoryview, memoryview]]) -> tuple[np.ndarray, np.ndarray]:
    """Run numbers in merged order, and bytes shared with the one before.

    A loser tree over the heads of the runs.  ``know[i]`` is how much head i
    shares with the last winner.  The head that shares more is smaller; only
    of heads that share the same are the bytes after that compared, and the
    loser then remembers what it shares with the winner.
    """
    count = len(runs)
    size = 1 << max(0, (count - 1).bit_length())
    readers = [read_run(*r) for r in runs]
    # An empty place is past every suffix and shares nothing.
    past = 1 << (8 * LENGTH)
    head, know = [past] * size, [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        if know[a] != know[b]:
            return (a, b) if know[a] > know[b] else (b, a)
        if know[a] < 0:
            return a, b
        x, y = head[a], head[b]
        same = LENGTH - ((x ^ y).bit_length() + 7 >> 3)
        if x <= y:
            know[b] = same
            return a, b
        know[a] = same
        return b, a

    for i, reader in enumerate(readers):
        first = next(reader, None)
        if first:
            know[i], head[i] = 0, first[1]
    losers = [0] * size
    round_ = list(range(size))
    node = size
    while len(round_) > 1:
        node //= 2
        winners = []
        for k in range(0, len(round_), 2):
            best, worse = play(round_[k], round_[k + 1])
            losers[node + k // 2] = worse
            winners.append(best)
        round_ = winners
    best = round_[0]
    order, common = array("i"), array("B")
    while know[best] >= 0:
        order.append(best)
        common.append(know[best])
        following = next(readers[best], None)
        if following is None:
            know[best], head[best] = -1, past
        else:
            know[best], head[best] = following
        node = (size + best) >> 1
        while node:
            other = losers[node]
            mine, theirs = know[best], know[other]
            if theirs > mine:
                losers[node], best = best, other
            elif theirs == mine and mine >= 0:
                winner, loser = play(best, other)
                losers[node], best = loser, winner
            node >>= 1
    return np.frombuffer(order, np.int32), np.frombuffer(common, np.uint8)


def _parts(column: pa.ChunkedArray) -> tuple[memoryview, np.ndarray]:
    """Bytes of all rows of a binary column, one after another, and their bounds."""
    whole = column.combine_chunks().cast(pa.large_binary())
    _, ends, data = whole.buffers()
    bounds = np.frombuffer(ends, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return memoryview(data or b""), bounds


def removed_spans(bucket: pa.Table) -> list[dict]:
    """Spans of a bucket's suffixes that a smaller document has as well."""
    is_span = bucket.column("spans")
    out = bucket.filter(is_span).to_pylist()
    runs = bucket.filter(pc.invert(is_span))
    if not runs.num_rows:
        return out
    # Columns are read where Arrow has them; a bucket may be large.
    (lead, lead_at), (rest, rest_at) = _parts(runs.column("shared")), _parts(runs.column("rest"))
    order, common = merge_runs(
        [
            (lead[lead_at[i] : lead_at[i + 1]], rest[rest_at[i] : rest_at[i + 1]])
            for i in range(runs.num_rows)
        ]
    )
    del lead, rest
    size = runs.column("n").to_numpy()
    # The k-th time a run wins is its k-th suffix.
    seat = np.empty(len(order), np.int64)
    seat[np.argsort(order, kind="stable")] = np.arange(len(order))

    def joined(name: str, kind: str, width: int = 1) -> np.ndarray:
        data, bounds = _parts(runs.column(name))
        flat = np.frombuffer(data[bounds[0] : bounds[-1]], kind)
        return (flat.reshape(-1, width) if width > 1 else flat)[seat]

    before, room = joined("before", "u1", BEFORE), joined("room", "u1", 2)
    ids, doc, at = joined("ids", "<i8"), joined("doc", "<i4"), joined("at", "<i8")
    block = np.repeat(runs.column("block").to_numpy(), size)[seat]
    del runs, seat, order
    n = len(common)
    by_left = row_order(before)
    left_shared = shared(before[by_left])
    low, high = np.full(n, LENGTH), np.full(n, -1)
    left_class = np.empty(n, np.int64)
    for o in range(BEFORE + 1):
        right_class = np.cumsum(common < LENGTH - o)
        left_class[by_left] = np.cumsum(left_shared < o) if o else 0
        fits = np.flatnonzero((room[:, 0] >= o) & (room[:, 1] >= LENGTH - o))
        if not len(fits):
            continue
        key = right_class[fits] * (n + 1) + left_class[fits]
        ranks = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[ranks], prepend=-1))
        sizes = np.diff(np.append(starts, len(ranks)))
        least = np.repeat(np.minimum.reduceat(ids[fits][ranks], starts), sizes)
        late = fits[ranks[ids[fits][ranks] > least]]
        low[late] = np.minimum(low[late], o)
        high[late] = o
    hit = np.flatnonzero(high >= 0)
    # Strings of one anchor overlap, so the first and last give one span.
    for _, some in by_bucket(block[hit]):
        rows_ = hit[some]
        out.append(
            span_row(
                int(block[rows_[0]]), 0, doc[rows_], at[rows_] - high[rows_], at[rows_] - low[rows_] + LENGTH
            )
        )
    return out


# ---- removal ----


def covered(block: Block, spans: list[dict]) -> np.ndarray:
    """Which bytes of the block are removed."""
    steps = np.zeros(len(block.data) + 1, np.int32)
    for row in spans:
        doc = np.frombuffer(row["doc"], "<i4")
        base = block.offsets[doc]
        np.add.at(steps, base + np.frombuffer(row["at"], "<i8"), 1)
        np.add.at(steps, base + np.frombuffer(row["stop"], "<i8"), -1)
    for i in np.flatnonzero(block.copy):
        a, b = block.offsets[i], block.offsets[i + 1]
        if b - a >= LENGTH:
            steps[a] += 1
            steps[b] -= 1
    return np.cumsum(steps, dtype=steps.dtype, out=steps)[:-1] > 0


def counted(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Marks before every bound."""
    sums = np.zeros(len(marks) + 1, np.int32 if len(marks) < 1 << 31 else np.int64)
    sums[1:] = marks
    return np.cumsum(sums, dtype=sums.dtype, out=sums)[bounds].astype(np.int64)


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=RUN)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    rewrite: bool = False,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    To rewrite, the rows of ``docs`` themselves, with the bytes that stay as
    text, less pieces of characters that were cut; see ``without_repeats``.
    """
    # Whole rows are dealt once, and every step reads that one exchange.
    others = [docs[c].alias(f"_{i}") for i, c in enumerate(docs.columns) if rewrite and c != text]
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text], F.lit("")).alias("text"),
        F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("h"),
        F.struct(docs[text].isNull().alias("none"), *others).alias("rest"),
    )
    total = rows.agg(F.sum(text_size(F.col("text")))).first()[0]
    blocks, buckets = pieces_for(total, block_bytes), pieces_for(total, bucket_bytes)
    # Rows that repeat an id part by text.
    block_of = F.pmod(F.xxhash64("doc_id", "h"), F.lit(blocks)).alias("block")
    dealt = rows.select(block_of, "doc_id", "h", "text", "rest")

    marks = rows.filter(F.col("doc_id").isNotNull()).select(
        "doc_id", "h", block_of, F.md5(F.col("text").cast("binary")).alias("m")
    )
    first = marks.groupBy("m").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    copies = marks.join(first.filter("n > 1"), "m").filter("doc_id > first")
    # What a block is told: ids and text hashes of its copies, later the repeated hashes.
    side_ddl = "bucket long, block long, copies array<long>, texts array<long>, hashes binary"
    copy_side = (
        copies.groupBy("block")
        .agg(F.collect_list(F.struct("doc_id", "h")).alias("pairs"))
        .select(
            F.lit(0).cast("long").alias("bucket"),
            "block",
            F.col("pairs.doc_id").alias("copies"),
            F.col("pairs.h").alias("texts"),
            F.lit(None).cast("binary").alias("hashes"),
        )
    )

    def copies_of(side: pa.Table) -> set[tuple[int, int]]:
        lists = zip(side.column("copies").to_pylist(), side.column("texts").to_pylist(), strict=True)
        return {pair for ids, texts in lists if ids for pair in zip(ids, texts, strict=True)}

    hash_schema = pa.schema(
        [
            ("bucket", pa.int64()),
            ("block", pa.int64()),
            ("copies", pa.list_(pa.int64())),
            ("texts", pa.list_(pa.int64())),
            ("hashes", pa.binary()),
        ]
    )

    def collect(docs_: pa.Table, side: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return hash_schema.empty_table()
        number = docs_.column("block")[0].as_py()
        h, many = repeated_hashes(Block(docs_, copies_of(side)))
        rows_ = [
            {"bucket": b, "block": number, "hashes": (h[some] | many[some]).tobytes()}
            for b, some in by_bucket(bucket_of(h, buckets))
        ]
        return pa.Table.from_pylist(rows_, schema=hash_schema)

    def meet(asked: pa.Table) -> pa.Table:
        rows_ = asked.select(["block", "hashes"]).to_pylist()
        h = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows_])
        block = np.repeat([r["block"] for r in rows_], [len(r["hashes"]) // 8 for r in rows_])
        many, h = h & np.uint64(1), h & ~np.uint64(1)
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.diff(h[order], prepend=~np.uint64(0)))
        sizes = np.diff(np.append(starts, len(order)))
        repeated = (sizes > 1) | (np.maximum.reduceat(many[order], starts) > 0)
        found = order[np.repeat(repeated, sizes)]
        bucket = asked.column("bucket")[0].as_py()
        answer = [
            {"bucket": bucket, "block": b, "hashes": np.sort(h[found[some]]).tobytes()}
            for b, some in by_bucket(block[found])
        ]
        return pa.Table.from_pylist(answer, schema=hash_schema)

    def sort_runs(docs_: pa.Table, side: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return RUN.empty_table()
        parts = [np.frombuffer(x, np.uint64) for x in side.column("hashes").to_pylist() if x]
        if not parts:
            return RUN.empty_table()
        hashes = np.sort(np.concatenate(parts))
        number = docs_.column("block")[0].as_py()
        return _table(make_runs(Block(docs_, copies_of(side)), number, hashes, buckets))

    def merge(rows_: pa.Table) -> pa.Table:
        return _table(removed_spans(rows_))

    result = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_bytes", pa.int64()),
            ("n_removed", pa.int64()),
            ("n_spans", pa.int64()),
            ("kept_sha256", pa.string()),
        ]
    )
    result_ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    names = docs.columns

    def rewritten(block: Block, removed: np.ndarray, kept: list[bytes]) -> pa.Table:
        """The rows of the block with shortened texts; rows that lost all of it go."""
        rest = block.docs.column("rest").combine_chunks()
        shorter = removed > 0
        words = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
        columns = []
        for i, name in enumerate(names):
            if name == text:
                columns.append(pc.if_else(rest.field("none"), pa.scalar(None, pa.string()), words))
            elif name == "n_chars":
                was = rest.field(f"_{i}")
                size = pc.utf8_length(words).cast(was.type)
                columns.append(pc.if_else(pa.array(shorter), size, was))
            else:
                columns.append(rest.field(f"_{i}"))
        stays = pa.array(~shorter | (pc.binary_length(words).to_numpy() > 0))
        return pa.Table.from_arrays(columns, names=names).filter(stays)

    def remove(docs_: pa.Table, side: pa.Table) -> pa.Table:
        # A side row names a block of documents, so no group is without them.
        block = Block(docs_, copies_of(side), with_anchors=False)
        gone = covered(block, [r for r in side.to_pylist() if r["spans"]])
        removed = counted(gone, block.offsets)
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        inner = block.offsets[1:-1]
        inner = inner[inner < len(gone)]
        starts[inner] = gone[inner]
        begun = counted(starts, block.offsets)
        stays = block.data[~gone]
        bounds = block.offsets - removed
        kept = [stays[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        if rewrite:
            return rewritten(block, np.diff(removed), kept)
        columns = {
            "doc_id": block.docs.column("doc_id"),
            "n_bytes": np.diff(block.offsets),
            "n_removed": np.diff(removed),
            "n_spans": np.diff(begun),
            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
        }
        return pa.Table.from_batches([table(result, **columns)])

    by_block = dealt.groupBy("block")
    hashes = by_block.cogroup(copy_side.groupBy("block")).applyInArrow(
        lambda docs_, side_: freed(collect(docs_, side_)), side_ddl
    )
    answers = hashes.groupBy("bucket").applyInArrow(lambda asked: freed(meet(asked)), side_ddl)
    side = copy_side.unionByName(answers)
    runs = by_block.cogroup(side.groupBy("block")).applyInArrow(
        lambda docs_, side_: freed(sort_runs(docs_, side_)), RUN_DDL
    )
    spans = runs.groupBy("bucket").applyInArrow(lambda rows_: freed(merge(rows_)), RUN_DDL)
    spans = spans.select(
        "block",
        "spans",
        "doc",
        "at",
        "stop",
        *[F.lit(None).cast("array<long>").alias(n) for n in ("copies", "texts")],
    )
    whole = copy_side.select(
        "block",
        F.lit(False).alias("spans"),
        *[F.lit(None).cast("binary").alias(n) for n in ("doc", "at", "stop")],
        "copies",
        "texts",
    )
    return by_block.cogroup(spans.unionByName(whole).groupBy("block")).applyInArrow(
        lambda docs_, side_: freed(remove(docs_, side_)), docs.schema if rewrite else result_ddl
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the shortened texts; rows of which nothing is left go.

    A row that had no text keeps it.  ``n_chars``, where the table has it, is
    counted anew.
    """
    return remove_repeats(docs, id_col, text, rewrite=True)
