"""Document fingerprints by consistent weighted sampling.

Terms are words, weighted by how often they occur.  For every term and sample
three variables are drawn from a hash of the term: r and c from Gamma(2, 1), b from
[0, 1).  With t = floor(ln w / r + b) the term's key is
ln c - r (t - b + 1), and the sample of a document is the (term, t) with the
smallest key.  Two documents agree in a sample with a probability equal to the
sum of minima over the sum of maxima of their weights, the generalised Jaccard
similarity.  A fingerprint is the row of samples, 16 bits each.

Defined results: null and empty texts have no words and share one fingerprint,
like any texts without words; equal texts have equal fingerprints; a likeness
with a text without words is 0, or 1 if both have none; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierflow.llm.columnar import chunks, mixed, table, text_bytes
from tierflow.llm.tables import pieces_for, text_size
from tierflow.runtime import cut_lineage

SAMPLES = 64
# Text that is worked on at once, and text of a block of ids.
CHUNK = 3 << 20
BLOCK_BYTES = 16 << 20
# Blocks are streamed and may grow; their bounds reach the driver and may not.
MOST_BLOCKS = 1 << 13
# Terms whose variables are drawn at once, and (text, term) rows compared at once.
BLOCK_TERMS = 1 << 10
BLOCK_ROWS = 1 << 14

LOWEST = -(1 << 63)

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the first word's position of each row."""
    data, offsets = text_bytes(column)
    blank = np.ones(len(data) + 1, bool)
    blank[:-1] = _BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = ~blank
    starts[1:] &= blank[:-1] | edge[1:]
    starts = np.flatnonzero(starts)
    ends = blank.copy()
    ends[1:] |= edge[1:]
    ends[0] = False
    ends[1:] &= ~blank[:-1]
    ends = np.flatnonzero(ends)
    return hashed_runs(data, starts, ends), np.searchsorted(starts, offsets)


def hashed_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, eight bytes a step."""
    lengths = ends - starts
    out = mixed(lengths.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    left = np.arange(len(starts))
    step = 0
    while len(left):
        rest = lengths[left] - step
        part = words[starts[left] + step]
        short = np.minimum(rest, 8).astype(np.uint64)
        part = part & (~np.uint64(0) >> ((np.uint64(8) - short) * np.uint64(8)))
        out[left] = mixed(out[left] * np.uint64(0x9E3779B97F4A7C15) ^ part)
        step += 8
        left = left[rest > 8]
    return out


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of all texts, ordered by row and term."""
    term, first = word_hashes(column)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((term, rows))
    rows, term = rows[order], term[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return rows[at], term[at], np.diff(np.append(at, len(rows)))


def _uniform(seed: np.ndarray) -> np.ndarray:
    """In (0, 1], from the top bits of a mixed hash."""
    return ((seed >> np.uint64(40)).astype(np.float32) + np.float32(1)) * np.float32(2.0**-24)


def _keys(term: np.ndarray, weight: np.ndarray, samples: int) -> np.ndarray:
    """Key and name of every (term, weight) for every sample, one number each.

    The upper half orders like the key, the lower half names (term, t).
    """
    base = term[:, None] + np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(
        0xA0761D6478BD642F
    )
    h1 = mixed(base)
    h2 = h1 * np.uint64(0xE7037ED1A0B428DB)
    h2 ^= h2 >> np.uint64(29)
    h2 *= np.uint64(0x8EBC6AF09C88C6E3)
    low = np.uint64(24)
    r = -np.log(_uniform(h1) * _uniform(h1 << low))
    c = -np.log(_uniform(h2) * _uniform(h2 << low))
    b = _uniform((h1 ^ h2) * np.uint64(0x589965CC75374CC3)) - np.float32(2.0**-24)
    r = np.maximum(r, np.float32(1e-12))
    c = np.maximum(c, np.float32(1e-30))
    t = np.floor(np.log(weight.astype(np.float32))[:, None] / r + b)
    key = (np.log(c) - r * (t - b + np.float32(1))).astype(np.float32)
    bits = key.view(np.uint32)
    bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
    name = mixed(term)[:, None] + t.astype(np.int64).astype(np.uint64) * np.uint64(
        0x9E3779B97F4A7C15
    )
    name = name * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
    return bits << np.uint64(32) | name


def signatures(column: pa.Array, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Samples of every row (16 bits each), and whether the row has terms."""
    row, term, weight = _terms(column)
    out = np.zeros((len(column), samples), np.uint16)
    some = np.zeros(len(column), bool)
    if not len(row):
        return out, some
    pair = term * np.uint64(0x9E3779B97F4A7C15) + weight.astype(np.uint64)
    _, first, where = np.unique(pair, return_index=True, return_inverse=True)
    keys = np.empty((len(first), samples), np.uint64)
    for k in range(0, len(first), BLOCK_TERMS):
        at = first[k : k + BLOCK_TERMS]
        keys[k : k + BLOCK_TERMS] = _keys(term[at], weight[at], samples)
    best = np.full((len(column), samples), ~np.uint64(0))
    for a in range(0, len(row), BLOCK_ROWS):
        part = row[a : a + BLOCK_ROWS]
        begin = np.flatnonzero(np.diff(part, prepend=-1))
        least = np.minimum.reduceat(keys[where[a : a + BLOCK_ROWS]], begin, axis=0)
        owner = part[begin]
        best[owner] = np.minimum(best[owner], least)
    some[row] = True
    out[some] = (best[some] & np.uint64(0xFFFF)).astype(np.uint16)
    return out, some


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    equal = (a == b).mean(axis=1)
    return np.where(a_some & b_some, equal, (a_some == b_some).astype(float))


def fingerprinted(docs: DataFrame, text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """All columns of ``docs`` as struct ``row``, with its ``fingerprint``."""

    def work(batches):
        for batch in chunks(batches, "__text", CHUNK):
            marks, _ = signatures(batch.column("__text"), samples)
            yield batch.drop_columns("__text").append_column(
                "fingerprint", pa.array([m.tobytes().hex() for m in marks], pa.string())
            )

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias("__text"))
    return rows.mapInArrow(work, f"row {rows.dtypes[0][1]}, fingerprint string")


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows with the block of their id, and the blocks in order.

    Blocks are ranges of ids; their bounds are approximate quantiles, so they
    are few and of like size.  Null ids come first.
    """
    total, some = docs.agg(F.sum(text_size(F.col("text"))), F.count("doc_id")).first()
    n = min(pieces_for(total, block_bytes), MOST_BLOCKS)
    key = F.coalesce(F.col("doc_id"), F.lit(LOWEST)).cast("double")
    cuts = []
    if n > 1 and some:
        cuts = docs.select(key.alias("key")).approxQuantile(
            "key", [k / n for k in range(1, n)], 1 / (8 * n)
        )
    edges = sorted({c for c in cuts})
    if edges:
        cut = Bucketizer(splits=[-np.inf, *edges, np.inf], inputCol="key", outputCol="block")
        rows = cut.transform(docs.withColumn("key", key)).drop("key")
        rows = rows.withColumn("block", F.col("block").cast("long"))
    else:
        rows = docs.withColumn("block", F.lit(0).cast("long"))
    heads = rows.groupBy("block").agg(F.min(F.struct("at", "h")).alias("head"))
    order = Window.orderBy("block")
    first = F.first("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # One row per block: the last block is followed by the first one.
    follows = heads.select("block", "head", F.coalesce(F.lead("block").over(order), first).alias("next"))
    return rows, follows


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _compared(ids: list, texts: list[str], samples: int) -> pa.RecordBatch:
    """Every text but the last against its edited form and the one after it."""
    n = len(ids)
    edited = []
    for a, b in zip(texts[:-1], texts[1:], strict=True):
        half = len(a) // 2
        edited.append(a[: len(a) - half] + b[:half])
    marks, some = signatures(pa.array(texts + edited, pa.large_string()), samples)
    own, changed, following = slice(0, n), slice(n + 1, None), slice(1, n + 1)
    return table(
        RESULT,
        doc_id=pa.array(ids, pa.int64()),
        n_chars=[len(t) for t in texts[:-1]],
        edited_sha256=[hashlib.sha256(e.encode()).hexdigest() for e in edited],
        fingerprint=[m.tobytes().hex() for m in marks[own]],
        edited_fingerprint=[m.tobytes().hex() for m in marks[changed]],
        near_edited=likeness(marks[own], some[own], marks[changed], some[changed]),
        near_next=likeness(marks[own], some[own], marks[following], some[following]),
    )


def compare_edited(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", samples: int = SAMPLES
) -> DataFrame:
    """Fingerprints of every text and of its edited form, in order of ids.

    The edited form has the second half replaced by the start of the next
    text.  Rows stream through sorted blocks of ids; each block also gets the
    first text of the block that follows.
    """
    rows, follows = in_blocks(
        docs.select(
            docs[id_col].cast("long").alias("doc_id"),
            F.coalesce(docs[id_col].cast("long"), F.lit(LOWEST)).alias("at"),
            F.coalesce(docs[text], F.lit("")).alias("text"),
            F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("h"),
        )
    )
    follows = cut_lineage(follows)
    heads = follows.select("block", F.col("head.at").alias("at"), F.col("head.h").alias("h"))
    texts = rows.join(heads, ["block", "at", "h"], "left_semi").select("block", "text")
    texts = texts.groupBy("block").agg(F.first("text").alias("text"))
    tails = follows.select(F.col("block").alias("of"), F.col("next").alias("block")).join(texts, "block")
    tails = tails.select(
        F.col("of").alias("block"),
        F.lit(1).alias("tail"),
        F.lit(None).cast("long").alias("doc_id"),
        F.lit(0).cast("long").alias("at"),
        F.lit(0).cast("long").alias("h"),
        "text",
    )
    rows = rows.select("block", F.lit(0).alias("tail"), "doc_id", "at", "h", "text").union(tails)
    ordered = rows.repartition("block").sortWithinPartitions("block", "tail", "at", "h")

    def work(batches):
        ids: list = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for tail, doc_id, body in zip(
                batch.column("tail").to_pylist(),
                batch.column("doc_id").to_pylist(),
                batch.column("text").to_pylist(),
                strict=True,
            ):
                texts.append(body)
                size += len(body)
                if tail:
                    yield _compared(ids, texts, samples)
                    ids, texts, size = [], [], 0
                else:
                    if size > CHUNK and ids:
                        yield _compared(ids, texts, samples)
                        ids, texts, size = [], [body], len(body)
                    ids.append(doc_id)

    return ordered.mapInArrow(
        work,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
