"""Jaccard join of word n-grams through MinHash bands of a fixed depth.

Every text is the set of its runs of five words.  Texts with equal sets are one
class and only the smallest id of a class goes on.  A text has ``TREES`` bands
of MinHash values.  Two sets of similarity s share a band of d values with
probability s ** d; d is the deepest, up to ``LONGEST``, with which a pair at
the threshold shares some band with the wanted recall.  It is fixed by this
formula before data is read: unlike an LSH forest there are no sorted prefixes,
and nothing is shortened by what is found.

Texts that share a band are candidates.  No pairs are written: each text with
a band is tied to the smallest id with it, and the connected components of
these ties hold all candidate pairs.  Inside a component every pair is verified
on the exact sets.  A large component is dealt to blocks, and each task
verifies one pair of blocks as matrix products; it returns a tree of the links
and the number of links per text.  Links therefore are never lost by the size
of a group, and what a task holds is bounded.

Defined results: texts with fewer than five words are one run of all their
words; null and empty texts and texts without words have no link and are a
class of their own; rows that repeat an id are one document; a null id gets a
null class; an empty table gives no rows; other columns are not read.  Sets hold
64-bit hashes of the runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm.columnar import chunks, freed, give_back, mixed, table
from tierflow.llm.components import components
from tierflow.llm.fingerprints import word_hashes
from tierflow.llm.tables import pieces_for
from tierflow.runtime import cut_lineage

WORDS = 5
THRESHOLD = 0.8
TREES = 28
LONGEST = 16
RECALL = 0.999
# Texts of one side of a verification task.
BLOCK = 1024
# Columns of a matrix product.
COLUMNS = 4096
CHUNK = 8 << 20
# Runs hashed at once.
STRETCH = 1 << 16


def depth_for(
    threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, longest: int = LONGEST
) -> int:
    """The longest prefix with which a pair at the threshold is found often enough."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word runs of every row, and offsets between rows."""
    h, first = word_hashes(column)
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    run = np.zeros(len(h), np.uint64)
    # A short text is one run, told apart from longer ones by its length.
    length = np.minimum(n, words)[rows]
    place = np.arange(len(h)) - first[:-1][rows]
    starts = place <= (n[rows] - length)
    at = np.flatnonzero(starts)
    for k in range(words):
        use = length[at] > k
        part = at[use]
        run[part] = mixed(run[part] * np.uint64(0x9E3779B97F4A7C15) + h[part + k])
    owner, run = rows[at], run[at]
    order = np.lexsort((run, owner))
    owner, run = owner[order], run[order]
    new = np.ones(len(run), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (run[1:] != run[:-1])
    owner, run = owner[new], run[new]
    return run, np.searchsorted(owner, np.arange(len(n) + 1))


def _set_keys(run: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name a set."""
    one = np.concatenate([[np.uint64(0)], np.cumsum(mixed(run))])
    two = np.concatenate([[np.uint64(0)], np.cumsum(mixed(run ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    return (
        (one[bounds[1:]] - one[bounds[:-1]]).view(np.int64),
        (two[bounds[1:]] - two[bounds[:-1]]).view(np.int64),
    )


def min_hashes(run: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """``count`` MinHash values of every row; rows without runs get the maximum."""
    n = len(bounds) - 1
    out = np.full((n, count), 0xFFFFFFFF, np.uint32)
    odd = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    x = (run >> np.uint64(32)).astype(np.uint32) ^ run.astype(np.uint32)
    some = np.flatnonzero(np.diff(bounds) > 0)
    start = 0
    while start < len(some):
        stop = max(
            start + 1,
            int(np.searchsorted(bounds[some], bounds[some[start]] + STRETCH, side="right")) - 1,
        )
        rows = some[start:stop]
        a, b = bounds[rows[0]], bounds[rows[-1] + 1]
        part, begin = x[a:b], bounds[rows] - a
        for k in range(count):
            y = part * odd[2 * k]
            y ^= y >> np.uint32(15)
            y *= odd[2 * k + 1]
            y ^= y >> np.uint32(13)
            out[rows, k] = np.minimum.reduceat(y, begin)
        start = stop
    return out


_MARKS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("k1", pa.int64()),
        ("k2", pa.int64()),
        ("size", pa.int32()),
        ("prefixes", pa.list_(pa.int64())),
    ]
)


def marked(docs: DataFrame, words: int, trees: int, depth: int) -> DataFrame:
    """Set key, set size and a hash of every tree's prefix, for every row."""

    def work(batches):
        for batch in chunks(batches, "text", CHUNK):
            run, bounds = shingles(batch.column("text"), words)
            k1, k2 = _set_keys(run, bounds)
            values = min_hashes(run, bounds, trees * depth).reshape(-1, trees, depth)
            prefix = np.broadcast_to(
                mixed(np.arange(1, trees + 1, dtype=np.uint64)), values.shape[:2]
            ).copy()
            for k in range(depth):
                prefix = mixed(prefix * np.uint64(0x9E3779B97F4A7C15) + values[:, :, k])
            ends = np.arange(len(prefix) + 1, dtype=np.int32) * trees
            yield table(
                _MARKS,
                doc_id=batch.column("doc_id"),
                k1=k1,
                k2=k2,
                size=np.diff(bounds),
                prefixes=pa.ListArray.from_arrays(ends, pa.array(prefix.ravel().view(np.int64))),
            )
        give_back()

    return docs.mapInArrow(work, "doc_id long, k1 long, k2 long, size int, prefixes array<long>")


# ---- verification ----


def linked(
    left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float
) -> np.ndarray:
    """Which texts of two lists (or of one list) reach the threshold."""
    all_sets = left if right is None else left + right
    sizes = np.array([len(x) for x in all_sets], np.int64)
    runs, ids = np.unique(np.concatenate(all_sets), return_inverse=True)
    rows = np.repeat(np.arange(len(all_sets)), sizes)
    # A run that one text alone has is in no intersection.
    often = np.bincount(ids, minlength=len(runs))[ids] > 1
    rows, ids = rows[often], ids[often]
    _, ids = np.unique(ids, return_inverse=True)
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    n = len(left)
    m = n if right is None else len(right)
    common = np.zeros((n, m), np.float32)
    width = int(ids[-1]) + 1 if len(ids) else 0
    for a in range(0, width, COLUMNS):
        low, high = np.searchsorted(ids, [a, a + COLUMNS])
        part = np.zeros((len(all_sets), min(COLUMNS, width - a)), np.float32)
        part[rows[low:high], ids[low:high] - a] = 1
        common += part[:n] @ (part[:n] if right is None else part[n:]).T
    union = sizes[:n, None] + (sizes[None, :n] if right is None else sizes[None, n:]) - common
    out = common >= threshold * union - 1e-6
    if right is None:
        np.fill_diagonal(out, False)
    return out


def roots(out: np.ndarray) -> np.ndarray:
    """Component of every vertex of a symmetric relation, by smallest number."""
    label = np.arange(len(out))
    while True:
        near = np.where(out, label[None, :], len(out)).min(axis=1, initial=len(out))
        low = np.minimum(label, near)
        low = low[low]
        if (low == label).all():
            return label
        label = low


_LINKS = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("n_links", pa.int64())])


def _verify(texts: list[dict], i: int, j: int, threshold: float) -> list[dict]:
    """Links among the texts of blocks i and j of one component."""
    left = [t for t in texts if t["block"] == i]
    right = [t for t in texts if t["block"] == j] if i != j else None
    if not left or (right is not None and not right):
        return []
    sets = lambda rows: [np.frombuffer(t["runs"], np.uint64) for t in rows]
    out = linked(sets(left), None if right is None else sets(right), threshold)
    copies = lambda rows: np.array([t["copies"] for t in rows], np.int64)
    if right is None:
        rows, relation = left, out
        links = out @ copies(left)
    else:
        rows = left + right
        n = len(left)
        relation = np.zeros((len(rows), len(rows)), bool)
        relation[:n, n:], relation[n:, :n] = out, out.T
        links = np.concatenate([out @ copies(right), out.T @ copies(left)])
    nodes = np.array([t["doc_id"] for t in rows], np.int64)
    order = np.argsort(nodes)
    label = roots(relation[np.ix_(order, order)])
    return [
        {"node": int(nodes[order[k]]), "root": int(nodes[order[label[k]]]), "n_links": int(links[order[k]])}
        for k in np.flatnonzero(links[order] > 0)
    ]


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    recall: float = RECALL,
) -> DataFrame:
    """``doc_id, class_id, copy_of, n_links`` for every row.

    ``class_id`` is the smallest id reached over links, ``copy_of`` the
    smallest id with an equal set, ``n_links`` the number of other documents
    whose similarity reaches the threshold, copies included.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text].alias("text"))
    depth = depth_for(threshold, trees, recall)
    marks = cut_lineage(marked(rows, words, trees, depth))
    some = marks.filter("doc_id IS NOT NULL AND size > 0")
    classes = cut_lineage(
        some.groupBy("k1", "k2", "size").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies"))
    )
    firsts = some.join(
        classes.select("k1", "k2", "size", F.col("copy_of").alias("doc_id")), ["k1", "k2", "size", "doc_id"], "left_semi"
    )
    nodes = firsts.select("doc_id", F.explode("prefixes").alias("prefix"))
    shared = nodes.groupBy("prefix").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    ties = nodes.join(shared.filter("least < most"), "prefix").select(
        F.col("doc_id").alias("a"), F.col("least").alias("b")
    )
    candidates = components(ties)

    # Component sizes decide how many blocks a component is dealt to.
    sizes = candidates.groupBy("label").agg(F.count("*").alias("n"))
    members = candidates.join(sizes, "label").select(
        F.col("node").alias("doc_id"),
        F.col("label").alias("component"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
    )
    members = cut_lineage(members.join(classes.groupBy(F.col("copy_of").alias("doc_id")).agg(F.sum("copies").alias("copies")), "doc_id"))
    small = pieces_for(members.filter("blocks = 1").count(), 4 * BLOCK)

    def with_runs(batches):
        for batch in chunks(batches, "text", CHUNK):
            run, bounds = shingles(batch.column("text"), words)
            blobs = [run[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield batch.drop_columns("text").append_column("runs", pa.array(blobs, pa.binary()))
        give_back()

    texts = rows.join(members, "doc_id").select("doc_id", "component", "blocks", "copies", "text")
    sets = texts.mapInArrow(
        with_runs, "doc_id long, component long, blocks int, copies long, runs binary"
    )
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    units = sets.withColumn("block", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    large = F.col("blocks") > 1
    units = units.select(
        large.alias("large"),
        F.when(large, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(small))).alias("unit"),
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "doc_id",
        "component",
        "copies",
        "block",
        "runs",
    )

    def verify(unit: pa.Table) -> pa.Table:
        by_component: dict[int, list[dict]] = {}
        for row in unit.to_pylist():
            by_component.setdefault(row["component"], []).append(row)
        out = []
        for members_ in by_component.values():
            out += _verify(members_, members_[0]["i"], members_[0]["j"], threshold)
        return pa.Table.from_pylist(out, schema=_LINKS)

    links = cut_lineage(
        units.groupBy("large", "unit", "i", "j").applyInArrow(
            lambda unit: freed(verify(unit)), "node long, root long, n_links long"
        )
    )
    labels = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("n_links").alias("links"))
    known = classes.join(counts, classes["copy_of"] == counts["node"], "left").drop("node")
    known = known.join(labels, known["copy_of"] == labels["node"], "left").select(
        "k1",
        "k2",
        "size",
        "copy_of",
        F.coalesce("label", "copy_of").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return marks.select("doc_id", "k1", "k2", "size").join(known, ["k1", "k2", "size"], "left").select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("copy_of", "doc_id")).alias("copy_of"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, its smallest id; rows without id all stay."""
    joined = jaccard_join(docs, id_col, text)
    gone = joined.filter("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
