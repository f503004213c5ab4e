"""Prefix trie of conversations by collapsing whole sequences.

Conversations are rebuilt first: conversation c takes the first h turns of
conversation c - c % 5 and then its own turns after its first h, where h is
crc32 of c in decimal, modulo 9.

* A running sum over a conversation of hashes of (position, role, text) names
  every prefix by its depth and a number of 90 bits; texts do not move.
* Whole sequences: conversations with the same depth and number at their end
  are one weighted sequence.  From here on only the turns of its smallest
  conversation stand for it.
* Leaves: sequences that are not a proper prefix of another, by anti-join.
* Nodes: one aggregation over the prefixes of the weighted sequences.  What a
  subtree saves is a sum over the sequences through its top: all bytes from the
  top on by the weight, less the bytes that the sequence stands for itself.
  A sequence stands for the nodes whose smallest member is its own; these are
  the last ones of its path, so one number a sequence says where they begin.
* End lists: sorted ids are written out in ranges, so a list of any length is
  formed in many tasks; one task then feeds the pieces to the hash in order.

Numbering and running sums go over ranges of rows, so a conversation may hold
any share of the turns.  Sums by node are formed before they are shuffled.

Defined results: turns of equal number stand in the order of a hash of role and
text; null turns come first; a null role or text is empty; rows that repeat are
turns of their own; rows with a null conv_id belong to no conversation and are
left out; a conversation without turns after rebuilding ends at the root; an
empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.operators.ordered import running
from tierflow.runtime import cut_lineage

# Turns of a conversation that meet their conversation's row in one task.
SALT_TURNS = 100_000
# A parent of more nodes than this is looked up by broadcast: such parents are
# at most the number of nodes over this.
HOT_CHILDREN = 100_000
# Ids of an end list that one range writes at once.
LIST_IDS = 50_000
# Conversations whose ids one task sorts.
RANGE_IDS = 500_000
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _zero() -> Column:
    return F.lit(0).cast("decimal(38,0)")


def borrowed_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from another at most."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("long")


def _salted(rows: DataFrame, place: str, small: DataFrame, size: str, key: str) -> DataFrame:
    """``rows`` joined to one row per ``key``, however many rows a key has."""
    salts = F.sequence(F.lit(0).cast("long"), F.floor(F.col(size) / SALT_TURNS))
    copies = small.withColumn("_salt", F.explode(salts))
    return rows.withColumn("_salt", F.floor(F.col(place) / SALT_TURNS)).join(copies, [key, "_salt"]).drop("_salt")


def rebuilt(conversations: DataFrame, block_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv_id, d, a, b, size`` of rebuilt conversations, and all ``conv_id``."""
    role, text = (F.coalesce(conversations[c], F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].alias("turn"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(text, F.lit("turn"), role).alias("b"),
        F.octet_length(text).cast("long").alias("size"),
        # Equal turns are interchangeable; this parts them into ranges.
        F.monotonically_increasing_id().alias("tie"),
    ).filter("conv_id IS NOT NULL")
    numbered = cut_lineage(
        running(turns, ["conv_id"], ["turn", "a", "b", "tie"], {"d": F.lit(1)}, block_rows).select(
            "conv_id", "d", "a", "b", "size"
        )
    )
    convs = cut_lineage(numbered.groupBy("conv_id").agg(F.max("d").alias("own")))
    lender = F.col("conv_id") - F.col("conv_id") % 5
    asks = convs.select("conv_id", lender.alias("lender"), borrowed_turns(F.col("conv_id")).alias("h"))
    heads = numbered.filter("conv_id % 5 = 0 AND d <= 8").withColumnRenamed("conv_id", "lender")
    taken = asks.join(heads, "lender").filter("d <= h").select("conv_id", "d", "a", "b", "size")
    lent = convs.select(F.col("conv_id").alias("lender"), F.col("own").alias("lent"))
    moved = asks.join(lent, "lender", "left").join(convs, "conv_id").select(
        "conv_id", "own", (F.least("h", F.coalesce("lent", F.lit(0))) - F.col("h")).alias("shift")
    )
    late = numbered.filter(F.col("d") > borrowed_turns(F.col("conv_id")))
    kept = _salted(late, "d", moved, "own", "conv_id").select(
        "conv_id", (F.col("d") + F.col("shift")).alias("d"), "a", "b", "size"
    )
    return taken.unionByName(kept), convs.select("conv_id")


def _prefix_number() -> Column:
    """A number of 90 bits for one turn at one place; their sum names a prefix."""
    high = F.shiftrightunsigned(F.xxhash64("d", "a", "b"), 19).cast("decimal(14,0)")
    low = F.shiftrightunsigned(F.xxhash64("b", "d", F.lit("prefix"), "a"), 19).cast("decimal(14,0)")
    return (high * F.lit(1 << 45).cast("decimal(14,0)") + low).cast("decimal(38,0)")


def end_digests(ends: DataFrame) -> DataFrame:
    """``n, name, ends_sha256``: SHA-256 of the sorted, comma-joined ids of each group.

    ``ends`` has ``n, name, conv_id``.
    """
    piece = pa.schema(
        [("n", pa.int64()), ("name", pa.string()), ("first", pa.int64()), ("ids", pa.string())]
    )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, LIST_IDS):
                rows = zip(*[c.to_pylist() for c in batch.slice(start, LIST_IDS).columns], strict=True)
                out = []
                for (n, name), group in groupby(rows, key=lambda r: r[:2]):
                    ids = [r[2] for r in group]
                    out.append({"n": n, "name": name, "first": ids[0], "ids": ",".join(map(str, ids))})
                yield pa.RecordBatch.from_pylist(out, schema=piece)

    result = pa.schema([("n", pa.int64()), ("name", pa.string()), ("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            for n, name, ids in zip(*[batch.column(c).to_pylist() for c in ("n", "name", "ids")], strict=True):
                if now == (n, name):
                    sha.update(b",")
                else:
                    if now:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (n, name), hashlib.sha256()
                sha.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(result.names, d)) for d in done], schema=result)
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(result.names, (*now, sha.hexdigest())))], schema=result)

    order = ["n", "name", "conv_id"]
    parts = max(1, -(-ends.count() // RANGE_IDS))
    pieces = (
        ends.select(*order)
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(runs, "n long, name string, first long, ids string")
    )
    return (
        pieces.repartition(parts, "n", "name")
        .sortWithinPartitions("n", "name", "first")
        .mapInArrow(digest, "n long, name string, ends_sha256 string")
    )


def prefix_trie(conversations: DataFrame, block_rows: int | None = None) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``."""
    turns, convs = rebuilt(conversations, block_rows)
    paths = running(
        turns.withColumn("x", _prefix_number()),
        ["conv_id"],
        ["d"],
        {"key": F.col("x"), "upto": F.col("size")},
        block_rows,
    )
    paths = cut_lineage(paths.select("conv_id", "d", F.col("key").cast("decimal(38,0)").alias("key"), "x", "size", "upto"))

    # Whole sequences.
    last = paths.groupBy("conv_id").agg(F.max(F.struct("d", "key", "upto")).alias("last"))
    whole = cut_lineage(
        convs.join(last, "conv_id", "left").select(
            "conv_id",
            F.coalesce("last.d", F.lit(0)).alias("n"),
            F.coalesce("last.key", _zero()).alias("key"),
            F.coalesce("last.upto", F.lit(0)).alias("total"),
        )
    )
    sequences = cut_lineage(
        whole.groupBy("n", "key").agg(
            F.count("*").alias("w"), F.min("conv_id").alias("conv_id"), F.min("total").alias("total")
        )
    )
    name = F.col("key").cast("string").alias("name")
    ends = end_digests(whole.select("n", name, "conv_id"))

    # Prefixes of the sequences, the root among them.
    alone = sequences.select("conv_id", "n")
    prefixes = _salted(paths, "d", alone, "n", "conv_id").select(
        "conv_id", "n", "d", "key", (F.col("key") - F.col("x")).cast("decimal(38,0)").alias("parent"), (F.col("upto") - F.col("size")).alias("before")
    )
    zero = F.lit(0).cast("long")
    root = alone.select("conv_id", "n", zero.alias("d"), _zero().alias("key"), _zero().alias("parent"), zero.alias("before"))
    prefixes = cut_lineage(prefixes.unionByName(root))

    # Leaves: sequences that are no proper prefix.
    proper = prefixes.filter("d < n").select(F.col("d").alias("n"), "key").distinct()
    leaves = sequences.join(proper, ["n", "key"], "left_anti").select("conv_id", F.lit(1).alias("leaf"))

    # Where the nodes begin that a sequence stands for.
    least = prefixes.groupBy("d", "key").agg(F.min("conv_id").alias("conv_id"), F.min("before").alias("before"))
    begin = least.groupBy("conv_id").agg(F.min("before").alias("begin"))
    known = (
        sequences.withColumn("name", name)
        .join(leaves, "conv_id", "left")
        .join(begin, "conv_id", "left")
        .join(ends, ["n", "name"], "left")
        .select(
            "conv_id",
            F.col("n").alias("size"),
            "w",
            "total",
            F.coalesce("leaf", F.lit(0)).alias("leaf"),
            F.coalesce("begin", "total").alias("begin"),
            "ends_sha256",
        )
    )
    saved = F.col("w") * (F.col("total") - F.col("before")) - (F.col("total") - F.greatest("before", "begin"))
    nodes = cut_lineage(
        _salted(prefixes, "d", known, "size", "conv_id")
        .groupBy("d", "key")
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.min("parent").alias("parent"),
            F.sum("w").alias("n_convs"),
            F.sum("leaf").cast("long").alias("n_leaves"),
            F.sum(saved).alias("saved_tokens"),
            F.max(F.when(F.col("d") == F.col("n"), F.col("ends_sha256"))).alias("ends"),
        )
    )
    children = (
        nodes.filter("d > 0")
        .groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("key"))
        .agg(F.count("*").alias("n_children"))
    )
    full = cut_lineage(
        nodes.join(children, ["d", "key"], "left").select(
            "conv_id",
            F.col("d").alias("depth"),
            "key",
            "parent",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
        )
    )
    return with_parents(full)


def with_parents(nodes: DataFrame, hot: int = HOT_CHILDREN) -> DataFrame:
    """Nodes with the conv_id of their parent; parents of very many by broadcast."""
    parents = nodes.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"),
        F.col("key").alias("parent"),
        F.col("conv_id").alias("parent_conv_id"),
        "n_children",
    )
    on = ["depth", "parent"]
    many = F.broadcast(parents.filter(F.col("n_children") > hot).drop("n_children"))
    few = parents.filter(F.col("n_children") <= hot).drop("n_children")
    below = nodes.filter("depth > 0")
    found = below.join(many, on).unionByName(below.join(many, on, "left_anti").join(few, on, "left"))
    top = nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return found.unionByName(top).select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        "ends_sha256",
    )
