"""Spelling variants: words one edit apart, found in a sorted vocabulary.

Words are counted over all texts, map-side first.  The search keeps a sorted
list of words and, for a word, the three entries around the diagonal of the
edit matrix; a row of the matrix belongs to a prefix of the list, so words that
share a prefix with their neighbour share its rows, and a range of the list
whose prefix is already more than one edit away is skipped as a whole.  All
words of a block go down the list together, one character at a time, as arrays.

The list is cut so that no task needs all of it.  Two words one edit apart
share everything before and after one place.  With ``size`` the length of the
shorter and places cut into regions ``[a, b)``, a pair that parts inside a
region shares its first ``a`` and its last ``size - b`` characters, and a group
is a length, a region and these characters.  Every word belongs to two lengths
(its own and one less) and two regions each.  A group of too many words has its
regions halved, until it is small: one place left leaves only the characters of
the alphabet.  A pair is counted in the one region where it parts.

A word's form is its near word of largest count, if that is at least five times
its own.  Counts grow along forms, so a chain of forms is short; its end is
found by doubling steps.

Defined results: a null text has no words; a null id counts as empty text in
the hash that decides on a deleted letter; rows that repeat count each; ties
between near words go to the smallest in code-point order; an empty table has
no words; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.llm.columnar import chunks, spread
from tierflow.llm.tables import pieces_for
from tierflow.runtime import cut_lineage

LEAST_LENGTH = 6
LEAST_COUNT = 5
TIMES = 5
NOISE = 199
# Words counted in a worker before they are passed on, and text of one step.
HELD_WORDS = 200_000
STEP_BYTES = 4 << 20
# Words of a group before its region is halved, of a block, and searched at once.
GROUP_WORDS = 50_000
BLOCK_WORDS = 1 << 16
SEARCH_WORDS = 1 << 13
FAR = 9

# a-z and the letters U+00C0 to U+00FF, in UTF-8; all are Latin-1 as well.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % LEAST_LENGTH)


def count_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", noise: int = NOISE) -> DataFrame:
    """``word, n``: runs of at least six letters, in lower case, some short of a letter.

    ``noise`` divides the crc32 of ``<doc_id>:<run>`` of the runs that lose one.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            kept = {w: n for w, n in held.items() if len(w) - w.count(b"\xc3") >= LEAST_LENGTH}
            words = pa.array(list(kept), pa.binary()).cast(pa.string())
            held.clear()
            return pa.RecordBatch.from_arrays([words, pa.array(list(kept.values()), pa.int64())], schema=schema)

        for batch in chunks(batches, "text", STEP_BYTES):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for name, data in zip(batch.column("id").to_pylist(), texts, strict=True):
                start = zlib.crc32(f"{name}:".encode())
                for word, n in Counter(_RUN.findall(data.lower())).items():
                    h = zlib.crc32(word, start)
                    if h % noise == 0:
                        chars = word.decode()
                        gone = h % len(chars)
                        word = (chars[:gone] + chars[gone + 1 :]).encode()
                    held[word] += n
                if len(held) > HELD_WORDS:
                    yield flush()
        yield flush()

    rows = docs.select(
        F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), docs[text].alias("text")
    ).filter("text IS NOT NULL")
    counted = rows.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


# ---- the search ----


def _code(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all words as Latin-1, where each starts, and lengths."""
    coded = [w.encode("latin-1") for w in words.to_pylist()]
    size = np.array([len(c) for c in coded], np.int64)
    # Two bytes more, so that looking past the last word is no error.
    return np.frombuffer(b"".join(coded) + b"\0\0", np.uint8), np.cumsum(size) - size, size


def _shared(data: np.ndarray, at: np.ndarray, size: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Characters each word shares with the one before; -1 at the first of a group."""
    out = np.full(len(at), -1, np.int64)
    alive = np.flatnonzero(~new)
    out[alive] = 0
    depth = 0
    while len(alive):
        inside = (size[alive] > depth) & (size[alive - 1] > depth)
        alive = alive[inside]
        alive = alive[data[at[alive] + depth] == data[at[alive - 1] + depth]]
        depth += 1
        out[alive] = depth
    return out


def near_pairs(
    words: pa.Array, group: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(word, near word) by number, for words sorted by group and then by word.

    ``size, a, b`` are the shorter length and the region of a word's group.
    """
    data, at, length = _code(words)
    n = len(at)
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    common = _shared(data, at, length, new)
    first = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    low_of, high_of = first[number], np.append(first[1:], n)[number]
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def char(word: np.ndarray, place: int) -> np.ndarray:
        """Characters at a place, 0 beyond the end."""
        inside = place < length[word]
        return np.where(inside, data[np.where(inside, at[word] + place, 0)], 0)

    def take_ends() -> None:
        """Pairs of the frontier whose listed word ends at this depth."""
        gap = length[q] - depth
        ends = np.flatnonzero((length[low] == depth) & (np.abs(gap) <= 1))
        asked_, listed = q[ends], low[ends]
        where = np.where(parted[ends] < 0, np.minimum(depth, length[asked_]), parted[ends])
        both_long = (length[asked_] > size[asked_]) & (depth > size[asked_])
        good = (row[ends, gap[ends] + 1] == 1) & (where >= a[asked_]) & (where < b[asked_]) & ~both_long
        out.append((asked_[good], listed[good]))

    for begin in range(0, n, SEARCH_WORDS):
        asked = np.arange(begin, min(begin + SEARCH_WORDS, n))
        by_depth = {int(d): asked[a[asked] == d] for d in np.unique(a[asked])}
        depth = min(by_depth)
        # The frontier: word, range of the list, matrix row, where the prefixes part.
        q = np.zeros(0, np.int64)
        low, high, parted = q, q, q
        row = np.zeros((0, 3), np.int64)
        while len(q) or by_depth:
            fresh = by_depth.pop(depth, None)
            if fresh is not None:
                before = q, low, high, parted, row
                q, low, high, parted = fresh, low_of[fresh], high_of[fresh], np.full(len(fresh), -1)
                row = np.tile([1, 0, 1], (len(fresh), 1))
                row[length[q] <= depth, 2] = FAR
                take_ends()
                q, low, high, parted, row = (
                    np.concatenate(x) for x in zip(before, (q, low, high, parted, row), strict=True)
                )
            starts = np.flatnonzero(common <= depth)
            i, j = np.searchsorted(starts, low), np.searchsorted(starts, high)
            parent = np.repeat(np.arange(len(q)), j - i)
            child = spread(i, j - i)
            begin_at = starts[child]
            # A word that ends here has no further prefix.
            on = length[begin_at] > depth
            parent, child, begin_at = parent[on], child[on], begin_at[on]
            end_at = np.append(starts, n)[child + 1]
            q, old, parted = q[parent], row[parent], parted[parent]
            c = data[at[begin_at] + depth]
            here = char(q, depth)
            one = np.minimum(old[:, 1] + 1, old[:, 0] + (c != char(q, depth - 1) if depth else FAR))
            two = np.minimum(np.minimum(old[:, 2] + 1, one + 1), old[:, 1] + (c != here))
            two = np.where(depth + 1 > length[q], FAR, two)
            three = np.minimum(two + 1, old[:, 2] + (c != char(q, depth + 1)))
            three = np.where(depth + 2 > length[q], FAR, three)
            row = np.stack([one, two, three], axis=1)
            parted = np.where((parted < 0) & (c != here), depth, parted)
            low, high = begin_at, end_at
            depth += 1
            take_ends()
            # Ranges more than one edit away, and pairs that part in another region, are skipped.
            go = (row.min(axis=1) <= 1) & ((parted >= 0) | (depth < b[q]))
            q, low, high, parted, row = q[go], low[go], high[go], parted[go], row[go]
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def regions(words: DataFrame) -> DataFrame:
    """Every word in the groups where it can meet a near word."""
    length = F.length("word")
    sizes = F.array(length, length - 1)
    at = words.withColumn("size", F.explode(sizes)).filter(F.col("size") >= LEAST_LENGTH)
    half = F.floor(F.col("size") / 2).cast("int")
    cut = F.array(
        F.struct(F.lit(0).alias("a"), half.alias("b")),
        F.struct(half.alias("a"), (F.col("size") + 1).alias("b")),
    )
    return at.withColumn("_r", F.explode(cut)).select("word", "n", "size", "_r.a", "_r.b")


def _group() -> Column:
    """What the words of a group share."""
    after = F.greatest(F.col("size") - F.col("b"), F.lit(0))
    tail = F.when(after > 0, F.expr("right(word, greatest(size - b, 0))")).otherwise("")
    return F.concat_ws(" ", "size", "a", "b", F.substring("word", F.lit(1), F.col("a")), tail)


def grouped(words: DataFrame, most: int = GROUP_WORDS) -> tuple[DataFrame, int]:
    """``group, word, n, size, a, b`` with small groups, and the number of rows."""
    rows = regions(words).withColumn("group", _group())
    done: DataFrame | None = None
    total = 0
    while True:
        counts = cut_lineage(rows.groupBy("group").agg(F.count("*").alias("members")))
        # A region of one place cannot be halved: its words differ in one character.
        some = counts.filter(F.col("members") > most).select("group")
        sizes = counts.agg(F.sum("members"), F.max("members")).first()
        total += sizes[0] or 0
        if (sizes[1] or 0) <= most:
            return (rows if done is None else done.unionByName(rows)), total
        wide = F.col("b") - F.col("a") > 1
        hot = cut_lineage(rows.join(some, "group", "left_semi").filter(wide))
        rest = rows.join(some, "group", "left_anti").unionByName(
            rows.join(some, "group", "left_semi").filter(~wide)
        )
        done = rest if done is None else done.unionByName(rest)
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        cut = F.array(
            F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b"))
        )
        halves = hot.withColumn("_r", F.explode(cut)).select("word", "n", "size", "_r.a", "_r.b")
        rows = halves.withColumn("group", _group())


def near_words(words: DataFrame, most: int = GROUP_WORDS) -> DataFrame:
    """``word, n_near, near_n, near``: how many are near, and the commonest of them."""
    rows, total = grouped(words, most)
    schema = pa.schema(
        [("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())]
    )

    def found(block: pa.Table) -> pa.RecordBatch:
        block = block.combine_chunks()
        names = block.column("word").combine_chunks()
        group = np.asarray(block.column("group").combine_chunks().dictionary_encode().indices)
        size, a, b, n = (block.column(c).to_numpy().astype(np.int64) for c in ("size", "a", "b", "n"))
        q, w = near_pairs(names, group, size, a, b)
        # By word, the largest count first, then code-point order.
        order = np.lexsort((w, -n[w], q))
        q, w = q[order], w[order]
        start = np.flatnonzero(np.diff(q, prepend=-1))
        counts = np.diff(np.append(start, len(q)))
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(q[start])), pa.array(counts), pa.array(n[w[start]]), names.take(pa.array(w[start]))],
            schema=schema,
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < BLOCK_WORDS:
                continue
            # Whole groups only: the last one may go on in the next batch.
            block = pa.Table.from_batches(held)
            group = np.asarray(block.column("group").combine_chunks().dictionary_encode().indices)
            cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if (group != group[-1]).any() else 0
            if cut:
                yield found(block.slice(0, cut))
            held = block.slice(cut).to_batches()
            count = block.num_rows - cut
        if count:
            yield found(pa.Table.from_batches(held))

    parts = pieces_for(total, 2 * BLOCK_WORDS)
    dealt = rows.repartition(parts, "group").sortWithinPartitions("group", "word")
    partial = dealt.mapInArrow(search, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), "near"))
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")).select(
        "word", "n_near", (-F.col("_best.rank")).alias("near_n"), F.col("_best.near").alias("near")
    )


def variants(words: DataFrame, times: int = TIMES, most: int = GROUP_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a vocabulary ``word, n``."""
    near = near_words(words, most)
    is_form = F.col("near_n") >= times * F.col("n")
    formed = cut_lineage(
        words.join(near, "word", "left").select(
            "word",
            F.when(is_form, F.col("near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("near_n")).alias("form_n"),
        )
    )
    links = formed.filter("form IS NOT NULL")
    reach = links.select("word", F.col("form").alias("root"))
    most_n = links.agg(F.max("form_n")).first()[0] or 1
    # Counts grow at least ``times`` fold a step, so the longest chain is known.
    steps = 1 + ceil(log(max(most_n, times), times))
    for _ in range(ceil(log2(steps))):
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        reach = cut_lineage(
            reach.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
        )
    return formed.join(reach, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of all texts with their near words, forms and roots."""
    words = cut_lineage(count_words(docs, id_col, text).filter(F.col("n") >= LEAST_COUNT))
    return variants(words)
