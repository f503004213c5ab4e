"""Byte-level BPE of whole texts, long ones in overlapping chunks.

A text is split by the tokenizer's pattern into pre-tokens, and each pre-token
is merged on its own by the ranks.  A text of at most one chunk is split and
encoded where it stands.  A longer one is cut into chunks that overlap:

* every chunk is split by itself, in parallel, from an arbitrary first
  character; only the bounds of pre-tokens near its two ends are kept;
* the pattern looks at nothing before a match, so from the first bound that a
  chunk shares with the true split on, both are the same.  Chunks are stitched
  at the first bound in the overlap that both neighbours have;
* a chunk that shares no bound with the one before (a pre-token longer than
  the overlap) is joined to it and the joined text is split anew, until all
  neighbours meet;
* the stretches between the meeting bounds are encoded, in parallel, and their
  ids joined in order.

Bounds close to the end of a chunk may hang on what follows and are not used:
those after the last four characters that come before trailing white space.
This fits patterns whose matches look at most at a run of one class and three
characters more, as the public one does.

Equal long texts are encoded once.  Decoding joins the bytes of the ids.

Classes of characters (letter, number, white space) are those of the tiktoken
library, which may know fewer characters than the ``regex`` module: every
character beyond ASCII is compared once in each worker, and one that differs
takes part in the split as another character of its class.

Defined results: a null text is empty; an empty text has no ids; rows that
repeat, also with a null id, each have their result; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierflow.llm.columnar import chunks, table
from tierflow.runtime import cut_lineage

# Characters of a chunk, and characters by which it reaches into the next one.
CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 10
# What a match may look at behind its end.
LOOK_AHEAD = 4
# Text bytes worked on at once, and pre-tokens a worker remembers.
STEP_BYTES = 4 << 20
CACHED = 1 << 18
CACHED_CHARS = 64
# A character of each class that no other part of a pattern names.
STAND_INS = {"letter": "a", "number": "0", "space": " ", "other": "!"}
_PROBES = {"letter": "a", "number": "1", "other": "!"}


class Codec:
    """Splits, encodes and decodes with one file of ranks."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.findall = regex.compile(pattern).findall
        # A tokenizer that merges a probe with the first byte of what follows it
        # in the same pre-token tells the class of any character.
        shown = {bytes([i]): i for i in range(256)}
        for probe in _PROBES.values():
            for i in range(256):
                shown[probe.encode() + bytes([i])] = len(shown)
        self.probe = tiktoken.Encoding(
            "probe", pat_str=pattern, mergeable_ranks=shown, special_tokens={}
        )
        self.plain: set[str] = {chr(i) for i in range(128)}
        self.odd: dict[int, str] = {}
        self.known: dict[str, bytes] = {}

    def _class(self, char: str) -> str:
        for name, probe in _PROBES.items():
            if self.probe.encode_ordinary(probe + char)[0] >= 256:
                return name
        return "space"

    def _own_class(self, char: str) -> str:
        for name, probe in _PROBES.items():
            if len(self.findall(probe + char)) == 1:
                return name
        return "space"

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text, one after another the whole text."""
        odd = False
        if not text.isascii():
            chars = set(text)
            for char in chars - self.plain:
                if ord(char) not in self.odd:
                    name = self._class(char)
                    if name == self._own_class(char):
                        self.plain.add(char)
                    else:
                        self.odd[ord(char)] = STAND_INS[name]
            odd = not chars <= self.plain
        if not odd:
            return self.findall(text)
        out, at = [], 0
        for piece in self.findall(text.translate(self.odd)):
            out.append(text[at : at + len(piece)])
            at += len(piece)
        return out

    def merge(self, pieces: list[str]) -> bytes:
        """Ids of pre-tokens as little-endian unsigned 32-bit integers."""
        known = self.known
        if len(known) > CACHED:
            known.clear()
        extra = {}
        for piece in set(pieces).difference(known):
            ids = np.array(self.coder._encode_single_piece(piece), "<u4").tobytes()
            (known if len(piece) <= CACHED_CHARS else extra)[piece] = ids
        if extra:
            return b"".join([extra[p] if p in extra else known[p] for p in pieces])
        return b"".join(map(known.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        return self.merge(self.split(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def bounds(self, text: str, ends: bool) -> np.ndarray:
        """Starts of pre-tokens and the end of the last; only sure ones."""
        at = np.cumsum([0, *map(len, self.split(text))])
        if at[-1] != len(text):
            raise ValueError("the pattern leaves characters out")
        return at if ends else at[at <= len(text.rstrip()) - LOOK_AHEAD]

    def stretch(self, text: str, start: int, stop: int | None) -> bytes:
        """Ids of the pre-tokens between two true bounds."""
        pieces = self.split(text[start:])
        if stop is None:
            return self.merge(pieces)
        count = int(np.searchsorted(np.cumsum([0, *map(len, pieces)]), stop - start))
        return self.merge(pieces[:count])


@cache
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return Codec(path, pattern)


def _edges(found: np.ndarray, size: int, overlap: int) -> tuple[list[int], list[int]]:
    """Bounds in the first characters, and those in the overlap behind ``size``."""
    tail = found[(found >= size) & (found <= size + overlap)] - size
    return found[found <= overlap].tolist(), tail.tolist()


PART = pa.schema(
    [("key", pa.binary()), ("k", pa.int32()), ("ends", pa.bool_()), ("chunk", pa.string())]
)
PART_DDL = "key binary, k int, ends boolean, chunk string"
EDGE_DDL = "key binary, first int, last int, head array<int>, tail array<int>"
STRETCH_DDL = "key binary, first int, ids binary"


def encode_long(
    texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int
) -> DataFrame:
    """``key, ids`` of every distinct text of a column ``text``; key is its SHA-256."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", STEP_BYTES):
            for text in batch.column("text").to_pylist():
                key = hashlib.sha256(text.encode()).digest()
                for k, start in enumerate(range(0, len(text), chunk)):
                    stop = start + chunk + overlap
                    row = [[key], [k], [stop >= len(text)], [text[start:stop]]]
                    yield pa.RecordBatch.from_arrays([pa.array(*c) for c in zip(row, PART.types)], schema=PART)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            edges = [
                _edges(own.bounds(c, e), chunk, overlap)
                for c, e in zip(batch.column("chunk").to_pylist(), batch.column("ends").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("k"),
                    batch.column("k"),
                    pa.array([h for h, _ in edges], pa.list_(pa.int32())),
                    pa.array([t for _, t in edges], pa.list_(pa.int32())),
                ],
                names=["key", "first", "last", "head", "tail"],
            )

    def whole(rows: pa.Table) -> tuple[str, int, bool]:
        """Joined text of the chunks of a segment, its size without overlap, if it ends."""
        rows = rows.sort_by("k")
        texts_, ends = rows.column("chunk").to_pylist(), rows.column("ends").to_pylist()
        return "".join([t[:chunk] for t in texts_[:-1]] + texts_[-1:]), chunk * len(texts_), ends[-1]

    def find_again(rows: pa.Table) -> pa.Table:
        text, size, ends = whole(rows)
        head, tail = _edges(codec(path, pattern).bounds(text, ends), size, overlap)
        return pa.table(
            {
                "key": pa.array([rows.column("key")[0].as_py()], pa.binary()),
                "first": pa.array([rows.column("first")[0].as_py()], pa.int32()),
                "last": pa.array([rows.column("last")[0].as_py()], pa.int32()),
                "head": pa.array([head], pa.list_(pa.int32())),
                "tail": pa.array([tail], pa.list_(pa.int32())),
            }
        )

    def encode_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("chunk", "sync", "following")]
            ids = [
                own.stretch(c, s, None if f is None else chunk + f)
                for c, s, f in zip(*columns, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("first"), pa.array(ids, pa.binary())],
                names=["key", "first", "ids"],
            )

    def encode_many(rows: pa.Table) -> pa.Table:
        text, size, _ = whole(rows)
        sync, following = rows.column("sync")[0].as_py(), rows.column("following")[0].as_py()
        ids = codec(path, pattern).stretch(text, sync, None if following is None else size + following)
        return pa.table(
            {
                "key": pa.array([rows.column("key")[0].as_py()], pa.binary()),
                "first": pa.array([rows.column("first")[0].as_py()], pa.int32()),
                "ids": pa.array([ids], pa.binary()),
            }
        )

    def join(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("first")
        ids = b"".join(rows.column("ids").to_pylist())
        return pa.table({"key": rows.column("key")[:1].cast(pa.binary()), "ids": pa.array([ids], pa.binary())})

    cut_up = texts.select("text").mapInArrow(cut, PART_DDL)
    parts = cut_lineage(
        cut_up.groupBy("key", "k").agg(F.first("ends").alias("ends"), F.first("chunk").alias("chunk"))
    )
    segments = cut_lineage(parts.mapInArrow(find, EDGE_DDL))
    along = Window.partitionBy("key").orderBy("first")
    members = F.explode(F.sequence("first", "last")).alias("k")
    while True:
        met = F.array_min(F.array_intersect(F.lag("tail").over(along), "head"))
        linked = segments.withColumn("sync", F.when(F.col("first") == 0, 0).otherwise(met))
        if not linked.filter("sync IS NULL").limit(1).count():
            break
        # A segment that does not meet its predecessor becomes part of it.
        start = F.last(F.when(F.col("sync").isNotNull(), F.col("first")), ignorenulls=True)
        joined = (
            linked.withColumn("start", start.over(along.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("key", "start")
            .agg(
                F.max("last").alias("last"),
                F.count("*").alias("n"),
                F.min_by("head", "first").alias("head"),
                F.min_by("tail", "first").alias("tail"),
            )
            .withColumnRenamed("start", "first")
        )
        grown = joined.filter("n > 1").select("key", "first", "last", members)
        again = grown.join(parts, ["key", "k"]).groupBy("key", "first").applyInArrow(find_again, EDGE_DDL)
        segments = cut_lineage(
            joined.filter("n = 1").select("key", "first", "last", "head", "tail").unionByName(again)
        )
    placed = cut_lineage(
        linked.select("key", "first", "last", "sync", F.lead("sync").over(along).alias("following"))
    )
    with_text = placed.select("*", members).join(parts, ["key", "k"])
    single = F.col("first") == F.col("last")
    one = with_text.filter(single).select("key", "first", "sync", "following", "chunk")
    many = with_text.filter(~single).groupBy("key", "first")
    stretches = one.mapInArrow(encode_one, STRETCH_DDL).unionByName(many.applyInArrow(encode_many, STRETCH_DDL))
    return stretches.groupBy("key").applyInArrow(join, "key binary, ids binary")


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text: str = "text",
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row; ids are little-endian unsigned 32-bit."""
    if not LOOK_AHEAD < overlap <= chunk:
        raise ValueError("the overlap must be longer than the look-ahead and fit a chunk")
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text], F.lit("")).alias("text"),
    )
    is_long = F.length("text") > chunk
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def encode_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in chunks(batches, "text", STEP_BYTES):
            ids = [own.encode(t) for t in batch.column("text").to_pylist()]
            yield table(schema, doc_id=batch.column("doc_id"), ids=pa.array(ids, pa.binary()))

    short = rows.filter(~is_long).mapInArrow(encode_short, "doc_id long, ids binary")
    long = rows.filter(is_long)
    coded = encode_long(long.select("text"), path, pattern, chunk, overlap)
    keyed = long.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    both = short.unionByName(keyed.join(coded, "key").select("doc_id", "ids"))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, data``: the bytes of the ids of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in chunks(batches, "ids", STEP_BYTES):
            data = [own.decode(i) for i in batch.column("ids").to_pylist()]
            yield table(schema, doc_id=batch.column("doc_id"), data=pa.array(data, pa.binary()))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: ids and what they decode to."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_tokens", pa.int64()),
            ("ids_sha256", pa.string()),
            ("decoded_sha256", pa.string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in chunks(batches, "ids", STEP_BYTES):
            ids = batch.column("ids").to_pylist()
            yield table(
                schema,
                doc_id=batch.column("doc_id"),
                n_tokens=batch.column("n_tokens"),
                ids_sha256=[hashlib.sha256(i).hexdigest() for i in ids],
                decoded_sha256=[hashlib.sha256(own.decode(i)).hexdigest() for i in ids],
            )

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
