"""Raw token files with a minimal perfect hash index over document keys.

File format.  ``payload/<shard>-<attempt>.ids`` holds the ids of its documents
one after another as little-endian unsigned integers, two bytes wide if the
vocabulary fits, else four; every document ends with the end id.  Shards are
ranges of ascending document keys, so shard order and order inside the files is
key order.  ``manifest`` (Parquet) has one row per document: its file and its
place.  ``shards`` (Parquet) has one row per shard: its file and how many ids
stand before it.  ``index`` (Parquet) has one row per bucket of keys: a minimal
perfect hash of the bucket's keys (bit arrays, one per level) and, by hash
value, a 32-bit fingerprint of the key, its shard, offset and length.

A lookup hashes the key to its bucket, finds the first level whose bit is set,
counts the set bits before it, compares the fingerprint and reads the payload
range: constant time, and a key that is not there is told by its fingerprint.

A task that runs again writes a file of its own; the manifest names the files
of the tasks that were committed, so a lost executor leaves at most a file that
nothing names.

Defined results: a null or empty text is the end id alone; rows with a null key
or with a key seen before are written, but the index leads to the first row of
a key; an empty table gives empty tables and no files; other columns are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierflow.llm.columnar import chunks, give_back, mixed, table
from tierflow.llm.encoding import ENCODED_BYTES, encoder
from tierflow.llm.tables import pieces_for, text_size

# Text of one shard, and keys of one index bucket.
SHARD_BYTES = 64 << 20
BUCKET_KEYS = 1 << 15
# Bits per key of a level; most keys find a place of their own in the first two.
LEVEL_BITS = 2
# Payload read at once when documents stand close together.
READ_BYTES = 8 << 20


def open_folder(uri: str):
    """A file system that reaches ``uri``, and the path on it."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + (uri[5:] if uri.startswith("file:") else uri)
    return fs.FileSystem.from_uri(uri)


# ---- minimal perfect hash ----


def _level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    return (mixed(keys ^ seed) >> np.uint64(16)) % np.uint64(size)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32)


def build_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays, level by level, for distinct 64-bit keys.

    A key takes its bit on the first level where no other key wants it.
    """
    levels = []
    left = keys
    while len(left):
        size = max(64, LEVEL_BITS * len(left))
        at = _level(left, len(levels), size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels


def hash_value(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """0 to n - 1 for the n keys; -1 for a key that surely is not there."""
    out = np.full(len(keys), -1, np.int64)
    left = np.arange(len(keys))
    before = 0
    for number, bits in enumerate(levels):
        at = _level(keys[left], number, len(bits)).astype(np.int64)
        rank = np.cumsum(bits) - 1
        hit = bits[at]
        out[left[hit]] = before + rank[at[hit]]
        left = left[~hit]
        before += int(bits.sum())
    return out


def _pack(levels: list[np.ndarray]) -> tuple[list[int], bytes]:
    sizes = [len(x) for x in levels]
    return sizes, b"".join(np.packbits(x).tobytes() for x in levels)


def _unpack(sizes: list[int], data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for size in sizes:
        width = -(-size // 8)
        part = np.frombuffer(data, np.uint8, width, at)
        out.append(np.unpackbits(part, count=size).astype(bool))
        at += width
    return out


# ---- writing ----

_MANIFEST = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("shard", pa.int64()),
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("n_tokens", pa.int64()),
    ]
)
_MANIFEST_DDL = "doc_id long, shard long, file string, offset long, n_tokens long"


def write_store(
    docs: DataFrame,
    folder: str,
    path: str,
    end: int,
    width: int,
    id_col: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode all texts and write payload, manifest, shards and index."""
    spark = docs.sparkSession
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[text].alias("text"),
        F.xxhash64(docs[text]).alias("h"),
    )
    total = rows.agg(F.sum(text_size(F.col("text")))).first()[0]
    shards = pieces_for(total, SHARD_BYTES)
    # Equal ids part by text, so that one repeated id does not fill a shard.
    ordered = rows.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    kind = {2: "<u2", 4: "<u4"}[width]

    def work(batches):
        context = TaskContext.get()
        shard = context.partitionId()
        name = f"{shard:07d}-{context.taskAttemptId()}.ids"
        files, root = open_folder(f"{folder}/payload")
        files.create_dir(root, recursive=True)
        out, at = None, 0
        for batch in chunks(batches, "text", ENCODED_BYTES):
            if out is None:
                out = files.open_output_stream(f"{root}/{name}")
            ids, bounds = encoder(path).encode(batch.column("text"), end)
            out.write(ids.astype(kind).tobytes())
            n = np.diff(bounds)
            yield table(
                _MANIFEST,
                doc_id=batch.column("doc_id"),
                shard=np.full(len(n), shard),
                file=[name] * len(n),
                offset=at + bounds[:-1],
                n_tokens=n,
            )
            at += len(ids)
        if out is not None:
            out.close()
        # The worker waits for its next task without the buffers of this one.
        give_back()

    ordered.select("doc_id", "text").mapInArrow(work, _MANIFEST_DDL).write.parquet(
        f"{folder}/manifest"
    )
    manifest = spark.read.schema(_MANIFEST_DDL).parquet(f"{folder}/manifest")
    per_shard = manifest.groupBy("shard", "file").agg(
        F.sum("n_tokens").alias("n_ids"), F.count("*").alias("n_docs")
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per_shard.select("*", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")).write.parquet(
        f"{folder}/shards"
    )
    _write_index(manifest, folder)


_INDEX_DDL = (
    "bucket long, n long, level_sizes array<int>, bits binary, "
    "fingerprints binary, shards binary, offsets binary, lengths binary"
)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets))


def _write_index(manifest: DataFrame, folder: str) -> None:
    """One row per bucket; repeated keys are reduced to their first row."""
    keyed = manifest.filter(F.col("doc_id").isNotNull())
    buckets = pieces_for(keyed.count(), BUCKET_KEYS)
    first = (
        keyed.groupBy("doc_id")
        .agg(F.min(F.struct("shard", "offset", "n_tokens")).alias("at"))
        .select(_bucket(buckets).alias("bucket"), "doc_id", "at.*")
    )

    def build(group: pa.Table) -> pa.Table:
        keys = group.column("doc_id").to_numpy().astype(np.uint64)
        levels = build_hash(keys)
        place = np.empty(len(keys), np.int64)
        place[hash_value(levels, keys)] = np.arange(len(keys))
        sizes, bits = _pack(levels)
        by_value = lambda name, kind: group.column(name).to_numpy()[place].astype(kind).tobytes()
        return pa.table(
            {
                "bucket": pa.array([group.column("bucket")[0].as_py()], pa.int64()),
                "n": pa.array([len(keys)], pa.int64()),
                "level_sizes": pa.array([sizes], pa.list_(pa.int32())),
                "bits": pa.array([bits], pa.binary()),
                "fingerprints": pa.array([fingerprint(keys)[place].tobytes()], pa.binary()),
                "shards": pa.array([by_value("shard", "<u4")], pa.binary()),
                "offsets": pa.array([by_value("offset", "<u8")], pa.binary()),
                "lengths": pa.array([by_value("n_tokens", "<u4")], pa.binary()),
            }
        )

    first.groupBy("bucket").applyInArrow(build, _INDEX_DDL).select(
        "*", F.lit(buckets).cast("long").alias("buckets")
    ).write.parquet(f"{folder}/index")


# ---- reading ----


def lookup(spark: SparkSession, folder: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """``doc_id, shard, offset, n_tokens`` of every distinct key that is there."""
    index = spark.read.schema(_INDEX_DDL + ", buckets long").parquet(f"{folder}/index")
    head = index.select("buckets").first()
    buckets = head[0] if head else 1
    wanted = (
        keys.select(keys[key].cast("long").alias("doc_id"))
        .filter(F.col("doc_id").isNotNull())
        .distinct()
        .select(_bucket(buckets).alias("bucket"), "doc_id")
    )
    schema = pa.schema([f for f in _MANIFEST if f.name != "file"])

    def find(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        entry = rows.slice(0, 1).to_pylist()[0]
        ids = asked.column("doc_id").to_numpy()
        names = ids.astype(np.uint64)
        value = hash_value(_unpack(entry["level_sizes"], entry["bits"]), names)
        column = lambda name, kind: np.frombuffer(entry[name], kind)
        hit = value >= 0
        hit[hit] = column("fingerprints", "<u4")[value[hit]] == fingerprint(names[hit])
        value = value[hit]
        found = table(
            schema,
            doc_id=ids[hit],
            shard=column("shards", "<u4")[value],
            offset=column("offsets", "<u8")[value],
            n_tokens=column("lengths", "<u4")[value],
        )
        return pa.Table.from_batches([found])

    return (
        wanted.groupBy("bucket")
        .cogroup(index.groupBy("bucket"))
        .applyInArrow(find, "doc_id long, shard long, offset long, n_tokens long")
    )


def _ranges(files, root: str, asked: list[tuple[str, int, int]], width: int) -> Iterator[bytes]:
    """Payload of (file, offset, length) in order; near ranges share a read."""
    name, stream, buffer, begin = None, None, b"", 0
    for i, (file, offset, length) in enumerate(asked):
        if file != name:
            if stream is not None:
                stream.close()
            name, stream, buffer, begin = file, files.open_input_file(f"{root}/{file}"), b"", 0
        a, b = offset * width, (offset + length) * width
        if a < begin or b > begin + len(buffer):
            stop = b
            for other, at, n in asked[i + 1 : i + 4096]:
                if other != file or (at + n) * width - a > READ_BYTES or at * width > stop + READ_BYTES // 8:
                    break
                stop = max(stop, (at + n) * width)
            buffer, begin = stream.read_at(stop - a, a), a
        yield buffer[a - begin : b - begin]
    if stream is not None:
        stream.close()


def all_places(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place: by the index, and by the manifest where the
    index does not lead (null keys and further rows of a key)."""
    manifest = spark.read.schema(_MANIFEST_DDL).parquet(f"{folder}/manifest").drop("file")
    found = lookup(spark, folder, manifest)
    rest = manifest.join(found.select("shard", "offset"), ["shard", "offset"], "left_anti")
    return found.unionByName(rest)


def read_documents(
    spark: SparkSession, folder: str, places: DataFrame, width: int, with_ids: bool = True
) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and ``ids`` of places.

    ``start`` counts the ids of all documents before in the whole store.
    Places are read file by file in order of their offsets.
    """
    shards = spark.read.schema("shard long, file string, n_ids long, n_docs long, base long").parquet(
        f"{folder}/shards"
    )
    located = places.join(shards.select("shard", "file", "base"), "shard").select(
        "doc_id", "file", "offset", "n_tokens", (F.col("base") + F.col("offset")).alias("start")
    )
    # Several tasks share a large file: a part is a stretch of its offsets.
    part = F.floor(F.col("offset") / READ_BYTES)
    ordered = (
        located.withColumn("part", part)
        .repartition("file", "part")
        .sortWithinPartitions("file", "offset")
        .drop("part")
    )
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("start", pa.int64()),
            ("n_tokens", pa.int64()),
            ("ids_crc32", pa.int64()),
            *([("ids", pa.binary())] if with_ids else []),
        ]
    )
    kind = {2: "<u2", 4: "<u4"}[width]

    def work(batches):
        files, root = open_folder(f"{folder}/payload")
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                asked = list(
                    zip(
                        some.column("file").to_pylist(),
                        some.column("offset").to_pylist(),
                        some.column("n_tokens").to_pylist(),
                        strict=True,
                    )
                )
                ids = [
                    np.frombuffer(raw, kind).astype("<u4").tobytes()
                    for raw in _ranges(files, root, asked, width)
                ]
                yield table(
                    schema,
                    doc_id=some.column("doc_id"),
                    start=some.column("start"),
                    n_tokens=[len(x) // 4 for x in ids],
                    ids_crc32=[zlib.crc32(x) for x in ids],
                    ids=pa.array(ids, pa.binary()),
                )

    return ordered.mapInArrow(
        work,
        "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids,
    )
