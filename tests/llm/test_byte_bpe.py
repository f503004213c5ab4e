"""Byte-level BPE in chunks against the tiktoken library on whole texts."""

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import types as T

from tierflow.llm import bpe
from tierflow.llm.queries import QUERIES
from tierflow.llm.tables import tokenizer_path, tokenizer_pattern

SMALL = "/root/testdata/sf0.001"
PATH, PATTERN = tokenizer_path("byte_bpe_multi_50k.tiktoken"), tokenizer_pattern()
TWO = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return (
        len(ids),
        hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
        hashlib.sha256((text or "").encode()).hexdigest(),
    )


def digests(docs, **sizes):
    rows = bpe.digests(bpe.encode(docs, PATH, PATTERN, **sizes), PATH, PATTERN).collect()
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in rows)


def odd_text(rng):
    parts = [
        "'ll", "'s", "'", "''ve", " ", "  ", "\t", "\n", "\r\n", " ", " ", "   \n  ", "a", "xyz", "ÀÉ", "漢字",
        "12", "٣٤", "!", "?!", "\U0001f600", "՘", "࢏", "₝", "don't", "é", "<|endoftext|>", "\x1c", "\x85",
    ]
    return "".join(rng.choice(parts) * rng.choice([1, 1, 1, 2, 7, 30]) for _ in range(rng.randrange(60)))


@pytest.mark.parametrize("chunk, overlap", [(7, 6), (16, 8), (64, 16)])
def test_tiny_chunks_are_stitched(spark, library, chunk, overlap):
    rng = random.Random(chunk)
    texts = [odd_text(rng) for _ in range(150)] + ["x" * 500, " " * 300 + "a", "ab " * 200, " x" * 99]
    docs = spark.createDataFrame(list(enumerate(texts)), TWO).repartition(3)
    want = sorted((i, *expected(library, t)) for i, t in enumerate(texts))
    assert digests(docs, chunk=chunk, overlap=overlap) == want


def test_decoded_bytes_are_the_text(spark):
    docs = spark.createDataFrame([(1, "naïve 漢字 \U0001f600 " * 50), (2, ""), (3, None)], TWO)
    found = bpe.decode(bpe.encode(docs, PATH, PATTERN, chunk=64, overlap=32), PATH, PATTERN)
    texts = {r["doc_id"]: bytes(r["data"]).decode() for r in found.collect()}
    assert texts == {1: "naïve 漢字 \U0001f600 " * 50, 2: "", 3: ""}


def test_awkward_rows(awkward, empty, library):
    rows = awkward.select("doc_id", "text").collect()
    want = sorted((-1 if i is None else i, *expected(library, t)) for i, t in rows)
    assert digests(awkward) == want
    assert digests(empty) == []


def test_whole_table(spark, small_rows, library):
    want = sorted((i, *expected(library, t)) for i, t in small_rows)
    assert sorted(tuple(r) for r in QUERIES["op13_byte_bpe"](spark, SMALL).collect()) == want


def test_very_long_texts(spark, library):
    """Chunks of production size, among them one pre-token longer than many chunks."""
    prose = "The quiet river's bank — l'été, 42 Straßen; don't  stop\n" * 20_000
    texts = [prose, "x" * 150_000 + " end", prose[: bpe.CHUNK_CHARS], prose[: bpe.CHUNK_CHARS + 1], prose]
    docs = spark.createDataFrame(list(enumerate(texts)), TWO)
    assert digests(docs) == [(i, *expected(library, t)) for i, t in enumerate(texts)]


def test_overlap_must_fit(spark, empty):
    with pytest.raises(ValueError):
        bpe.encode(empty, PATH, PATTERN, chunk=8, overlap=9)
