"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet to the shared folder and reads it again as the next
stage's documents.  All but the last return the columns of ``documents``.

* quality: documents that fail a rule go.
* near duplicates: of each class of linked documents the smallest id stays.
* repeated strings: bytes of 50-byte strings that a smaller id has as well go;
  a document of which nothing is left goes with them.
* mixture: documents are sampled to raked shares of source, language, topic.
* packing: what is left is cut and packed into sequences of 2048 tokens.

Rows with nulls follow the rules of the operators: a null text fails the
quality rules, a null id is never a duplicate.  Rows that repeat an id share
their fate.  An empty table passes through all stages.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tierflow.llm import lsh_forest, mixing, packing, quality, suffix
from tierflow.llm.tables import documents, tokenizer_path
from tierflow.runtime import shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lsh_forest.keep_first(docs)


def repeated_string_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep_sampled(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(docs, tokenizer_path("byte_bpe_50k.json"), end=0))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeated_string_stage),
    ("mixing to target weights", mixture_stage),
    ("best-fit packing", packing_stage),
]

# Verification by sets, byte spans and tokens has no SQL form; the stages are
# tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    docs = documents(spark, sf_dir)
    folder = f"{shared_folder(spark)}/corpus-{uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
