"""Text vectors, computed once per distinct text.

An encoder turns a table ``key, text`` into ``key, embedding``.  The default
averages hashed word vectors.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.functions.text import WHITESPACE, content_key, md5_number

Encoder = Callable[[DataFrame], DataFrame]
EMBEDDING_SCHEMA = "key string, embedding array<float>"


def hashed_words(dim: int) -> Encoder:
    """Mean of one-hot word vectors, words placed by MD5; empty text gives zeros.

    Built-in expressions only; the weight of a slot is its share of the words.
    Texts come grouped by key, so counting their words moves nothing.
    """

    def encode(texts: DataFrame) -> DataFrame:
        words = F.filter(F.split("text", " "), lambda w: w != "")
        placed = texts.select("key", F.explode_outer(words).alias("_word")).select(
            "key", (md5_number(F.col("_word")) % dim).alias("_slot")
        )
        size = F.greatest(F.count("_slot"), F.lit(1))
        shares = [(F.count_if(F.col("_slot") == d) / size).cast("float") for d in range(dim)]
        return placed.groupBy("key").agg(F.array(*shares).alias("embedding"))

    return encode


def python_encoder(encode: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Encoder:
    """An encoder from a function over pandas batches ``key, text``."""
    return lambda texts: texts.select("key", "text").mapInPandas(encode, EMBEDDING_SCHEMA)


def distinct_texts(df: DataFrame, text: Column, namespace: str) -> DataFrame:
    """Each normalised text once with its key; copies combine before the shuffle."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " "))
    keyed = df.select(content_key(text, namespace).alias("key"), F.lower(squeezed).alias("text"))
    return keyed.groupBy("key").agg(F.first("text").alias("text"))


def missing(texts: DataFrame, cache: DataFrame | None) -> DataFrame:
    """Texts whose key is not cached."""
    return texts if cache is None else texts.join(cache.select("key"), "key", "left_anti")


def embed_texts(
    df: DataFrame,
    text: Column,
    namespace: str,
    encoder: Encoder,
    cache: DataFrame | None = None,
) -> DataFrame:
    """Vectors ``key, embedding`` of every distinct text, cached ones reused.

    Texts are grouped by key once and encoded where they then are; a cache
    should be a stored table, since it is read twice.
    """
    texts = distinct_texts(df, text, namespace)
    fresh = encoder(missing(texts, cache))
    if cache is None:
        return fresh
    known = cache.join(texts.select("key"), "key", "left_semi")
    return known.select("key", "embedding").unionByName(fresh)


def append_to_cache(
    spark: SparkSession, path: str, df: DataFrame, text: Column, namespace: str, encoder: Encoder
) -> DataFrame:
    """Encode the texts that the cache at ``path`` lacks, store them, return it all.

    A text is encoded once in the life of a cache.
    """
    try:
        cache = spark.read.schema(EMBEDDING_SCHEMA).parquet(path)
    except AnalysisException:
        cache = None
    fresh = encoder(missing(distinct_texts(df, text, namespace), cache))
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(EMBEDDING_SCHEMA).parquet(path)


def attach_embeddings(df: DataFrame, text: Column, namespace: str, vectors: DataFrame) -> DataFrame:
    """Join vectors back; a text shared by very many rows is a skewed key, which
    adaptive execution splits."""
    keyed = df.withColumn("key", content_key(text, namespace))
    return keyed.join(vectors, "key", "left")
