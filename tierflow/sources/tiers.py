"""What each storage tier keeps of a log."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from tierflow.functions.text import content_id, payload_bytes

# Relational columns, where they come from, and their widths
# (characters; the message is limited in bytes).
RELATIONAL = {
    "log_timestamp": ("Time", 255),
    "log_level": ("Level", 32),
    "source_host": ("Node", 255),
    "service_name": ("Component", 128),
    "log_message": ("Content", 65_535),
}

# Longest keyword the search tier indexes, by field.
KEYWORDS = {"Date": 512, "Time": 512, "Level": 256, "Component": 512, "LogSource": 512}


def relational_rows(logs: DataFrame) -> DataFrame:
    """Five columns, empty text as null; ``overflow`` marks rows to reject."""
    rows = logs.select(
        "log_id",
        *[F.nullif(F.col(source), F.lit("")).alias(name) for name, (source, _) in RELATIONAL.items()],
    )

    def too_wide(name: str, width: int) -> Column:
        size = F.octet_length(name) if name == "log_message" else F.length(name)
        return F.coalesce(size > width, F.lit(False))

    wide = [too_wide(name, width) for name, (_, width) in RELATIONAL.items()]
    return rows.withColumn("overflow", reduce(Column.__or__, wide))


def json_safe(column: str, schema: StructType) -> Column:
    """NaN and infinite numbers become null, everything else stays."""
    if isinstance(schema[column].dataType, (DoubleType, FloatType)):
        value = F.col(column)
        bad = F.isnan(value) | (F.abs(value) == float("inf"))
        return F.when(~bad, value).alias(column)
    return F.col(column)


def search_documents(logs: DataFrame, columns: list[str]) -> DataFrame:
    """The whole entry as one JSON document, and the indexed keywords."""
    document = F.to_json(
        F.struct(*[json_safe(c, logs.schema) for c in columns]), {"ignoreNullFields": "false"}
    )
    keywords = [
        F.when(F.length(name) <= width, F.col(name)).alias(f"{name.lower()}_keyword")
        for name, width in KEYWORDS.items()
    ]
    return logs.select("log_id", document.alias("document"), *keywords)


def content_references(logs: DataFrame, text: str = "Content") -> DataFrame:
    """Content address of each log; no shuffle."""
    return logs.select(
        "log_id", content_id(F.col(text)).alias("cid"), payload_bytes(F.col(text)).alias("payload_bytes")
    )


def content_store(logs: DataFrame, text: str = "Content") -> DataFrame:
    """Each content once.  Equal address means equal text, so one text is kept
    per address, and copies combine before the shuffle by address."""
    body = F.coalesce(F.col(text), F.lit(""))
    named = logs.select(content_id(F.col(text)).alias("cid"), body.alias("content"))
    return named.groupBy("cid").agg(F.first("content").alias("content"))


def tier_counts(decided: DataFrame) -> DataFrame:
    """Rows and bytes that each tier receives."""
    return decided.groupBy("destination").agg(
        F.count("*").alias("logs"),
        F.sum(payload_bytes(F.col("Content"))).alias("payload_bytes"),
        F.count_if("compliance_forced").alias("forced"),
    )


def write_tiers(decided: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One pass over the logs, one folder per destination."""
    decided.write.mode(mode).partitionBy("destination").parquet(path)


def write_relational(logs: DataFrame, path: str, rejects: str) -> None:
    """Accepted rows and rejected rows in their own folders."""
    rows = relational_rows(logs)
    rows.where("NOT overflow").drop("overflow").write.mode("overwrite").parquet(path)
    rows.where("overflow").drop("overflow").write.mode("overwrite").parquet(rejects)


def write_tier_shapes(decided: DataFrame, columns: list[str], path: str, part: str = "") -> None:
    """Each log in the shape of its tier, below ``path``.

    ``relational`` and ``relational_rejects`` hold rows, ``search`` holds JSON
    documents, ``references`` the content address of each log and ``content``
    each content once.  ``part`` names a sub-folder, such as a batch; it is
    replaced as a whole.  Keep ``decided`` if it is costly: it is read once for
    each shape.
    """

    def to(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{name}/{part}")

    relational = decided.where("destination = 'mysql'")
    rows = relational_rows(relational)
    to(rows.where("NOT overflow").drop("overflow"), "relational")
    to(rows.where("overflow").drop("overflow"), "relational_rejects")
    to(search_documents(decided.where("destination = 'elk'"), columns), "search")
    immutable = decided.where("destination = 'ipfs'")
    to(content_references(immutable), "references")
    to(content_store(immutable), "content")


def read_tier(spark: SparkSession, path: str, name: str) -> DataFrame:
    """All parts of one shape."""
    return spark.read.parquet(f"{path}/{name}")
