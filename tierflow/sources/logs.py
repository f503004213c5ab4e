"""Log scans: CSV files with a header, every column text."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tierflow.schemas import LOG_COLUMNS

# A file's number stands above the line number in an id.
LINE_BITS = 40


def _options(multiline: bool) -> dict[str, str]:
    return {
        "header": "true",
        "encoding": "UTF-8",
        "escape": '"',
        "multiLine": str(multiline).lower(),
        # A file whose header differs from the schema is an error, not a mix-up.
        "enforceSchema": "false",
    }


def header(spark: SparkSession, path: str, multiline: bool = False) -> StructType:
    """Columns of a path's files, all text, in the order of the first file."""
    names = spark.read.options(**_options(multiline)).csv(path).columns
    schema = StructType()
    for name in names:
        schema.add(name, StringType())
    return schema


def by_name(rows: DataFrame, names: Sequence[str]) -> list[Column]:
    """The named columns; empty text where a file has none or an empty cell."""
    return [
        (F.coalesce(F.col(f"`{n}`"), F.lit("")) if n in rows.columns else F.lit("")).alias(n)
        for n in names
    ]


def file_numbers(spark: SparkSession, path: str) -> DataFrame:
    """``path, number``: the files of a path in order of their names.

    Reads the listing only; one row per file.
    """
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("path")
    )
    return files.withColumn("number", F.row_number().over(Window.orderBy("path")) - 1)


def read_logs(
    spark: SparkSession, path: str, multiline: bool = False, ids: str = "file"
) -> DataFrame:
    """Scan log files by column name; an empty cell is the empty text.

    All files of ``path`` must have the same header, in any order of columns;
    files with other layouts are read by calls of their own.  ``multiline`` is
    for quoted line breaks only: such a file cannot be split.

    ``log_id`` orders the stream.  With ``ids="file"`` it joins the number of
    the file, by name, and the line number, which may start anew in each file;
    ``"line"`` takes the line number alone.
    """
    rows = spark.read.schema(header(spark, path, multiline)).options(**_options(multiline)).csv(path)
    line = F.col("LineId").try_cast("long")
    named = rows.select(*by_name(rows, LOG_COLUMNS), F.col("_metadata.file_path").alias("_path"))
    if ids == "line":
        return named.withColumn("log_id", line).drop("_path")
    if ids != "file":
        raise ValueError(f"unknown ids: {ids}")
    numbers = file_numbers(spark, path).withColumnRenamed("path", "_path")
    return (
        named.join(numbers, "_path", "left")
        .withColumn("log_id", F.shiftleft(F.col("number").cast("long"), LINE_BITS) + line)
        .drop("_path", "number")
    )


def stream_logs(
    spark: SparkSession, path: str, files_per_trigger: int = 1, ids: str = "file"
) -> DataFrame:
    """The same scan as a stream over a folder.

    Files that arrive later have no number yet: with ``ids="file"`` the id is a
    63-bit hash of file and line, the same whenever a batch runs again.
    """
    rows = (
        spark.readStream.schema(header(spark, path))
        .options(**_options(False))
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(path)
    )
    line = F.col("LineId").try_cast("long")
    named = rows.select(*by_name(rows, LOG_COLUMNS), F.col("_metadata.file_path").alias("_path"))
    hashed = F.when(
        line.isNotNull(), F.shiftrightunsigned(F.xxhash64("_path", line), 1)
    )
    return named.withColumn("log_id", line if ids == "line" else hashed).drop("_path")


def event_time(formats: dict[str, str], column: str = "Time") -> Column:
    """Timestamp by the first format whose shape the text has, else null.

    ``formats`` maps a regular expression to a datetime pattern.
    """
    parsed = [
        F.when(F.col(column).rlike(shape), F.try_to_timestamp(F.col(column), F.lit(pattern)))
        for shape, pattern in formats.items()
    ]
    return F.coalesce(*parsed)


def select_log_columns(df: DataFrame) -> DataFrame:
    return df.select("log_id", *LOG_COLUMNS)
