"""Result files: traces, summaries, reward histories."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tierflow.functions.text import safe_bool, safe_double
from tierflow.schemas import REWARD_SCHEMA, TRACE_SCHEMA

# Fixed value: router and data set in a result file's name.
RESULT_NAME = r"^(?:summary_)?(direct_(?:mysql|elk|ipfs)|q_learning|[^_]+)_(.+)\.csv$"


# A result is a file, or a folder of part files that bears the file's name.
RESULT_PATH = r"(?:^|[/=])([^/=]+\.csv)(?:/part-[^/]*)?$"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, RESULT_PATH, 1)


def result_router(name: Column) -> Column:
    return F.regexp_extract(name, RESULT_NAME, 1)


def result_dataset(name: Column) -> Column:
    return F.regexp_extract(name, RESULT_NAME, 2)


def is_summary_name(name: Column) -> Column:
    return name.startswith("summary_")


def write_trace(trace: DataFrame, path: str, file_format: str = "parquet") -> None:
    """One folder per run.  Rows of a run stay spread over many files."""
    writer = trace.write.mode("overwrite").partitionBy("router", "dataset_name")
    writer.option("header", True).format(file_format).save(path)


def write_one_csv(summary: DataFrame, path: str) -> None:
    """A summary, one row per run, as one file with a header."""
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def result_files(spark: SparkSession, glob: str) -> DataFrame:
    """``path, name, is_trace`` of every file; summaries and files of other
    names are no traces.  Reads the listing only."""
    files = spark.read.format("binaryFile").load(glob).select(
        F.col("path"), file_name(F.col("path")).alias("name")
    )
    named = result_router(F.col("name")) != ""
    return files.withColumn("is_trace", named & ~is_summary_name(F.col("name")))


def skipped_files(spark: SparkSession, glob: str) -> DataFrame:
    """Paths that ``read_trace_csv`` leaves out."""
    return result_files(spark, glob).where("NOT is_trace").select("path")


def read_trace_csv(spark: SparkSession, glob: str) -> DataFrame:
    """Trace files of many runs by column name, router and data set taken from
    the file name.

    Numbers that cannot be read are null.  All traces must have the same
    header; files that are no traces are left out, see ``skipped_files``.
    """
    paths = [r["path"] for r in result_files(spark, glob).where("is_trace").collect()]
    if not paths:
        return spark.createDataFrame([], TRACE_SCHEMA)
    options = {"header": "true", "enforceSchema": "false", "mode": "PERMISSIVE"}
    text = StructType()
    for name in spark.read.options(**options).csv(paths).columns:
        text.add(name, StringType())
    rows = spark.read.schema(text).options(**options).csv(paths)
    rows = rows.withColumn("_name", file_name(F.col("_metadata.file_path")))
    parsers = {"double": safe_double, "boolean": safe_bool}

    def typed(field) -> Column:
        kind = field.dataType.simpleString()
        column = F.col(field.name) if field.name in rows.columns else F.lit(None).cast("string")
        if kind == "bigint":
            return column.try_cast("long").alias(field.name)
        return (parsers[kind](column) if kind in parsers else column).alias(field.name)

    named = {"router": result_router(F.col("_name")), "dataset_name": result_dataset(F.col("_name"))}
    return rows.select(
        *[named[f.name].alias(f.name) if f.name in named else typed(f) for f in TRACE_SCHEMA]
    )


def summary_dataset(path: Column) -> Column:
    """Data set of a combined summary's path."""
    return F.regexp_extract(path, r"combined_summary_(.+)\.csv$", 1)


def under_compliance(path: Column) -> Column:
    return path.contains("compliance")


def merge_summaries(summaries: Sequence[DataFrame], path: str = "path") -> DataFrame:
    """Combined summaries of several runs in one table.

    A column that one of them lacks is null there; ``dataset`` and
    ``compliance`` come from the path each row was read from.
    """
    merged = summaries[0]
    for other in summaries[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged.withColumn("dataset", summary_dataset(F.col(path))).withColumn(
        "compliance", under_compliance(F.col(path))
    )


# Columns of a combined summary that are counts or names; the
# others are numbers.
SUMMARY_COUNTS = ("rows", "sensitive_total", "sensitive_to_ipfs", "sensitive_leakage")
SUMMARY_NAMES = ("router", "dataset_name", "dataset")


def read_summaries(spark: SparkSession, glob: str) -> DataFrame:
    """Combined summary files by column name, with the path of each row."""
    options = {"header": "true", "enforceSchema": "false"}
    text = StructType()
    for name in spark.read.options(**options).csv(glob).columns:
        text.add(name, StringType())
    rows = spark.read.schema(text).options(**options).csv(glob)

    def typed(name: str) -> Column:
        if name in SUMMARY_NAMES:
            return F.col(name)
        kind = "long" if name in SUMMARY_COUNTS else "double"
        return F.col(name).try_cast(kind).alias(name)

    return rows.select(*[typed(n) for n in text.names], F.col("_metadata.file_path").alias("path"))


def markdown_rows(summary: DataFrame, columns: Sequence[str], decimals: int = 6) -> DataFrame:
    """Each row as a line of a Markdown table, numbers with fixed decimals."""

    def cell(name: str) -> Column:
        kind = dict(summary.dtypes)[name]
        if kind == "double":
            return F.col(name).cast(f"decimal(28,{decimals})").cast("string")
        return F.col(name).cast("string")

    cells = [F.coalesce(cell(c), F.lit("")) for c in columns]
    return summary.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_header(columns: Sequence[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "| " + " | ".join(["---"] * len(columns)) + " |"]


def write_markdown(summary: DataFrame, columns: Sequence[str], title: str, path: str) -> None:
    """Title, header and rows in order in one text file; for a few rows only."""
    spark = summary.sparkSession
    head = [f"# {title}", "", *markdown_header(columns)]
    numbered = [(i - len(head), line) for i, line in enumerate(head)]
    first = spark.createDataFrame(numbered, "ord long, line string")
    rows = markdown_rows(summary, columns).select(F.lit(0).cast("long").alias("ord"), "line")
    ordered = first.unionByName(rows).coalesce(1).sortWithinPartitions("ord", "line")
    ordered.select("line").write.mode("overwrite").text(path)


def write_rewards(history: DataFrame, path: str) -> None:
    """Files in order of episodes."""
    history.select(*REWARD_SCHEMA.names).orderBy("episode").write.mode("overwrite").option(
        "header", True
    ).csv(path)


def read_rewards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REWARD_SCHEMA).option("header", True).csv(path)


def write_events(events: DataFrame, path: str) -> None:
    """Exploration cuts as JSON lines."""
    events.select("episode", "epsilon").orderBy("episode").write.mode("overwrite").json(path)
