"""CSV files of one folder whose headers differ, with broken ones set aside."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tierflow.runtime import cut_lineage

CSV = {"sep": ",", "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}


@dataclass(frozen=True)
class Scan:
    """``rows``: the wanted columns as text and ``path``; null where a file lacks one.
    ``files_aside``: ``path, header, reason`` of files not read.
    ``rows_aside``: ``path, line, reason`` of lines that do not fit their header."""

    rows: DataFrame
    files_aside: DataFrame
    rows_aside: DataFrame


def headers(spark: SparkSession, path: str) -> DataFrame:
    """``path, header`` of every file.  Spark's listing leaves out files of no bytes.

    One job over the listing and the first stretch of each file.  A file is
    read in order, so its first line has the smallest number in its task.
    """
    files = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("path")
    )
    lines = spark.read.text(path).where("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("path"),
        "value",
        F.monotonically_increasing_id().alias("_place"),
    )
    first = lines.groupBy("path").agg(F.min_by("value", "_place").alias("header"))
    bare = F.regexp_replace("header", "^\uFEFF|\r$", "")
    return files.join(first, "path", "left").withColumn("header", bare)


def columns_of(header: Column) -> Column:
    """Names in a header line, an array."""
    cells = F.split(header, ",")
    return F.transform(cells, lambda c: F.trim(F.regexp_replace(c, '^\\s*"|"\\s*$', "")))


def read_mixed(
    spark: SparkSession, path: str, wanted: Sequence[str], needed: Sequence[str] = ()
) -> Scan:
    """Read all files of ``path`` in one scan, each by its own header.

    Files are set aside when their first line is empty, when they name a column twice or lack one of
    ``needed``; lines when they have more or fewer cells than their header.
    Other files and lines are read.  A line that repeats its file's header is
    a header.  Quoted line breaks are not supported: such files are for
    ``read_logs`` with ``multiline``.

    The driver sees one text per distinct header, never the list of files.
    """
    known = headers(spark, path)
    names = columns_of(F.col("header"))
    lacking = F.array_except(F.array(*[F.lit(n) for n in needed]).cast("array<string>"), names)
    reason = (
        F.when(F.col("header").isNull() | (F.trim("header") == ""), "empty")
        .when(F.size(F.array_distinct(names)) < F.size(names), "column named twice")
        .when(F.size(lacking) > 0, F.concat(F.lit("lacks "), F.concat_ws(", ", lacking)))
    )
    listed = cut_lineage(known.withColumn("reason", reason))
    fit = listed.where("reason IS NULL").select("path", "header")
    layouts = [r[0] for r in fit.select("header").distinct().orderBy("header").collect()]

    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r$", "").alias("line")
    )
    bare = F.regexp_replace("line", "^\uFEFF", "")
    lines = lines.join(fit, "path").where((bare != F.col("header")) & (F.col("line") != ""))

    out = StructType()
    for name in ("_broken", *wanted):
        out.add(name, StringType())

    def parsed(header: str) -> Column:
        found = [c.strip().strip('"') for c in header.split(",")]
        # Places, not names: a header may differ in case or use odd characters.
        schema = ", ".join([*[f"c{i} string" for i in range(len(found))], "_broken string"])
        row = F.from_csv("line", schema, CSV)
        cells = [
            (row[f"c{found.index(n)}"] if n in found else F.lit(None).cast("string")).alias(n)
            for n in wanted
        ]
        return F.struct(row["_broken"].alias("_broken"), *cells)

    record = F.lit(None).cast(out)
    for header in layouts:
        record = F.when(F.col("header") == header, parsed(header)).otherwise(record)
    read = lines.select("path", "line", record.alias("_r"))
    return Scan(
        read.where("_r._broken IS NULL").select("path", *[F.col(f"_r.`{n}`").alias(n) for n in wanted]),
        listed.where("reason IS NOT NULL").select("path", "header", "reason"),
        read.where("_r._broken IS NOT NULL").select(
            "path", "line", F.lit("other number of cells than its header").alias("reason")
        ),
    )
