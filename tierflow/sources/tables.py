"""Log, observation and metric views derived from the generic test tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Columns of the tables in use, so that opening one starts no job.
SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "labels": "doc_id long, quality int, toxic int",
    "customer": "c_custkey long, c_name string",
    "nation": "n_nationkey int, n_name string",
}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{directory}/{name}.parquet")


def table_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The same table as a file stream."""
    return (
        spark.readStream.schema(SCHEMAS[name])
        .option("pathGlobFilter", f"{name}.parquet")
        .option("maxFilesPerTrigger", 1)
        .parquet(directory)
    )


def arriving(spark: SparkSession, directory: str, folder: str, parts: int):
    """``events`` arriving in a folder, in ``parts`` steps of their ids.

    Yields a stream over the folder after each step's files were written.
    """
    events = table(spark, directory, "events")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    step = F.floor((F.col("event_id") - F.lit(low or 0)) * parts / (F.lit((high or 0) - (low or 0)) + 1))
    for part in range(parts):
        events.where(step == part).write.mode("append").parquet(folder)
        yield part, spark.readStream.schema(SCHEMAS["events"]).parquet(folder)


def logs(spark: SparkSession, directory: str) -> DataFrame:
    """Every event as a log entry.  ``ts`` stays a timestamp without zone."""
    return as_logs(table(spark, directory, "events"))


def as_logs(events: DataFrame) -> DataFrame:
    user = F.col("user_id")
    event = F.col("event_id")
    kind = F.col("event_type")
    user_text = user.cast("string")
    level = (
        F.when((kind == "error") & (event % 5 == 0), "crit")
        .when(kind == "error", "ERROR")
        .when(kind == "purchase", "WARN")
        .when(kind == "signup", "notice")
        .when(kind == "view", "INFO")
    )
    component = (
        F.when(user % 7 == 0, "kernel")
        .when(user % 7 == 1, "sshd")
        .when(user % 7 == 2, "dfs.DataNode")
        .otherwise("app")
    )
    source = (
        F.when(user % 6 == 0, "OpenSSH")
        .when(user % 6 == 1, "Apache")
        .when(user % 6 == 2, "HDFS")
        .when(user % 6 == 3, "Linux")
        .otherwise("Spark")
    )
    message = event % 17
    content = (
        F.when(message == 0, F.concat(F.lit("Login attempt by user "), user_text))
        .when(message == 3, "open /home/app/cfg: Permission denied")
        .when(message == 5, F.concat(F.lit("request failed props="), "props"))
        .when(message == 7, F.concat(F.lit("sessionId="), user_text))
        .otherwise(F.concat(kind, F.lit(" by user "), user_text, F.lit(" "), "props"))
    )
    return events.select(
        event.alias("log_id"),
        "ts",
        event.cast("string").alias("LineId"),
        F.date_format("ts", "HH:mm:ss").alias("Time"),
        F.date_format("ts", "yyyy-MM-dd").alias("Date"),
        level.alias("Level"),
        component.alias("Component"),
        source.alias("LogSource"),
        F.concat(F.lit("node-"), (user % 10).cast("string")).alias("Node"),
        F.concat(F.lit("E"), (event % 50).cast("string")).alias("EventId"),
        F.concat(kind, F.lit(" <*> by <*>")).alias("EventTemplate"),
        content.alias("Content"),
    )


def observations(spark: SparkSession, directory: str) -> DataFrame:
    """Measured outcome of every log at every tier."""
    event = F.col("event_id")
    code = F.col("tier.code")
    failing = F.col("event_type") == "error"
    factor = (
        F.when(code == 0, F.when(failing, 3.0).otherwise(1.0))
        .when(code == 1, F.when(failing, 1.0).otherwise(2.0))
        .otherwise(2.5)
    )
    tiers = F.array(
        *[
            F.struct(F.lit(i).alias("code"), F.lit(name).alias("name"))
            for i, name in enumerate(("mysql", "elk", "ipfs"))
        ]
    )
    return (
        table(spark, directory, "events")
        .select("event_id", "event_type", "value", F.explode(tiers).alias("tier"))
        .select(
            event.alias("log_id"),
            F.col("tier.name").alias("destination"),
            ((event * 13 + code) % 101 != 0).alias("success"),
            (((event * 7 + code) % 40).cast("double") / 100.0).alias("routing_latency_ms"),
            (F.col("value") * factor).alias("backend_write_latency_ms"),
            (((event * 31 + code * 17) % 1000).cast("double") / 10000.0).alias("energy_cpu_pkg_j"),
        )
    )


def system_metrics(spark: SparkSession, directory: str) -> DataFrame:
    """Six load readings per node and hour, stamped at the end of the hour."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    return (
        table(spark, directory, "events")
        .groupBy(
            F.concat(F.lit("node-"), (F.col("user_id") % 10).cast("string")).alias("node"),
            hour.alias("hour"),
        )
        .agg(
            F.round(F.avg("value") + 1e-6, 4).alias("cpu_pct"),
            F.max("value").alias("mem_pct"),
            F.count("*").cast("double").alias("active_jobs"),
            F.sum(F.when(kind == "view", 1.0).otherwise(0.0)).alias("load_relational"),
            F.sum(F.when(kind == "error", 1.0).otherwise(0.0)).alias("load_search"),
            F.sum(F.when(kind == "purchase", 1.0).otherwise(0.0)).alias("load_content"),
        )
        .withColumn("ts", (F.col("hour") + F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz"))
        .drop("hour")
    )


def power_samples(spark: SparkSession, directory: str) -> DataFrame:
    """Every event as a power reading in watts of its node."""
    return table(spark, directory, "events").select(
        F.concat(F.lit("node-"), (F.col("user_id") % 10).cast("string")).alias("host"),
        seconds("ts").alias("ts"),
        F.col("value").alias("watts"),
    )


def counter_readings(spark: SparkSession, directory: str) -> DataFrame:
    """Every event as a reading of a cumulative energy counter that wraps."""
    kind = F.col("event_type")
    domain = (
        F.when(kind == "view", "package-0")
        .when(kind == "click", "package-0:core")
        .when(kind == "error", "package-1")
        .when(kind == "signup", "psys")
        .otherwise("dram")
    )
    rate = F.when(kind == "signup", 900).otherwise(370)
    return table(spark, directory, "events").select(
        F.concat(F.lit("node-"), (F.col("user_id") % 10).cast("string")).alias("host"),
        domain.alias("domain"),
        F.col("event_id").alias("seq"),
        "ts",
        ((F.floor(seconds("ts")) * rate) % 50_000_000).cast("long").alias("energy_uj"),
    )


def seconds(column: str):
    """Seconds since 1970 with fraction, of a timestamp in UTC."""
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


def reward_history(spark: SparkSession, directory: str) -> DataFrame:
    """One run per event type, one episode per hour, reward = sum of value."""
    return (
        table(spark, directory, "events")
        .groupBy(
            F.col("event_type").alias("run"),
            F.floor(seconds("ts") / 3600).cast("long").alias("episode"),
        )
        .agg(F.round(F.sum("value"), 4).alias("reward"))
    )
