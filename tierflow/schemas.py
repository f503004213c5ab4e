"""Row shapes shared by every operator."""

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# Tier names in priority order (a tie goes to the earlier one)
# and the action codes that stand for them.
TIERS = ("mysql", "elk", "ipfs")
ACTION_CODES = {"mysql": 0, "elk": 1, "ipfs": 2}

# Attributes the adaptive router may classify by, in tie order.
CBR_ATTRIBUTES = ("Level", "Component", "LogSource")

# The ten text columns of a log entry.
LOG_COLUMNS = (
    "LineId",
    "Time",
    "EventId",
    "Level",
    "EventTemplate",
    "Content",
    "Component",
    "Date",
    "Node",
    "LogSource",
)

LOG_SCHEMA = StructType([StructField(c, StringType()) for c in LOG_COLUMNS])

OBSERVATION_SCHEMA = StructType(
    [
        StructField("log_id", LongType()),
        StructField("destination", StringType()),
        StructField("success", BooleanType()),
        StructField("routing_latency_ms", DoubleType()),
        StructField("backend_write_latency_ms", DoubleType()),
        StructField("energy_cpu_pkg_j", DoubleType()),
    ]
)

TRACE_SCHEMA = StructType(
    [
        StructField("log_id", LongType()),
        StructField("router", StringType()),
        StructField("dataset_name", StringType()),
        StructField("destination", StringType()),
        StructField("raw_destination", StringType()),
        StructField("compliance_forced", BooleanType()),
        StructField("routing_latency_ms", DoubleType()),
        StructField("backend_write_latency_ms", DoubleType()),
        StructField("total_latency_ms", DoubleType()),
        StructField("success", BooleanType()),
        StructField("energy_cpu_pkg_j", DoubleType()),
        StructField("payload_bytes", LongType()),
        StructField("sensitive", BooleanType()),
        StructField("proc_cpu_pct", DoubleType()),
        StructField("proc_rss_mb", DoubleType()),
    ]
)

# Sufficient statistics of the adaptive router: count, mean and summed squares
# about the mean, which merge without loss for costs of any size.
CBR_STATE_SCHEMA = StructType(
    [
        StructField("attr", StringType()),
        StructField("bucket", LongType()),
        StructField("destination", StringType()),
        StructField("n", LongType()),
        StructField("mean", DoubleType()),
        StructField("m2", DoubleType()),
    ]
)

REWARD_SCHEMA = StructType(
    [StructField("episode", LongType()), StructField("reward", DoubleType())]
)
