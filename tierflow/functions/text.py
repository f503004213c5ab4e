"""Text predicates and keys over log columns, all native expressions."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default substrings that mark a log as sensitive.
DEFAULT_PATTERNS = (
    "sessionid",
    "token",
    "secret key",
    "permission denied",
    "login",
    "/home/",
)

# Levels that mark a log as sensitive for compliance.
COMPLIANCE_LEVELS = ("error", "crit", "alert", "emerg")

# Words that mark a log as sensitive for the reward.
REWARD_KEYWORDS = ("sshd", "kernel", "denied", "fail", "unauthorized", "forbidden")

# Fixed value: white space at both ends of a user pattern.
EDGES = r"^[\t-\r\x1c-\x1f\x85\p{Z}]+|[\t-\r\x1c-\x1f\x85\p{Z}]+$"

# Fixed value: what counts as white space when a content key is built
# (every Unicode separator, not only the ASCII ones).
WHITESPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]+"


def safe_lower(column: Column) -> Column:
    """Lower case; null, NaN and the text ``nan`` become the empty string."""
    lowered = F.lower(column.cast("string"))
    return F.when(lowered == "nan", "").otherwise(F.coalesce(lowered, F.lit("")))


def merge_patterns(user_patterns: Sequence[str] = ()) -> list[str]:
    """Defaults, then user patterns: trimmed, non-empty, first spelling kept."""
    merged = {}
    for pattern in (*DEFAULT_PATTERNS, *user_patterns):
        if pattern.strip():
            merged.setdefault(pattern.strip().lower(), pattern.strip())
    return list(merged.values())


def merge_pattern_table(user_patterns: DataFrame) -> DataFrame:
    """The same merge for a pattern table ``(ord, pattern)`` of any size.

    Defaults rank before every user pattern.  Grouping keeps one candidate per
    spelling and map task, so a pattern listed very often is no hot spot.
    """
    spark = user_patterns.sparkSession
    defaults = spark.createDataFrame(
        [(i - len(DEFAULT_PATTERNS), p) for i, p in enumerate(DEFAULT_PATTERNS)],
        "ord long, pattern string",
    )
    trimmed = F.regexp_replace("pattern", EDGES, "")
    return (
        defaults.unionByName(user_patterns.select(F.col("ord").cast("long"), "pattern"))
        .select("ord", trimmed.alias("pattern"), F.lower(trimmed).alias("key"))
        .where("pattern <> ''")
        .groupBy("key")
        .agg(F.min(F.struct("ord", "pattern")).alias("first"))
        .select("first.ord", "first.pattern")
    )


def compliance_text() -> Column:
    """Content, template and component in one lower-case text, gaps kept."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("Content", "EventTemplate", "Component")]
    return F.lower(F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2]))


def is_sensitive(patterns: Sequence[str] | None = None) -> Column:
    """Compliance predicate: a sensitive level or any literal substring."""
    level = F.lower(F.coalesce(F.col("Level"), F.lit("")))
    text = compliance_text()
    hits = [text.contains(p.lower()) for p in (patterns or merge_patterns())]
    return reduce(Column.__or__, hits, level.isin(*COMPLIANCE_LEVELS))


def matching_patterns(patterns: Sequence[str] | None = None) -> Column:
    """Array of the patterns that occur in the log."""
    text = compliance_text()
    return F.array_compact(
        F.array(*[F.when(text.contains(p.lower()), F.lit(p)) for p in (patterns or merge_patterns())])
    )


def is_sensitive_for_reward() -> Column:
    """The reward's own predicate: level, kernel component, or key words."""
    content = safe_lower(F.col("Content"))
    rules = [content.contains(word) for word in REWARD_KEYWORDS]
    start = safe_lower(F.col("Level")).isin(*COMPLIANCE_LEVELS) | (
        safe_lower(F.col("Component")) == "kernel"
    )
    return reduce(Column.__or__, rules, start)


def payload_bytes(column: Column) -> Column:
    """UTF-8 length of the text, 0 for null."""
    return F.octet_length(F.coalesce(column, F.lit(""))).cast("long")


def content_key(column: Column, namespace: str) -> Column:
    """Cache key of a text: namespace and white-space-normalised text, SHA-1."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), WHITESPACE, " "))
    return F.sha1(F.concat(F.lit(namespace + "\n"), squeezed))


def raw_content_key(column: Column) -> Column:
    """Cache key without normalisation."""
    return F.sha1(F.coalesce(column, F.lit("")))


def content_id(column: Column) -> Column:
    """Content address: the first 46 hex digits of SHA-256."""
    return F.substring(F.sha2(F.coalesce(column, F.lit("")), 256), 1, 46)


def md5_number(column: Column) -> Column:
    """First 32 bits of MD5 as a long: the same in every process and engine."""
    return F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("long")


def hash_bucket(column: Column, buckets: int) -> Column:
    """Portable bucket of an attribute value; null counts as the empty text."""
    return md5_number(F.coalesce(column.cast("string"), F.lit(""))) % buckets


def hash_uniform(salt: str, *columns: Column) -> Column:
    """A number in [0, 10000) drawn by hash, so that reruns draw the same."""
    text = F.concat_ws("|", F.lit(salt), *[c.cast("string") for c in columns])
    return md5_number(text) % 10_000


def hash_sample(probability: float, salt: str, *columns: Column) -> Column:
    """Keep a row with the given probability, decided by hash."""
    return hash_uniform(salt, *columns) < int(round(probability * 10_000))


def safe_double(column: Column) -> Column:
    """Number of a text, null if it is none or NaN."""
    number = column.cast("string").try_cast("double")
    return F.when(~F.isnan(number), number)


def safe_bool(column: Column) -> Column:
    """True only for the word ``true`` in any case."""
    return F.coalesce(F.lower(column.cast("string")) == "true", F.lit(False))
