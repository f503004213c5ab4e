"""Compliance patterns from a table of any size, matched by how they start.

One expression per pattern does not carry far.  Here a place in a text meets
the patterns' starts, runs of three characters, and only their shapes: which
lengths patterns of this start have, and on which characters these end.  Each
shape that fits cuts one string out of the text, and the strings meet the
patterns by equality.  A place thus gives at most one string per length, however
many patterns share its characters.  Patterns of one or two characters are
their own start.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.functions.text import COMPLIANCE_LEVELS, compliance_text
from tierflow.runtime import cut_lineage

GRAM = 3
# Characters of a text that are searched at once, or the longest pattern's.
WINDOW = 1_024


def runs(text: Column, size: int) -> Column:
    """The run of ``size`` characters at each place that has one, in order."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))


def starts_of(named: DataFrame, gram: int = GRAM) -> DataFrame:
    """``start, shapes``: lengths of the keys with this start, and their last characters."""
    return (
        named.groupBy(F.substring("key", 1, gram).alias("start"), F.length("key").alias("length"))
        .agg(F.collect_set(F.right("key", F.lit(1))).alias("ends"))
        .groupBy("start")
        .agg(F.collect_list(F.struct("length", "ends")).alias("shapes"))
    )


def cut_strings(texts: DataFrame, starts: DataFrame) -> DataFrame:
    """``log_id, key`` for every string of a text that has some pattern's shape.

    ``starts`` is stored.  Long texts are cut into windows that overlap by the
    longest pattern.
    """
    wide = starts.agg(
        F.collect_set(F.length("start")).alias("sizes"),
        F.max(F.array_max(F.transform("shapes", lambda s: s["length"]))).alias("longest"),
    ).first()
    if not wide.sizes:
        return texts.select("log_id", F.col("text").alias("key")).where(F.lit(False))
    step = max(WINDOW, wide.longest)
    last = F.greatest(F.lit(0), F.floor((F.length("text") - 1) / step).cast("int"))
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.substring(F.col("text"), i * step + 1, F.lit(step + wide.longest - 1)),
    )
    each = F.array(*[runs(F.col("part"), s) for s in sorted(wide.sizes)])
    places = (
        texts.select("log_id", F.explode(windows).alias("part"))
        .select("log_id", "part", F.explode(each).alias("runs"))
        .select("log_id", "part", F.posexplode("runs").alias("place", "start"))
    )
    shaped = places.join(starts, "start").select(
        "log_id", "part", "place", F.explode("shapes").alias("shape")
    )
    key = F.substring(F.col("part"), F.col("place") + 1, F.col("shape.length"))
    return (
        shaped.select("log_id", "shape", key.alias("key"))
        .where(F.length("key") == F.col("shape.length"))
        .where(F.array_contains("shape.ends", F.right("key", F.lit(1))))
        .select("log_id", "key")
    )


def pattern_matches(logs: DataFrame, patterns: DataFrame, gram: int = GRAM) -> DataFrame:
    """``log_id, pattern`` for every pattern that is a literal part of a log's text.

    ``patterns`` has ``pattern``; case does not count, and of spellings that
    differ in case alone the smallest is named.  Empty and null patterns match
    nothing; a null text is empty; a log without an id is left out.
    """
    named = cut_lineage(
        patterns.where("pattern <> ''")
        .groupBy(F.lower("pattern").alias("key"))
        .agg(F.min("pattern").alias("pattern"))
    )
    texts = logs.where("log_id IS NOT NULL").select("log_id", compliance_text().alias("text"))
    strings = cut_strings(texts, cut_lineage(starts_of(named, gram)))
    return strings.join(named, "key").select("log_id", "pattern").distinct()


def flag_by_table(logs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``logs`` with ``sensitive``: a sensitive level, or any pattern of the table."""
    hit = pattern_matches(logs, patterns).select("log_id").distinct().withColumn("_hit", F.lit(True))
    level = F.lower(F.coalesce(F.col("Level"), F.lit(""))).isin(*COMPLIANCE_LEVELS)
    return (
        logs.join(hit, "log_id", "left")
        .withColumn("sensitive", level | F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )
