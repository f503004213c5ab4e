"""Quality rules: one threshold table becomes one Spark projection.

Every rule is a ratio of two measures and the range it must stay in.  All
measures are built-in expressions over the words and lines of the whole text,
so the projection runs inside the scan, without a shuffle and without user
functions.  Repeated windows are found by ordering a document's own windows;
the work per document is n log n in its words.

Defined results: a null text has no words and fails the base rules; an empty
text likewise; ties and repeated rows are judged row by row; an empty table
stays empty.  Columns of the input never meet the computed ones, since the row
travels as one struct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.llm.tables import BLANK

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it was for with as on be at by this are or "
    "der die das und ist von mit den für auf nicht ein eine im zu "
    "le la les de des et en un une est pour dans que qui par "
    "el los las del y una es por con para se no su"
).split()

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``low <= top / bottom <= high``; checked without division."""

    name: str
    top: str
    bottom: str
    low: float | None = None
    high: float | None = None

    def holds(self, measures: dict[str, Column]) -> Column:
        top, bottom = measures[self.top], measures[self.bottom]
        within = F.lit(True)
        if self.low is not None:
            within = within & (top >= F.lit(float(self.low)) * bottom)
        if self.high is not None:
            within = within & (top <= F.lit(float(self.high)) * bottom)
        return within


# The base rules every text must pass first.
BASE = (
    Rule("words", "n_words", "one", low=50),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.5),
)

# Length, symbol, stop-word and line ratios.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2, high=20),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.01),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice."""
    count = F.size(words)
    windows = F.transform(
        F.arrays_zip(
            F.slice(words, 1, F.greatest(count - 2, F.lit(0))).alias("a"),
            F.slice(words, 2, F.greatest(count - 2, F.lit(0))).alias("b"),
            F.slice(words, 3, F.greatest(count - 2, F.lit(0))).alias("c"),
        ),
        lambda w, i: F.struct(F.concat_ws(" ", w["a"], w["b"], w["c"]).alias("w"), i.alias("i")),
    )
    return F.sort_array(windows)


def _twice(ordered: Column) -> Column:
    """Positions of windows whose neighbour in the order is equal."""
    neighbours = F.zip_with(
        ordered,
        F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))),
        lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])),
    )
    return F.array_distinct(F.flatten(F.filter(neighbours, lambda p: p.isNotNull())))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row as struct ``row`` with its measures beside it."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    body = F.coalesce(F.col("row")[text], F.lit(""))
    split = rows.select(
        "row",
        F.filter(F.split(body, f"{BLANK}+"), lambda w: w != "").alias("words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).alias("n_symbols"),
    )
    ordered = split.select(
        "row",
        "n_symbols",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(
            F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))
        ).alias("n_stop_words"),
        _repeat_words(F.col("words")).alias("ordered"),
    )
    marked = ordered.select(*[c for c in ordered.columns if c != "ordered"], _twice(F.col("ordered")).alias("at"))
    covered = F.concat(
        F.col("at"), F.transform("at", lambda i: i + 1), F.transform("at", lambda i: i + 2)
    )
    return marked.select(
        *[c for c in marked.columns if c != "at"],
        F.size(F.array_distinct(covered)).alias("n_repeat_words"),
    ).select(
        "row",
        *[
            F.col(c).cast("long").alias(c)
            for c in (
                "n_words word_chars n_symbols n_lines n_dup_lines n_stop_words n_repeat_words"
            ).split()
        ],
    )


def judged(
    docs: DataFrame,
    text: str = "text",
    base: tuple[Rule, ...] = BASE,
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """Measures, ``base_failed``, the failed rules by name, and ``kept``."""
    rows = measured(docs, text)
    measures = {c: F.col(c) for c in rows.columns if c != "row"} | {"one": F.lit(1)}
    holds = {r.name: r.holds(measures) for r in (*base, *rules)}
    base_ok, rules_ok = F.lit(True), F.lit(True)
    for rule in base:
        base_ok = base_ok & holds[rule.name]
    for rule in rules:
        rules_ok = rules_ok & holds[rule.name]
    failed = F.array_compact(
        F.array(*[F.when(~ok, F.lit(name)) for name, ok in holds.items()])
    )
    return rows.select(
        "*",
        (~base_ok).alias("base_failed"),
        failed.alias("failed_rules"),
        (base_ok & rules_ok).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass every rule, with their own columns.

    The verdict passes a generator, so that the filter stays above the measures;
    pushed below, it would compute each of them again and again.
    """
    verdicts = judged(docs, text).select(F.struct("row", "kept").alias("one"))
    return (
        verdicts.select(F.explode(F.array("one")).alias("one"))
        .filter("one.kept")
        .select("one.row.*")
    )
