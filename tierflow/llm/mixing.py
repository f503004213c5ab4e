"""Mixing by raking: weights that meet target shares of several marginals.

Tokens are summed by cell, one cell for each combination of the categories.
Iterative proportional fitting scales the cell weights to the target total of
one marginal after the other until all marginals meet their targets.  A
document's factor is its cell's raked weight over the cell's tokens, and it is
kept with a probability in proportion to the factor, the largest factor being
kept whole, so the expected token shares of the sample are the targets.

The documents are read once to make the cells and once to be sampled; the
fitting works on the cells alone, whose number is bounded by the categories.
One category with most rows is combined before the shuffle.

Targets are tables ``(category, share)``.  Defined results: a null category is
a category of its own; a category without a target, or with target 0, gets
weight 0; documents without tokens (null or empty text) have factor 0 and are
not kept; draws use a hash of the id, so repeated rows share their fate and a
null id draws like an empty one; an empty table stays empty; other columns keep
their values, since the row travels as one struct.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierflow.llm.tables import WORD
from tierflow.runtime import cut_lineage

# Largest share of all tokens by which a marginal may miss its target.
TOLERANCE = 1e-12
# Sweeps over all marginals in one job, and in all before a fit that is neither
# met nor proven contradictory is given up as slow.
SWEEPS_A_JOB = 5
MAX_SWEEPS = 5000
# A miss that shrinks by less than this share in a job no longer shrinks; one
# below the second number may do so for rounding alone.
LEAST_SHRINK = 1e-6
ROUNDING = 1e-10
# How often the step of a slow sweep may be made again at once.
JUMPS = [1 << k for k in range(16)]

LOG = logging.getLogger(__name__)


def tokens(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def category(value: Column) -> Column:
    """A category's name; null has a name no text can have."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the MD5 of a key."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Targets in proportion to a power of the present token shares."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("n"))
    raised = F.when(F.col("n") > 0, F.pow("n", F.lit(power))).otherwise(0.0)
    return sums.select(F.col(dim).alias("category"), raised.alias("r")).select(
        "category", (F.col("r") / F.sum("r").over(Window.partitionBy())).alias("share")
    )


def rake(
    cells: DataFrame,
    targets: dict[str, DataFrame],
    tolerance: float = TOLERANCE,
    max_sweeps: int = MAX_SWEEPS,
    strict: bool = True,
) -> DataFrame:
    """``cells`` (categories and ``tokens``) with the raked ``weight``.

    With it ``sweeps``, ``state`` and ``miss``, a struct of the share of all
    tokens by which each marginal misses its targets.  The states:

    * met: every marginal is within the tolerance, or as near as doubles go.
    * contradictory: no weights of the cells meet the targets, which is proven,
      and the miss no longer shrinks.
    * slow: they may be met, but ``max_sweeps`` were not enough.

    The proof: a sweep multiplies categories by exp(d) and so cells by the
    products.  Over any weights x that meet the targets the mean of a cell's
    log growth is the mean of d over the targets, the sweep's gain; so if the
    gain is above the growth of every cell there are no such weights.

    Where a sweep brings little, its step is made again many times at once, as
    long as the likelihood that raking climbs rises; the solution is the same.
    Other states than met raise an error, or without ``strict`` a warning.
    """
    dims = list(targets)
    everything = Window.partitionBy()
    fitted = cells.withColumn("weight", F.col("tokens").cast("double"))
    fitted = fitted.withColumn("total", F.sum("weight").over(everything))
    for dim, target in targets.items():
        named = target.select(
            F.col("category").alias(dim), (F.col("share").cast("double")).alias(f"goal_{dim}")
        )
        fitted = fitted.join(named, dim, "left").fillna(0.0, [f"goal_{dim}"])
    # Categories without tokens can't be met: the others share what they leave.
    for dim in dims:
        met = F.sum(F.col("share_")).over(everything)
        per = Window.partitionBy(dim)
        present = F.when(F.sum("weight").over(per) > 0, F.col(f"goal_{dim}")).otherwise(0.0)
        fitted = fitted.withColumn(
            "share_", present / F.count("*").over(per)
        ).withColumn(
            f"goal_{dim}", F.when(met > 0, present / met * F.col("total")).otherwise(0.0)
        )
    fitted = cut_lineage(fitted.drop("share_"))
    # Cells that may hold weight.
    free = reduce(lambda a, d: a & (F.col(f"goal_{d}") > 0), dims, F.col("tokens") > 0)

    def sweep(df: DataFrame) -> DataFrame:
        df = df.withColumn("growth", F.lit(0.0)).withColumn("gain", F.lit(0.0))
        for dim in dims:
            held = F.sum("weight").over(Window.partitionBy(dim))
            ratio = F.when(held > 0, F.col(f"goal_{dim}") / held).otherwise(0.0)
            df = df.withColumn("ratio", ratio).withColumn("weight", F.col("weight") * F.col("ratio"))
            step = F.when(F.col("ratio") > 0, F.log("ratio")).otherwise(0.0)
            df = df.withColumn("growth", F.col("growth") + step)
            df = df.withColumn("gain", F.col("gain") + F.col("weight") * step / F.col("total"))
        return df.drop("ratio")

    def risen(times: int) -> Column:
        """What the likelihood rises by when the last sweep's step is made again."""
        rest = F.when(F.col("weight") > 0, F.col("weight") * F.expm1(times * F.col("growth"))).otherwise(0.0)
        return (times * F.sum("gain") - F.sum(rest / F.col("total"))).alias(f"risen_{times}")

    done, before, contradictory = 0, None, False
    while True:
        fitted = cut_lineage(reduce(lambda df, _: sweep(df), range(SWEEPS_A_JOB), fitted))
        done += SWEEPS_A_JOB
        held = [F.sum("weight").over(Window.partitionBy(d)) for d in dims]
        misses = fitted.withColumns(
            {f"miss_{d}": F.abs(h - F.col(f"goal_{d}")) / F.col("total") for d, h in zip(dims, held, strict=True)}
        )
        now = misses.agg(
            *[F.max(f"miss_{d}").alias(f"miss_{d}") for d in dims],
            F.sum("gain").alias("gain"),
            F.max(F.when(free, F.col("growth"))).alias("growth"),
            *[risen(t) for t in JUMPS],
        ).first()
        miss = {d: now[f"miss_{d}"] or 0.0 for d in dims}
        worst = max(miss.values())
        shrinks = before is None or worst < before * (1 - LEAST_SHRINK)
        state = "slow"
        if worst <= tolerance or (worst <= ROUNDING and not shrinks):
            state = "met"
        elif now["growth"] is None or now["gain"] > now["growth"] + ROUNDING:
            contradictory = True
        if contradictory and not shrinks and state != "met":
            state = "contradictory"
        if state != "met" and contradictory and done >= max_sweeps:
            state = "contradictory"
        if state != "slow" or done >= max_sweeps:
            break
        if not contradictory and before is not None and worst > before / 2:
            rises = {t: now[f"risen_{t}"] for t in JUMPS}
            best = max(rises, key=rises.get)
            if rises[best] > 0:
                jumped = F.when(F.col("weight") > 0, F.col("weight") * F.exp(best * F.col("growth")))
                fitted = fitted.withColumn("weight", jumped.otherwise(0.0))
        before = worst
    if state != "met":
        said = f"raking missed its targets ({state}) after {done} sweeps, by marginal {miss}"
        if strict:
            raise ValueError(said)
        LOG.warning(said)
    return fitted.select(
        *cells.columns,
        "weight",
        F.lit(done).alias("sweeps"),
        F.lit(state).alias("state"),
        F.struct(*[F.lit(m).alias(d) for d, m in miss.items()]).alias("miss"),
    )


def with_probability(
    docs: DataFrame,
    dims: dict[str, Column],
    powers: dict[str, float] | None = None,
    targets: dict[str, DataFrame] | None = None,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Struct ``row`` with its categories, ``n_tokens``, ``factor``,
    ``probability`` and ``kept``, and ``sweeps``, ``state`` and ``miss`` of the fit.

    ``dims`` names the marginals and gives their expressions over ``docs``;
    each has its targets as a table or as a power of the present shares.
    """
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        *[category(expression).alias(name) for name, expression in dims.items()],
        tokens(docs[text]).alias("n_tokens"),
    )
    cells = cut_lineage(rows.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens")))
    goals = {
        d: targets[d] if targets and d in targets else tempered(cells, d, (powers or {})[d])
        for d in dims
    }
    raked = rake(cells, goals, strict=False)
    factor = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    factors = raked.select(*dims, "sweeps", "state", "miss", factor.alias("factor"))
    factors = cut_lineage(
        factors.withColumn(
            "probability",
            F.when(
                F.max("factor").over(Window.partitionBy()) > 0,
                F.col("factor") / F.max("factor").over(Window.partitionBy()),
            ).otherwise(0.0),
        )
    )
    some = F.col("n_tokens") > 0
    return rows.join(factors, list(dims)).select(
        "row",
        *dims,
        "n_tokens",
        F.when(some, F.col("factor")).otherwise(0.0).alias("factor"),
        F.when(some, F.col("probability")).otherwise(0.0).alias("probability"),
        (some & (uniform(F.col("row")[id_col]) < F.col("probability"))).alias("kept"),
        "sweeps",
        "state",
        "miss",
    )


def topic(text: Column) -> Column:
    """A plain topic by the signs a text carries."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("!!"), "shout")
        .when(text.rlike("[0-9]{3}"), "record")
        .otherwise("prose")
    )


# Shares of the sample go with these powers of the present token shares.
POWERS = {"source": 0.9, "lang": 0.9, "topic": 0.95}


def mixture(docs: DataFrame) -> DataFrame:
    """``documents`` raked over source, language and topic."""
    dims = {"source": docs["source"], "lang": docs["lang"], "topic": topic(docs["text"])}
    return with_probability(docs, dims, POWERS)


def keep_sampled(docs: DataFrame) -> DataFrame:
    """The sampled documents, with their own columns."""
    return mixture(docs).filter("kept").select("row.*")
