"""Joins that keep rows with null keys."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join by equal keys, null being equal to null; the keys appear once."""
    names = {k: f"_right_{k}" for k in keys}
    renamed = right.withColumnsRenamed(names)
    same = reduce(Column.__and__, [left[k].eqNullSafe(renamed[n]) for k, n in names.items()])
    return left.join(renamed, same, how).drop(*names.values())
