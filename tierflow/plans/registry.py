"""Names of queries, their DataFrames and the SQL that checks them."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with SQL over the same tables if there is any."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        if check is not None:
            CHECKS[name] = check
        return build

    return register


def rounded(df: DataFrame, digits: int = 6, fine: Sequence[str] = ()) -> DataFrame:
    """Round every double column, columns in ``fine`` to twice the digits.

    Sums depend on the order of addition in their last bits.  A small addend
    keeps values that end in an exact half from falling on both sides.
    """

    def column(name: str, kind: str) -> Column:
        if kind != "double":
            return F.col(name)
        places = 2 * digits if name in fine else digits
        return F.round(F.col(name) + 10.0 ** -(places + 2), places).alias(name)

    return df.select(*[column(n, k) for n, k in df.dtypes])
