"""Helpers shared by several operators: global totals as scalar subqueries,
exact means, and sort-key construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetframe.functions.util import as_col


def scalar_of(one_value: DataFrame) -> Column:
    """A one-row, one-column aggregate used as a value (a scalar subquery).

    Spark runs the subquery once and substitutes its result; there is no join,
    no cartesian product and no single-partition window over the data.
    """
    return one_value.scalar()


def tenths(c) -> Column:
    """A one-decimal double as an exact count of tenths (bigint)."""
    return F.round(as_col(c).cast("double") * F.lit(10.0)).cast("bigint")


def mean_of_tenths(sum_tenths: Column, n: Column) -> Column:
    """The mean of one-decimal values from their exact sum in tenths, as a double before
    rounding: the sum is exact, so the result doesn't depend on summation order. No rows -> null."""
    return F.when(n > 0, sum_tenths.cast("double") / F.lit(10.0) / n.cast("double"))


def sort_cols(spec: list, nulls: str = "default") -> list[Column]:
    """[(column, 'asc'|'desc'), ...] -> Column sort keys.

    ``nulls``: 'last' (nulls last both ways), 'person' (last when asc, first
    when desc), or 'default' (Spark's: first when asc, last when desc).
    """
    out = []
    for c, d in spec:
        x = as_col(c)
        asc = d.lower() == "asc"
        if nulls == "last":
            out.append(x.asc_nulls_last() if asc else x.desc_nulls_last())
        elif nulls == "person":
            out.append(x.asc_nulls_last() if asc else x.desc_nulls_first())
        else:
            out.append(x.asc() if asc else x.desc())
    return out
