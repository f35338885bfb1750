"""Mergeable distinct counts: stored theta sketches, united and intersected on demand.

A count of distinct titles cannot be added up over groups, so each new grouping would read the rows
again. The index holds one theta sketch per cell, a combination of dimension values: a hash sample of
at most about 2**log_entries keys. Any coarser grouping is a union of cells, and the keys two indexes
share are an intersection; both read small binary rows only. Building is one grouped aggregation whose
map side already forms sketches, so a cell with a third of all rows sends one sketch per task.

Below 2**log_entries distinct keys a sketch holds all of them and its count is exact. Beyond, the
standard error is 1 / sqrt(2**log_entries) of the count (of an intersection: of the larger side), and
:func:`error_bound` states it at ``sigmas`` standard errors.

A null key counts for nothing; null is a dimension value of its own; a repeated row changes nothing; an
empty table gives an empty index.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetframe.sources.stored import once

LOG_ENTRIES = 12
SKETCH = "sketch"


def build_sketches(rows: DataFrame, dims: Iterable[str], key: str, path: str, log_entries: int = LOG_ENTRIES) -> DataFrame:
    """The index of the distinct ``key`` values of ``rows`` per combination of ``dims``, stored at ``path``
    as (*dims, sketch)."""
    cells = rows.groupBy(*dims).agg(F.theta_sketch_agg(key, log_entries).alias(SKETCH))
    return rows.sparkSession.read.schema(cells.schema).parquet(
        once(rows.sparkSession, path, lambda where: cells.write.mode("overwrite").parquet(where)))


def roll_up(index: DataFrame, *by: str | Column, log_entries: int = LOG_ENTRIES) -> DataFrame:
    """The cells united to a coarser grouping, as (*by, sketch)."""
    return index.groupBy(*by).agg(F.theta_union_agg(SKETCH, log_entries).alias(SKETCH))


def estimates(cells: DataFrame, name: str = "estimate") -> DataFrame:
    """The cells with their number of distinct keys in place of the sketch."""
    return cells.withColumn(name, F.theta_sketch_estimate(SKETCH)).drop(SKETCH)


def shared(left: DataFrame, right: DataFrame, on: list[str], name: str = "estimate", larger: str = "larger") -> DataFrame:
    """Keys in both a cell of ``left`` and one of ``right``, per pair of cells that agree in ``on`` (null
    agrees with null); ``larger`` is the count of the larger side, which the error is stated against."""
    keep = [c for c in right.columns if c not in (*on, SKETCH)]
    r = right.select(*[F.col(c).alias(f"__on_{c}") for c in on], *keep, F.col(SKETCH).alias("__r"))
    agree = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on])
    both = left.withColumnRenamed(SKETCH, "__l").join(r, agree).drop(*[f"__on_{c}" for c in on])
    count = F.theta_sketch_estimate
    return (both.withColumn(name, count(F.theta_intersection("__l", "__r")))
            .withColumn(larger, F.greatest(count("__l"), count("__r"))).drop("__l", "__r"))


def error_bound(estimate: Column, log_entries: int = LOG_ENTRIES, sigmas: float = 4.0) -> Column:
    """The stated error of a count: none below the sketch's capacity, else ``sigmas`` standard errors."""
    return (F.when(estimate < (1 << log_entries), F.lit(0.0))
            .otherwise(estimate * F.lit(sigmas / math.sqrt(1 << log_entries))))
