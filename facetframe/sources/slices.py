"""IO2: slices of about equal size for a partitioned relational read, whatever the key's skew.

Equal-width bounds make one slow task of a skewed key and put all null keys in the first slice.
Here one pass over the key alone builds a mergeable KLL quantile sketch (Spark's own, partial per
task, bounded size) and the slices are predicates cut at its quantiles:

- a value that stands at four or more of the ``4 * slices`` quantile marks holds about a slice's
  share by itself: it is a slice of its own, cut by another whole-number column's quantiles (a
  second pass over these rows) into as many parts as it has shares;
- the rest is cut into ranges between marks, closed at about one share;
- null keys are slices of their own, cut the same way.

The predicates cover every row exactly once whatever the sketch's error: it moves sizes, never rows.
With the error of the sketch's ``k`` no slice passes twice ``rows / slices`` (``k`` is at its limit of
65 535 from about 600 slices on; sizes are looser beyond). An empty key gives one slice of everything
not null and one of nulls. Where nulls or one value hold more than a share, ``split_by`` should
spread over them: rows equal in both columns cannot be told apart by a predicate on them.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetframe.sources.ingest import FETCH_SIZE

_STEPS = 4  # quantile marks a slice


@dataclass(frozen=True)
class Slice:
    kind: str  # 'range', 'value' or 'null'
    predicate: str
    value: int | None = None  # the key of a 'value' slice
    pieces: int = 1  # how many shares it holds


def sketch_size(slices: int) -> int:
    """KLL's ``k`` for a rank error of a quarter of a mark."""
    return int(min(65_535, max(200, (36 * slices) ** 1.11)))


def cut(marks: list[int], nulls: int, rows: int, slices: int, key: str) -> list[Slice]:
    """Slices from the ascending quantile marks of the non-null keys."""
    out, low, gathered = [], None, 0

    def close(high: int | None, below: bool = False) -> None:
        nonlocal low, gathered
        ends = [] if low is None else [f"{key} > {low}"]
        ends += [] if high is None else [f"{key} {'<' if below else '<='} {high}"]
        out.append(Slice("range", " AND ".join(ends) or f"{key} IS NOT NULL"))
        low, gathered = high, 0

    for value, n in sorted(Counter(marks).items()):
        if n >= _STEPS:  # its own slice, between the range before it and the one after
            close(value, below=True)
            out.append(Slice("value", f"{key} = {value}", value, -(-(n + 1) // _STEPS)))
            continue
        gathered += n
        if gathered >= _STEPS:
            close(value)
    close(None)
    return out + [Slice("null", f"{key} IS NULL", None, -(-nulls * slices // rows) if rows else 1)]


def _sketched(slices: int):
    """Aggregates over a column ``x``: rows, known ones, and the sketch."""
    return [F.count(F.lit(1)).alias("rows"), F.count("x").alias("known"),
            F.kll_sketch_agg_bigint("x", F.lit(sketch_size(slices))).alias("sketch")]


def _marks(slices: int):
    ranks = F.array(*[F.lit(i / (slices * _STEPS)) for i in range(1, slices * _STEPS)])
    return F.when(F.col("known") > 0, F.kll_sketch_get_quantile_bigint("sketch", ranks)).alias("marks")


def balanced_slices(df: DataFrame, key: str, split_by: str, slices: int) -> list[Slice]:
    """About ``slices`` predicates over whole-number columns of ``df`` that hold each row once."""
    keys = df.select(F.col(key).cast("bigint").alias("k"), F.col(split_by).cast("bigint").alias("x"))
    got = (keys.select(F.col("k").alias("x")).agg(*_sketched(slices))
           .select("rows", "known", _marks(slices)).first())
    whole = cut(list(got["marks"] or []), got["rows"] - got["known"], got["rows"], slices, key)
    hot = {s.value: s for s in whole if s.pieces > 1}  # fewer than ``slices`` values, and null
    if not hot:
        return whole
    known = [v for v in hot if v is not None]
    heavy = keys.where(F.col("k").isin(known) | (F.col("k").isNull() & F.lit(None in hot)))
    inside = {r["k"]: r for r in heavy.groupBy("k").agg(*_sketched(slices))
              .select("k", "rows", "known", _marks(slices)).collect()}
    out = []
    for s in whole:
        r = inside.get(s.value) if s.pieces > 1 else None
        if r is None:
            out.append(s)
            continue
        # marks of the second column, thinned to those of the pieces wanted
        n = s.pieces * _STEPS
        all_marks = r["marks"] or []
        marks = [all_marks[i * (len(all_marks) + 1) // n - 1] for i in range(1, n)] if all_marks else []
        out += [Slice(s.kind, f"{s.predicate} AND {part.predicate}", s.value)
                for part in cut(marks, r["rows"] - r["known"], r["rows"], s.pieces, split_by)]
    return out


def slice_sizes(df: DataFrame, slices: list[Slice]) -> DataFrame:
    """One row per slice: (slice, kind, rows), counted in one pass."""
    counted = df.agg(*[F.count_if(F.expr(s.predicate)).alias(f"n{i}") for i, s in enumerate(slices)])
    rows = F.array(*[F.struct(F.lit(i).alias("slice"), F.lit(s.kind).alias("kind"), F.col(f"n{i}").alias("rows"))
                     for i, s in enumerate(slices)])
    return counted.select(F.inline(rows))


def read_jdbc_slices(spark: SparkSession, url: str, table: str, slices: list[Slice],
                     properties: dict[str, str] | None = None) -> DataFrame:
    """IO2: a whole table through JDBC, one task a slice."""
    return spark.read.jdbc(url, table, predicates=[s.predicate for s in slices],
                           properties={"fetchsize": str(FETCH_SIZE)} | (properties or {}))
