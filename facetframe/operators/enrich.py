"""Per-key enrichment primitives: first row per key, delimited list per key,
and two-step fallback lookup.

Scale notes
-----------
* ``first_per_key`` is one aggregate with ``min_by(struct, struct)``: the
  per-key state is one row, it combines map-side, and a hot key costs no more
  than a cold one. (A struct buffer makes it sort-based, which spills instead
  of failing when a task holds many keys.)
* ``list_per_key`` keeps duplicates, as the source's string aggregation does.
  It first counts ``(key, value)`` pairs (map-side combine collapses repeats of
  a hot key before the shuffle) and then builds the list per key from the
  distinct values with their counts, so what is gathered per key is its distinct
  values; the resulting text itself still repeats a value as often as it occurs.
* Which side of a lookup is broadcast is left to the planner and AQE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetframe.functions.util import as_col, nulls_last_key


def _as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def first_per_key(df: DataFrame, key, cols: Sequence[str], order=None,
                  prefix: str = "") -> DataFrame:
    """One row per key: the values of ``cols`` from the first row in ``order``.

    ``order`` defaults to ``cols`` ascending with nulls last, so "first" is a
    deterministic function of the data (the source left it arbitrary). All
    values come from the same row because they travel in one struct.
    """
    keys = _as_list(key)
    order_cols = _as_list(order) or list(cols)
    picked = F.min_by(F.struct(*[F.col(c).alias(c) for c in cols]),
                      F.struct(*nulls_last_key(*order_cols)))
    out = df.groupBy(*keys).agg(picked.alias("_first"))
    return out.select(*keys, *[F.col("_first")[c].alias(prefix + c) for c in cols])


def _list_from_counts(values_n: Column, sep: str) -> Column:
    """Sorted array<struct<v, n>> -> 'v1, v1, v2' (each value repeated n times)."""
    each = F.transform(F.array_sort(values_n), lambda s: F.concat(
        F.repeat(F.concat(s["v"], F.lit(sep)), (s["n"] - 1).cast("int")), s["v"]))
    return F.array_join(each, sep)


def list_per_key(df: DataFrame, key, col, sep: str = ", ", alias: str = "list") -> DataFrame:
    """Delimited list of ``col`` per key, ordered by value, nulls skipped, duplicates kept.

    Keys whose values are all null get no row (as the SQL string aggregate
    returns null for them, and a left join then yields null).
    """
    keys = _as_list(key)
    v = as_col(col)
    pairs = (df.where(v.isNotNull())
               .groupBy(*keys, v.cast("string").alias("v"))
               .agg(F.count(F.lit(1)).alias("n")))
    return (pairs.groupBy(*keys)
                 .agg(_list_from_counts(F.collect_list(F.struct("v", "n")), sep).alias(alias)))


def count_rows(df: DataFrame, key, cols: Sequence[str], count_col: str = "_n") -> DataFrame:
    """(key, distinct row, count): the map-side-combined first step of a bridge roll-up."""
    return df.groupBy(*_as_list(key), *cols).agg(F.count(F.lit(1)).alias(count_col))


def bridge_rollup(df: DataFrame, key, first_cols: Sequence[str], list_col: str | None,
                  sep: str = ", ", list_alias: str = "list", prefix: str = "",
                  order=None, counted: str | None = None) -> DataFrame:
    """``first_per_key`` and ``list_per_key`` of one bridge in a single per-key aggregation.

    With a list, the bridge is first reduced to ``(key, distinct row, count)``
    (or the caller passes such rows, naming the count column in ``counted``),
    so a key's working set is its distinct rows. Without a list the first row
    is taken straight from the bridge (``min_by`` combines map-side).
    """
    keys = _as_list(key)
    order_cols = _as_list(order) or list(first_cols)
    first = F.min_by(F.struct(*[F.col(c).alias(c) for c in first_cols]),
                     F.struct(*nulls_last_key(*order_cols))).alias("_first")
    sel = [*keys, *[F.col("_first")[c].alias(prefix + c) for c in first_cols]]
    if not list_col:
        return df.groupBy(*keys).agg(first).select(*sel)
    if counted is None:
        cols = list(dict.fromkeys(list(first_cols) + [list_col]))
        df = count_rows(df, keys, cols)
        counted = "_n"
    lv = F.col(list_col).cast("string")
    item = F.when(lv.isNotNull(), F.struct(lv.alias("v"), F.col(counted).alias("n")))
    out = df.groupBy(*keys).agg(first, F.collect_list(item).alias("_items"))
    sel.append(F.when(F.size("_items") > 0, _list_from_counts(F.col("_items"), sep)).alias(list_alias))
    return out.select(*sel)


def lookup_with_fallback(df: DataFrame, dim: DataFrame, primary: tuple[str, str],
                         secondary: tuple[str, str], take: Sequence[str],
                         prefix: str = "dim_") -> DataFrame:
    """Left-join ``dim`` on ``primary``; rows without a primary match try ``secondary``.

    ``primary``/``secondary`` are ``(df column, dim column)`` pairs. For each
    column in ``take`` the result carries ``prefix + col`` (primary value, else
    secondary value) and ``prefix + col + '_by_key'`` (primary value only).
    The second join carries the condition "primary found nothing", so a row
    never matches both ways.
    """
    (pl, pd_), (sl, sd) = primary, secondary
    dcols = list(dict.fromkeys([pd_, sd, *take]))
    d = dim.select(*dcols)
    a = d.select(*[F.col(c).alias("_p_" + c) for c in dcols])
    b = d.select(*[F.col(c).alias("_s_" + c) for c in dcols])
    j = df.join(a, df[pl] == a["_p_" + pd_], "left")
    miss = F.col("_p_" + pd_).isNull()
    j = j.join(b, (j[sl] == b["_s_" + sd]) & miss, "left")
    out_cols = []
    for c in take:
        out_cols.append(F.coalesce(F.col("_p_" + c), F.col("_s_" + c)).alias(prefix + c))
        out_cols.append(F.col("_p_" + c).alias(prefix + c + "_by_key"))
    drop = ["_p_" + c for c in dcols] + ["_s_" + c for c in dcols]
    return j.select(*[c for c in j.columns if c not in drop], *out_cols)
