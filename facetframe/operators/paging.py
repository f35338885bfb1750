"""Sorted pages (S3-S7) with a unique tiebreak, plus keyset paging.

Offset paging plans as ``TakeOrderedAndProject(offset + size)``: each task
keeps its top (offset + size) rows, so the cost grows with page depth, not
with the table. ``page_after`` (keyset paging) filters on the last sort tuple
instead, so every page costs one scan plus a top-``size``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetframe.operators.common import sort_cols

PAGE_SIZE = 50

# Sortable columns of each table and their defaults.
THEME_SORTS = ("mentions", "title", "idiom", "theme", "word")
FILM_SORTS = ("title", "director", "year", "country", "genre", "rating", "ratingMl",
              "votesMl", "box", "oscars", "otherAwards")
PERSON_SORTS = ("name", "gender", "nationality", "race", "birthYear", "count", "votesImdb",
                "votesMl", "ratingImdb", "ratingMl", "oscars", "otherAwards")
LOCATION_SORTS = ("title", "countries", "location", "locType", "mentions")


def resolve_sort(sort: str, allowed: Sequence[str], default: str) -> str:
    """Unknown sort keys fall back to the default (S3)."""
    return sort if sort in allowed else default


def direction(d: str) -> str:
    return "asc" if d == "asc" else "desc"


def page(df: DataFrame, sort: str, dir_: str, page_no: int = 0, size: int = PAGE_SIZE,
         tiebreak: Sequence[str] = (), nulls: str = "default",
         sort_expr: Column | None = None, collation: str | None = None) -> DataFrame:
    """One page: rows ``[page_no*size, page_no*size + size)`` in sort order.

    ``tiebreak`` columns (ascending) make the order total, so consecutive
    pages neither repeat nor skip rows. ``sort_expr`` overrides the sort
    column's value (e.g. null year compared as 0). ``collation`` names a collation for a
    text sort column (e.g. ``UNICODE``); the default is code-point order.
    """
    key = sort_expr if sort_expr is not None else F.col(sort)
    if collation and df.schema[sort].dataType.typeName() == "string":
        key = F.collate(key, collation)
    keys = sort_cols([(key, direction(dir_))], nulls) + \
        [F.col(c).asc_nulls_last() for c in tiebreak if c != sort]
    return df.orderBy(*keys).offset(max(0, page_no) * size).limit(size)


def page_info(df: DataFrame, page_no: int, size: int = PAGE_SIZE) -> DataFrame:
    """One row (page, from, to, total, pages), page clamped to the last page."""
    n = F.count(F.lit(1))
    pages = F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("bigint")
    pg = F.least(F.lit(page_no), pages - 1)
    info = df.agg(n.alias("total"), pages.alias("pages"), pg.alias("page"))
    start = F.col("page") * size
    return info.select(
        "page",
        F.when(F.col("total") > 0, start + 1).otherwise(F.lit(0)).cast("bigint").alias("from"),
        F.least(start + size, F.col("total")).cast("bigint").alias("to"),
        F.col("total").cast("bigint").alias("total"), "pages")


def clamp_page(df: DataFrame, page_no: int, size: int = PAGE_SIZE) -> int:
    """Page number clamped to the last page. An action: it counts ``df``, so pass the narrowest
    rows that have the table's count, or persisted ones."""
    pages = max(1, -(-df.count() // size))
    return min(max(0, page_no), pages - 1)


def film_page(profile: DataFrame, sort: str = "title", dir_: str = "asc", page_no: int = 0,
              size: int = PAGE_SIZE, key: str = "imdbid", collation: str | None = None) -> DataFrame:
    """Film table page; a null year compares as 0. ``page_no`` is taken as given; clamp it
    with ``clamp_page`` where a page past the end must show the last one."""
    s = resolve_sort(sort, FILM_SORTS, "title")
    expr = F.coalesce(F.col(s), F.lit(0)) if s in ("year",) else None
    return page(profile, s, dir_, page_no, size, (key,), "default", expr, collation)


def person_page(people: DataFrame, sort: str = "count", dir_: str = "desc", page_no: int = 0,
                size: int = PAGE_SIZE, collation: str | None = None) -> DataFrame:
    """Person table page; nulls last when ascending, first when descending."""
    s = resolve_sort(sort, PERSON_SORTS, "count")
    return page(people, s, dir_, page_no, size, ("name", "id"), "person", None, collation)


def location_page(rows: DataFrame, sort: str = "mentions", dir_: str = "desc", page_no: int = 0,
                  size: int = PAGE_SIZE, collation: str | None = None) -> DataFrame:
    """Location table page, same null rule as S5; the whole row is the tiebreak, as several
    rows of a title can share a label."""
    s = resolve_sort(sort, LOCATION_SORTS, "mentions")
    first = [c for c in ("imdbid", "location", "mentions") if c in rows.columns]
    return page(rows, s, dir_, page_no, size, [*first, *[c for c in rows.columns if c not in first]],
                "person", None, collation)


def _after(key: Column, value, asc: bool, nulls_last: bool) -> Column:
    """Whether ``key`` sorts strictly after ``value``."""
    if value is None:
        return F.lit(False) if nulls_last else key.isNotNull()
    past = (key > F.lit(value)) if asc else (key < F.lit(value))
    return F.coalesce(past, F.lit(nulls_last))


def page_after(df: DataFrame, sort: str, dir_: str, after: tuple | None, size: int = PAGE_SIZE,
               tiebreak: Sequence[str] | str = ("imdbid",), nulls: str = "person") -> DataFrame:
    """Keyset paging: the ``size`` rows after the tuple ``(sort value, *tiebreak values)``.

    Nulls are values of their own: by ``nulls`` last when ascending and first when descending
    ('person'), always last ('last'), or Spark's default; in tiebreaks they are last. Cost is
    one filtered scan plus a top-``size``.
    """
    ties = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    asc = direction(dir_) == "asc"
    nulls_last = {"person": asc, "last": True}.get(nulls, not asc)
    keys = [(F.col(sort), asc, nulls_last), *[(F.col(c), True, True) for c in ties]]
    d = df
    if after is not None:
        past, same = F.lit(False), F.lit(True)
        for (k, up, last), v in zip(keys, after, strict=True):
            past = past | (same & _after(k, v, up, last))
            same = same & k.eqNullSafe(F.lit(v))
        d = d.where(past)
    order = sort_cols([(F.col(sort), direction(dir_))], nulls) + [F.col(c).asc_nulls_last() for c in ties]
    return d.orderBy(*order).limit(size)
