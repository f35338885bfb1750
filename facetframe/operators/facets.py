"""Facet domains (D1, D2): the selectable values of each facet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetframe.operators.common import scalar_of

# Facet -> (profile column, values left out of its domain).
FACET_DOMAINS = {
    "years": ("year", []),
    "mlGenres": ("mlGenre", [""]),
    "imdbGenres": ("imdbGenre", [""]),
    "continents": ("continent", ["", "Other"]),
    "regions": ("region", [""]),
    "countries": ("country", ["", "Unknown"]),
}


def facet_values(profile: DataFrame, facet: str, fallback: DataFrame | None = None) -> DataFrame:
    """Distinct non-null values of one facet, sorted; D2: ``fallback``
    (a one-column DataFrame ``value``) when the derived domain is empty."""
    col, excl = FACET_DOMAINS[facet]
    x = F.col(col)
    d = profile.where(x.isNotNull() & ~x.isin(excl) if excl else x.isNotNull())
    vals = d.select(x.alias("value")).distinct()
    if fallback is not None:  # decided by the query itself: one scalar subquery over the domain
        none = scalar_of(vals.agg(F.count(F.lit(1)))) == 0
        other = fallback.select("value").where(F.col("value").isNotNull()).distinct().where(none)
        vals = vals.unionByName(other)
    return vals.orderBy("value")


def all_facet_values(profile: DataFrame) -> DataFrame:
    """D1 for every facet in one scan: rows ``(facet, value)`` with text values."""
    items = []
    for name, (col, excl) in FACET_DOMAINS.items():
        x = F.col(col)
        ok = x.isNotNull() & ~x.isin(excl) if excl else x.isNotNull()
        items.append(F.when(ok, F.struct(F.lit(name).alias("facet"), x.cast("string").alias("value"))))
    exploded = profile.select(F.explode(F.array_compact(F.array(*items))).alias("f"))
    return exploded.select("f.facet", "f.value").distinct()
