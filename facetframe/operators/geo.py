"""Map metrics (J10, M4, M5): country names to map codes, relative intensity,
share of the maximum. Maxima are global aggregates used as scalar subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetframe.operators.common import scalar_of


def intensity(df: DataFrame, value: str, alias: str = "intensity") -> DataFrame:
    """M4: sqrt(value / max) with max over all rows; max defaults to 1 when 0 or empty."""
    mx = scalar_of(df.agg(F.max(value)))
    m = F.when(mx.isNull() | (mx == 0), F.lit(1.0)).otherwise(mx)
    return df.withColumn(alias, F.sqrt(F.col(value).cast("double") / m.cast("double")))


def share_of_max(df: DataFrame, value: str, alias: str = "share_of_max") -> DataFrame:
    """M5: value / max(1, max value) over all rows."""
    mx = scalar_of(df.agg(F.max(value)))
    m = F.greatest(F.lit(1.0), F.coalesce(mx.cast("double"), F.lit(1.0)))
    return df.withColumn(alias, F.col(value).cast("double") / m)


def map_metric(df: DataFrame, codes: DataFrame, country: str = "country",
               code_name: str = "name", code: str = "code", value: str = "value") -> DataFrame:
    """J10 + M4: attach a map code by country name (unmatched names drop out);
    intensity is relative to the maximum over *all* rows, matched or not."""
    with_int = intensity(df, value)
    c = codes.select(F.col(code_name).alias("_cname"), F.col(code).alias("code"))
    return with_int.join(c, with_int[country] == c["_cname"], "inner").drop("_cname")
