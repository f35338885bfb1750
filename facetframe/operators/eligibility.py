"""Title eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetframe.functions import clean as C

# What makes a title eligible.
TYPE_MOVIE = "movie"
RESPONSE_TRUE = "true"
NOT_AVAILABLE = "N/A"


def eligible_titles(titles: DataFrame, require_rating: bool = True,
                    require_parsed_rating: bool = False) -> DataFrame:
    """titles of type movie with a positive response (and a rating text).

    ``require_parsed_rating`` adds F3 (rating text parses as a number); it is
    applied before any join, which is equivalent because every later join is
    a left join from the titles or a per-key aggregate restricted to them.
    """
    cond = (F.col("TYPE") == TYPE_MOVIE) & (F.col("RESPONSE") == RESPONSE_TRUE)
    if require_rating:
        cond = cond & F.col("IMDBRATING").isNotNull() & (F.col("IMDBRATING") != NOT_AVAILABLE)
    out = titles.where(cond)
    if require_parsed_rating:
        out = out.withColumn("RATING_NUM", C.rating("IMDBRATING")).where(F.col("RATING_NUM").isNotNull())
    return out
