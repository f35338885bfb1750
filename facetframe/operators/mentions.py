"""Location mentions.

Shape: raw mention rows (subtitle id, location, count) are summed per
(subtitle id, location) with map-side combine, thresholded, linked to titles
through the id bridge (inner equi joins; duplicate bridge rows multiply, as in
the source), given the title's primary country and classified in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetframe.functions.util import or_else
from facetframe.operators.places import classify_places
from facetframe.operators.eligibility import eligible_titles

UNKNOWN = "Unknown"


def linked_titles(bridge: DataFrame, titles: DataFrame, sub_key: str = "IMDB") -> DataFrame:
    """(subtitle id, imdbid, title) of eligible titles (F2); duplicate bridge rows stay."""
    t = eligible_titles(titles, require_rating=False).select(
        F.col("MOVIEID").alias("_t_movieid"), F.col("IMDBID").alias("imdbid"), F.col("TITLE").alias("title"))
    b = bridge.select(F.col("IMDBID").alias(sub_key), F.col("MOVIEID").alias("_b_movieid"))
    return b.join(t, F.col("_b_movieid") == F.col("_t_movieid")).select(sub_key, "imdbid", "title")


def primary_country(country_bridge: DataFrame, linked: DataFrame, key: str = "IMDBID",
                    country: str = "COUNTRY") -> DataFrame:
    """One production country per linked title (first by name). The bridge is cut down to
    the linked titles first; the order column is the value itself, so it is a plain minimum."""
    b = country_bridge.join(linked.select(F.col("imdbid").alias(key)), key, "left_semi")
    return b.groupBy(F.col(key).alias("_pc_key")).agg(F.min(country).alias("_pc_country"))


def link_titles(rows: DataFrame, bridge: DataFrame, titles: DataFrame,
                countries: DataFrame | None, sub_key: str = "IMDB") -> DataFrame:
    """Subtitle id -> bridge -> eligible title (F2) -> primary country (left).

    Adds ``imdbid``, ``title`` and ``_pc_country`` (null when ``countries`` is None).
    """
    linked = linked_titles(bridge, titles, sub_key)
    j = rows.join(linked, sub_key)
    if countries is None:
        return j.withColumn("_pc_country", F.lit(None).cast("string"))
    primary = primary_country(countries, linked)
    return j.join(primary, F.col("imdbid") == F.col("_pc_key"), "left").drop("_pc_key")


def linked_only(rows: DataFrame, bridge: DataFrame, sub_key: str = "IMDB") -> DataFrame:
    """Only rows whose subtitle id is in the bridge. The later inner join drops the others
    anyway; as a semi join here it comes before the first sums. Spark does not move it below a
    tokenisation: rows made from texts are better linked before (``linked=True`` in the callers)."""
    return rows.join(bridge.select(F.col("IMDBID").alias(sub_key)), sub_key, "left_semi")


def location_mentions(geo: DataFrame, bridge: DataFrame, titles: DataFrame, countries: DataFrame,
                      gazetteer: DataFrame, min_mentions: int = 2, limit: int | None = None,
                      normalise: bool = False, linked: bool = False) -> DataFrame:
    """A4 + F7 (+ S2 when ``limit``): one row per (location, title) with >= ``min_mentions``.

    Columns: location, locType, label, mentions, imdbid, title, country.
    By default grouping is case-sensitive, as in the source ('PARIS' and 'Paris'
    stay two rows with one label). ``normalise=True`` groups case variants
    together (the label depends only on the lower-cased name), so the threshold
    applies to their sum and ``location`` is the lower-cased name. ``linked``: all rows of
    ``geo`` are of subtitles in the bridge already.
    """
    g = geo if linked else linked_only(geo, bridge)
    if normalise:
        g = g.withColumn("LOCATION", F.lower("LOCATION"))
    la = (g.groupBy("IMDB", "LOCATION").agg(F.sum("COUNT").alias("mentions"))
             .where(F.col("mentions") >= min_mentions))
    j = link_titles(la, bridge, titles, countries)
    rows = j.select(F.col("LOCATION").alias("location"), F.col("mentions").cast("bigint").alias("mentions"),
                    "imdbid", "title", or_else("_pc_country", F.lit(UNKNOWN)).alias("country"))
    if limit is not None:
        rows = rows.orderBy(F.col("mentions").desc(), "imdbid", "location").limit(limit)
    out = classify_places(rows, gazetteer, "location")
    return out.select("location", "locType", "label", "mentions", "imdbid", "title", "country")


def mention_table(rows: DataFrame, profile: DataFrame, key: str = "imdbid") -> DataFrame:
    """Mention rows with the title's attributes (title, all countries) from the
    profile, falling back to the row's own; location shown title-cased."""
    p = profile.select(F.col(key).alias("_p_key"), F.col("title").alias("_p_title"),
                       or_else("countriesAll", "country").alias("_p_countries"))
    j = rows.join(p, rows[key] == p["_p_key"], "left")
    return j.select(
        key,
        F.coalesce("_p_title", "title").alias("title"),
        F.coalesce("_p_countries", or_else("country", F.lit(UNKNOWN))).alias("countries"),
        F.col("label").alias("location"),
        F.coalesce("locType", F.lit("Other")).alias("locType"),
        "mentions")


def mentions_by_country(rows: DataFrame) -> DataFrame:
    """Total mentions per production country (the row's own), null -> 'Unknown'."""
    return (rows.groupBy(or_else("country", F.lit(UNKNOWN)).alias("country"))
                .agg(F.sum("mentions").cast("bigint").alias("mentions")))


def titles_by_country(rows: DataFrame, profile: DataFrame, n: int = 15,
                      key: str = "imdbid") -> DataFrame:
    """Distinct titles with matching mentions per country (profile's country,
    else the row's), top ``n`` by count (ties by country)."""
    p = profile.select(F.col(key).alias("_p_key"), F.col("country").alias("_p_country"))
    j = rows.join(p, rows[key] == p["_p_key"], "left")
    c = F.coalesce("_p_country", or_else("country", F.lit(UNKNOWN)))
    per = (j.select(c.alias("country"), key).distinct()
            .groupBy("country").agg(F.count(F.lit(1)).alias("n")))
    return per.orderBy(F.col("n").desc(), F.col("country").asc()).limit(n)


def location_options(rows: DataFrame, titles: DataFrame, key: str = "imdbid") -> DataFrame:
    """D3: distinct display names per place type for titles in the current set
    (place searches ignored), sorted."""
    r = rows.join(titles.select(key), key, "left_semi")
    return r.select("locType", F.col("label").alias("location")).distinct().orderBy("locType", "location")
