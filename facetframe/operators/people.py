"""Roll-ups per country and per person.

"First" and "best" are decided by explicit orderings (title, then id) so the
results do not depend on partitioning: ``min_by``/``max_by`` keep one row of
state per group, combine map-side, and are indifferent to skewed groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetframe.functions.rounding import round_half_up, to_fixed
from facetframe.operators.common import mean_of_tenths, tenths

NO_NAME = "—"


def by_country(df: DataFrame, country: str = "country", title: str = "title",
               key: str = "imdbid") -> DataFrame:
    """Per country - titles, ML votes, best-rated title, mean rating, box office.

    Best title: highest rating, ties to the first title in title order (then id).
    Mean rating: over the exact sum, rounded by M3. Box office: exact
    two-decimal sum.
    """
    best = F.min_by(F.col(title), F.struct(-F.col("rating"), F.col(title), F.col(key)))
    return df.groupBy(F.col(country).alias("country")).agg(
        F.count(F.lit(1)).alias("films"),
        F.sum("votesMl").cast("bigint").alias("votes_ml"),
        best.alias("top_title"),
        to_fixed(mean_of_tenths(F.sum(tenths("rating")), F.count(F.lit(1)))).alias("mean_rating"),
        F.sum(F.col("box").cast("decimal(20,2)")).cast("double").alias("box"),
    )


def people_by_country(df: DataFrame, role: str = "dir", name_col: str | None = None) -> DataFrame:
    """Titles per person-country and the most frequent person name there.

    Country = the person's country, else the title's. Most frequent name ties go
    to the alphabetically first name; a country without names gets '—'.
    Two aggregates: (country, name) counts, then one row per country.
    """
    name = F.col(name_col) if name_col else (F.col("director") if role == "dir" else F.col("wri.name"))
    c = F.coalesce(F.when(F.col(f"{role}.country") != "", F.col(f"{role}.country")), F.col("country"))
    pairs = (df.select(c.alias("country"), F.coalesce(name, F.lit("")).alias("name"))
               .groupBy("country", "name").agg(F.count(F.lit(1)).alias("n")))
    named = F.when(F.col("name") != "", F.struct(-F.col("n"), F.col("name")))
    return pairs.groupBy("country").agg(
        F.sum("n").cast("bigint").alias("count"),
        F.coalesce(F.min_by(F.col("name"), named), F.lit(NO_NAME)).alias("top_name"))


def top_countries(people_counts: DataFrame, n: int = 15) -> DataFrame:
    """The n countries with most titles (ties by country name)."""
    return people_counts.orderBy(F.col("count").desc(), F.col("country").asc()).limit(n)


def people_table(df: DataFrame, role: str = "dir", key: str = "name",
                 title: str = "title", title_key: str = "imdbid") -> DataFrame:
    """One row per person (by name, or by id with ``key='id'``).

    First-seen attributes come from the person's first title in title order;
    birth year from the first title with both age and year. Means are over
    exact sums, rounded by M2.
    """
    if role == "dir":
        name, pid = F.col("director"), F.col("directorid")
    else:
        name, pid = F.col("wri.name"), F.col("wri.id")
    p = f"{role}."
    order = F.struct(F.col(title), F.col(title_key))
    first = F.min_by(F.struct(name.alias("name"), pid.alias("id"),
                              F.col(p + "gender").alias("gender"),
                              F.col(p + "country").alias("nationality"),
                              F.col(p + "race").alias("race")), order)
    has_by = F.col(p + "age").isNotNull() & F.col("year").isNotNull()
    birth = F.min_by(F.when(has_by, F.col("year") - F.col(p + "age")), F.when(has_by, order))
    grp = name if key == "name" else pid
    rows = df.where(name.isNotNull() & (name != ""))
    out = rows.groupBy(grp.alias("_k")).agg(
        first.alias("_f"),
        birth.alias("birthYear"),
        F.count(F.lit(1)).alias("count"),
        F.sum("votesImdb").cast("bigint").alias("votesImdb"),
        F.sum("votesMl").cast("bigint").alias("votesMl"),
        F.sum(tenths("rating")).alias("_ri"),
        F.sum(F.coalesce(tenths("ratingMl"), F.lit(0))).alias("_rm"),
        F.sum("oscars").cast("bigint").alias("oscars"),
        F.sum("otherAwards").cast("bigint").alias("otherAwards"),
    )
    return out.select(
        F.col("_f.name").alias("name"), F.col("_f.id").alias("id"),
        F.col("_f.gender").alias("gender"), F.col("_f.nationality").alias("nationality"),
        F.col("_f.race").alias("race"), F.col("birthYear").cast("bigint").alias("birthYear"),
        "count", "votesImdb", "votesMl",
        round_half_up(mean_of_tenths(F.col("_ri"), F.col("count"))).alias("ratingImdb"),
        round_half_up(mean_of_tenths(F.col("_rm"), F.col("count"))).alias("ratingMl"),
        "oscars", "otherAwards")
