"""The wide profile: one cleaned row per eligible title.

Inputs are DataFrames conformed to the catalogue's column names (see
``ProfileTables``); the film preset passes its tables through unchanged, the
order preset derives them from the driver's star schema. The result is one lazy
DataFrame; nothing reaches the driver.

Plan shape (scale):
  titles --filter(F1, F3)--> m
  each bridge --left_semi m--> (key, distinct row, count) --> first + list per key
  m LEFT JOIN the per-key results, grouped by join key so that consecutive
  sort-merge joins share one partitioning; small dimensions are broadcast
  after a bounded size check.
A stage of that chain holds the sorts of all its bridges at once. Left to the planner, its tasks
are as few as the cores (AQE coalesces), so a task's memory grows with the input;
``ProfileTables.partitions`` deals titles and bridges into a number of tasks that grows instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetframe.functions import clean as C
from facetframe.functions.rounding import round_exact
from facetframe.functions.util import blank_to_null, or_else
from facetframe.operators.eligibility import eligible_titles  # noqa: F401 (re-export)
from facetframe.operators.enrich import (bridge_rollup, count_rows,
                                         first_per_key, lookup_with_fallback)

# The fallbacks of the cleaned profile.
UNKNOWN_COUNTRY = "Unknown"
OTHER_CONTINENT = "Other"
OTHER_GENRE = "Other"

PROFILE_COLUMNS = [
    "imdbid", "movieid", "title", "director", "directorid", "directorsAll", "year",
    "country", "countriesAll", "genre", "genresAll", "mlGenre", "imdbGenre", "rating",
    "box", "continent", "region", "ratingImdb", "ratingMl", "votesImdb", "votesMl",
    "oscars", "otherAwards", "dir", "wri",
]

DIRECTOR_COLS = ["DIRECTORID", "NAME", "GENDER", "GENDER_LLM", "RACE", "BIRTHYEAR", "NATIONALITY"]
WRITER_COLS = ["WRITERID", "NAME", "GENDER", "RACE", "BIRTHYEAR", "NATIONALITY"]


@dataclass
class ProfileTables:
    """Conformed inputs (column names as in the catalogue's source tables)."""
    titles: DataFrame           # IMDBID, MOVIEID, TITLE, TYPE, RESPONSE, YEAR, IMDBRATING, IMDBVOTES,
                                # BOXOFFICE, {OSCAR,AWARD,BAFTA,EMMY}_{WINNING,NOMINATION}, GENRE, COUNTRY
    country_bridge: DataFrame   # IMDBID, ISO, COUNTRY
    country: DataFrame          # ISO, COUNTRY, CONTINENT, REGION
    ml_genre: DataFrame         # MOVIEID, GENRE
    imdb_genre: DataFrame       # IMDBID, GENRE
    director_bridge: DataFrame  # IMDBID, DIRECTORID
    directors: DataFrame        # DIRECTORID, NAME, GENDER, GENDER_LLM, RACE, BIRTHYEAR, NATIONALITY
    writer_bridge: DataFrame    # IMDBID, WRITERID
    writers: DataFrame          # WRITERID, NAME, GENDER, RACE, BIRTHYEAR, NATIONALITY
    ratings: DataFrame          # MOVIEID, RATING, COUNT_RATING
    partitions: int | None = None  # tasks per title-keyed stage (None: the planner's choice)

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` by ``key``, in the partitions all sides of the title joins share."""
        return df if self.partitions is None else df.repartition(self.partitions, key)


def nationality_map(country: DataFrame) -> DataFrame:
    """ISO code -> (country, continent, region); one row per code (first by value)."""
    c = country.where(F.col("ISO").isNotNull())
    return first_per_key(c, "ISO", ["COUNTRY", "CONTINENT", "REGION"])


def country_per_title(t: ProfileTables, m: DataFrame) -> DataFrame:
    """First country row (raw name, continent, region) and the list of display names.

    The bridge is counted per (title, ISO, name) before the two lookup joins,
    so the joins see distinct rows only.
    """
    cb = t.dealt(t.country_bridge, "IMDBID").join(t.dealt(m.select("IMDBID"), "IMDBID"), "IMDBID", "left_semi")
    counted = count_rows(cb, "IMDBID", ["ISO", "COUNTRY"])
    looked = lookup_with_fallback(counted, t.country, ("ISO", "ISO"), ("COUNTRY", "COUNTRY"),
                                  ["COUNTRY", "CONTINENT", "REGION"])
    rows = looked.select(
        "IMDBID", "COUNTRY", "_n",
        F.col("dim_CONTINENT").alias("CONTINENT"),
        F.col("dim_REGION").alias("REGION"),
        F.coalesce("dim_COUNTRY", "COUNTRY").alias("DISPLAY"))
    return bridge_rollup(rows, "IMDBID", ["COUNTRY", "CONTINENT", "REGION"], "DISPLAY",
                         list_alias="COUNTRY_LIST", prefix="PRIMARY_", counted="_n")


def genre_per_key(t: ProfileTables, bridge: DataFrame, key: str, m: DataFrame, name: str) -> DataFrame:
    g = t.dealt(bridge, key).join(t.dealt(m.select(key), key), key, "left_semi")
    return bridge_rollup(g, key, ["GENRE"], "GENRE", list_alias=f"{name}_GENRE_LIST",
                         prefix=f"{name}_")


def people_per_title(t: ProfileTables, bridge: DataFrame, people: DataFrame, id_col: str, cols: list[str],
                     m: DataFrame, prefix: str, with_list: bool) -> DataFrame:
    """First person per title (by id, then the other columns) with gender and race
    already cleaned (C4-C6), plus the list of names when asked. Without a list only the
    smallest known id per title is joined to the people, not the whole bridge."""
    b = t.dealt(bridge, "IMDBID").join(t.dealt(m.select("IMDBID"), "IMDBID"), "IMDBID", "left_semi")
    if with_list:
        r = bridge_rollup(t.dealt(b.join(people.select(*cols), id_col), "IMDBID"), "IMDBID", cols, "NAME",
                          list_alias="DIRECTOR_LIST", prefix=prefix)
    else:
        known = b.join(people.select(id_col), id_col, "left_semi")
        first = known.groupBy("IMDBID").agg(F.min(id_col).alias(id_col))
        rest = [c for c in cols if c != id_col]
        j = first.join(first_per_key(people.select(*cols), id_col, rest), id_col)
        r = t.dealt(j.select("IMDBID", *[F.col(c).alias(prefix + c) for c in cols]), "IMDBID")
    g = F.col(prefix + "GENDER")
    if prefix + "GENDER_LLM" in r.columns:
        g = F.coalesce(g, F.col(prefix + "GENDER_LLM"))
    keep = [c for c in r.columns if c not in (prefix + "GENDER", prefix + "GENDER_LLM", prefix + "RACE")]
    return r.select(*keep, C.gender(g).alias(prefix + "GENDER_C"), C.race(prefix + "RACE").alias(prefix + "RACE_C"))


def votes_per_title(t: ProfileTables, m: DataFrame) -> DataFrame:
    r = t.dealt(t.ratings, "MOVIEID").join(t.dealt(m.select("MOVIEID"), "MOVIEID"), "MOVIEID", "left_semi")
    return r.groupBy("MOVIEID").agg(F.sum("COUNT_RATING").alias("VOTES_ML"))


def clean_titles(m: DataFrame) -> DataFrame:
    """Title-level rules (C1, C11, C12) evaluated where the titles are read; ``title_texts``
    adds the others. All are evaluated before any join: the joins then carry compact cleaned
    values instead of raw text, and the final stage stays small."""
    return m.select(
        "IMDBID", "MOVIEID", "TITLE",
        F.col("RATING_NUM").alias("rating"),
        C.int_or_zero("OSCAR_WINNING").alias("oscars"),
        C.other_awards("AWARD_WINNING", "OSCAR_WINNING", "AWARD_NOMINATION", "OSCAR_NOMINATION",
                       "BAFTA_WINNING", "BAFTA_NOMINATION", "EMMY_WINNING",
                       "EMMY_NOMINATION").alias("otherAwards"),
        C.year("YEAR").alias("year"),
        "BOXOFFICE", "IMDBVOTES", "COUNTRY", "GENRE",
    )


def title_texts(titles: DataFrame) -> DataFrame:
    """The rules of the raw texts (C2, C3, C9 fallbacks, C15) and the halved rating, once the titles are
    dealt: with the other rules in the stage that reads the titles, Spark's generated method is longer
    than the JVM compiles (8 000 bytes), so that each title is interpreted."""
    return titles.select(
        "IMDBID", "MOVIEID", "TITLE", "rating",
        round_exact(F.col("rating") / F.lit(2.0), 1).alias("ratingMl"),
        C.money_millions("BOXOFFICE").alias("box"),
        C.digits_int("IMDBVOTES").alias("votesImdb"),
        "oscars", "otherAwards", "year",
        C.first_of_list("COUNTRY").alias("_country_raw1"),
        C.first_of_list("GENRE").alias("_genre_raw1"),
        C.spaced_list("GENRE").alias("_genre_spaced"),
    )


def assemble(t: ProfileTables) -> DataFrame:
    """The wide row per eligible title (title-level values already cleaned)."""
    m = eligible_titles(t.titles, require_parsed_rating=True)
    directors = people_per_title(t, t.director_bridge, t.directors, "DIRECTORID", DIRECTOR_COLS, m,
                                 "DIRECTOR_", with_list=True)
    writers = people_per_title(t, t.writer_bridge, t.writers, "WRITERID", WRITER_COLS, m,
                               "WRITER_", with_list=False)
    by_title = [country_per_title(t, m), genre_per_key(t, t.imdb_genre, "IMDBID", m, "IMDB"), directors, writers]
    by_movie = [genre_per_key(t, t.ml_genre, "MOVIEID", m, "ML"), votes_per_title(t, m)]
    wide = title_texts(t.dealt(clean_titles(m), "IMDBID"))
    for part in by_title:
        wide = wide.join(part, "IMDBID", "left")
    wide = t.dealt(wide, "MOVIEID")
    for part in by_movie:
        wide = wide.join(part, "MOVIEID", "left")
    return wide


def clean_profile(wide: DataFrame, country: DataFrame) -> DataFrame:
    """Fallback chains across the joined parts (C6-C10, C13, C14, C16, C19) and J8;
    output columns ``PROFILE_COLUMNS``."""
    nat = nationality_map(country)
    dn = nat.select(F.col("ISO").alias("_dn_iso"), F.col("COUNTRY").alias("_dn_country"),
                    F.col("REGION").alias("_dn_region"))
    wn = nat.select(F.col("ISO").alias("_wn_iso"), F.col("COUNTRY").alias("_wn_country"),
                    F.col("REGION").alias("_wn_region"))
    w = (wide.join(dn, F.col("DIRECTOR_NATIONALITY") == F.col("_dn_iso"), "left")
             .join(wn, F.col("WRITER_NATIONALITY") == F.col("_wn_iso"), "left"))

    country_c = or_else("PRIMARY_COUNTRY", "_country_raw1", F.lit(UNKNOWN_COUNTRY))
    region = F.coalesce(blank_to_null("PRIMARY_REGION"), F.lit(""))
    ml_g = blank_to_null("ML_GENRE")
    imdb_g = or_else("IMDB_GENRE", "_genre_raw1")
    genre = F.coalesce(ml_g, imdb_g, F.lit(OTHER_GENRE))
    all_genres = F.coalesce(F.col("ML_GENRE_LIST"), F.col("IMDB_GENRE_LIST"))

    flat = w.select(
        F.col("IMDBID").alias("imdbid"),
        F.col("MOVIEID").alias("movieid"),
        F.col("TITLE").alias("title"),
        F.coalesce(blank_to_null("DIRECTOR_NAME"), F.lit("")).alias("director"),
        F.col("DIRECTOR_DIRECTORID").alias("directorid"),
        or_else("DIRECTOR_LIST", "DIRECTOR_NAME", F.lit("")).alias("directorsAll"),
        "year",
        country_c.alias("country"),
        or_else("PRIMARY_CONTINENT", F.lit(OTHER_CONTINENT)).alias("continent"),
        region.alias("region"),
        ml_g.alias("_ml_g"), imdb_g.alias("_imdb_g"), genre.alias("genre"),
        all_genres.alias("_all_genres"), "_genre_spaced",
        F.col("COUNTRY_LIST").alias("_all_countries"),
        "rating", "ratingMl", "box", "votesImdb",
        F.when(C.truthy_number("VOTES_ML"), F.col("VOTES_ML").cast("double").cast("bigint"))
         .otherwise(F.lit(0).cast("bigint")).alias("votesMl"),
        "oscars", "otherAwards",
        F.coalesce(F.col("DIRECTOR_GENDER_C"), F.lit(C.UNKNOWN_GENDER)).alias("_d_gender"),
        F.coalesce(F.col("DIRECTOR_RACE_C"), F.lit(C.UNKNOWN_RACE)).alias("_d_race"),
        F.col("_dn_country"), F.col("_dn_region"), F.col("DIRECTOR_BIRTHYEAR").alias("_d_by"),
        F.coalesce(blank_to_null("WRITER_NAME"), F.lit("")).alias("_w_name"),
        F.col("WRITER_WRITERID").alias("_w_id"),
        F.coalesce(F.col("WRITER_GENDER_C"), F.lit(C.UNKNOWN_GENDER)).alias("_w_gender"),
        F.coalesce(F.col("WRITER_RACE_C"), F.lit(C.UNKNOWN_RACE)).alias("_w_race"),
        F.col("_wn_country"), F.col("_wn_region"), F.col("WRITER_BIRTHYEAR").alias("_w_by"),
    )
    return flat.select(
        "imdbid", "movieid", "title", "director", "directorid", "directorsAll", "year",
        "country",
        or_else("_all_countries", "country").alias("countriesAll"),
        "genre",
        C.all_genres("_all_genres", "_genre_spaced", "genre").alias("genresAll"),
        F.coalesce("_ml_g", "genre").alias("mlGenre"),
        F.coalesce("_imdb_g", "genre").alias("imdbGenre"),
        "rating", "box", "continent", "region",
        F.col("rating").alias("ratingImdb"),
        "ratingMl", "votesImdb", "votesMl", "oscars", "otherAwards",
        F.struct(
            F.col("_d_gender").alias("gender"),
            F.col("_d_race").alias("race"),
            or_else("_dn_country", "country").alias("country"),
            or_else("_dn_region", "region").alias("region"),
            C.age("year", "_d_by").alias("age"),
        ).alias("dir"),
        F.struct(
            F.col("_w_name").alias("name"),
            F.col("_w_id").alias("id"),
            F.col("_w_gender").alias("gender"),
            F.col("_w_race").alias("race"),
            or_else("_wn_country", "country").alias("country"),
            or_else("_wn_region", "region").alias("region"),
            C.age("year", "_w_by").alias("age"),
        ).alias("wri"),
    )


def build_profile(t: ProfileTables, order_by_title: bool = False) -> DataFrame:
    """The cleaned one-row-per-title profile (S1 ordering only when asked)."""
    p = clean_profile(assemble(t), t.country)
    return p.orderBy(F.col("title").asc_nulls_last()) if order_by_title else p


def flatten_profile(p: DataFrame) -> DataFrame:
    """Profile with ``dir``/``wri`` struct fields as ``dir_*``/``wri_*`` columns."""
    base = [c for c in p.columns if c not in ("dir", "wri")]
    dcols = [F.col("dir." + f).alias("dir_" + f) for f in ("gender", "race", "country", "region", "age")]
    wcols = [F.col("wri." + f).alias("wri_" + f)
             for f in ("name", "id", "gender", "race", "country", "region", "age")]
    return p.select(*base, *dcols, *wcols)
