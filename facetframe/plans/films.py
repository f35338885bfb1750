"""Film preset: the catalogue's own thirteen tables, passed through unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetframe.plans.profile import ProfileTables, build_profile
from facetframe.sources.catalog import FILM_TABLES, read_table


def film_tables_from(frames: dict[str, DataFrame]) -> ProfileTables:
    f = frames
    return ProfileTables(
        titles=f["movie_imdb"], country_bridge=f["movie_country"], country=f["country"],
        ml_genre=f["movie_ml_genre"], imdb_genre=f["movie_imdb_genre"],
        director_bridge=f["movie_director"], directors=f["director"],
        writer_bridge=f["movie_writer"], writers=f["writer"], ratings=f["movie_rating"])


def film_frames(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    return {n: read_table(spark, base, n) for n in FILM_TABLES}


def film_profile(frames: dict[str, DataFrame], order_by_title: bool = False) -> DataFrame:
    return build_profile(film_tables_from(frames), order_by_title=order_by_title)


def film_subtitle_links(frames: dict[str, DataFrame]):
    """(bridge, titles) for the mention and theme operators: subtitle id -> film."""
    return frames["ml_imdb"], frames["movie_imdb"]
