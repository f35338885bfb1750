"""Table registration, facet domains with fallback, map metrics."""

from pyspark.sql import functions as F

from facetframe.operators import facets as FA
from facetframe.operators import geo as G
from facetframe.sources.catalog import register_tables
from tests.conftest import SF_SMALL


def test_register_tables_reports_missing(spark):
    skipped = register_tables(spark, SF_SMALL, ["orders", "no_such_table", "nation"])
    assert skipped == ["no_such_table"]
    assert spark.table("orders").count() > 0 and spark.table("nation").count() == 25


def test_facet_values_and_fallback(spark, film_profile):
    years = [r.value for r in FA.facet_values(film_profile, "years").collect()]
    assert years == [1995, 2000, 2001]
    countries = [r.value for r in FA.facet_values(film_profile, "countries").collect()]
    assert countries == ["Brazil", "France", "Spain"]          # 'Unknown' left out
    static = spark.createDataFrame([("Chile",), ("Peru",)], "value string")
    empty = film_profile.where(F.lit(False))
    assert [r.value for r in FA.facet_values(empty, "countries", fallback=static).collect()] == ["Chile", "Peru"]
    allf = {(r.facet, r.value) for r in FA.all_facet_values(film_profile).collect()}
    assert ("continents", "Europe") in allf and ("continents", "Other") not in allf


def test_intensity_and_share(spark):
    df = spark.createDataFrame([("France", 4), ("Spain", 1), ("Narnia", 0)], "country string, value long")
    got = {r.country: r.intensity for r in G.intensity(df, "value").collect()}
    assert got == {"France": 1.0, "Spain": 0.5, "Narnia": 0.0}
    zeros = spark.createDataFrame([("A", 0)], "country string, value long")
    assert G.intensity(zeros, "value").first().intensity == 0.0     # max 0 -> 1
    codes = spark.createDataFrame([("France", 250), ("Spain", 724)], "name string, code long")
    mm = {r.country: (r.code, r.intensity) for r in G.map_metric(df, codes).collect()}
    assert mm == {"France": (250, 1.0), "Spain": (724, 0.5)}        # unmatched drop out
    sh = {r.country: r.share_of_max for r in G.share_of_max(df, "value").collect()}
    assert sh["France"] == 1.0 and sh["Spain"] == 0.25
