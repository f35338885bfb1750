"""Order preset: the driver's star schema conformed to the profile's inputs.

Roles (title = order):
  titles          <- orders (rating text from o_totalprice, votes text from o_custkey,
                     box-office text from o_totalprice, award counts from keys)
  country bridge  <- lineitem -> supplier -> nation (some ISO codes missing or
                     unknown, some names lower-cased, to exercise the fallback lookup)
  country         <- nation -> region (continent = r_name)
  ML genre        <- lineitem (closed lines) -> part.p_type
  IMDb genre      <- lineitem (open lines) -> part.p_brand
  director        <- orders.o_custkey -> customer (names shared by two ids)
  writer          <- lineitem.l_suppkey -> supplier
  ratings         <- lineitem (rating from l_discount, count = l_quantity)
Every rule below is restated in the DuckDB oracle, so the two must change together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetframe.plans.profile import ProfileTables, build_profile
from facetframe.sources.catalog import read_table, tasks_for


def _mod(c: str, n: int):
    return F.col(c) % F.lit(n)


def conform_titles(orders: DataFrame) -> DataFrame:
    tenths = F.floor(F.col("o_totalprice") / F.lit(5000.0)).cast("bigint")
    rating_txt = F.concat(F.floor(tenths / F.lit(10)).cast("bigint").cast("string"), F.lit("."),
                          (tenths % F.lit(10)).cast("string"))
    return orders.select(
        F.col("o_orderkey").alias("IMDBID"),
        F.col("o_orderkey").alias("MOVIEID"),
        F.concat(F.lower(F.substring(F.col("o_orderpriority"), F.lit(3), F.length("o_orderpriority"))), F.lit(" order "),
                 F.col("o_orderkey").cast("string")).alias("TITLE"),
        F.when(F.col("o_orderstatus") == "P", F.lit("series")).otherwise(F.lit("movie")).alias("TYPE"),
        F.when(_mod("o_orderkey", 31) == 0, F.lit("false")).otherwise(F.lit("true")).alias("RESPONSE"),
        F.year("o_orderdate").cast("double").alias("YEAR"),
        F.when(_mod("o_orderkey", 23) == 0, F.lit("N/A"))
         .when(_mod("o_orderkey", 29) == 0, F.lit("unrated"))
         .when(_mod("o_orderkey", 37) == 0, F.lit(None).cast("string"))
         .otherwise(rating_txt).alias("IMDBRATING"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(","),
                 F.lpad((F.col("o_orderkey") % F.lit(1000)).cast("string"), 3, "0")).alias("IMDBVOTES"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("N/A"))
         .otherwise(F.concat(F.lit("$"), F.floor("o_totalprice").cast("string"))).alias("BOXOFFICE"),
        _mod("o_orderkey", 3).cast("double").alias("OSCAR_WINNING"),
        _mod("o_orderkey", 5).cast("double").alias("OSCAR_NOMINATION"),
        _mod("o_custkey", 4).cast("double").alias("AWARD_WINNING"),
        _mod("o_custkey", 7).cast("double").alias("AWARD_NOMINATION"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(1.0)).otherwise(F.lit(0.0)).alias("BAFTA_WINNING"),
        F.when(_mod("o_orderkey", 2) == 0, F.lit(None).cast("double")).otherwise(F.lit(1.0)).alias("BAFTA_NOMINATION"),
        F.lit(None).cast("double").alias("EMMY_WINNING"),
        F.when(F.col("o_orderstatus") == "O", F.lit(2.0)).alias("EMMY_NOMINATION"),
        F.concat(F.col("o_orderpriority"), F.lit(","), F.col("o_orderstatus")).alias("GENRE"),
        F.when(_mod("o_custkey", 3) == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("NATION_"), (F.col("o_custkey") % F.lit(25)).cast("string"),
                             F.lit(", NATION_0"))).alias("COUNTRY"),
    )


def conform_country(nation: DataFrame, region: DataFrame) -> DataFrame:
    j = nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "inner")
    return j.select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ISO"),
        F.col("n_name").alias("COUNTRY"),
        F.col("r_name").alias("CONTINENT"),
        F.concat(F.col("r_name"),
                 F.when(_mod("n_nationkey", 2) == 0, F.lit(" EAST")).otherwise(F.lit(" WEST"))).alias("REGION"),
    )


def conform_country_bridge(lineitem: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    j = (lineitem.select("l_orderkey", "l_suppkey")
                 .join(supplier.select("s_suppkey", "s_nationkey"),
                       F.col("l_suppkey") == F.col("s_suppkey"), "inner")
                 .join(nation.select("n_nationkey", "n_name"),
                       F.col("s_nationkey") == F.col("n_nationkey"), "inner"))
    return j.select(
        F.col("l_orderkey").alias("IMDBID"),
        F.when(_mod("s_suppkey", 7) == 0, F.lit(None).cast("string"))
         .when(_mod("s_suppkey", 11) == 0, F.concat(F.lit("X"), F.col("s_nationkey").cast("string")))
         .otherwise(F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))).alias("ISO"),
        F.when(_mod("s_suppkey", 13) == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("COUNTRY"),
    )


def conform_genres(lineitem: DataFrame, part: DataFrame):
    j = (lineitem.select("l_orderkey", "l_partkey", "l_linestatus")
                 .join(part.select("p_partkey", "p_type", "p_brand"),
                       F.col("l_partkey") == F.col("p_partkey"), "inner"))
    ml = j.where(F.col("l_linestatus") == "F").select(
        F.col("l_orderkey").alias("MOVIEID"), F.col("p_type").alias("GENRE"))
    imdb = j.where(F.col("l_linestatus") == "O").select(
        F.col("l_orderkey").alias("IMDBID"), F.col("p_brand").alias("GENRE"))
    return ml, imdb


def conform_directors(customer: DataFrame) -> DataFrame:
    seg = F.col("c_mktsegment")
    race = F.col("c_nationkey") % F.lit(7)
    return customer.select(
        F.col("c_custkey").alias("DIRECTORID"),
        F.concat(F.lit("cust "), F.lpad((F.col("c_custkey") % F.lit(1000)).cast("string"), 3, "0")).alias("NAME"),
        F.when(seg == "MACHINERY", F.lit("male")).when(seg == "BUILDING", F.lit("FEMALE"))
         .when(seg == "HOUSEHOLD", F.lit("Male")).alias("GENDER"),
        F.when(seg == "AUTOMOBILE", F.lit("female")).alias("GENDER_LLM"),
        F.when(race == 0, F.lit("white")).when(race == 1, F.lit("asian")).when(race == 2, F.lit("black"))
         .when(race == 3, F.lit("undefined")).when(race == 4, F.lit(None).cast("string"))
         .when(race == 5, F.lit("Indigenous")).otherwise(F.lit("martian")).alias("RACE"),
        F.when(_mod("c_custkey", 11) == 0, F.lit(None).cast("double"))
         .otherwise((F.lit(1930) + F.col("c_custkey") % F.lit(60)).cast("double")).alias("BIRTHYEAR"),
        F.when(_mod("c_custkey", 9) == 0, F.lit("ZZ"))
         .otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("NATIONALITY"),
    )


def conform_writers(supplier: DataFrame) -> DataFrame:
    g = F.col("s_suppkey") % F.lit(3)
    r = F.col("s_nationkey") % F.lit(3)
    return supplier.select(
        F.col("s_suppkey").alias("WRITERID"),
        F.col("s_name").alias("NAME"),
        F.when(g == 0, F.lit("male")).when(g == 1, F.lit("female")).alias("GENDER"),
        F.when(r == 0, F.lit("white")).when(r == 1, F.lit("mixed-race")).otherwise(F.lit("")).alias("RACE"),
        (F.lit(1940) + F.col("s_suppkey") % F.lit(45)).cast("double").alias("BIRTHYEAR"),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("NATIONALITY"),
    )


def conform_ratings(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("MOVIEID"),
        (F.round(F.col("l_discount") * F.lit(100.0)) / F.lit(2.0)).alias("RATING"),
        F.col("l_quantity").cast("bigint").alias("COUNT_RATING"),
    )


def order_tables(spark: SparkSession, base: str) -> ProfileTables:
    rd = lambda n: read_table(spark, base, n)
    orders, lineitem, part = rd("orders"), rd("lineitem"), rd("part")
    supplier, customer, nation, region = rd("supplier"), rd("customer"), rd("nation"), rd("region")
    ml, imdb = conform_genres(lineitem, part)
    return ProfileTables(
        titles=conform_titles(orders),
        country_bridge=conform_country_bridge(lineitem, supplier, nation),
        country=conform_country(nation, region),
        ml_genre=ml, imdb_genre=imdb,
        director_bridge=orders.select(F.col("o_orderkey").alias("IMDBID"),
                                      F.col("o_custkey").alias("DIRECTORID")),
        directors=conform_directors(customer),
        writer_bridge=lineitem.select(F.col("l_orderkey").alias("IMDBID"),
                                      F.col("l_suppkey").alias("WRITERID")),
        writers=conform_writers(supplier),
        ratings=conform_ratings(lineitem),
        partitions=tasks_for(spark, base, ["orders", "lineitem"]),
    )


def order_profile(spark: SparkSession, base: str, order_by_title: bool = False) -> DataFrame:
    return build_profile(order_tables(spark, base), order_by_title=order_by_title)


# --- text tables: documents as subtitles ------------------------------------------
# Location candidates are the letter runs of the raw text (case kept), theme words
# the letter runs of the lower-cased text; idiom = upper(lang), theme = source.


def letter_runs(text):
    """The maximal runs of letters in ``text`` (split on the complement, empties dropped)."""
    return F.array_remove(F.split(text, r"[^\p{L}]+"), "")


def linked_documents(spark: SparkSession, base: str) -> DataFrame:
    """The documents that the subtitle bridge names: whole texts are dropped here, before they are
    split into words, and what is left is dealt by document id for the sums that follow, into tasks that
    grow with the table (a scan has as few as the file has row groups, and splits each text there)."""
    labels = read_table(spark, base, "labels").select("doc_id")
    linked = read_table(spark, base, "documents").join(labels, "doc_id", "left_semi")
    return linked.repartition(tasks_for(spark, base, ["documents"]), "doc_id")


def conform_geo(documents: DataFrame) -> DataFrame:
    """subtitle_geo analogue: (IMDB = doc_id, LOCATION = token, COUNT = 1 per occurrence)."""
    return documents.select(
        F.col("doc_id").alias("IMDB"),
        F.explode(letter_runs(F.col("text"))).alias("LOCATION"),
        F.lit(1).cast("bigint").alias("COUNT"))


def conform_themes(documents: DataFrame) -> DataFrame:
    """subtitle_theme analogue: (IMDB, IDIOM, THEME, WORD, COUNT = 1 per occurrence)."""
    return documents.select(
        F.col("doc_id").alias("IMDB"),
        F.upper("lang").alias("IDIOM"),
        F.col("source").alias("THEME"),
        F.explode(letter_runs(F.lower("text"))).alias("WORD"),
        F.lit(1).cast("bigint").alias("COUNT"))


def conform_subtitle_bridge(labels: DataFrame) -> DataFrame:
    """ml_imdb analogue: labelled documents link to the order with the same key;
    toxic documents appear twice, so their sums double (bridge multiplicity)."""
    one = labels.select(F.col("doc_id").alias("IMDBID"), F.col("doc_id").alias("MOVIEID"))
    two = labels.where(F.col("toxic") == 1).select(F.col("doc_id").alias("IMDBID"),
                                                   F.col("doc_id").alias("MOVIEID"))
    return one.unionAll(two)


# A small self-written gazetteer over frequent letter runs of the
# documents, with duplicate main entries (later category wins), aliases that
# override main entries, and stems reached only by stripping a trailing 's'.
TOKEN_GAZETTEER = [
    ("the", "Country", "main", 1), ("of", "City", "main", 2), ("de", "State", "main", 3),
    ("and", "Region", "main", 4), ("la", "City", "main", 2), ("der", "Country", "main", 1),
    ("le", "State", "main", 3), ("que", "Region", "main", 4), ("en", "City", "main", 2),
    ("die", "State", "main", 3), ("und", "Country", "main", 1), ("des", "City", "main", 2),
    ("el", "Country", "main", 1), ("ou", "Region", "main", 4), ("in", "Country", "main", 1),
    ("in", "City", "main", 2), ("to", "City", "main", 2), ("to", "State", "main", 3),
    ("on", "Country", "main", 1), ("on", "Region", "main", 4), ("ere", "Region", "main", 4),
    ("one", "City", "main", 2), ("wa", "State", "main", 3), ("lo", "Country", "main", 1),
    ("a", "City", "alias", 1), ("it", "Country", "alias", 1), ("the", "Region", "alias", 1),
    ("an", "State", "alias", 1), ("ci", "City", "alias", 1),
]


def token_gazetteer(spark: SparkSession) -> DataFrame:
    """The fixed entries as a JVM-side local table (no Python workers needed)."""
    rows = [F.struct(F.lit(n).alias("name"), F.lit(t).alias("loc_type"), F.lit(src).alias("source"),
                     F.lit(p).alias("priority")) for n, t, src, p in TOKEN_GAZETTEER]
    return spark.range(1).select(F.inline(F.array(*rows)))
