"""Registered queries: each catalogue operator run over the driver's tables.

Every callable takes ``(spark, sf_dir)``, reads the whole tables it needs and
returns a lazy DataFrame with flat, explicitly named columns (so the DuckDB
restatement in ``parity_sql`` can match them by name).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetframe.functions import clean as C
from facetframe.functions.rounding import round_exact, round_half_up, to_fixed
from facetframe.operators import distributions as D
from facetframe.operators import facets as FA
from facetframe.operators import geo as G
from facetframe.operators import mentions as MN
from facetframe.operators import paging as PG
from facetframe.operators import people as PE
from facetframe.operators import themes as TH
from facetframe.operators.enrich import first_per_key, list_per_key, lookup_with_fallback
from facetframe.operators.filters import FilterSpec, filter_mentions, filter_titles
from facetframe.operators.places import classify_names
from facetframe.plans import orders as O
from facetframe.plans.orders import order_profile
from facetframe.plans.profile import flatten_profile
from facetframe.sources.catalog import read_table, register_tables, while_unchanged
from facetframe.sources.ingest import normalise_types

PROFILE_TABLES = ["orders", "lineitem", "part", "supplier", "customer", "nation", "region"]
TEXT_TABLES = ["documents", "labels", "orders", "lineitem", "supplier", "nation"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def profile(spark: SparkSession, base: str) -> DataFrame:
    return while_unchanged(spark, base, PROFILE_TABLES, "profile", lambda: order_profile(spark, base))


@register("order_profile")
def q_order_profile(spark, base):
    return flatten_profile(profile(spark, base))


# --- filters and headline figures -------------------------------------------------


FACET_SPEC = FilterSpec(title=" High ", director="cust 1",
                        facets={"continents": ["ASIA", "EUROPE", "AMERICA"],
                                "dirGenders": ["Male", "Female"], "years": [1996, 1997, 1998, 2000]})
KPI_SPEC = FilterSpec(facets={"years": [1996, 1997, 1998], "wriRaces": ["WHITE", "UNKNOWN"]})


@register("facet_filter")
def q_facet_filter(spark, base):
    p = filter_titles(profile(spark, base), FACET_SPEC)
    return p.select("imdbid", "title", "director", "continent", "year",
                    F.col("dir.gender").alias("dir_gender"))


@register("kpis")
def q_kpis(spark, base):
    p = profile(spark, base)
    return D.kpis(filter_titles(p, KPI_SPEC), p)


@register("grouping_sets")
def q_grouping_sets(spark, base):
    return D.facet_distributions(profile(spark, base))


@register("distribution_count")
def q_distribution_count(spark, base):
    return D.distribution(profile(spark, base), "genre")


@register("distribution_sum")
def q_distribution_sum(spark, base):
    return D.distribution(profile(spark, base), "continent", value="otherAwards",
                          exclude=["", "Other"])


@register("decade_counts")
def q_decade_counts(spark, base):
    p = profile(spark, base)
    return D.by_decade(p.where(F.col("continent") == "ASIA"), p)


@register("histogram_ml")
def q_histogram_ml(spark, base):
    return D.histogram(profile(spark, base), "ratingMl", D.ML_EDGES)


@register("histogram_imdb")
def q_histogram_imdb(spark, base):
    return D.histogram(profile(spark, base), "rating", D.IMDB_EDGES, dash="-")


@register("histogram_events")
def q_histogram_events(spark, base):
    return D.histogram(read_table(spark, base, "events"), "value", [0.0, 1.0, 10.0, 100.0, 1000.0])


@register("breakdown_race")
def q_breakdown_race(spark, base):
    return D.breakdown(profile(spark, base), "dir.race", D.RACES)


@register("breakdown_gender")
def q_breakdown_gender(spark, base):
    return D.breakdown(profile(spark, base), "wri.gender", D.GENDERS)


@register("breakdown_segment")
def q_breakdown_segment(spark, base):
    return D.breakdown(read_table(spark, base, "customer"), "c_mktsegment",
                       ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", ""])


@register("age_pyramid_dir")
def q_age_pyramid_dir(spark, base):
    return D.age_pyramid(profile(spark, base), "dir")


@register("age_pyramid_wri")
def q_age_pyramid_wri(spark, base):
    return D.age_pyramid(profile(spark, base), "wri")


@register("country_rollup_best")
def q_country_rollup_best(spark, base):
    return PE.by_country(profile(spark, base))


@register("top_entity_per_group")
def q_top_entity_per_group(spark, base):
    return PE.people_by_country(profile(spark, base), "dir")


@register("top15_writer_countries")
def q_top15_writer_countries(spark, base):
    return PE.top_countries(PE.people_by_country(profile(spark, base), "wri"), 15)


@register("people_table_dir")
def q_people_table_dir(spark, base):
    return PE.people_table(profile(spark, base), "dir")


@register("people_table_wri")
def q_people_table_wri(spark, base):
    return PE.people_table(profile(spark, base), "wri")


@register("map_metric")
def q_map_metric(spark, base):
    nation = read_table(spark, base, "nation")
    per_country = PE.by_country(profile(spark, base)).select("country", F.col("films").alias("value"))
    return G.map_metric(per_country, nation, code_name="n_name", code="n_nationkey")


@register("share_of_max")
def q_share_of_max(spark, base):
    return G.share_of_max(D.distribution(profile(spark, base), "genre"), "n")


@register("facet_values")
def q_facet_values(spark, base):
    return FA.all_facet_values(profile(spark, base))


@register("page_sorted")
def q_page_sorted(spark, base):
    pg = PG.film_page(profile(spark, base), "rating", "desc", page_no=3)
    return pg.select("imdbid", "title", "rating", "year")


@register("page_people")
def q_page_people(spark, base):
    people = PE.people_table(profile(spark, base), "wri")
    return PG.person_page(people, "birthYear", "asc", page_no=1).select("name", "id", "birthYear", "count")


@register("page_info")
def q_page_info(spark, base):
    return PG.page_info(profile(spark, base), page_no=10_000)


# --- text: mentions, places, themes -------------------------------------------------

THEME_IDIOM = "EN"
LOC_SEARCH_TABLE = {"Country": "the", "City": "o"}
LOC_SEARCH_TITLES = {"State": "de", "Region": "and"}


def text_inputs(spark, base):
    rd = lambda n: read_table(spark, base, n)
    docs = rd("documents")
    linked = O.linked_documents(spark, base)
    return dict(geo=O.conform_geo(docs), themes=O.conform_themes(docs),
                linked_geo=O.conform_geo(linked), linked_themes=O.conform_themes(linked),
                bridge=O.conform_subtitle_bridge(rd("labels")), titles=O.conform_titles(rd("orders")),
                countries=O.conform_country_bridge(rd("lineitem"), rd("supplier"), rd("nation")),
                gazetteer=O.token_gazetteer(spark))


def token_mentions(spark, base, **options):
    def build():
        t = text_inputs(spark, base)
        return MN.location_mentions(t["linked_geo"], t["bridge"], t["titles"], t["countries"], t["gazetteer"],
                                    linked=True, **options)
    return while_unchanged(spark, base, TEXT_TABLES, f"mentions {sorted(options.items())}", build)


def theme_base(spark, base, **keys):
    def build():
        t = text_inputs(spark, base)
        return TH.theme_mentions(t["linked_themes"], t["bridge"], t["titles"], t["countries"], linked=True, **keys)
    return while_unchanged(spark, base, TEXT_TABLES, f"themes {sorted(keys.items())}", build)


@register("token_mentions")
def q_token_mentions(spark, base):
    return token_mentions(spark, base)


@register("classify_tokens")
def q_classify_tokens(spark, base):
    t = text_inputs(spark, base)
    return classify_names(t["geo"], t["gazetteer"], "LOCATION")


@register("mentions_by_country")
def q_mentions_by_country(spark, base):
    return MN.mentions_by_country(token_mentions(spark, base))


@register("mention_table")
def q_mention_table(spark, base):
    p = profile(spark, base)
    rows = filter_mentions(token_mentions(spark, base), p, LOC_SEARCH_TABLE)
    return MN.mention_table(rows, p)


@register("location_options")
def q_location_options(spark, base):
    return MN.location_options(token_mentions(spark, base), profile(spark, base))


@register("titles_by_country")
def q_titles_by_country(spark, base):
    p = profile(spark, base)
    rows = filter_mentions(token_mentions(spark, base), p, LOC_SEARCH_TITLES)
    return MN.titles_by_country(rows, p, 15)


@register("semi_join_mentions")
def q_semi_join_mentions(spark, base):
    p = profile(spark, base)
    f = filter_titles(p, FilterSpec(loc_search=LOC_SEARCH_TITLES), mentions=token_mentions(spark, base))
    return f.select("imdbid", "title", "country")


@register("theme_page")
def q_theme_page(spark, base):
    return TH.theme_page(theme_base(spark, base), "mentions", "desc", page_no=1)


@register("theme_total")
def q_theme_total(spark, base):
    return TH.theme_total(theme_base(spark, base))


@register("theme_ids")
def q_theme_ids(spark, base):
    return TH.theme_ids(theme_base(spark, base))


@register("theme_by_country")
def q_theme_by_country(spark, base):
    return TH.theme_by_country(theme_base(spark, base))


@register("theme_top15")
def q_theme_top15(spark, base):
    return TH.theme_stats(theme_base(spark, base), 15)


@register("theme_options")
def q_theme_options(spark, base):
    t = text_inputs(spark, base)
    return TH.theme_options(t["linked_themes"], t["bridge"], t["titles"], linked=True)


@register("theme_option_tree")
def q_theme_option_tree(spark, base):
    t = text_inputs(spark, base)
    tree = TH.theme_option_tree(TH.theme_options(t["linked_themes"], t["bridge"], t["titles"], linked=True))
    return tree.select("idiom", F.array_join("themes", " ").alias("themes"), "theme",
                       F.array_join("words", " ").alias("words"))


# --- primitives, cleaning rules, rounding, ingest ------------------------------------

LINE_COLS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@register("primary_row_per_key")
def q_primary_row_per_key(spark, base):
    return first_per_key(read_table(spark, base, "lineitem"), "l_orderkey", LINE_COLS)


@register("delimited_list")
def q_delimited_list(spark, base):
    li, part = read_table(spark, base, "lineitem"), read_table(spark, base, "part")
    j = li.join(part, li["l_partkey"] == part["p_partkey"], "inner")
    return list_per_key(j, "l_orderkey", "p_type", alias="types")


@register("fallback_lookup")
def q_fallback_lookup(spark, base):
    cust, nation = read_table(spark, base, "customer"), read_table(spark, base, "nation")
    c = cust.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("iso"),
        F.when(F.col("c_custkey") % 7 == 0, F.lower(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))))
         .otherwise(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).alias("cname"))
    dim = nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("iso"),
                        F.col("n_name").alias("cname"), "n_regionkey")
    out = lookup_with_fallback(c, dim, ("iso", "iso"), ("cname", "cname"), ["cname", "n_regionkey"])
    return out.select("c_custkey", "dim_cname", "dim_n_regionkey", "dim_cname_by_key")


@register("value_distribution")
def q_value_distribution(spark, base):
    return D.rating_distribution(O.conform_ratings(read_table(spark, base, "lineitem")))


def _part_texts(part):
    k = F.col("p_partkey")
    num = F.concat(F.col("p_size").cast("string"), F.lit("."), (k % 10).cast("string"))
    rating_txt = (F.when(k % 13 == 0, F.lit("N/A")).when(k % 17 == 0, F.concat(num, F.lit("d")))
                   .when(k % 19 == 0, F.lit("")).when(k % 23 == 0, F.lit("nan"))
                   .when(k % 29 == 0, F.concat(F.lit(" "), num, F.lit(" "))).otherwise(num))
    votes_txt = F.when(k % 11 == 0, F.lit("N/A")).otherwise(
        F.concat(F.col("p_size").cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0")))
    box_txt = (F.when(k % 7 == 0, F.lit("$0")).when(k % 9 == 0, F.lit(""))
                .otherwise(F.concat(F.lit("$"), (k * 12347).cast("string"))))
    seg = k % 4
    gender_txt = (F.when(seg == 0, F.lit("MALE")).when(seg == 1, F.lit("female"))
                   .when(seg == 2, F.lit("")).otherwise(F.lit("other")))
    race_txt = (F.when(k % 5 == 0, F.lit("undefined")).when(k % 5 == 1, F.lit(None).cast("string"))
                 .otherwise(F.lower("p_type")))
    return part.select("p_partkey", rating_txt.alias("rating_txt"), votes_txt.alias("votes_txt"),
                       box_txt.alias("box_txt"), gender_txt.alias("gender_txt"), race_txt.alias("race_txt"))


@register("clean_numbers")
def q_clean_numbers(spark, base):
    t = _part_texts(read_table(spark, base, "part"))
    return t.select("p_partkey", C.rating("rating_txt").alias("rating"),
                    C.digits_int("votes_txt").alias("votes"), C.money_millions("box_txt").alias("box"),
                    C.gender("gender_txt").alias("gender"), C.race("race_txt").alias("race"))


@register("clean_labels")
def q_clean_labels(spark, base):
    part = read_table(spark, base, "part")
    k = F.col("p_partkey")
    raw = (F.when(k % 3 == 0, F.concat(F.upper("p_name"), F.lit("-"), F.lower("p_type"), F.lit("/"), F.col("p_brand")))
            .when(k % 3 == 1, F.concat(F.lit(" "), F.col("p_name"), F.lit("--"), F.col("p_type"), F.lit(" /x")))
            .otherwise(F.concat(F.col("p_name"), F.lit("'S "), F.col("p_brand"))))
    return part.select("p_partkey", raw.alias("raw"), C.title_case(raw).alias("label"))


@register("round_exact")
def q_round_exact(spark, base):
    part = read_table(spark, base, "part")
    x = F.col("p_retailprice") / F.lit(2.0)
    y = F.col("p_retailprice") / F.lit(8.0)
    return part.select("p_partkey", round_exact(x, 1).alias("rx1"), round_half_up(x, 1).alias("rh1"),
                       to_fixed(x, 1).alias("tf1"), round_exact(y, 2).alias("rx2"))


@register("ingest_normalise")
def q_ingest_normalise(spark, base):
    o = read_table(spark, base, "orders").select(
        F.col("o_orderkey").cast("decimal(12,0)").alias("o_orderkey"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"),
        F.col("o_custkey").cast("int").alias("o_custkey"),
        F.col("o_orderstatus"))
    return normalise_types(o)


# --- combined filters and table pages ------------------------------------------------
THEME_WORD = "the"


@register("theme_filter_titles")
def q_theme_filter_titles(spark, base):
    spec = FilterSpec(idiom=THEME_IDIOM, word=THEME_WORD)
    rows = theme_base(spark, base, idiom=THEME_IDIOM, word=THEME_WORD)
    f = filter_titles(profile(spark, base), spec, theme_rows=rows)
    return f.select("imdbid", "title", "genre")


def _location_table(spark, base):
    p = profile(spark, base)
    return MN.mention_table(filter_mentions(token_mentions(spark, base), p, LOC_SEARCH_TABLE), p)


@register("location_page")
def q_location_page(spark, base):
    return PG.location_page(_location_table(spark, base), "location", "asc", page_no=2)


@register("location_page_title")
def q_location_page_title(spark, base):
    return PG.location_page(_location_table(spark, base), "title", "desc", page_no=1)


@register("people_table_by_id")
def q_people_table_by_id(spark, base):
    return PE.people_table(profile(spark, base), "dir", key="id")


# --- options of operators above -------------------------------------------------------


@register("profile_ordered")
def q_profile_ordered(spark, base):
    """The whole profile, ordered by title."""
    return flatten_profile(order_profile(spark, base, order_by_title=True))


@register("profile_by_title")
def q_profile_by_title(spark, base):
    """The whole profile, ordered by title."""
    return flatten_profile(order_profile(spark, base, order_by_title=True))


@register("token_mentions_top")
def q_token_mentions_top(spark, base):
    return token_mentions(spark, base, limit=200)


@register("facet_values_years")
def q_facet_values_years(spark, base):
    return FA.facet_values(profile(spark, base), "years").select(F.col("value").cast("bigint").alias("value"))


@register("facet_values_fallback")
def q_facet_values_fallback(spark, base):
    """No profile row has a region in the set, so the domain comes from the region table."""
    empty = profile(spark, base).where(F.col("region") == "nowhere")
    names = read_table(spark, base, "region").select(F.col("r_name").alias("value"))
    return FA.facet_values(empty, "regions", fallback=names)


@register("registered_views")
def q_registered_views(spark, base):
    """IO1: the tables as views, queried by name."""
    register_tables(spark, base, ["orders", "customer", "nation", "region"])
    return spark.sql("SELECT r_name, count(*) AS orders, count(DISTINCT c_custkey) AS customers, "
                     "count(DISTINCT n_nationkey) AS nations FROM orders JOIN customer ON o_custkey = c_custkey "
                     "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")


@register("ingest_declared")
def q_ingest_declared(spark, base):
    """IO4: one declared column converts throughout, the other holds text and stays text."""
    part = _part_texts(read_table(spark, base, "part")).select(
        "p_partkey", F.col("p_partkey").cast("string").alias("key_txt"), "rating_txt")
    return normalise_types(part, {"key_txt": T.LongType(), "rating_txt": T.DoubleType()})


def _theme_page_by(sort: str, dir_: str):
    def q(spark, base):
        return TH.theme_page(theme_base(spark, base), sort, dir_, page_no=0)
    return q


for _sort in ("title", "idiom", "theme", "word"):
    for _dir in ("asc", "desc"):
        QUERIES[f"theme_page_{_sort}_{_dir}"] = _theme_page_by(_sort, _dir)
QUERIES["theme_page_mentions_asc"] = _theme_page_by("mentions", "asc")
