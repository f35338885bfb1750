"""Registered queries over stored tables and indexes (the profile is built once, then reused).

Building one of these writes the table or index under ``spark.checkpoint.dir`` unless it is there
for the current source files; later queries only read it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetframe.operators import bitmap_index as BI
from facetframe.operators import distinct_sketches as DS
from facetframe.operators import mentions as MN
from facetframe.operators import option_chunks as OC
from facetframe.operators import substring_index as SI
from facetframe.operators import themes as TH
from facetframe.operators import topk as TK
from facetframe.operators.common import sort_cols
from facetframe.operators.filters import FACETS, FilterSpec, filter_mentions
from facetframe.operators.page_index import PageIndex, build_page_index
from facetframe.plans import analogues as A
from facetframe.plans.analogues import register
from facetframe.plans.profile import flatten_profile
from facetframe.session import scratch_path
from facetframe.sources.catalog import read_table, table_path
from facetframe.sources.publish import export_verified
from facetframe.sources.slices import balanced_slices
from facetframe.sources.stored import bucketed, stored_path


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored_profile(spark: SparkSession, base: str) -> DataFrame:
    """The profile as a table hash-partitioned and sorted by title id."""
    n = parts(spark)
    path = stored_path(spark, "profile", base, A.PROFILE_TABLES, (n,))
    return bucketed(spark, path, "imdbid", n, lambda: A.profile(spark, base))


def stored_mentions(spark: SparkSession, base: str) -> DataFrame:
    """All place mentions, hash-partitioned by title id like the profile."""
    n = parts(spark)
    path = stored_path(spark, "mentions", base, A.TEXT_TABLES, (n,))
    return bucketed(spark, path, "imdbid", n, lambda: A.token_mentions(spark, base))


@register("profile_stored")
def q_profile_stored(spark, base):
    return flatten_profile(stored_profile(spark, base))


@register("mention_table_stored")
def q_mention_table_stored(spark, base):
    """J9 over stored tables: both sides are hash-partitioned by title id already."""
    p = stored_profile(spark, base)
    return MN.mention_table(filter_mentions(stored_mentions(spark, base), p, A.LOC_SEARCH_TABLE), p)


# --- pages ----------------------------------------------------------------------------


def mention_pages(spark: SparkSession, base: str) -> PageIndex:
    """The place table of all titles by place name, descending."""
    path = stored_path(spark, "mention-pages", base, [*A.PROFILE_TABLES, *A.TEXT_TABLES], (parts(spark),))
    p = stored_profile(spark, base)
    rows = MN.mention_table(filter_mentions(stored_mentions(spark, base), p, {}), p)
    order = sort_cols([("location", "desc")], "person") + [
        F.col(c).asc_nulls_last() for c in ("imdbid", "mentions", "title", "countries", "locType")]
    return build_page_index(rows, order, path, parts(spark))


def profile_pages(spark: SparkSession, base: str) -> PageIndex:
    """The profile by title id, with row numbers for bitmaps."""
    path = stored_path(spark, "profile-pages", base, A.PROFILE_TABLES, (parts(spark),))
    return build_page_index(stored_profile(spark, base), [F.col("imdbid").asc_nulls_last()], path, parts(spark))


@register("page_deep")
def q_page_deep(spark, base):
    """The page nine tenths down the place table."""
    index = mention_pages(spark, base)
    return index.page(index.pages() * 9 // 10)


@register("page_last")
def q_page_last(spark, base):
    """A page past the end shows the last one."""
    return mention_pages(spark, base).page(10**12)


# --- facets ---------------------------------------------------------------------------

BITMAP_CHOICES = {"continents": ["ASIA", "EUROPE", "AMERICA"], "dirGenders": ["Male", "Female"],
                  "years": [1996, 1997, 1998, 2000]}


def facet_bitmaps(spark: SparkSession, base: str) -> DataFrame:
    path = stored_path(spark, "facet-bitmaps", base, A.PROFILE_TABLES, (parts(spark),))
    pages = profile_pages(spark, base)
    return BI.build_bitmaps(pages.numbered(), FACETS, path, rows=pages.total)


@register("facet_counts_bitmap")
def q_facet_counts_bitmap(spark, base):
    return BI.facet_counts(facet_bitmaps(spark, base), BITMAP_CHOICES)


@register("facet_rows_bitmap")
def q_facet_rows_bitmap(spark, base):
    return BI.selected_rows(facet_bitmaps(spark, base), BITMAP_CHOICES)


# --- text searches --------------------------------------------------------------------

SEARCHES = [("title", " High "), ("title", "order 12"), ("director", "cust 1"), ("writer", "zz"), ("title", "w "),
            ("place Other", "the"), ("place City", "o"), ("title", "no such title")]


def text_index(spark: SparkSession, base: str) -> SI.SubstringIndex:
    path = stored_path(spark, "substrings", base, [*A.PROFILE_TABLES, *A.TEXT_TABLES], (parts(spark), SI.BLOCK_TEXTS))
    return SI.build_substring_index(SI.profile_fields(stored_profile(spark, base), stored_mentions(spark, base)),
                                    path, parts(spark))


@register("search_titles_indexed")
def q_search_titles_indexed(spark, base):
    p = SI.filter_titles_indexed(stored_profile(spark, base), A.FACET_SPEC, text_index(spark, base))
    return p.select("imdbid", "title", "director", "continent", "year", F.col("dir.gender").alias("dir_gender"))


@register("search_places_indexed")
def q_search_places_indexed(spark, base):
    f = SI.filter_titles_indexed(stored_profile(spark, base), FilterSpec(loc_search=A.LOC_SEARCH_TITLES),
                                 text_index(spark, base), stored_mentions(spark, base))
    return f.select("imdbid", "title", "country")


@register("search_cost")
def q_search_cost(spark, base):
    """Texts read and found by each request, against the texts a scan reads."""
    index, out = text_index(spark, base), None
    for field, needle in SEARCHES:
        one = index.cost(field, needle)
        out = one if out is None else out.unionAll(one)
    return out


# --- most frequent keys ---------------------------------------------------------------


def top_words(spark: SparkSession, base: str) -> TK.CertifiedTop:
    return TK.top_keys(A.text_inputs(spark, base)["themes"], "IDIOM", "WORD", 15, weight="COUNT")


@register("top_words_certified")
def q_top_words_certified(spark, base):
    """A9's roll-up over words: the 15 most frequent of each idiom, few of the others counted."""
    return top_words(spark, base).result.select(F.col("group").alias("idiom"), "rank", F.col("key").alias("word"), "n")


@register("top_directors_certified")
def q_top_directors_certified(spark, base):
    """The three most frequent directors of each country."""
    p = stored_profile(spark, base).where("director <> ''").select("country", "director")
    top = TK.top_keys(p, "country", "director", 3, buckets=256)
    return top.result.select(F.col("group").alias("country"), "rank", F.col("key").alias("director"), "n")


# --- mergeable distinct counts --------------------------------------------------------

def decade():
    """A15's decade number of a year."""
    return F.floor((F.col("year") - 1) / 10).cast("bigint").alias("decade")


def theme_titles(spark: SparkSession, base: str) -> DataFrame:
    """The distinct (title, theme, country, year) of the theme rows, by title id."""
    def build() -> DataFrame:
        named = A.theme_base(spark, base).select("imdbid", "theme", "country").distinct()
        return named.join(stored_profile(spark, base).select("imdbid", F.col("year").cast("bigint").alias("year")), "imdbid")
    n = parts(spark)
    path = stored_path(spark, "theme-titles", base, [*A.PROFILE_TABLES, *A.TEXT_TABLES], (n,))
    return bucketed(spark, path, "imdbid", n, build)


def theme_sketches(spark: SparkSession, base: str) -> DataFrame:
    path = stored_path(spark, "theme-sketches", base, [*A.PROFILE_TABLES, *A.TEXT_TABLES], (DS.LOG_ENTRIES,))
    return DS.build_sketches(theme_titles(spark, base), ["theme", "country", "year"], "imdbid", path)


def director_sketches(spark: SparkSession, base: str) -> DataFrame:
    path = stored_path(spark, "director-sketches", base, A.PROFILE_TABLES, (DS.LOG_ENTRIES,))
    titles = stored_profile(spark, base).select("imdbid", F.col("dir.gender").alias("gender"), F.col("year").cast("bigint").alias("year"))
    return DS.build_sketches(titles, ["gender", "year"], "imdbid", path)


def _against_exact(exact: DataFrame, estimated: DataFrame, by: list[str], reference: str = "estimate") -> DataFrame:
    """Exact counts (``titles``) beside the estimates, and whether these keep the stated error."""
    e, s = exact.alias("e"), estimated.alias("s")
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}"))
    bound = DS.error_bound(F.col(f"s.{reference}"))
    return e.join(s, same).select(*[f"e.{c}" for c in by], "titles", "estimate",
                                  (F.abs(F.col("estimate") - F.col("titles")) <= bound).alias("within_error"))


@register("theme_titles_sketched")
def q_theme_titles_sketched(spark, base):
    """A9 per decade: distinct titles of each theme, from the union of its countries and years."""
    estimated = DS.estimates(DS.roll_up(theme_sketches(spark, base), "theme", decade()))
    exact = theme_titles(spark, base).groupBy("theme", decade()).agg(F.count_distinct("imdbid").alias("titles"))
    return _against_exact(exact, estimated, ["theme", "decade"])


@register("country_titles_sketched")
def q_country_titles_sketched(spark, base):
    """A25's roll-up from the same cells: distinct titles of each country, over all themes and years."""
    estimated = DS.estimates(DS.roll_up(theme_sketches(spark, base), "country"))
    exact = theme_titles(spark, base).groupBy("country").agg(F.count_distinct("imdbid").alias("titles"))
    return _against_exact(exact, estimated, ["country"])


@register("theme_directors_sketched")
def q_theme_directors_sketched(spark, base):
    """Titles that have the theme and a director of the gender, per year: cells of two indexes intersected."""
    themes = DS.roll_up(theme_sketches(spark, base), "theme", "year")
    estimated = DS.shared(themes, director_sketches(spark, base), ["year"])
    p = stored_profile(spark, base).select("imdbid", F.col("dir.gender").alias("gender"))
    exact = (theme_titles(spark, base).join(p, "imdbid").groupBy("theme", "gender", "year")
             .agg(F.count_distinct("imdbid").alias("titles")))
    return _against_exact(exact, estimated, ["theme", "gender", "year"], reference="larger")


# --- option tree ----------------------------------------------------------------------

CHUNK_WORDS = 100


def options_index(spark: SparkSession, base: str) -> PageIndex:
    t = A.text_inputs(spark, base)
    path = stored_path(spark, "theme-options", base, A.TEXT_TABLES, (parts(spark),))
    return OC.option_index(TH.theme_options(t["linked_themes"], t["bridge"], t["titles"], linked=True), path, parts(spark))


@register("theme_option_chunks")
def q_theme_option_chunks(spark, base):
    """D5 in rows of at most a hundred words."""
    chunks = OC.theme_chunks(options_index(spark, base), CHUNK_WORDS)
    return chunks.select("idiom", "theme", "chunk", "first", F.array_join("words", " ").alias("words"))


@register("theme_option_sizes")
def q_theme_option_sizes(spark, base):
    return OC.theme_sizes(options_index(spark, base), CHUNK_WORDS)


# --- export ---------------------------------------------------------------------------

EXPORTED = ["region", "nation", "customer", "orders", "part_texts", "no_such_table"]


def export_source(spark: SparkSession, base: str):
    """The tables to export; ``part_texts`` has numbers as text, ``no_such_table`` cannot be read."""
    def read(name: str) -> DataFrame:
        if name == "part_texts":
            part = A._part_texts(read_table(spark, base, "part"))
            return part.select("p_partkey", F.col("p_partkey").cast("string").alias("key_txt"), "rating_txt")
        return spark.read.parquet(table_path(base, name))
    return read


@register("export_roundtrip")
def q_export_roundtrip(spark, base):
    """IO5-IO7: written, read again, published; one table fails on purpose."""
    declared = {"part_texts": {"key_txt": T.LongType(), "rating_txt": T.DoubleType()}}
    return export_verified(spark, export_source(spark, base), scratch_path(spark, f"export-{uuid.uuid4().hex}"), EXPORTED, declared)


# --- partitioned reads ----------------------------------------------------------------

READ_SLICES = 16


@register("read_slices")
def q_read_slices(spark, base):
    """IO2: slices over a key of which a third is one value and some is null; every row lies in one
    slice and none passes twice the mean asked for."""
    keyed = read_table(spark, base, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey + l_linenumber AS spread",
        "CASE WHEN l_orderkey % 3 = 0 THEN 7 WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_partkey END AS k")
    slices = balanced_slices(keyed, "k", "spread", READ_SLICES)
    hits = sum((F.coalesce(F.expr(s.predicate), F.lit(False)).cast("int") for s in slices), F.lit(0))
    counted = keyed.agg(F.count(F.lit(1)).alias("rows"), F.count_if(hits == 1).alias("rows_in_one_slice"),
                        *[F.count_if(F.expr(s.predicate)).alias(f"n{i}") for i, s in enumerate(slices)])
    n = [F.col(f"n{i}") for i in range(len(slices))]
    return counted.select(
        "rows", "rows_in_one_slice", sum(n, F.lit(0)).cast("bigint").alias("rows_read"),
        sum((c for c, s in zip(n, slices) if s.kind == "null"), F.lit(0)).cast("bigint").alias("null_rows"),
        (F.greatest(*n) * READ_SLICES <= 2 * F.col("rows")).alias("within_twice_the_mean"))
