"""Theme mentions.

``theme_mentions`` is the base result; the page, total, id list, per-country
and per-theme figures are separate small plans over it, so callers persist the
base once (``ThemeResult``) instead of recomputing it five times.

Thresholds apply at two grains, as in the source: options need >= 3 mentions
per (idiom, theme, word) across titles; filtered rows need >= 3 per
(idiom, theme, word, title, country).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetframe.operators.mentions import link_titles, linked_only
from facetframe.operators.paging import THEME_SORTS, direction, resolve_sort

UNKNOWN = "Unknown"


def _key_filter(themes: DataFrame, idiom: str | None, theme: str | None, word: str | None) -> DataFrame:
    """equality on group keys, applied before the aggregate (and pushed to the scan)."""
    out = themes
    for col, val in (("IDIOM", idiom), ("THEME", theme), ("WORD", word)):
        if val:
            out = out.where(F.col(col) == F.lit(val))
    return out


def theme_mentions(themes: DataFrame, bridge: DataFrame, titles: DataFrame, countries: DataFrame,
                   idiom: str | None = None, theme: str | None = None, word: str | None = None,
                   min_mentions: int = 3, linked: bool = False) -> DataFrame:
    """A5: mentions per (idiom, theme, word, title, country) with >= ``min_mentions``.

    Columns: idiom, theme, word, mentions, imdbid, title, country (null -> 'Unknown').
    Rows are pre-summed per (subtitle id, idiom, theme, word) before the title
    joins, so the join carries one row per distinct key instead of every raw row. ``linked``:
    all of ``themes`` are of subtitles in the bridge already.
    """
    t = _key_filter(themes, idiom, theme, word)
    t = t if linked else linked_only(t, bridge)
    pre = t.groupBy("IMDB", "IDIOM", "THEME", "WORD").agg(F.sum("COUNT").alias("_c"))
    j = link_titles(pre, bridge, titles, countries)
    g = (j.groupBy("IDIOM", "THEME", "WORD", "imdbid", "title", "_pc_country")
          .agg(F.sum("_c").alias("mentions"))
          .where(F.col("mentions") >= min_mentions))
    return g.select(F.col("IDIOM").alias("idiom"), F.col("THEME").alias("theme"),
                    F.col("WORD").alias("word"), F.col("mentions").cast("bigint").alias("mentions"),
                    "imdbid", "title",
                    F.coalesce(F.col("_pc_country"), F.lit(UNKNOWN)).alias("country"))


def theme_total(base: DataFrame) -> DataFrame:
    """Number of result rows."""
    return base.agg(F.count(F.lit(1)).alias("total"))


def theme_ids(base: DataFrame) -> DataFrame:
    """Distinct title ids of the result."""
    return base.select("imdbid").distinct()


def theme_by_country(base: DataFrame) -> DataFrame:
    """Mentions per country, descending."""
    return (base.groupBy("country").agg(F.sum("mentions").cast("bigint").alias("mentions"))
                .orderBy(F.col("mentions").desc(), F.col("country").asc()))


def theme_stats(base: DataFrame, n: int = 15, approximate: bool = False) -> DataFrame:
    """Distinct titles per theme, top ``n`` (ties by theme name)."""
    cnt = F.approx_count_distinct("imdbid") if approximate else F.count_distinct("imdbid")
    return (base.groupBy("theme").agg(cnt.alias("n"))
                .orderBy(F.col("n").desc(), F.col("theme").asc()).limit(n))


def theme_page(base: DataFrame, sort: str = "mentions", dir_: str = "desc", page_no: int = 0,
               size: int = 50) -> DataFrame:
    """S3: sort key from a whitelist (unknown -> mentions), 'asc' else descending,
    LIMIT size OFFSET page*size, with the whole row as tiebreak."""
    s = resolve_sort(sort, THEME_SORTS, "mentions")
    asc = direction(dir_) == "asc"
    key = F.col(s).asc_nulls_last() if asc else F.col(s).desc_nulls_last()
    rest = [c for c in ("idiom", "theme", "word", "imdbid", "title", "country", "mentions") if c != s]
    return base.orderBy(key, *[F.col(c).asc_nulls_last() for c in rest]) \
               .offset(max(0, page_no) * size).limit(size)


@dataclass
class ThemeResult:
    """The five answers of one theme request over one persisted base."""
    base: DataFrame

    @classmethod
    def compute(cls, base: DataFrame) -> "ThemeResult":
        return cls(base.persist())

    def page(self, sort="mentions", dir_="desc", page_no=0, size=50):
        return theme_page(self.base, sort, dir_, page_no, size)

    def total(self):
        return theme_total(self.base)

    def ids(self):
        return theme_ids(self.base)

    def by_country(self):
        return theme_by_country(self.base)

    def stats(self, n=15):
        return theme_stats(self.base, n)

    def release(self):
        self.base.unpersist()


def theme_options(themes: DataFrame, bridge: DataFrame, titles: DataFrame,
                  min_mentions: int = 3, linked: bool = False) -> DataFrame:
    """D4 (+F10): distinct (idiom, theme, word) with >= ``min_mentions`` across eligible titles.
    ``linked``: all of ``themes`` are of subtitles in the bridge already."""
    t = themes.where(F.col("IDIOM").isNotNull())
    t = t if linked else linked_only(t, bridge)
    pre = t.groupBy("IMDB", "IDIOM", "THEME", "WORD").agg(F.sum("COUNT").alias("_c"))
    j = link_titles(pre, bridge, titles, None)
    return (j.groupBy(F.col("IDIOM").alias("idiom"), F.col("THEME").alias("theme"), F.col("WORD").alias("word"))
             .agg(F.sum("_c").alias("_m"))
             .where(F.col("_m") >= min_mentions)
             .select("idiom", "theme", "word"))


def theme_option_tree(options: DataFrame) -> DataFrame:
    """The nested option shape as rows: one per (idiom, theme) with the idiom's
    sorted themes and the theme's sorted words.

    Columns: idiom, themes array<string>, theme, words array<string>. The shape gathers one
    theme's words in a row; for an open vocabulary the scale form is the flat, sorted
    ``options`` themselves, and this is a last step over them.
    """
    per_theme = (options.groupBy("idiom", "theme")
                        .agg(F.array_sort(F.collect_set("word")).alias("words")))
    themes = (options.select("idiom", "theme").distinct()
                     .groupBy("idiom").agg(F.array_sort(F.collect_list("theme")).alias("themes")))
    return per_theme.join(themes, "idiom").select("idiom", "themes", "theme", "words")
