"""Faceted title filter.

A ``FilterSpec`` compiles to one Column predicate over the profile plus at most
two ``left_semi`` joins (titles with a matching location, titles with a matching
theme). Semi joins never duplicate profile rows and let the planner broadcast
the id side when it is small.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Facet name -> profile column (14 facets), and the place types.
FACETS = {
    "mlGenres": "mlGenre", "imdbGenres": "imdbGenre", "years": "year",
    "continents": "continent", "regions": "region", "countries": "country",
    "dirGenders": "dir.gender", "dirRaces": "dir.race", "dirRegions": "dir.region",
    "dirCountries": "dir.country",
    "wriGenders": "wri.gender", "wriRaces": "wri.race", "wriRegions": "wri.region",
    "wriCountries": "wri.country",
}
LOC_TYPES = ["Country", "City", "State", "Region", "Other"]


def _norm(s: str | None) -> str:
    return (s or "").strip().lower()


@dataclass
class FilterSpec:
    """Filter state: free-text searches, facet selections, place and theme searches.

    ``facets`` maps a facet name (see ``FACETS``) or a profile column to the
    accepted values; an empty list means no restriction.
    """
    title: str = ""
    director: str = ""
    writer: str = ""
    facets: dict[str, list] = field(default_factory=dict)
    loc_search: dict[str, str] = field(default_factory=dict)
    idiom: str = ""
    theme: str = ""
    word: str = ""

    def predicate(self) -> Column:
        """F4 and F5 as one Column (true when nothing is selected)."""
        cond = F.lit(True)
        for text, col in ((self.title, "title"), (self.director, "director"),
                          (self.writer, "wri.name")):
            q = _norm(text)
            if q:
                cond = cond & F.lower(F.coalesce(F.col(col), F.lit(""))).contains(F.lit(q))
        for name, values in self.facets.items():
            if values:
                col = FACETS.get(name, name)
                cond = cond & F.col(col).isin(list(values))
        return cond

    def loc_active(self) -> bool:
        return any(_norm(v) for v in self.loc_search.values())

    def theme_active(self) -> bool:
        return any(_norm(v) for v in (self.idiom, self.theme, self.word))


def location_match(mentions: DataFrame, loc_search: dict[str, str],
                   location_col: str = "location", type_col: str = "locType") -> Column:
    """Row matches when the search for *its own* type is non-empty and contained."""
    cond = F.lit(False)
    for t, s in loc_search.items():
        q = _norm(s)
        if q:
            cond = cond | ((F.col(type_col) == F.lit(t))
                           & F.lower(F.col(location_col)).contains(F.lit(q)))
    return cond


def titles_with_location(mentions: DataFrame, loc_search: dict[str, str],
                         key: str = "imdbid") -> DataFrame:
    """Ids of titles with at least one mention matching the place search (OR over types)."""
    return mentions.where(location_match(mentions, loc_search)).select(key).distinct()


def titles_with_theme(theme_rows: DataFrame, key: str = "imdbid") -> DataFrame:
    """Ids of titles in an already filtered theme result."""
    return theme_rows.select(key).distinct()


def theme_match(spec: FilterSpec) -> Column:
    """F9 on theme result rows: equality on each given key."""
    cond = F.lit(True)
    for value, col in ((spec.idiom, "idiom"), (spec.theme, "theme"), (spec.word, "word")):
        if _norm(value):
            cond = cond & (F.col(col) == F.lit(value))
    return cond


def filter_titles(profile: DataFrame, spec: FilterSpec, mentions: DataFrame | None = None,
                  theme_rows: DataFrame | None = None, key: str = "imdbid") -> DataFrame:
    """the profile rows passing every active part of ``spec``.

    An active place or theme search needs its rows (``mentions``, ``theme_rows``); both are
    filtered by the spec here. A search with no match yields no titles; for themes the
    source showed all titles in that case (pinned change, see README). All-empty searches
    filter nothing.
    """
    out = profile.where(spec.predicate())
    if spec.loc_active():
        if mentions is None:
            raise ValueError("a place search is active, but there are no mentions to search")
        out = out.join(titles_with_location(mentions, spec.loc_search, key), key, "left_semi")
    if spec.theme_active():
        if theme_rows is None:
            raise ValueError("a theme search is active, but there are no theme rows to search")
        out = out.join(titles_with_theme(theme_rows.where(theme_match(spec)), key), key, "left_semi")
    return out


def filter_mentions(mentions: DataFrame, titles: DataFrame, loc_search: dict[str, str],
                    key: str = "imdbid") -> DataFrame:
    """mention rows of titles in the current set that match the place search.

    With no active search every mention row of the current titles is kept.
    """
    rows = mentions.join(titles.select(key), key, "left_semi")
    if any(_norm(v) for v in loc_search.values()):
        rows = rows.where(location_match(rows, loc_search))
    return rows
