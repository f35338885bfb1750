"""Place-name classification (Country / City / State / Region / Other).

The gazetteer is an input table ``(name, loc_type, source, priority)`` with
``source`` in {'alias', 'main'}; no word list ships with the library. Rules:

1. key = lower(trim(name))
2. an alias entry for the key wins;
3. else a main entry for the key;
4. else strip every trailing ``'`` and ``s`` character (then whitespace) and
   look the stripped key up in the main entries only;
5. else 'Other'.

Duplicate names within one source resolve to the highest ``priority``; for
main entries the default priority is the category rank below (a later
category overrides an earlier one).

Scale: rows join the gazetteer directly by alias key, main key and stripped key;
the planner broadcasts the gazetteer when it measures small, so rows are not
shuffled by name and a very common name costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetframe.functions.clean import title_case
from facetframe.functions.util import strip_ws

# Place types and the default precedence of main entries.
LOC_TYPES = ["Country", "City", "State", "Region", "Other"]
CATEGORY_RANK = {"Country": 1, "City": 2, "State": 3, "Region": 4}
OTHER = "Other"


def normalise_gazetteer(gaz: DataFrame) -> DataFrame:
    """One row per (source, key): the entry with the highest priority wins."""
    rank = F.lit(0)
    for t, r in CATEGORY_RANK.items():
        rank = F.when(F.col("loc_type") == t, F.lit(r)).otherwise(rank)
    prio = F.col("priority") if "priority" in gaz.columns else rank
    g = gaz.select(F.lower(strip_ws("name")).alias("key"), "loc_type", "source",
                   prio.cast("int").alias("_p"))
    return g.groupBy("source", "key").agg(
        F.max_by("loc_type", F.struct("_p", "loc_type")).alias("loc_type"))


def strip_possessive(key_col) -> F.Column:
    """Remove every trailing ' and s character, then surrounding whitespace."""
    return strip_ws(F.regexp_replace(key_col, "['s]+$", ""))


def _classified(df: DataFrame, gazetteer: DataFrame, name_col: str) -> DataFrame:
    """``df`` with ``_key``, ``locType`` and ``label`` of its name column."""
    g = normalise_gazetteer(gazetteer)
    entries = lambda source, key, kind: (
        g.where(F.col("source") == source).select(F.col("key").alias(key), F.col("loc_type").alias(kind)))
    d = df.withColumn("_key", F.lower(strip_ws(name_col)))
    d = d.withColumn("_stripped", strip_possessive(F.col("_key")))
    j = (d.join(entries("alias", "_alias_key", "_alias"), F.col("_key") == F.col("_alias_key"), "left")
          .join(entries("main", "_main_key", "_main"), F.col("_key") == F.col("_main_key"), "left")
          .join(entries("main", "_strip_key", "_strip"), F.col("_stripped") == F.col("_strip_key"), "left"))
    return j.select(*df.columns, "_key", F.coalesce("_alias", "_main", "_strip", F.lit(OTHER)).alias("locType"),
                    title_case(F.col(name_col)).alias("label"))


def classify_names(names: DataFrame, gazetteer: DataFrame, name_col: str = "location") -> DataFrame:
    """Distinct names -> (name, key, locType, label).

    ``label`` is the title-cased display name (case variants share a label but
    stay separate rows, as grouping upstream is case-sensitive).
    """
    d = names.select(F.col(name_col).alias("name")).distinct()
    return _classified(d, gazetteer, "name").select("name", F.col("_key").alias("key"), "locType", "label")


def classify_places(df: DataFrame, gazetteer: DataFrame, name_col: str = "location") -> DataFrame:
    """Add ``locType`` and ``label`` to every row of ``df``."""
    return _classified(df, gazetteer, name_col).drop("_key")
