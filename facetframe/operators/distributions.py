"""Headline figures and distributions over a (filtered) profile.

Every operator here is an aggregate whose grouping keys have small domains
(genre, continent, band, bin); partial aggregation runs map-side, so the
shuffle carries one row per key per task whatever the skew. Zero-filled
outputs build their domain with ``explode`` on a one-row frame (no driver-side
data, no cartesian product).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetframe.functions.rounding import to_fixed
from facetframe.functions.util import as_col
from facetframe.operators.common import mean_of_tenths, scalar_of, tenths

# Display domains of the breakdowns and the fixed histogram edges.
RACES = ["WHITE", "ASIAN", "BLACK", "INDIGENOUS", "MIXED-RACE", "UNKNOWN"]
GENDERS = ["Male", "Female", "Unknown"]
ML_EDGES = [0.0, 3.5, 4.0, 4.5, 99.0]
IMDB_EDGES = [0.0, 7.0, 7.5, 8.0, 99.0]
AGE_BANDS = [("> 60", 61, 999), ("51 a 60", 51, 60), ("41 a 50", 41, 50), ("31 a 40", 31, 40),
             ("21 a 30", 21, 30), ("ate 20", 0, 20)]
EN_DASH = "–"


def rating_distribution(ratings: DataFrame, rating_col: str = "RATING",
                        count_col: str = "COUNT_RATING") -> DataFrame:
    """A3: total votes per rating value over all rating rows, ordered by rating."""
    return (ratings.groupBy(F.col(rating_col).alias("rating"))
                   .agg(F.sum(count_col).alias("votes"))
                   .orderBy(F.col("rating").asc_nulls_last()))


def kpis(filtered: DataFrame, all_titles: DataFrame) -> DataFrame:
    """A10: one row of headline figures for the filtered set.

    Means are of one-decimal values over their exact sum, rounded by M3 at one decimal
    (0.0 when the set is empty).
    """
    f = filtered.agg(
        F.count(F.lit(1)).alias("films"),
        F.count_distinct("country").alias("countries"),
        F.coalesce(F.sum("votesImdb"), F.lit(0)).cast("bigint").alias("votes_imdb"),
        F.coalesce(F.sum("votesMl"), F.lit(0)).cast("bigint").alias("votes_ml"),
        F.sum(tenths("ratingImdb")).alias("_r_imdb"),
        F.sum(tenths("ratingMl")).alias("_r_ml"),
        F.coalesce(F.sum("oscars"), F.lit(0)).cast("bigint").alias("oscars"),
        F.coalesce(F.sum("otherAwards"), F.lit(0)).cast("bigint").alias("other_awards"),
    )
    films_all = scalar_of(all_titles.agg(F.count(F.lit(1))))
    return f.select(
        "films", films_all.alias("films_all"), "countries", "votes_imdb", "votes_ml",
        F.coalesce(to_fixed(mean_of_tenths(F.col("_r_imdb"), F.col("films"))), F.lit(0.0)).alias("mean_rating_imdb"),
        F.coalesce(to_fixed(mean_of_tenths(F.col("_r_ml"), F.col("films"))), F.lit(0.0)).alias("mean_rating_ml"),
        "oscars", "other_awards")


def distribution(df: DataFrame, col: str, value: str | None = None,
                 exclude: Sequence[str] = ()) -> DataFrame:
    """Count of rows (or sum of ``value``) per value of ``col``, descending.

    Values in ``exclude`` (and nulls) get no row. With ``value``, a group
    appears only if some row has a non-zero value.
    """
    x = F.col(col)
    d = df.where(x.isNotNull() & ~x.isin(list(exclude))) if exclude else df.where(x.isNotNull())
    if value is None:
        out = d.groupBy(x.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    else:
        v = F.col(value)
        out = (d.where(v.isNotNull() & (v != 0))
                .groupBy(x.alias("label")).agg(F.sum(v).alias("n")))
    return out.orderBy(F.col("n").desc(), F.col("label").asc())


# The three facets of the chart tab and what each leaves out.
FACET_EXCLUDES = {"genre": [], "continent": ["", "Other"], "region": [""]}


def facet_distributions(df: DataFrame) -> DataFrame:
    """A11-A14 in one scan: GROUPING SETS over (genre), (continent), (region).

    Returns long rows ``(facet, label, measure, value)`` with measure in
    {films, oscars, otherAwards}; exclusions and the non-zero rule per facet
    are applied after the single aggregate.
    """
    g = df.groupingSets([["genre"], ["continent"], ["region"]], "genre", "continent", "region").agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("films"),
        F.sum("oscars").alias("oscars"),
        F.count_if(F.col("oscars") != 0).alias("_n_osc"),
        F.sum("otherAwards").alias("otherAwards"),
        F.count_if(F.col("otherAwards") != 0).alias("_n_aw"),
    )
    # grouping_id bits follow the column order (genre, continent, region).
    facet = (F.when(F.col("_gid") == 3, F.lit("genre"))
              .when(F.col("_gid") == 5, F.lit("continent"))
              .otherwise(F.lit("region")))
    label = F.coalesce(
        F.when(F.col("_gid") == 3, F.col("genre")),
        F.when(F.col("_gid") == 5, F.col("continent")),
        F.when(F.col("_gid") == 6, F.col("region")))
    g = g.select(facet.alias("facet"), label.alias("label"), "films", "oscars", "_n_osc",
                 "otherAwards", "_n_aw")
    excluded = F.lit(False)
    for fct, ex in FACET_EXCLUDES.items():
        if ex:
            excluded = excluded | ((F.col("facet") == fct) & F.col("label").isin(ex))
    g = g.where(F.col("label").isNotNull() & ~excluded)
    rows = F.explode(F.array(
        F.struct(F.lit("films").alias("measure"), F.col("films").cast("bigint").alias("value"),
                 F.lit(True).alias("keep")),
        F.struct(F.lit("oscars").alias("measure"), F.col("oscars").cast("bigint").alias("value"),
                 (F.col("_n_osc") > 0).alias("keep")),
        F.struct(F.lit("otherAwards").alias("measure"), F.col("otherAwards").cast("bigint").alias("value"),
                 (F.col("_n_aw") > 0).alias("keep")),
    ))
    long = g.select("facet", "label", rows.alias("r"))
    # The genre facet is charted by count only.
    return (long.where(F.col("r.keep") & ((F.col("facet") != "genre") | (F.col("r.measure") == "films")))
                .select("facet", "label", F.col("r.measure").alias("measure"),
                        F.col("r.value").alias("value")))


def by_decade(filtered: DataFrame, all_titles: DataFrame, year_col: str = "year") -> DataFrame:
    """Titles per decade, zero-filled over the decades spanned by *all* titles.

    Decade index = floor((year - 1) / 10); label 'start–end' with the newest
    decade ending at the newest year. Ordered newest first.
    """
    idx = lambda c: F.floor((F.col(c) - F.lit(1)) / F.lit(10)).cast("bigint")
    rng = all_titles.where(F.col(year_col).isNotNull()).agg(
        F.min(year_col).alias("_ymin"), F.max(year_col).alias("_ymax"))
    dom = rng.select(
        "_ymax", F.explode(F.sequence(F.floor((F.col("_ymin") - 1) / 10).cast("bigint"),
                                      F.floor((F.col("_ymax") - 1) / 10).cast("bigint"))).alias("decade"))
    dom = dom.withColumn("_last", F.col("decade") == F.floor((F.col("_ymax") - 1) / 10).cast("bigint"))
    counts = (filtered.where(F.col(year_col).isNotNull())
                      .groupBy(idx(year_col).alias("decade")).agg(F.count(F.lit(1)).alias("n")))
    start = F.col("decade") * 10 + 1
    end = F.when(F.col("_last"), F.col("_ymax").cast("bigint")).otherwise(start + 9)
    return (dom.join(counts, "decade", "left")
               .select("decade",
                       F.concat(start.cast("string"), F.lit(EN_DASH), end.cast("string")).alias("label"),
                       F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))
               .orderBy(F.col("decade").desc()))


def histogram(df: DataFrame, col, edges: Sequence[float], dash: str = EN_DASH) -> DataFrame:
    """Zero-filled counts over half-open bins [e_i, e_{i+1}) in one pass.

    Labels: '<e1', 'e_i<dash>e_{i+1}', 'e_{n-1}+' (one decimal).
    """
    x = as_col(col)
    edges = list(edges)
    nb = len(edges) - 1
    aggs = [F.count_if((x >= F.lit(edges[i])) & (x < F.lit(edges[i + 1]))).alias(f"_b{i}")
            for i in range(nb)]
    row = df.agg(*aggs)

    def label(i: int) -> str:
        if i == 0:
            return f"<{edges[1]:.1f}"
        if i == nb - 1:
            return f"{edges[i]:.1f}+"
        return f"{edges[i]:.1f}{dash}{edges[i + 1]:.1f}"

    bins = F.explode(F.array(*[
        F.struct(F.lit(i).alias("bin"), F.lit(label(i)).alias("label"),
                 F.lit(edges[i]).alias("lo"), F.lit(edges[i + 1]).alias("hi"),
                 F.col(f"_b{i}").cast("bigint").alias("n"))
        for i in range(nb)]))
    return row.select(bins.alias("b")).select("b.*")


def breakdown(df: DataFrame, col, domain: Sequence[str]) -> DataFrame:
    """Counts over a fixed domain (zero-filled) with share % of all rows.

    share = floor(n / max(1, total) * 100 + 0.5) in double arithmetic; rows
    whose value is outside the domain count in the total but get no row.
    """
    x = as_col(col)
    aggs = [F.count(F.lit(1)).alias("_total")]
    aggs += [F.count_if(x == F.lit(v)).alias(f"_d{i}") for i, v in enumerate(domain)]
    row = df.agg(*aggs)
    items = F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(v).alias("label"), F.col(f"_d{i}").cast("bigint").alias("n"))
        for i, v in enumerate(domain)]))
    tot = F.greatest(F.lit(1), F.col("_total")).cast("double")
    return (row.select("_total", items.alias("d"))
               .select(F.col("d.pos").alias("pos"), F.col("d.label").alias("label"), F.col("d.n").alias("n"),
                       F.floor(F.col("d.n").cast("double") / tot * F.lit(100.0) + F.lit(0.5))
                        .cast("bigint").alias("share")))


def age_pyramid(df: DataFrame, role: str = "dir", bands=AGE_BANDS) -> DataFrame:
    """Male / Female counts per age band (zero-filled); null, negative or
    out-of-band ages and other genders are left out."""
    age, gender = F.col(f"{role}.age"), F.col(f"{role}.gender")
    aggs = []
    for i, (_, lo, hi) in enumerate(bands):
        inb = age.isNotNull() & (age >= lo) & (age <= hi)
        aggs.append(F.count_if(inb & (gender == "Male")).alias(f"_m{i}"))
        aggs.append(F.count_if(inb & (gender == "Female")).alias(f"_f{i}"))
    row = df.agg(*aggs)
    items = F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(lbl).alias("band"), F.lit(lo).alias("lo"),
                 F.lit(hi).alias("hi"), F.col(f"_m{i}").cast("bigint").alias("male"),
                 F.col(f"_f{i}").cast("bigint").alias("female"))
        for i, (lbl, lo, hi) in enumerate(bands)]))
    return row.select(items.alias("b")).select("b.*")
