"""Bitmap facet index: facet choices and their counts without reading the rows.

Rows are numbered; for each (facet, value) and each bucket of 32 768 row numbers the index holds a
bitmap of the rows that have the value. Choices inside a facet are united, facets are intersected,
and a count is the number of bits left: one small row per value and bucket, whatever a row of the
table holds. Buckets are independent, so every step is a grouped aggregation with map-side combine.

Nulls are values of their own (a row without a value has the value null). A facet with an empty
choice does not restrict. A choice that no row has gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetframe.sources.stored import once

BUCKET_ROWS = 32_768  # bits of one of Spark's bitmaps
TASK_BUCKETS = 4


def build_bitmaps(numbered: DataFrame, facets: Mapping[str, str], path: str, row: str = "__row",
                  rows: int | None = None) -> DataFrame:
    """The index of the ``facets`` (name -> column) of rows numbered from 0, stored at ``path`` as
    (facet, value, bucket, bits); values are kept as text. With their number ``rows``, they are dealt by
    bucket into tasks of about ``TASK_BUCKETS`` buckets, whatever the size of a split or the table."""
    spark = numbered.sparkSession

    def write(where: str) -> None:
        each = numbered.select(F.col(row).alias("row"), F.bitmap_bucket_number(F.col(row) + 1).alias("bucket"),
                               *[F.col(col).cast("string").alias(f"value{i}") for i, col in enumerate(facets.values())])
        pairs = F.array(*[F.struct(F.lit(name).alias("facet"), F.col(f"value{i}").alias("value"))
                          for i, name in enumerate(facets)])
        if rows is not None:
            each = each.repartition(max(1, -(-rows // (TASK_BUCKETS * BUCKET_ROWS))), "bucket")
        cells = each.select("row", "bucket", F.explode(pairs).alias("p")).select("row", "bucket", "p.facet", "p.value")
        (cells.groupBy("facet", "value", "bucket")
         .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("row") + 1)).alias("bits"))
         .hint("rebalance", "facet").write.mode("overwrite").partitionBy("facet").parquet(where))

    schema = "facet string, value string, bucket long, bits binary"
    return spark.read.schema(schema).parquet(once(spark, path, write))


def _any_of(choices: Mapping[str, Iterable]) -> Column:
    """Index rows of the chosen values; null is chosen by None."""
    def one(facet: str, values: list) -> Column:
        known = F.col("value").isin([str(v) for v in values if v is not None])
        return (F.col("facet") == facet) & (known | F.col("value").isNull() if None in values else known)
    return reduce(lambda a, b: a | b, [one(f, list(v)) for f, v in choices.items()])


def selection(index: DataFrame, choices: Mapping[str, Iterable]) -> DataFrame:
    """(bucket, chosen): the rows that pass every facet's choice."""
    active = {f: list(v) for f, v in choices.items() if list(v)}
    if not active:
        every = index.where(F.col("facet") == index.select(F.min("facet")).scalar())
        return every.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("chosen"))
    inside = index.where(_any_of(active)).groupBy("bucket", "facet").agg(F.bitmap_or_agg("bits").alias("bits"))
    return (inside.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("chosen"), F.count("*").alias("facets"))
            .where(F.col("facets") == len(active)).select("bucket", "chosen"))


def selected_rows(index: DataFrame, choices: Mapping[str, Iterable]) -> DataFrame:
    """A10's number of rows under the choices, as one row (rows)."""
    return selection(index, choices).agg(F.coalesce(F.sum(F.bitmap_count("chosen")), F.lit(0)).alias("rows"))


def facet_counts(index: DataFrame, choices: Mapping[str, Iterable], facets: Iterable[str] | None = None) -> DataFrame:
    """(facet, value, n): rows under the choices per value of every facet (or of ``facets``); values
    without a row are left out."""
    rows = index if facets is None else index.where(F.col("facet").isin(list(facets)))
    both = rows.join(selection(index, choices), "bucket").select("facet", "value", "bucket", F.explode(F.array("bits", "chosen")).alias("b"))
    cells = both.groupBy("facet", "value", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("b")).alias("n"))
    return cells.groupBy("facet", "value").agg(F.sum("n").alias("n")).where("n > 0")
