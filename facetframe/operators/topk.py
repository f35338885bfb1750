"""Exact most frequent keys per group with a certificate.

Counting every key of a group shuffles all distinct keys. Here a first pass adds up the weights
of hash buckets of keys: a sketch of at most ``buckets`` numbers per group, made with map-side
combine, and two sketches of parts of the data merge by addition. A bucket's total is an upper
bound for each key in it. The keys of the heaviest buckets are then counted exactly; their k-th
count is a lower bound for the k-th place. A bucket whose total is below it cannot hold a
winner: that is the certificate. Keys of the buckets it does not rule out are counted as well,
so the answer is exact on any data; where counts are flat, that is the full count.

Weights must not be negative. Ties go to the smaller key. Null keys take no part; null is a group
of its own. Groups with fewer than k keys give all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetframe.sources.stored import written


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def count_sketch(rows: DataFrame, group: str, key: str, weight: str | None = None, buckets: int = 4096) -> DataFrame:
    """(group, bucket, total): weights of the keys of each hash bucket."""
    w = F.lit(1) if weight is None else F.col(weight)
    return (rows.where(F.col(key).isNotNull())
            .groupBy(F.col(group).alias("group"), bucket_of(F.col(key), buckets).alias("bucket"))
            .agg(F.sum(w).cast("long").alias("total")))


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    """The sketch of all rows that the given ones were made of."""
    every = sketches[0]
    for s in sketches[1:]:
        every = every.unionByName(s)
    return every.groupBy("group", "bucket").agg(F.sum("total").alias("total"))


@dataclass
class CertifiedTop:
    """``result``: (group, rank, key, n). ``cost``: per group the buckets of the sketch, those whose
    keys were counted, and the weight in them against all (total, recounted)."""

    result: DataFrame
    cost: DataFrame


def top_keys(rows: DataFrame, group: str, key: str, k: int, weight: str | None = None, buckets: int = 4096,
             probe: int | None = None, sketch: DataFrame | None = None) -> CertifiedTop:
    """The k keys of largest weight of each group. ``probe``: heaviest buckets counted first (default
    2 k). Starts jobs: the sketch and the first count are written and read again."""
    w = F.lit(1) if weight is None else F.col(weight)
    named = rows.where(F.col(key).isNotNull()).select(
        F.col(group).alias("group"), F.col(key).alias("key"), w.alias("w"), bucket_of(F.col(key), buckets).alias("bucket"))
    totals = written(count_sketch(rows, group, key, weight, buckets) if sketch is None else sketch, "sketch")
    # at most `buckets` rows of a group in the window
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("total"), "bucket"))
    ranked = totals.withColumn("probed", place <= F.lit(2 * k if probe is None else probe))

    def count(wanted: DataFrame) -> DataFrame:
        some = wanted.select(F.col("group").alias("g"), F.col("bucket").alias("b"))
        met = named.join(some, named["group"].eqNullSafe(some["g"]) & (named["bucket"] == some["b"]), "left_semi")
        return met.groupBy("group", "bucket", "key").agg(F.sum("w").cast("long").alias("n"))

    def best(counted: DataFrame) -> DataFrame:
        order = (F.desc("n"), F.asc("key"))
        few = counted.withColumn("rank", F.row_number().over(Window.partitionBy("group", "bucket").orderBy(*order)))
        few = few.where(F.col("rank") <= k)  # at most k of each bucket go on
        return few.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(*order))).where(F.col("rank") <= k)

    first = written(best(count(ranked.where("probed"))).select("group", "bucket", "key", "n"), "probed")
    least = first.groupBy(F.col("group").alias("g")).agg(F.when(F.count("*") >= k, F.min("n")).alias("least"))
    judged = (ranked.join(least, ranked["group"].eqNullSafe(least["g"]), "left")
              .withColumn("counted", F.col("probed") | F.col("least").isNull() | (F.col("total") >= F.col("least")))
              .select("group", "bucket", "total", "probed", "counted"))
    judged = written(judged, "judged")
    second = count(judged.where("counted and not probed"))
    final = best(first.select("group", "bucket", "key", "n").unionAll(second))
    cost = judged.groupBy("group").agg(
        F.count("*").alias("buckets"), F.count_if("counted").alias("buckets_counted"), F.sum("total").alias("total"),
        F.sum(F.when(F.col("counted"), F.col("total")).otherwise(0)).alias("recounted"))
    return CertifiedTop(final.select("group", F.col("rank").cast("long").alias("rank"), "key", "n"), cost)
