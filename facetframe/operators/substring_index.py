"""Substring index: trigram postings over the distinct texts of several fields.

``contains`` reads every row of every request. The index holds each distinct text once (lower
case), numbered in blocks of ``BLOCK_TEXTS``, and for every trigram and block the numbers of the
block's texts that hold it. A request reads the postings of its needle's trigrams, keeps the texts
named by all of them, and verifies those on the text itself, so the answer is that of ``contains``.
A list never holds more than a block's texts, also for a trigram of every text.

Needles of one or two code points have no trigram: they scan the distinct texts. An empty needle
restricts nothing and is the caller's case. Null texts are in no answer.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetframe.operators.filters import LOC_TYPES, FilterSpec, _norm
from facetframe.sources.catalog import table_stamp
from facetframe.sources.stored import is_complete, row_in_partition

BLOCK_TEXTS = 4096
GRAM = 3
TASK_BYTES = 1 << 20  # stored texts whose trigrams one task holds
GRAM_FILES = 8  # files a trigram's lists lie in at most


def needle_grams(needle: str) -> list[str]:
    return sorted({needle[i:i + GRAM] for i in range(len(needle) - GRAM + 1)})


@dataclass
class SubstringIndex:
    """The stored dictionary and postings of an index."""

    spark: SparkSession
    path: str

    def texts(self) -> DataFrame:
        return self.spark.read.schema("text string, block int, number int, field string, part int").parquet(f"{self.path}/texts")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram string, part int, block int, numbers array<int>, field string").parquet(f"{self.path}/postings")

    def candidates(self, field: str, needle: str) -> DataFrame:
        """(part, block, number) of the field's texts that hold all trigrams of the needle."""
        grams = needle_grams(needle)
        lists = (self.postings().where((F.col("field") == field) & F.col("gram").isin(grams))
                 .groupBy("part", "block").agg(F.collect_list("numbers").alias("lists"))  # a list per trigram
                 .where(F.size("lists") == len(grams)))
        common = F.aggregate(F.slice("lists", 2, len(grams)), F.col("lists")[0], F.array_intersect)
        return lists.select("part", "block", F.explode(common).alias("number"))

    def search(self, field: str, needle: str) -> DataFrame:
        """(text): the field's distinct texts, in lower case, that contain the needle."""
        q = _norm(needle)
        texts = self.texts().where(F.col("field") == field)
        if len(q) >= GRAM:
            texts = texts.join(self.candidates(field, q), ["part", "block", "number"], "left_semi")
        return texts.where(F.col("text").contains(q)).select("text")

    def cost(self, field: str, needle: str) -> DataFrame:
        """One row on a request: texts a scan reads, texts the request reads, texts that match."""
        q = _norm(needle)
        texts = self.texts().where(F.col("field") == field)
        read = self.candidates(field, q) if len(q) >= GRAM else texts
        return self.spark.range(1).select(
            F.lit(field).alias("field"), F.lit(needle).alias("needle"),
            texts.agg(F.count("*")).scalar().alias("texts"), read.agg(F.count("*")).scalar().alias("texts_read"),
            self.search(field, needle).agg(F.count("*")).scalar().alias("texts_found"))


def build_substring_index(fields: Mapping[str, DataFrame], path: str, parts: int) -> SubstringIndex:
    """The index over ``fields`` (name -> one text column), stored at ``path``; one that is complete
    there is only opened."""
    spark = next(iter(fields.values())).sparkSession
    index = SubstringIndex(spark, path)
    if is_complete(spark, f"{path}/postings"):
        return index
    every = None
    for name, df in fields.items():
        one = df.select(F.lower(F.col(df.columns[0])).alias("text"), F.lit(name).alias("field")).where("text is not null").distinct()
        every = one if every is None else every.unionAll(one)
    spread = every.repartitionByRange(max(1, parts), "field", "text").sortWithinPartitions("field", "text")
    at = row_in_partition()
    numbered = (spread.withColumn("part", F.spark_partition_id()).withColumn("at", at)
                .select("text", F.floor(F.col("at") / BLOCK_TEXTS).cast("int").alias("block"),
                        (F.col("at") % BLOCK_TEXTS).cast("int").alias("number"), "field", "part"))
    numbered.write.mode("overwrite").partitionBy("field", "part").parquet(f"{path}/texts")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - (GRAM - 1)),
                                         lambda i: F.substring("text", i, F.lit(GRAM))))
    # a block's texts meet in one task before they are cut into trigrams: the lists are made there, and
    # only lists are dealt again (hashed, as a range would make every list twice; a common trigram's over several files)
    tasks = max(1, parts, -(-table_stamp(spark, f"{path}/texts")[1] // TASK_BYTES))
    blocks = index.texts().where(F.length("text") >= GRAM).repartition(tasks, "field", "part", "block")
    cells = blocks.select("field", "part", "block", "number", F.explode(grams).alias("gram"))
    lists = (cells.groupBy("field", "part", "block", "gram").agg(F.sort_array(F.collect_list("number")).alias("numbers"))
             .repartition(max(1, parts), "field", "gram", F.col("part") % GRAM_FILES).sortWithinPartitions("field", "gram"))
    lists.select("gram", "part", "block", "numbers", "field").write.mode("overwrite").partitionBy("field").parquet(f"{path}/postings")
    return index


# Fields of the profile, and the profile column each is made from.
TITLE_FIELDS = {"title": "title", "director": "director", "writer": "wri.name"}


def profile_fields(profile: DataFrame, mentions: DataFrame | None = None) -> dict[str, DataFrame]:
    """The searchable fields of a profile, and of its mentions' places by type."""
    out = {name: profile.select(F.col(col)) for name, col in TITLE_FIELDS.items()}
    for kind in LOC_TYPES if mentions is not None else ():
        out[f"place {kind}"] = mentions.where(F.col("locType") == kind).select("location")
    return out


def filter_titles_indexed(profile: DataFrame, spec: FilterSpec, index: SubstringIndex, mentions: DataFrame | None = None,
                          key: str = "imdbid") -> DataFrame:
    """F6 with its text searches answered by the index: the rows :func:`filters.filter_titles` keeps.
    Theme searches are equalities and stay with :func:`filters.filter_titles`."""
    if spec.theme_active():
        raise ValueError("theme searches are not substring searches")
    out = profile.where(FilterSpec(facets=spec.facets).predicate())
    for name, needle in (("title", spec.title), ("director", spec.director), ("writer", spec.writer)):
        if _norm(needle):
            found = index.search(name, needle).withColumnRenamed("text", "__text")
            out = out.join(found, F.lower(F.col(TITLE_FIELDS[name])) == F.col("__text"), "left_semi")
    if spec.loc_active():
        if mentions is None:
            raise ValueError("a place search is active, but there are no mentions to search")
        hits = None
        for kind, needle in spec.loc_search.items():
            if _norm(needle):
                one = index.search(f"place {kind}", needle).select(F.lit(kind).alias("__kind"), F.col("text").alias("__text"))
                hits = one if hits is None else hits.unionAll(one)
        rows = mentions.join(hits, (F.col("locType") == F.col("__kind")) & (F.lower(F.col("location")) == F.col("__text")), "left_semi")
        out = out.join(rows.select(key).distinct(), key, "left_semi")
    return out
