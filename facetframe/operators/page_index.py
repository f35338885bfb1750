"""Positional page index: any page of a sorted table from one or two of its range partitions.

Building range-partitions the table by its total sort order, sorts each partition and writes it
with every row's position in its partition. The partitions' counts, summed up in order, say which
positions of the whole each partition holds. A page is then a filter on at most a few partition
numbers and a span of positions: its cost is the same at the first and at the last page, and no
task keeps the rows before it.

Ties: the order should be total (end it with the whole row where nothing else is unique); equal
rows are interchangeable. Nulls follow the order's own null rule. An empty table has one empty
page.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from facetframe.operators.paging import PAGE_SIZE
from facetframe.sources.stored import is_complete, row_in_partition

PART, POSITION, ROW = "__part", "__position", "__row"


@dataclass
class PageIndex:
    """A stored table and what each of its partitions holds: (partition, first position, rows)."""

    spark: SparkSession
    path: str
    schema: StructType
    offsets: list[tuple[int, int, int]]

    @property
    def total(self) -> int:
        return sum(n for _, _, n in self.offsets)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def pages(self, size: int = PAGE_SIZE) -> int:
        return max(1, -(-self.total // size))

    def span(self, start: int, stop: int) -> list[tuple[int, int, int]]:
        """(partition, from, to) of the positions ``start`` to ``stop`` (not included)."""
        return [(p, max(start - first, 0), min(stop - first, n)) for p, first, n in self.offsets
                if first < stop and first + n > start]

    def page(self, page_no: int, size: int = PAGE_SIZE, clamp: bool = True) -> DataFrame:
        """One page in sort order; a page past the end is the last one (S7), or empty without ``clamp``."""
        page_no = max(0, min(page_no, self.pages(size) - 1) if clamp else page_no)
        wanted = F.lit(False)
        parts = self.span(page_no * size, (page_no + 1) * size)
        for p, a, z in parts:
            wanted = wanted | ((F.col(PART) == p) & (F.col(POSITION) >= a) & (F.col(POSITION) < z))
        rows = self.rows()
        if parts:
            rows = rows.where(F.col(PART).isin([p for p, _, _ in parts]))
        return rows.where(wanted).orderBy(PART, POSITION).limit(size).drop(PART, POSITION)

    def info(self, page_no: int, size: int = PAGE_SIZE) -> dict[str, int]:
        """Page (clamped), from, to, total, pages; nothing is read."""
        page_no = max(0, min(page_no, self.pages(size) - 1))
        start = page_no * size
        return {"page": page_no, "from": start + 1 if self.total else 0, "to": min(start + size, self.total),
                "total": self.total, "pages": self.pages(size)}

    def numbered(self) -> DataFrame:
        """All rows with ``__row``, the position in the whole table from 0. The joined side has a row
        per partition."""
        first = self.spark.createDataFrame([(p, f) for p, f, _ in self.offsets], f"{PART} int, __first long")
        return (self.rows().join(F.broadcast(first), PART)
                .withColumn(ROW, F.col("__first") + F.col(POSITION)).drop(PART, POSITION, "__first"))


def build_page_index(df: DataFrame, order: Sequence[Column], path: str, parts: int) -> PageIndex:
    """The index over ``df`` in ``order``, stored at ``path`` in up to ``parts`` range partitions (a
    partition should hold a few hundred MB); an index that is complete there is only opened."""
    spark = df.sparkSession
    if not is_complete(spark, f"{path}/counts"):
        # an empty table leaves no rows to tell its columns by
        empty = df.withColumn(POSITION, F.lit(0).cast("long")).withColumn(PART, F.lit(0)).limit(0)
        empty.write.mode("overwrite").parquet(f"{path}/columns")
        spread = df.repartitionByRange(max(1, parts), *order).sortWithinPartitions(*order)
        (spread.withColumn(PART, F.spark_partition_id()).withColumn(POSITION, row_in_partition())
         .write.mode("overwrite").partitionBy(PART).parquet(f"{path}/rows"))
        written = spark.read.schema(f"{PART} int, {POSITION} long").parquet(f"{path}/rows")
        written.groupBy(PART).agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")
    return open_page_index(spark, path)


def open_page_index(spark: SparkSession, path: str) -> PageIndex:
    """A stored index; its counts (a row per partition) come to the driver."""
    offsets, first = [], 0
    for r in sorted(spark.read.parquet(f"{path}/counts").collect(), key=lambda r: r[PART]):
        offsets.append((r[PART], first, r["n"]))
        first += r["n"]
    return PageIndex(spark, path, spark.read.parquet(f"{path}/columns").schema, offsets)
