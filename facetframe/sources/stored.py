"""Tables that are built once and kept in the shared folder, for many later queries.

A stored table lives under ``spark.checkpoint.dir`` at a path named after what it was made from: a
name, the stamps of its source tables (time, bytes, files) and its layout. A query that finds the
path complete reads it; else it builds it. So a changed source gives a new path, never a stale
answer, and several sessions share a table.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetframe.session import scratch_path
from facetframe.sources.catalog import path_exists, table_path, table_stamp

_LAYOUT = 1  # raise when the stored form of any table changes


def stored_path(spark: SparkSession, name: str, base: str, sources: Iterable[str], layout: tuple = ()) -> str:
    """Where the table ``name`` over the current files of ``sources`` belongs."""
    made_of = [(n, table_stamp(spark, table_path(base, n))) for n in sources]
    digest = hashlib.sha256(repr((_LAYOUT, base, made_of, layout)).encode()).hexdigest()[:24]
    return scratch_path(spark, os.path.join("stored", f"{name}-{digest}"))


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether the writer's last act, the success mark, is there."""
    return path_exists(spark, os.path.join(path, "_SUCCESS"))


def once(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """``path``, written by ``write`` unless it is complete already."""
    if not is_complete(spark, path):
        write(path)
    return path


def bucketed(spark: SparkSession, path: str, key: str, buckets: int, build: Callable[[], DataFrame]) -> DataFrame:
    """A table hash-partitioned by ``key`` into ``buckets`` sorted files, as Spark's catalogue knows it:
    a join or aggregation on ``key`` needs no exchange of this side.

    ``buckets`` should be at least the session's shuffle partitions, else Spark may deal the table anew.
    """
    name = "stored_" + hashlib.sha256(f"{path} {buckets}".encode()).hexdigest()[:24]
    if not is_complete(spark, path):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        (build().repartition(buckets, key).write.mode("overwrite").format("parquet")
         .bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name))
    elif not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
                  f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def row_in_partition():
    """Position of a row in its partition as the plan stands (after a sort: in sort order)."""
    return F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh path of the shared folder and read back, so that what uses it several
    times computes it once and a lost executor costs no more than a reread."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
