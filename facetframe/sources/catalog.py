"""IO1: register Parquet tables as temporary views."""

from __future__ import annotations

import os
import weakref
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

# The catalogue's source tables.
FILM_TABLES = [
    "country", "ml_imdb", "director", "writer",
    "movie_imdb", "movie_country", "movie_ml_genre", "movie_imdb_genre",
    "movie_director", "movie_writer", "movie_rating",
    "subtitle_geo", "subtitle_theme",
]

# The driver's star-schema tables used by the order preset and the text operators.
DRIVER_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table_path(base: str, name: str) -> str:
    return os.path.join(base, f"{name}.parquet")


# Lazy plans by session, kept while the files they were listed from stay as they are.
_PLANS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def table_stamp(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(modification time, bytes, files) of a table: changes with every write to it."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    inside = fs.getContentSummary(hpath)
    return fs.getFileStatus(hpath).getModificationTime(), inside.getLength(), inside.getFileCount()


# Bytes of stored input behind one task of a wide join; the most tasks, where the session's own
# number of shuffle partitions is not higher still (beyond, a task's share grows).
TASK_BYTES, MOST_TASKS = 8 << 20, 20_000


def tasks_for(spark: SparkSession, base: str, names: Iterable[str]) -> int:
    """Number of tasks for a shuffle of these tables: grows with their bytes, so that a task's
    share does not; at least one per core."""
    size = sum(table_stamp(spark, table_path(base, n))[1] for n in names)
    most = max(MOST_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(spark.sparkContext.defaultParallelism, min(most, -(-size // TASK_BYTES)))


def while_unchanged(spark: SparkSession, base: str, names: Iterable[str], kind: str,
                    build: Callable[[], DataFrame]) -> DataFrame:
    """The lazy plan ``build`` makes over tables of ``base``, built once per session and again
    after any of the tables was written. No data is kept."""
    stamp = tuple(table_stamp(spark, table_path(base, n)) for n in names)
    kept = _PLANS.setdefault(spark, {})
    if kept.get((kind, base), (None,))[0] != stamp:
        kept[kind, base] = (stamp, build())
    return kept[kind, base][1]


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``base/name.parquet`` as a DataFrame."""
    return while_unchanged(spark, base, [name], f"table {name}",
                           lambda: spark.read.parquet(table_path(base, name)))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through Hadoop's FileSystem, so remote stores work too."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def register_tables(spark: SparkSession, base: str, names: Iterable[str]) -> list[str]:
    """Create a temp view per table whose Parquet file exists; return the skipped names.

    The source skipped missing files silently; here the caller gets the list.
    """
    skipped = []
    for n in names:
        p = table_path(base, n)
        if path_exists(spark, p):
            spark.read.parquet(p).createOrReplaceTempView(n)
        else:
            skipped.append(n)
    return skipped
