"""Small helpers shared by the operators: shared-folder tables, columns, parts, components."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetframe.session import scratch_path

# Words are maximal runs of anything but these six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_table(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), **options) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back: the lineage ends there,
    and a lost executor costs no recomputation of what came before. ``options``: the writer's."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.options(**options).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_parts(spark: SparkSession) -> int:
    """Number of parts texts are dealt into: twice the shuffle partitions, so that it is
    sized by the same setting and a part stays a fraction of a task."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_buckets(parts: int) -> int:
    """Number of hash buckets the parts' keys meet in: fewer than parts, as keys are smaller
    than texts and every part sends every bucket a row."""
    return max(1, parts // 4)


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list as (node, component), component the smallest node.

    Alternating large-star and small-star rounds (each a group by node with a map-side
    minimum and one join); every node ends with one edge to its component's minimum. Stops
    when a round changes nothing, seen from the number of edges and a sum of their hashes.
    """
    def settle(frame: DataFrame) -> tuple[DataFrame, tuple]:
        kept = shared_table(frame.where("u <> v").distinct(), "cc")
        mark = kept.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        return kept, (mark["n"], mark["h"])

    e, mark = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    while True:
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node's smaller neighbours, and itself, move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(least.select("u", F.col("m").alias("v"))))
        last = mark
        e, mark = settle(small)
        if mark == last:
            break
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


_SHIPPED: set[str] = set()


# Rows per Arrow batch between Spark and the Python workers, where the session has Spark's own
# default: texts are long, and a batch is held whole on both sides.
_BATCH_ROWS, _DEFAULT_BATCH_ROWS = "1000", "10000"
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare_workers(spark: SparkSession) -> None:
    """Small Arrow batches, and this package importable in the Python workers.

    Nothing to ship where the workers already find it (installed, on PYTHONPATH, or local
    workers started in its folder); else Spark distributes a zip of it, once per application.
    """
    if spark.conf.get(_BATCH_CONF) == _DEFAULT_BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, _BATCH_ROWS)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if root in known or sc.applicationId in _SHIPPED:
        return
    if sc.master.startswith("local[") and os.getcwd() == root:
        return
    base = os.path.join(tempfile.mkdtemp(prefix="facetframe-"), "facetframe-package")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "facetframe"))
    _SHIPPED.add(sc.applicationId)


_KEPT: dict[tuple, object] = {}


def keep_in_worker(key: tuple, build: Callable[[], object]) -> object:
    """An object a worker process keeps between tasks (a tokenizer, a scorer). Only the last
    one is kept, so the stages of a pipeline do not add up in reused workers."""
    if key not in _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()
        _KEPT[key] = build()
    return _KEPT[key]


def byte_groups(column: pa.Array, most: int = 1 << 21) -> Iterator[list[bytes]]:
    """The texts of a column as UTF-8 (null: empty), in groups of about ``most`` bytes."""
    group, size = [], 0
    for t in column:
        group.append((t.as_py() or "").encode())
        size += len(group[-1])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group
