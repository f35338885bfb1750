"""Export as write, verify, publish (IO5-IO7).

Tables are written side by side into a staging folder, each in one pass: values are converted,
failures of declared columns and the source's rows are counted on the write itself, and a declared
column that holds other text is stored in both forms until the counts are known. Statistics come
from the files, read again. A table is published (its staged files renamed to their place) only if
the reread rows are the rows the source gave; else it is reported and what stood in its place
stays. One failing table does not stop the others.

Nulls and empty tables are exported like any rows; an empty table's files carry its columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetframe.sources.catalog import path_exists
from facetframe.sources.ingest import failure_counts, normalise_types

STATS = "table string, column string, rows bigint, nulls bigint, min string, max string, error string"
_RAW = "__as_text_"


def stat_text(c: Column, kind: T.DataType) -> Column:
    """A value as text that does not depend on an engine's way to print numbers: fractions with four
    digits, times to the second."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.round(c, 4).cast("decimal(38,4)").cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def column_stats(df: DataFrame) -> list[tuple[str, int, int, str | None, str | None]]:
    """(column, rows, nulls, min, max) of every column, in one pass. Binary columns have no bounds."""
    aggs = [F.count("*").alias("rows")]
    for i, f in enumerate(df.schema.fields):
        ordered = not isinstance(f.dataType, (T.BinaryType, T.MapType))
        aggs.append(F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"n{i}"))
        for name, low in (("a", F.min), ("z", F.max)):
            bound = stat_text(low(F.col(f"`{f.name}`")), f.dataType) if ordered else F.lit(None).cast("string")
            aggs.append(bound.alias(f"{name}{i}"))
    r = df.agg(*aggs).first()
    return [(f.name, r["rows"], r[f"n{i}"], r[f"a{i}"], r[f"z{i}"]) for i, f in enumerate(df.schema.fields)]


def _rename(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark.sparkContext._jvm
    a, z = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(z.getParent())
    if fs.exists(z):
        fs.delete(z, True)
    if not fs.rename(a, z):
        raise OSError(f"cannot rename {source} to {target}")


def _export_one(spark: SparkSession, read: Callable[[str], DataFrame], name: str, staging: str, out_dir: str,
                declared: dict[str, T.DataType]) -> list[tuple]:
    staged = f"{staging}/{name}.parquet"
    raw, seen = read(name), Observation(f"export_{name}")
    counted = raw.observe(seen, F.count(F.lit(1)).alias("rows"), *failure_counts(declared))
    # a declared column goes out in both forms; which one applies is known after the write
    both = normalise_types(counted.select("*", *[F.col(c).alias(f"{_RAW}{c}") for c in declared]), declared, failures={})
    both.write.option("compression", "snappy").parquet(staged)
    got = seen.get
    if declared:
        names = [c for c in both.columns if not c.startswith(_RAW)]
        chosen = [F.col(f"{_RAW}{c}" if got.get(c) else c).alias(c) for c in names]
        final = f"{staging}/{name}.chosen.parquet"
        spark.read.parquet(staged).select(*chosen).write.option("compression", "snappy").parquet(final)
        staged = final
    stats = column_stats(spark.read.parquet(staged))
    rows = stats[0][1] if stats else 0
    if rows != got["rows"]:
        raise ValueError(f"{got['rows']} rows read, {rows} rows written")
    _rename(spark, staged, f"{out_dir}/{name}.parquet")
    return [(name, *s, None) for s in stats]


def export_verified(spark: SparkSession, read: Callable[[str], DataFrame], out_dir: str, tables: Iterable[str],
                    declared: dict[str, dict[str, T.DataType]] | None = None, at_once: int = 4) -> DataFrame:
    """Export ``tables`` to ``out_dir``/<name>.parquet, ``at_once`` at a time: a row per column (table,
    column, rows, nulls, min, max), and one with ``error`` for a table that was not published."""
    out_dir = out_dir.rstrip("/")
    staging = f"{out_dir}/_staging-{uuid.uuid4().hex}"

    def one(name: str) -> list[tuple]:
        try:
            return _export_one(spark, read, name, staging, out_dir, (declared or {}).get(name, {}))
        except Exception as e:  # noqa: BLE001 - reported per table, like the source
            return [(name, None, 0, 0, None, None, type(e).__name__)]
    with ThreadPoolExecutor(at_once) as pool:
        rows = [r for some in pool.map(one, list(tables)) for r in some]
    return spark.createDataFrame(rows, STATS)


def is_published(spark: SparkSession, out_dir: str, name: str) -> bool:
    return path_exists(spark, f"{out_dir.rstrip('/')}/{name}.parquet/_SUCCESS")
