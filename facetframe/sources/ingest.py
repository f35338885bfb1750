"""Ingest and export (IO2-IO7): relational source -> normalised types -> Parquet.

Spark reads a relational table in parallel slices (``partitionColumn`` with
bounds and ``numPartitions``), instead of one cursor fetching fixed batches;
each slice is one task, so a lost executor re-reads only its slice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The source's fetch size (rows per round trip).
FETCH_SIZE = 50_000


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              bounds: tuple[int, int] | None = None, num_partitions: int | None = None,
              fetchsize: int = FETCH_SIZE, properties: dict[str, str] | None = None,
              one_task: bool = False) -> DataFrame:
    """IO2: full-table read (``SELECT *``) through JDBC, in slices of a numeric
    ``partition_column`` between ``bounds``. A read through a single task must be asked for."""
    if (partition_column is None) != (bounds is None):
        raise ValueError("partition_column and bounds go together")
    if bounds is None and not one_task:
        raise ValueError("name partition_column and bounds, or ask for one_task")
    r = (spark.read.format("jdbc").option("url", url).option("dbtable", table)
              .option("fetchsize", str(fetchsize)))
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if bounds is not None:
        r = (r.option("partitionColumn", partition_column)
              .option("lowerBound", str(bounds[0])).option("upperBound", str(bounds[1]))
              .option("numPartitions", str(num_partitions or spark.sparkContext.defaultParallelism)))
    return r.load()


def target_type(dt: T.DataType) -> T.DataType | None:
    """IO3 type rule; None = keep the column as it is."""
    if isinstance(dt, T.DecimalType):
        return T.LongType() if dt.scale == 0 and 1 <= dt.precision <= 18 else T.DoubleType()
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType)):
        return T.LongType()
    if isinstance(dt, T.TimestampType):
        return T.TimestampNTZType()
    if isinstance(dt, (T.LongType, T.DoubleType, T.FloatType, T.StringType, T.DateType,
                       T.TimestampNTZType, T.BinaryType)):
        return None
    if isinstance(dt, (T.VarcharType, T.CharType)):
        return T.StringType()
    return T.StringType()


def failure_counts(declared: dict[str, T.DataType]) -> list:
    """One count per declared column: non-null values that don't convert."""
    return [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c)
            for c, t in declared.items()]


def normalise_types(df: DataFrame, declared: dict[str, T.DataType] | None = None,
                    on_error: str = "string", failures: dict[str, int] | None = None) -> DataFrame:
    """IO3/IO4: apply the type rule to every column.

    ``declared`` names a wanted type for text columns (a source that ships
    numbers as text). A declared column keeps its text type when some non-null
    value does not convert (``on_error='string'``) or raises (``'raise'``).
    ``failures`` are the counts of such values (``failure_counts``); when not given
    they are counted here, which is an action over the declared columns. An export
    counts them on the write itself instead (``export_tables``).
    """
    declared = declared or {}
    bad_counts = failures
    if bad_counts is None:
        bad_counts = df.agg(*failure_counts(declared)).first().asDict() if declared else {}
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in declared:
            if bad_counts.get(f.name, 0):
                if on_error == "raise":
                    raise ValueError(f"column {f.name}: {bad_counts[f.name]} values do not fit "
                                     f"{declared[f.name].simpleString()}")
                out.append(c.cast("string").alias(f.name))
            else:
                out.append(c.try_cast(declared[f.name]).alias(f.name))
            continue
        t = target_type(f.dataType)
        if t is None:
            out.append(c)
        elif isinstance(t, T.StringType) and isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out.append(F.to_json(c).alias(f.name))
        else:
            out.append(c.cast(t).alias(f.name))
    return df.select(*out)


def write_table(df: DataFrame, out_dir: str, name: str, mode: str = "overwrite") -> str:
    """IO5: Parquet with snappy compression (column statistics are on by default).

    An empty table writes an empty dataset that still carries its schema.
    """
    path = f"{out_dir.rstrip('/')}/{name}.parquet"
    df.write.mode(mode).option("compression", "snappy").parquet(path)
    return path


def _bytes_at(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


STATS_SCHEMA = "table string, rows bigint, bytes bigint, seconds double, error string"


def export_tables(spark: SparkSession, read: Callable[[str], DataFrame], out_dir: str,
                  available: Iterable[str], tables: Iterable[str] | None = None,
                  normalise: bool = True,
                  declared: dict[str, dict[str, T.DataType]] | None = None) -> DataFrame:
    """IO6/IO7: export the chosen tables (case-insensitive names) to Parquet.

    ``declared`` gives wanted types of text columns per table (IO4). The source is read
    once: values are converted and failures counted on the write; only a table with a
    failing column is written a second time, with that column as text.

    One failing table does not stop the others; the result has one row per
    table with rows written (counted by an observation on the write itself),
    bytes on storage, seconds and the error text, if any.
    """
    names = list(available)
    if tables:
        wanted = {t.lower() for t in tables}
        names = [n for n in names if n.lower() in wanted]
        if not names:
            raise ValueError(f"no matching tables; available: {list(available)}")
    stats = []
    for n in names:
        t0 = time.time()
        try:
            raw, want = read(n), (declared or {}).get(n, {})
            obs = Observation(f"export_{n}")
            seen = raw.observe(obs, F.count(F.lit(1)).alias("rows"), *failure_counts(want))
            path = write_table(normalise_types(seen, want, failures={}) if normalise else seen, out_dir, n)
            got = obs.get
            rows = int(got["rows"])
            if normalise and any(got[c] for c in want):
                path = write_table(normalise_types(raw, want, failures=got), out_dir, n)
            stats.append((n, rows, _bytes_at(spark, path), time.time() - t0, None))
        except Exception as e:  # noqa: BLE001 - reported per table, like the source
            stats.append((n, 0, 0, time.time() - t0, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(stats, STATS_SCHEMA)
