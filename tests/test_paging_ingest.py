"""Paging properties, ingest/export and plan shape."""

import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetframe.operators import paging as PG
from facetframe.operators import people as PE
from facetframe.sources.ingest import export_tables, normalise_types
from tests.conftest import SF_SMALL


def test_pages_concatenate_to_the_full_sort(spark):
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus")
    full = [r.o_orderkey for r in df.orderBy(F.col("o_orderstatus").desc(), "o_orderkey").collect()]
    pages = []
    for k in range(0, (len(full) + 199) // 200):
        pages += [r.o_orderkey for r in PG.page(df, "o_orderstatus", "desc", k, 200,
                                                tiebreak=("o_orderkey",)).collect()]
    assert pages == full
    # keyset paging walks the same order
    seen, after = [], None
    while True:
        rows = PG.page_after(df, "o_totalprice", "asc", after, 250, "o_orderkey").collect()
        if not rows:
            break
        seen += [r.o_orderkey for r in rows]
        after = (rows[-1].o_totalprice, rows[-1].o_orderkey)
    assert seen == [r.o_orderkey for r in df.orderBy("o_totalprice", "o_orderkey").collect()]


def test_page_info_clamps(spark):
    df = spark.range(0, 101)
    info = PG.page_info(df, 99, 50).first()
    assert (info.page, info["from"], info.to, info.total, info.pages) == (2, 101, 101, 101, 3)
    empty = PG.page_info(df.where("id < 0"), 5, 50).first()
    assert (empty.page, empty["from"], empty.to, empty.total, empty.pages) == (0, 0, 0, 0, 1)


def test_person_page_null_rule(film_profile):
    people = PE.people_table(film_profile, "wri")
    asc = [r.birthYear for r in PG.person_page(people, "birthYear", "asc").collect()]
    desc = [r.birthYear for r in PG.person_page(people, "birthYear", "desc").collect()]
    assert asc[-1] is None or None not in asc
    assert desc[0] is None or None not in desc
    assert PG.resolve_sort("country", PG.THEME_SORTS, "mentions") == "mentions"


def test_normalise_types(spark):
    df = spark.createDataFrame(
        [(1, 2, "3", "x", [1, 2])], "a int, b int, c string, d string, e array<int>").select(
        F.col("a").cast("decimal(10,0)").alias("a"), F.col("b").cast("decimal(10,2)").alias("b"),
        F.col("c"), F.col("d"), F.col("e"), F.current_timestamp().alias("ts"))
    out = normalise_types(df, declared={"c": T.LongType(), "d": T.LongType()})
    types = {f.name: f.dataType for f in out.schema.fields}
    assert isinstance(types["a"], T.LongType) and isinstance(types["b"], T.DoubleType)
    assert isinstance(types["c"], T.LongType) and isinstance(types["d"], T.StringType)
    assert isinstance(types["e"], T.StringType) and isinstance(types["ts"], T.TimestampNTZType)
    assert out.first().e == "[1,2]"


def test_export_tables(spark, films):
    out = tempfile.mkdtemp(prefix="facetframe-export-")

    def read(name):
        if name == "broken":
            raise RuntimeError("source unavailable")
        return films[name]

    stats = {r.table: r for r in export_tables(spark, read, out, ["country", "broken", "movie_rating"],
                                               tables=["COUNTRY", "broken", "Movie_Rating"]).collect()}
    assert stats["country"].rows == 4 and stats["country"].error is None and stats["country"].bytes > 0
    assert stats["broken"].error.startswith("RuntimeError")
    back = spark.read.parquet(os.path.join(out, "movie_rating.parquet"))
    assert back.count() == 4 and dict(back.dtypes)["COUNT_RATING"] == "bigint"


def test_plan_shape(spark, films):
    """Filters reach the Parquet scan, small dimensions are broadcast, no Python in the plan."""
    from facetframe.plans.films import film_profile
    from facetframe.sources.ingest import write_table
    base = tempfile.mkdtemp(prefix="facetframe-films-")
    for n, df in films.items():
        write_table(df, base, n)
    frames = {n: spark.read.parquet(os.path.join(base, f"{n}.parquet")) for n in films}
    plan = film_profile(frames)._jdf.queryExecution().executedPlan().toString()
    pushed = [seg for seg in plan.split("PushedFilters: ")[1:] if "EqualTo(TYPE,movie)" in seg.split("]")[0]]
    assert pushed and "EqualTo(RESPONSE,true)" in pushed[0].split("]")[0]
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
    for bad in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_page_after_returns_every_row_once(spark):
    rows = [(n, y, i) for i, (n, y) in enumerate([("a", 1), ("b", None), ("a", None), ("c", 2), ("b", 1),
                                                  (None, 2), ("d", None), ("a", 2)])]
    df = spark.createDataFrame(rows, "name string, year int, id int")
    for dir_ in ("asc", "desc"):
        seen, after = [], None
        while True:
            page = PG.page_after(df, "year", dir_, after, 3, ("name", "id")).collect()
            if not page:
                break
            seen += [r.id for r in page]
            after = (page[-1].year, page[-1].name, page[-1].id)
        assert sorted(seen) == list(range(8))
        full = PG.page(df, "year", dir_, 0, 100, ("name", "id"), "person").collect()
        assert seen == [r.id for r in full]


def test_collation_is_an_option(spark):
    df = spark.createDataFrame([("Zola", 1), ("Émile", 2), ("emma", 3), ("Fay", 4)], "title string, imdbid int")
    order = lambda c: [r.imdbid for r in PG.page(df, "title", "asc", 0, 9, ("imdbid",), collation=c).collect()]
    assert order(None) == [4, 1, 3, 2]
    assert order("UNICODE") == [2, 3, 4, 1]


def test_read_table_sees_appended_rows(spark):
    from facetframe.sources.catalog import read_table
    base = tempfile.mkdtemp(prefix="facetframe-append-")
    one = spark.range(3)
    one.write.parquet(f"{base}/t.parquet")
    assert read_table(spark, base, "t").count() == 3
    one.write.mode("append").parquet(f"{base}/t.parquet")
    assert read_table(spark, base, "t").count() == 6


def test_jdbc_read_needs_slices(spark):
    import pytest
    from facetframe.sources.ingest import read_jdbc
    with pytest.raises(ValueError):
        read_jdbc(spark, "jdbc:none", "t")
    with pytest.raises(ValueError):
        read_jdbc(spark, "jdbc:none", "t", partition_column="id")


def test_export_decides_declared_types_on_the_write(spark):
    src = spark.createDataFrame([("1", "2.5"), ("2", "x"), (None, "3")], "a string, b string")
    out = tempfile.mkdtemp(prefix="facetframe-declared-")
    stats = export_tables(spark, lambda n: src, out, ["t"], declared={"t": {"a": T.LongType(), "b": T.DoubleType()}})
    assert stats.first().rows == 3
    back = spark.read.parquet(f"{out}/t.parquet")
    assert dict(back.dtypes) == {"a": "bigint", "b": "string"}
    assert sorted((r.b for r in back.collect())) == ["2.5", "3", "x"]
