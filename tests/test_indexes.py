"""Stored tables, page index, bitmap index and substring index against plain scans."""

import random
import re
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from facetframe.operators import bitmap_index as BI
from facetframe.operators import distinct_sketches as DS
from facetframe.operators import option_chunks as OC
from facetframe.operators import substring_index as SI
from facetframe.operators import topk as TK
from facetframe.operators.filters import FilterSpec, filter_titles
from facetframe.operators.page_index import build_page_index, open_page_index
from facetframe.plans import analogues, indexed
from facetframe.session import scratch_path
from facetframe.sources.stored import bucketed, stored_path
from tests.conftest import SF_SMALL


def _path(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- stored tables ----------------------------------------------------------------------


def test_stored_profile_joins_without_an_exchange_of_it(spark):
    p = indexed.stored_profile(spark, SF_SMALL)
    other = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select(F.col("o_orderkey").alias("imdbid"), "o_custkey")
    joined = p.select("imdbid", "title").hint("merge").join(other, "imdbid")
    plan = _plan(joined)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    both = p.select("imdbid").hint("merge").join(indexed.stored_mentions(spark, SF_SMALL).select("imdbid", "location"), "imdbid")
    assert "Exchange hashpartitioning" not in _plan(both)
    assert "Exchange hashpartitioning" not in _plan(p.groupBy("imdbid").count())


def test_bucketed_table_is_reopened_and_follows_its_sources(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(20).select(F.col("id").alias("k"), F.lit(len(made)).alias("v"))
    path = _path(spark, "b")
    assert bucketed(spark, path, "k", 4, build).count() == 20
    for t in spark.catalog.listTables():
        if t.name.startswith("stored_"):
            spark.sql(f"DROP TABLE {t.name}")  # as a new session would not know it
    again = bucketed(spark, path, "k", 4, build)
    assert made == [1] and again.count() == 20 and "Bucketed: true" in _plan(again.groupBy("k").count())
    base = str(tmp_path)
    spark.range(3).write.parquet(f"{base}/t.parquet")
    first = stored_path(spark, "x", base, ["t"])
    assert first == stored_path(spark, "x", base, ["t"]) != stored_path(spark, "x", base, ["t"], (2,))
    spark.range(4).write.mode("overwrite").parquet(f"{base}/t.parquet")
    assert stored_path(spark, "x", base, ["t"]) != first


# --- pages ------------------------------------------------------------------------------


def _rows(n, seed=1):
    rnd = random.Random(seed)
    return [(rnd.choice([None, "a", "b", "ç", "B"]), i // 2, rnd.choice([None, 1.5, 2.5])) for i in range(n)]


@pytest.mark.parametrize("n,parts", [(0, 3), (1, 3), (203, 7), (200, 1)])
def test_every_page_equals_the_sorted_rows(spark, n, parts):
    df = spark.createDataFrame(_rows(n), "k string, id long, v double").repartition(3)
    order = [F.col("k").desc_nulls_first(), F.col("id").asc_nulls_last(), F.col("v").asc_nulls_last()]
    index = build_page_index(df, order, _path(spark, "pages"), parts)
    want = [tuple(r) for r in df.orderBy(*order).collect()]
    assert index.total == n and index.pages(20) == max(1, -(-n // 20))
    got = [[tuple(r) for r in index.page(i, 20).collect()] for i in range(index.pages(20))]
    assert got == [want[i * 20:i * 20 + 20] for i in range(index.pages(20))]
    assert [tuple(r) for r in index.page(999, 20).collect()] == got[-1]
    assert index.page(999, 20, clamp=False).collect() == []
    assert index.info(999, 20) == {"page": index.pages(20) - 1, "from": (len(want) - 1) // 20 * 20 + 1 if n else 0,
                                   "to": n, "total": n, "pages": index.pages(20)}
    assert open_page_index(spark, index.path).offsets == index.offsets
    numbered = {r["__row"]: (r.k, r.id, r.v) for r in index.numbered().collect()}
    assert [numbered[i] for i in range(n)] == want


def test_a_deep_page_reads_few_partitions_and_keeps_no_rows_before_it(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("k"))
    index = build_page_index(df, [F.col("k").asc(), F.col("id").asc()], _path(spark, "pages"), 10)
    page = index.page(18, 50)
    assert 1 <= len(index.span(900, 950)) <= 2 < len(index.offsets)
    plan = _plan(page)
    assert "PartitionFilters: [isnotnull(__part" in plan and "__part#" in plan
    limits = [int(x) for x in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", plan)]
    assert limits == [50]
    assert page.count() == 50


# --- bitmaps ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def many(spark):
    n = 70_000  # three buckets
    df = spark.range(n).select(F.col("id").alias("__row"), (F.col("id") % 3).alias("a"),
                               F.when(F.col("id") % 5 > 0, F.concat(F.lit("v"), F.col("id") % 5)).alias("b"),
                               F.when(F.col("id") > 40_000, F.lit("late")).otherwise(F.lit("early")).alias("c"))
    return df, BI.build_bitmaps(df, {"a": "a", "b": "b", "c": "c"}, _path(spark, "bits"))


@pytest.mark.parametrize("choices", [{}, {"a": [1]}, {"a": [0, 2], "b": ["v1", None], "c": ["late"]}, {"a": [], "c": ["early"]},
                                     {"a": [9]}, {"a": [1], "b": ["none"]}])
def test_facet_counts_equal_a_scan(many, choices):
    df, index = many
    rows = [r for r in df.collect() if all(
        not v or (None if r[f] is None else str(r[f])) in [None if x is None else str(x) for x in v] for f, v in choices.items())]
    want = Counter((f, None if r[f] is None else str(r[f])) for r in rows for f in ("a", "b", "c"))
    assert {(r.facet, r.value): r.n for r in BI.facet_counts(index, choices).collect()} == dict(want)
    assert BI.selected_rows(index, choices).first().rows == len(rows)
    if choices.get("c"):
        only = BI.facet_counts(index, choices, ["b"]).collect()
        assert {r.value: r.n for r in only} == {v: n for (f, v), n in want.items() if f == "b"}


def test_bitmaps_of_rows_dealt_by_bucket(many, spark, monkeypatch):
    df, index = many
    monkeypatch.setattr(BI, "BUCKET_ROWS", 50)  # for the number of tasks only: Spark's buckets keep their size
    dealt = BI.build_bitmaps(df, {"a": "a", "b": "b", "c": "c"}, _path(spark, "dealt"), rows=df.count())
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, index.collect()))
    own = df.select("__row", F.col("a").alias("row"), F.col("b").alias("bucket"), F.col("c").alias("value0"))
    named = BI.build_bitmaps(own, {"a": "row", "b": "bucket", "c": "value0"}, _path(spark, "named"), rows=df.count())
    assert sorted(map(repr, named.collect())) == sorted(map(repr, index.collect()))


def test_texts_are_linked_before_they_are_split_into_words(spark):
    for df in (analogues.theme_base(spark, SF_SMALL), analogues.token_mentions(spark, SF_SMALL),
               analogues.q_theme_options(spark, SF_SMALL)):
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        split = next(i for i, line in enumerate(lines) if "Generate explode" in line and "Join LeftSemi" not in line)
        assert any("RepartitionByExpression" in line for line in lines[split:split + 3]), "\n".join(lines)
        assert any("Join LeftSemi" in line for line in lines[split:split + 5]), "\n".join(lines)


def test_bitmaps_of_an_empty_table(spark):
    df = spark.createDataFrame([], "__row long, a string")
    index = BI.build_bitmaps(df, {"a": "a"}, _path(spark, "bits"))
    assert BI.facet_counts(index, {"a": ["x"]}).collect() == [] and BI.selected_rows(index, {}).first().rows == 0


# --- substrings -------------------------------------------------------------------------


def test_postings_do_not_depend_on_the_tasks_that_make_them(spark, monkeypatch):
    df = spark.createDataFrame([(t,) for t in _rows_of_text(300)], "t string")
    monkeypatch.setattr(SI, "BLOCK_TEXTS", 16)
    lists = []
    for size in (1, 1 << 30):
        monkeypatch.setattr(SI, "TASK_BYTES", size)
        index = SI.build_substring_index({"t": df}, _path(spark, "sub"), 3)
        rows = index.postings().collect()
        lists.append(sorted(map(repr, rows)))
        assert len({(r.field, r.gram, r.part, r.block) for r in rows}) == len(rows)  # one list each
    assert lists[0] == lists[1] and lists[0]


def _rows_of_text(n):
    rnd = random.Random(9)
    return ["".join(rnd.choices("abcd ", k=rnd.randint(0, 12))) for _ in range(n)]


def test_searches_equal_a_scan(spark, monkeypatch):
    monkeypatch.setattr(SI, "BLOCK_TEXTS", 7)
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abA é%_", k=rnd.randint(0, 9))) for _ in range(300)] + [None, "", "x" * 5000 + "yz", "aaa", "aaaa"] * 2
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    index = SI.build_substring_index({"t": df, "u": df.where("t like 'a%'")}, _path(spark, "sub"), 5)
    lower = {t.lower() for t in texts if t is not None}
    for needle in ["ab", "a", "abA", " aba ", "aaaa", "é%_", "_", "xyz", "xxyz", "zzz", "baba", "a é"]:
        q = needle.strip().lower()
        got = [r.text for r in index.search("t", needle).collect()]
        assert sorted(got) == sorted(t for t in lower if q in t), needle
        cost = index.cost("t", needle).first()
        assert cost.texts == len(lower) and cost.texts_found == len(got) <= cost.texts_read <= cost.texts
    assert max(len(r.numbers) for r in index.postings().collect()) <= 7
    again = SI.build_substring_index({"t": df}, index.path, 5)
    assert again.search("u", "a").count() == index.search("u", "a").count() > 0


@pytest.mark.parametrize("spec", [FilterSpec(), FilterSpec(title=" HIGH"), FilterSpec(director="cust 1", writer="1"),
                                  FilterSpec(title="no such", facets={"years": [1996]}),
                                  FilterSpec(loc_search={"State": "de", "Other": "the", "City": ""})])
def test_indexed_filter_equals_the_scan(spark, spec):
    p, m = indexed.stored_profile(spark, SF_SMALL), indexed.stored_mentions(spark, SF_SMALL)
    got = SI.filter_titles_indexed(p, spec, indexed.text_index(spark, SF_SMALL), m).select("imdbid").collect()
    want = filter_titles(analogues.profile(spark, SF_SMALL), spec, mentions=m).select("imdbid").collect()
    assert sorted(got) == sorted(want)


def test_place_search_needs_mentions(spark):
    with pytest.raises(ValueError):
        SI.filter_titles_indexed(indexed.stored_profile(spark, SF_SMALL), FilterSpec(loc_search={"City": "o"}),
                                 indexed.text_index(spark, SF_SMALL))


# --- certified top k ----------------------------------------------------------------------


def _top(rows, k):
    count = Counter()
    for g, x, w in rows:
        if x is not None:
            count[g, x] += w
    out = []
    for g in {g for g, _ in count}:
        best = sorted(((-n, x) for (h, x), n in count.items() if h == g))[:k]
        out += [(g, i + 1, x, -n) for i, (n, x) in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,buckets,probe", [(1, 8, 1), (5, 64, 6), (5, 64, 1), (30, 1000, None), (500, 16, 4)])
def test_top_keys_equal_a_full_count(spark, k, buckets, probe):
    rnd = random.Random(k)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, *(f"k{min(int(rnd.paretovariate(.7)), 400)}" for _ in range(9))]),
             rnd.choice([0, 1, 3])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, x string, w long").repartition(5)
    got = TK.top_keys(df, "g", "x", k, "w", buckets, probe)
    assert sorted((tuple(r) for r in got.result.collect()), key=repr) == _top(rows, k)
    for r in got.cost.collect():
        assert r.buckets_counted <= r.buckets and r.recounted <= r.total


def test_few_keys_are_recounted_where_counts_are_skewed(spark):
    df = spark.range(60_000).select(F.lit("g").alias("g"), F.expr("if(id % 3 = 0, id % 9, 100 + id)").alias("x"))
    got = TK.top_keys(df, "g", "x", 3, buckets=4096)
    assert [r.n for r in got.result.orderBy("rank").collect()] == [6667, 6667, 6666]
    cost = got.cost.first()
    assert cost.buckets_counted < 20 and cost.recounted < 21_000


def test_sketches_merge(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), (F.col("id") % 37).cast("string").alias("x"))
    whole = TK.count_sketch(df, "g", "x", buckets=16)
    halves = TK.merge_sketches(TK.count_sketch(df.where("x < '2'"), "g", "x", buckets=16), TK.count_sketch(df.where("x >= '2'"), "g", "x", buckets=16))
    assert sorted(whole.collect()) == sorted(halves.select(*whole.columns).collect())
    assert TK.top_keys(df, "g", "x", 2, buckets=16, sketch=halves).result.count() == 4
    assert TK.top_keys(df.where("false"), "g", "x", 2).result.collect() == []


# --- option chunks ------------------------------------------------------------------------


def test_no_chunk_exceeds_its_size(spark):
    rows = [("EN", "big", f"w{i:05d}") for i in range(1234)] + [("EN", "small", "x"), ("FR", None, "y"), ("FR", None, "z")]
    index = OC.option_index(spark.createDataFrame(rows, "idiom string, theme string, word string").repartition(7), _path(spark, "opt"), 4)
    got = OC.theme_chunks(index, 100).collect()
    assert max(len(r.words) for r in got) == 100 and sum(len(r.words) for r in got) == len(rows)
    big = sorted((r for r in got if r.theme == "big"), key=lambda r: r.chunk)
    assert [w for r in big for w in r.words] == [f"w{i:05d}" for i in range(1234)]
    assert [r["first"] for r in big] == [100 * r.chunk for r in big] and [r.chunk for r in big] == list(range(13))
    assert {(r.idiom, r.theme): (r.words, r.chunks) for r in OC.theme_sizes(index, 100).collect()} == {
        ("EN", "big"): (1234, 13), ("EN", "small"): (1, 1), ("FR", None): (2, 1)}


# --- mergeable distinct counts -----------------------------------------------------------


def test_sketches_unite_and_intersect_like_sets(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([None, *range(60)])) for _ in range(400)]
    index = DS.build_sketches(spark.createDataFrame(rows * 2, "g string, y int, k long"), ["g", "y"], "k", _path(spark, "cells"))
    keys = lambda test: len({k for g, y, k in rows if k is not None and test(g, y)})
    assert index.count() == 9
    assert {r.g: r.estimate for r in DS.estimates(DS.roll_up(index, "g")).collect()} == {
        g: keys(lambda a, _: a == g) for g in ("a", "b", None)}
    left = DS.roll_up(index.where("g = 'a'"), "y")
    right = DS.roll_up(index.where("g = 'b'").withColumnRenamed("g", "h"), "h", "y")
    both = {r.y: (r.h, r.estimate) for r in DS.shared(left, right, ["y"]).collect()}
    sets = {(g, y): {k for a, b, k in rows if (a, b) == (g, y) and k is not None} for g, y, _ in rows}
    assert both == {y: ("b", len(sets["a", y] & sets["b", y])) for y in (1, 2, None)}


def test_sketches_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, k long")
    index = DS.build_sketches(empty, ["g"], "k", _path(spark, "none"))
    assert index.count() == 0 and DS.estimates(DS.roll_up(index, "g")).count() == 0
    nulls = DS.build_sketches(spark.createDataFrame([("x", None)], "g string, k long"), ["g"], "k", _path(spark, "nulls"))
    assert [tuple(r) for r in DS.estimates(nulls).collect()] == [("x", 0)]


def test_sketches_beyond_their_capacity_keep_the_stated_error(spark):
    rows = spark.range(120_000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("g"),
                                       (F.col("id") % 7).alias("y"))
    index = DS.build_sketches(rows, ["g", "y"], "k", _path(spark, "large"), log_entries=9)
    est = DS.estimates(DS.roll_up(index, "y", log_entries=9)).withColumn("bound", DS.error_bound(F.col("estimate"), 9))
    exact = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    got = est.collect()
    assert len(got) == 7 and all(0 < abs(r.estimate - exact[r.y]) <= r.bound < exact[r.y] / 4 for r in got)
    hot = DS.roll_up(index.where("g = 'hot'"), "g", log_entries=9).withColumn("one", F.lit(1))
    week = DS.roll_up(index.where("y = 2"), "y", log_entries=9).withColumn("one", F.lit(1))
    pair = DS.shared(hot, week, ["one"]).withColumn("bound", DS.error_bound(F.col("larger"), 9)).first()
    n = rows.where("g = 'hot' AND y = 2").count()
    assert abs(pair.estimate - n) <= pair.bound


# --- verified export ----------------------------------------------------------------------


def test_export_publishes_only_what_it_verified(spark, monkeypatch):
    from pyspark.sql import types as T

    from facetframe.sources import publish
    out = _path(spark, "export")
    tables = {"a": spark.createDataFrame([(1, "1", "x", None), (2, "2", None, b"z")], "k int, n string, t string, b binary"),
              "empty": spark.createDataFrame([], "k int, t string")}
    declared = {"a": {"n": T.LongType(), "t": T.LongType()}}

    def run():
        got = publish.export_verified(spark, lambda n: tables[n], out, ["a", "empty", "gone"], declared)
        return sorted((tuple(r) for r in got.collect()), key=repr)
    want = sorted([("a", "k", 2, 0, "1", "2", None), ("a", "n", 2, 0, "1", "2", None), ("a", "t", 2, 1, "x", "x", None),
                   ("a", "b", 2, 1, None, None, None), ("empty", "k", 0, 0, None, None, None),
                   ("empty", "t", 0, 0, None, None, None), ("gone", None, 0, 0, None, None, "KeyError")], key=repr)
    assert run() == want == run()  # also over an earlier export
    back = spark.read.parquet(f"{out}/a.parquet")
    assert dict(back.dtypes) == {"k": "bigint", "n": "bigint", "t": "string", "b": "binary"} and back.count() == 2
    assert publish.is_published(spark, out, "empty") and not publish.is_published(spark, out, "gone")
    # files that hold other rows than the source gave are not published; the earlier export stays
    real = publish.column_stats
    monkeypatch.setattr(publish, "column_stats", lambda df: [(c, n + 1, *rest) for c, n, *rest in real(df)])
    tables["a"] = tables["a"].unionAll(tables["a"])
    assert ("a", None, 0, 0, None, None, "ValueError") in run()
    assert spark.read.parquet(f"{out}/a.parquet").count() == 2
