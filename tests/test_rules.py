"""Column rules (rounding, cleaning, title case) against plain-Python statements
of the same rules, on edge values and on generated values."""

import math
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetframe.functions import clean as C
from facetframe.functions.rounding import round_exact, round_half_up, to_fixed


def js_to_fixed(x: float, n: int) -> float:
    """Number.prototype.toFixed on the exact binary value: ties away from zero."""
    d = Decimal(x).quantize(Decimal(1).scaleb(-n), rounding=ROUND_HALF_UP)
    return float(d)


def js_title_case(s):
    s = (s or "").lower()
    return re.sub(r"(?:^|[\s\-/])(\S)", lambda m: m.group(0)[:-1] + m.group(1).upper(), s)


def _col(spark, values, typ="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {typ}")


def test_round_exact_matches_python_on_half_steps(spark):
    vals = [r / 10 / 2 for r in range(0, 1001)] + [2.675, 1.005, 0.125, 0.375, -2.5, 1e-7]
    df = _col(spark, vals).select("i", round_exact("x", 1).alias("r1"), round_exact("x", 2).alias("r2"))
    got = {r.i: (r.r1, r.r2) for r in df.collect()}
    for i, v in enumerate(vals):
        assert got[i] == (round(v, 1), round(v, 2)), v


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=40))
def test_rounding_rules_generated(spark, xs):
    df = _col(spark, xs).select("i", round_exact("x", 1).alias("rx"), to_fixed("x", 1).alias("tf"),
                                round_half_up("x", 1).alias("rh"))
    for r in df.collect():
        x = xs[r.i]
        assert r.rx == round(x, 1)
        assert r.tf == js_to_fixed(x, 1)
        assert r.rh == math.floor(x * 10.0 + 0.5) / 10.0


def test_number_guard_and_rating(spark):
    texts = ["7.1", "7.", ".5", " 7 ", "1e1", "7.1d", "nan", "N/A", "", "1_0", None, "abc", "6.45"]
    df = _col(spark, texts, "string").select("i", C.rating("x").alias("r"))
    got = {r.i: r.r for r in df.collect()}
    assert [got[i] for i in range(len(texts))] == [7.1, 7.0, 0.5, 7.0, 10.0, None, None, None, None,
                                                    None, None, None, round(6.45, 1)]


def test_money_and_votes(spark):
    money = ["$14,648,076", "N/A", "$0", "", None, "$1.50"]
    votes = ["1,234", "N/A", None, "", "12a3"]
    m = {r.i: r.v for r in _col(spark, money, "string").select("i", C.money_millions("x").alias("v")).collect()}
    assert [m[i] for i in range(len(money))] == [14.65, 0.0, 0.0, 0.0, 0.0, 0.0]
    v = {r.i: r.v for r in _col(spark, votes, "string").select("i", C.digits_int("x").alias("v")).collect()}
    assert [v[i] for i in range(len(votes))] == [1234, 0, 0, 0, 123]


def test_gender_race(spark):
    g = ["male", "FEMALE", "", None, "other", "Male"]
    rc = [None, "undefined", "white", "", "Mixed-Race"]
    gg = {r.i: r.v for r in _col(spark, g, "string").select("i", C.gender("x").alias("v")).collect()}
    assert [gg[i] for i in range(len(g))] == ["Male", "Female", "Unknown", "Unknown", "Unknown", "Male"]
    rr = {r.i: r.v for r in _col(spark, rc, "string").select("i", C.race("x").alias("v")).collect()}
    assert [rr[i] for i in range(len(rc))] == ["UNKNOWN", "UNKNOWN", "WHITE", "UNKNOWN", "MIXED-RACE"]


@pytest.mark.parametrize("s", ["new york", "rio de janeiro", "saint-denis", "a--b", "x/y z", " lead",
                               "ALL CAPS-x", "tab\tsep", "", "o'neil's", "--", "é-à"])
def test_title_case_edges(spark, s):
    got = _col(spark, [s], "string").select(C.title_case("x").alias("t")).first().t
    assert got == js_title_case(s)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab -/\t'sX", max_size=12), min_size=1, max_size=20))
def test_title_case_generated(spark, xs):
    df = _col(spark, xs, "string").select("i", C.title_case("x").alias("t"))
    for r in df.collect():
        assert r.t == js_title_case(xs[r.i])


def test_year_age_awards(spark):
    df = spark.createDataFrame(
        [(2000.0, 1980.0, 3.0, 5.0, 4.0, 1.0, 1.0, 0.0, None, None), (0.0, 1980.0, None, None, None, None,
                                                                       None, None, None, None),
         (None, None, 2.9, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)],
        "y double, b double, aw double, ow double, an double, on double, bw double, bn double, "
        "ew double, en double")
    out = df.select(C.year("y").alias("year"), C.age(C.year("y"), "b").alias("age"),
                    C.other_awards("aw", "ow", "an", "on", "bw", "bn", "ew", "en").alias("oa")).collect()
    assert [(r.year, r.age, r.oa) for r in out] == [(2000, 20, 4), (None, None, 0), (None, None, 2)]


def test_first_of_list_and_all_genres(spark):
    df = spark.createDataFrame([(None, "Action, Drama", "Action"), ("Comedy, Drama", None, "Comedy"),
                                (None, None, "Other"), (None, " , x", "Other")],
                               "l string, raw string, g string")
    out = df.select(C.first_of_list("raw").alias("f"),
                    C.all_genres("l", C.spaced_list("raw"), "g").alias("a")).collect()
    assert [(r.f, r.a) for r in out] == [("Action", "Action,  Drama"), (None, "Comedy, Drama"),
                                         (None, "Other"), (None, ",  x")]


def test_means_follow_the_rules(spark):
    """M3 for headline figures and countries, M2 for people, on exact sums."""
    from facetframe.functions.rounding import round_half_up, to_fixed
    from facetframe.operators.common import mean_of_tenths

    def fixed(x):  # nearest one-decimal value of the exact binary value, ties away from zero
        return float(Decimal(x).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP))

    assert fixed(12.7 / 2) == 6.3
    pairs = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(st.integers(10, 100), min_size=1, max_size=7))
    def gather(values):
        pairs.append((sum(values), len(values)))
    gather()
    pairs += [(127, 2), (25, 2), (0, 1)]
    m = mean_of_tenths(F.col("s"), F.col("n"))
    rows = spark.createDataFrame(pairs, "s long, n long").select("s", "n", to_fixed(m).alias("m3"),
                                                                 round_half_up(m).alias("m2")).collect()
    for r in rows:
        x = r.s / 10.0 / r.n
        assert r.m3 == fixed(x) and r.m2 == math.floor(x * 10 + 0.5) / 10
