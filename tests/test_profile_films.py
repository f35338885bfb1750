"""The wide profile and its downstream operators on hand-made film tables."""

import datetime

from pyspark.sql import functions as F

from facetframe.operators import distributions as D
from facetframe.operators import people as PE
from facetframe.operators.filters import FilterSpec, filter_titles


def rows_by_id(df):
    return {r.imdbid: r for r in df.collect()}


def test_eligibility_and_one_row_per_title(film_profile):
    ids = sorted(r.imdbid for r in film_profile.select("imdbid").collect())
    assert ids == ["tt01", "tt02", "tt03", "tt04", "tt10"]


def test_profile_values(film_profile):
    p = rows_by_id(film_profile)
    a = p["tt01"]
    assert (a.rating, a.ratingMl, a.votesImdb, a.box, a.year) == (6.5, 3.2, 1234, 14.65, 2000)
    assert (a.country, a.continent, a.region, a.countriesAll) == ("France", "Europe", "Western Europe",
                                                                   "France, Spain")
    assert (a.genre, a.mlGenre, a.imdbGenre, a.genresAll) == ("Comedy", "Comedy", "Drama", "Comedy, Drama")
    assert (a.director, a.directorid, a.directorsAll) == ("Ann Lee", 1, "Ann Lee, Bob Ray")
    assert (a.oscars, a.otherAwards, a.votesMl) == (5, 4, 15)
    assert (a.dir.gender, a.dir.race, a.dir.country, a.dir.region, a.dir.age) == (
        "Female", "UNKNOWN", "France", "Western Europe", 20)
    assert (a.wri.name, a.wri.gender, a.wri.race, a.wri.country, a.wri.age) == (
        "Cy Dee", "Female", "ASIAN", "France", 21)

    b = p["tt02"]
    assert (b.ratingMl, b.votesImdb, b.box, b.continent, b.country) == (3.5, 0, 0.0, "Europe", "France")
    assert (b.genre, b.mlGenre, b.genresAll) == ("Horror", "Horror", "Horror")
    assert (b.dir.gender, b.dir.race, b.dir.country, b.dir.age) == ("Male", "WHITE", "France", None)
    assert (b.wri.gender, b.wri.race, b.wri.country, b.wri.region, b.wri.age) == (
        "Unknown", "UNKNOWN", "Brazil", "South America", 61)

    c = p["tt03"]
    assert (c.country, c.continent, c.region, c.year) == ("Spain", "Other", "", None)
    assert (c.genre, c.genresAll, c.box, c.votesImdb) == ("Action", "Action,  Drama", 0.0, 0)
    assert (c.dir.race, c.dir.country, c.wri.name, c.wri.country) == ("UNKNOWN", "Spain", "", "Spain")

    d = p["tt04"]
    assert (d.country, d.continent, d.region, d.genre, d.genresAll, d.year) == (
        "Unknown", "Other", "", "Other", "Other", None)
    assert (d.director, d.directorsAll, d.dir.gender) == ("", "", "Unknown")


def test_filters(film_profile):
    spec = FilterSpec(title=" AL", facets={"continents": ["Europe"]})
    assert [r.imdbid for r in filter_titles(film_profile, spec).collect()] == ["tt01"]
    spec2 = FilterSpec(director="ann", facets={"dirGenders": ["Male"]})
    assert [r.imdbid for r in filter_titles(film_profile, spec2).collect()] == ["tt02"]
    # idempotent and commutative facets
    s1 = FilterSpec(facets={"years": [2000, 2001], "countries": ["France"]})
    s2 = FilterSpec(facets={"countries": ["France"], "years": [2000, 2001]})
    once = sorted(r.imdbid for r in filter_titles(film_profile, s1).collect())
    twice = sorted(r.imdbid for r in filter_titles(filter_titles(film_profile, s1), s2).collect())
    assert once == twice == ["tt01", "tt02"]


def test_histogram_decade_kpis(film_profile):
    h = [(r.label, r.n) for r in D.histogram(film_profile, "ratingMl", D.ML_EDGES).collect()]
    assert h == [("<3.5", 1), ("3.5–4.0", 3), ("4.0–4.5", 1), ("4.5+", 0)]
    assert sum(n for _, n in h) == film_profile.count()
    dec = [(r.label, r.n) for r in D.by_decade(film_profile, film_profile).collect()]
    assert dec == [("2001–2001", 1), ("1991–2000", 2)]
    k = D.kpis(film_profile.where(F.col("country") == "France"), film_profile).first()
    assert (k.films, k.films_all, k.countries, k.votes_imdb, k.mean_rating_imdb) == (2, 5, 1, 1234, 6.7)
    empty = D.kpis(film_profile.where(F.lit(False)), film_profile).first()
    assert (empty.films, empty.mean_rating_imdb, empty.oscars) == (0, 0.0, 0)


def test_breakdown_and_pyramid(spark, film_profile):
    b = {r.label: (r.n, r.share) for r in D.breakdown(film_profile, "dir.race", D.RACES).collect()}
    assert b["UNKNOWN"] == (4, 80) and b["WHITE"] == (1, 20) and b["ASIAN"] == (0, 0)
    people = spark.createDataFrame(
        [(20, "Male"), (21, "Female"), (60, "Male"), (61, "Female"), (-1, "Male"), (None, "Male"),
         (30, "Unknown")], "age int, gender string").select(F.struct("age", "gender").alias("dir"))
    pyr = {r.band: (r.male, r.female) for r in D.age_pyramid(people, "dir").collect()}
    assert list(pyr.items()) == [("> 60", (0, 1)), ("51 a 60", (1, 0)), ("41 a 50", (0, 0)),
                                 ("31 a 40", (0, 0)), ("21 a 30", (0, 1)), ("ate 20", (1, 0))]


def test_people(film_profile):
    by_name = {r.name: r for r in PE.people_table(film_profile, "dir").collect()}
    assert set(by_name) == {"Ann Lee", "Bob Ray"}
    ann = by_name["Ann Lee"]
    assert (ann["count"], ann.id, ann.gender, ann.nationality, ann.birthYear, ann.ratingImdb) == (
        2, 1, "Female", "France", 1980, 6.7)
    bob = by_name["Bob Ray"]
    assert (bob["count"], bob.id, bob.birthYear, bob.ratingImdb) == (2, 2, 1940, 7.1)
    by_id = PE.people_table(film_profile, "dir", key="id").collect()
    assert sorted((r.name, r.id) for r in by_id) == [("Ann Lee", 1), ("Ann Lee", 3), ("Bob Ray", 2)]
    rollup = {r.country: r for r in PE.by_country(film_profile).collect()}
    assert (rollup["France"].films, rollup["France"].top_title, rollup["France"].mean_rating) == (2, "Beta", 6.7)
    top = {r.country: r.top_name for r in PE.people_by_country(film_profile, "dir").collect()}
    assert top["Unknown"] == "—" and top["France"] == "Ann Lee"


def test_title_stages_are_dealt_into_tasks_that_grow_with_the_input(spark, monkeypatch):
    from facetframe.plans import orders
    from facetframe.sources import catalog
    from tests.conftest import SF_SMALL
    size = sum(catalog.table_stamp(spark, catalog.table_path(SF_SMALL, n))[1] for n in ("orders", "lineitem"))
    want = sorted(map(repr, orders.order_profile(spark, SF_SMALL).collect()))
    for tasks in (11, 23):
        monkeypatch.setattr(catalog, "TASK_BYTES", -(-size // tasks))
        p = orders.order_profile(spark, SF_SMALL)
        plan = p._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(f"], {tasks}") >= 10
        assert sorted(map(repr, p.collect())) == want


def test_the_title_stages_are_short_enough_to_be_compiled(spark):
    # the JVM interprets methods of over 8 000 bytes; all title rules in one stage made one of 11 566
    from facetframe.operators.eligibility import eligible_titles
    from facetframe.plans.orders import conform_titles
    from facetframe.plans.profile import clean_titles, title_texts
    orders = spark.createDataFrame(
        [(1, 4, "O", 20_000.0, datetime.datetime(1997, 5, 1), "2-HIGH"), (2, 3, "F", 31_000.0, None, "5-LOW")],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
        "o_orderpriority string")
    cleaned = clean_titles(eligible_titles(conform_titles(orders), require_parsed_rating=True))
    dealt = spark.createDataFrame(cleaned.collect(), cleaned.schema)
    for stage in (cleaned, title_texts(dealt)):
        code = stage._jdf.queryExecution().debug().codegenToSeq()
        sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
        assert sizes and max(sizes) <= 8000, sizes
    got = {r.IMDBID: r for r in title_texts(dealt).collect()}
    assert (got[1].rating, got[1].ratingMl, got[1].box, got[1].votesImdb) == (0.4, 0.2, 0.02, 4001)
    assert (got[2].box, got[2].votesImdb, got[2]._country_raw1, got[2]._genre_raw1) == (0.0, 3002, None, "5-LOW")
    assert (got[1]._country_raw1, got[1]._genre_spaced, got[1].year) == ("NATION_4", "2-HIGH, O", 1997)
