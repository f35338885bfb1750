"""Place classification, location mentions and themes on the film fixtures."""

from pyspark.sql import functions as F

from facetframe.operators import mentions as MN
from facetframe.operators import themes as TH
from facetframe.operators.filters import FilterSpec, filter_mentions, filter_titles
from facetframe.operators.places import classify_names


def _inputs(films):
    return films["subtitle_geo"], films["ml_imdb"], films["movie_imdb"], films["movie_country"]


def test_classification_precedence(spark, gazetteer):
    names = spark.createDataFrame([(n,) for n in ["Georgia", "LA", "Chicago's", "Texas's", "Xyz", "PARIS",
                                                  "Paris", " holland ", "la"]], "location string")
    got = {r.name: (r.locType, r.label) for r in classify_names(names, gazetteer).collect()}
    assert got["Georgia"][0] == "State"          # later main category wins
    assert got["LA"][0] == "City"                # alias
    assert got["Chicago's"][0] == "City"         # possessive stripped
    assert got["Texas's"][0] == "Other"          # stripping by character set: 'texa'
    assert got["Xyz"][0] == "Other"
    assert got["PARIS"] == ("City", "Paris") and got["Paris"] == ("City", "Paris")
    assert got[" holland "][0] == "Country"


def test_location_mentions(films, gazetteer):
    geo, bridge, titles, primary = _inputs(films)
    rows = {(r.location, r.imdbid): r for r in
            MN.location_mentions(geo, bridge, titles, primary, gazetteer).collect()}
    assert rows[("PARIS", "tt01")].mentions == 2 and rows[("Paris", "tt01")].mentions == 2
    assert ("Madrid", "tt01") not in rows                     # below the threshold
    assert rows[("Madrid", "tt08")].country == "Spain"         # rating N/A: still a mention row
    assert rows[("Georgia", "tt01")].locType == "State"
    assert rows[("Holland", "tt02")].locType == "Country"


def test_location_mentions_normalised(films, gazetteer):
    geo, bridge, titles, primary = _inputs(films)
    rows = {(r.location, r.imdbid): r for r in
            MN.location_mentions(geo, bridge, titles, primary, gazetteer, normalise=True).collect()}
    assert rows[("paris", "tt01")].mentions == 4 and rows[("paris", "tt01")].label == "Paris"
    assert ("PARIS", "tt01") not in rows


def test_mention_filters(films, gazetteer, film_profile):
    geo, bridge, titles, primary = _inputs(films)
    m = MN.location_mentions(geo, bridge, titles, primary, gazetteer)
    # rows of titles outside the profile are dropped; search per row type
    rows = filter_mentions(m, film_profile, {"City": "par"}).collect()
    assert sorted((r.location, r.imdbid) for r in rows) == [("PARIS", "tt01"), ("Paris", "tt01")]
    ids = filter_titles(film_profile, FilterSpec(loc_search={"Country": "holl", "State": "zzz"}), mentions=m)
    assert [r.imdbid for r in ids.collect()] == ["tt02"]
    none = filter_titles(film_profile, FilterSpec(loc_search={"City": "nowhere"}), mentions=m)
    assert none.count() == 0
    table = MN.mention_table(filter_mentions(m, film_profile, {}), film_profile)
    assert {r.location for r in table.collect()} >= {"Paris", "Georgia", "Chicago's"}
    opts = MN.location_options(m, film_profile).collect()
    assert ("City", "Madrid") not in {(r.locType, r.location) for r in opts}   # tt08 not in profile


def test_themes(films):
    _, bridge, titles, primary = _inputs(films)
    th = films["subtitle_theme"]
    opts = {(r.idiom, r.theme, r.word) for r in TH.theme_options(th, bridge, titles).collect()}
    assert opts == {("EN", "love", "heart"), ("EN", "love", "kiss"), ("EN", "war", "gun"),
                    ("PT-BR", "love", "amor")}
    base = TH.theme_mentions(th, bridge, titles, primary)
    got = {(r.idiom, r.word, r.imdbid): (r.mentions, r.country) for r in base.collect()}
    # 'heart' is 2 + 2: options only; the null idiom is its own group in filtered rows
    assert got == {("EN", "kiss", "tt01"): (3, "France"), ("EN", "gun", "tt08"): (5, "Spain"),
                   ("PT-BR", "amor", "tt10"): (3, "Brazil"), (None, "kiss", "tt01"): (9, "France")}
    res = TH.ThemeResult.compute(TH.theme_mentions(th, bridge, titles, primary, idiom="EN"))
    assert res.total().first().total == 2
    assert {r.imdbid for r in res.ids().collect()} == {"tt01", "tt08"}
    assert [r.theme for r in res.stats().collect()] == ["love", "war"]
    page = res.page(sort="country").collect()                  # unknown key -> mentions desc
    assert [r.word for r in page] == ["gun", "kiss"]
    res.release()
    tree = {(r.idiom, r.theme): r for r in TH.theme_option_tree(TH.theme_options(th, bridge, titles)).collect()}
    assert tree[("EN", "love")].themes == ["love", "war"] and tree[("EN", "love")].words == ["heart", "kiss"]
    assert tree[("PT-BR", "love")].words == ["amor"]


def test_theme_filter_without_match_yields_no_titles(films, film_profile):
    _, bridge, titles, primary = _inputs(films)
    rows = TH.theme_mentions(films["subtitle_theme"], bridge, titles, primary, theme="none")
    out = filter_titles(film_profile, FilterSpec(theme="none"), theme_rows=rows)
    assert out.count() == 0
    all_empty = filter_titles(film_profile, FilterSpec(), theme_rows=rows)
    assert all_empty.count() == film_profile.count()


def test_rating_distribution(films):
    from facetframe.operators.distributions import rating_distribution
    got = [(r.rating, r.votes) for r in rating_distribution(films["movie_rating"]).collect()]
    assert got == [(3.0, 100), (3.5, 5), (4.0, 10), (4.5, 7)]
    assert F is not None


def test_active_searches_need_their_rows(film_profile):
    import pytest
    with pytest.raises(ValueError):
        filter_titles(film_profile, FilterSpec(loc_search={"City": "x"}))
    with pytest.raises(ValueError):
        filter_titles(film_profile, FilterSpec(word="x"))


def test_theme_spec_is_applied_inside(films, film_profile):
    geo, bridge, titles, countries = _inputs(films)
    rows = TH.theme_mentions(films["subtitle_theme"], bridge, titles, countries)
    themes = {r.theme for r in rows.select("theme").collect()}
    for theme in themes:
        want = {r.imdbid for r in rows.where(F.col("theme") == theme).collect()}
        got = {r.imdbid for r in filter_titles(film_profile, FilterSpec(theme=theme), theme_rows=rows).collect()}
        assert got == {r.imdbid for r in film_profile.collect()} & want


def test_classification_does_not_shuffle_names(spark):
    from facetframe.plans import analogues
    from tests.conftest import SF_SMALL
    plan = analogues.QUERIES["token_mentions"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not [x for x in exchanges if "hashpartitioning(LOCATION" in x or "hashpartitioning(_key" in x
                              or "hashpartitioning(location" in x]


def test_names_are_stripped_of_unicode_space(spark, gazetteer):
    names = spark.createDataFrame([("\xa0Paris\u2003",)], "location string")
    assert classify_names(names, gazetteer).first().locType == "City"
