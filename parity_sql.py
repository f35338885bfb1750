"""DuckDB texts that restate each registered query for the parity check.

Each text runs on the pre-registered driver views (orders, lineitem, ...).
They are written from the operator semantics, independently of the Spark
code, so an agreement means both readings of a rule agree.
"""

from __future__ import annotations

# Python round(x, n) on the exact binary value == DuckDB's format('{:.nf}').
def rx(expr: str, n: int = 1) -> str:
    return f"CAST(format('{{:.{n}f}}', ({expr})::DOUBLE) AS DOUBLE)"


NUM_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


# Fixed value: the characters Python's str.strip() removes.
_WS = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{_WS}+|{_WS}+$', '', 'g')"


def digits(expr: str) -> str:
    return (f"COALESCE(TRY_CAST(NULLIF(regexp_replace(CAST({expr} AS VARCHAR), '[^0-9]', '', 'g'), '')"
            f" AS BIGINT), 0)")


def gender(expr: str) -> str:
    return (f"CASE upper({expr}) WHEN 'MALE' THEN 'Male' WHEN 'FEMALE' THEN 'Female' "
            f"ELSE 'Unknown' END")


def race(expr: str) -> str:
    return (f"CASE WHEN {expr} IS NULL OR {expr} = '' OR upper({expr}) = 'UNDEFINED' "
            f"THEN 'UNKNOWN' ELSE upper({expr}) END")


def int0(expr: str) -> str:
    return f"CAST(trunc(COALESCE({expr}, 0)) AS BIGINT)"


# --- the order preset, conformed ------------------------------------------------
CONFORMED = f"""
t AS (
  SELECT o_orderkey AS IMDBID, o_orderkey AS MOVIEID,
    lower(substr(o_orderpriority, 3)) || ' order ' || CAST(o_orderkey AS VARCHAR) AS TITLE,
    CASE WHEN o_orderstatus = 'P' THEN 'series' ELSE 'movie' END AS TYPE,
    CASE WHEN o_orderkey % 31 = 0 THEN 'false' ELSE 'true' END AS RESPONSE,
    CAST(year(o_orderdate) AS DOUBLE) AS YEAR,
    CASE WHEN o_orderkey % 23 = 0 THEN 'N/A'
         WHEN o_orderkey % 29 = 0 THEN 'unrated'
         WHEN o_orderkey % 37 = 0 THEN NULL
         ELSE CAST(CAST(floor(o_totalprice / 5000.0) AS BIGINT) // 10 AS VARCHAR) || '.'
              || CAST(CAST(floor(o_totalprice / 5000.0) AS BIGINT) % 10 AS VARCHAR) END AS IMDBRATING,
    CAST(o_custkey AS VARCHAR) || ',' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS IMDBVOTES,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'N/A'
         ELSE '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS BOXOFFICE,
    CAST(o_orderkey % 3 AS DOUBLE) AS OSCAR_WINNING,
    CAST(o_orderkey % 5 AS DOUBLE) AS OSCAR_NOMINATION,
    CAST(o_custkey % 4 AS DOUBLE) AS AWARD_WINNING,
    CAST(o_custkey % 7 AS DOUBLE) AS AWARD_NOMINATION,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END::DOUBLE AS BAFTA_WINNING,
    CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 1.0 END::DOUBLE AS BAFTA_NOMINATION,
    NULL::DOUBLE AS EMMY_WINNING,
    CASE WHEN o_orderstatus = 'O' THEN 2.0 END::DOUBLE AS EMMY_NOMINATION,
    o_orderpriority || ',' || o_orderstatus AS GENRE,
    CASE WHEN o_custkey % 3 = 0 THEN NULL
         ELSE 'NATION_' || CAST(o_custkey % 25 AS VARCHAR) || ', NATION_0' END AS COUNTRY
  FROM orders
),
cd AS (
  SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS ISO, n_name AS COUNTRY, r_name AS CONTINENT,
         r_name || CASE WHEN n_nationkey % 2 = 0 THEN ' EAST' ELSE ' WEST' END AS REGION
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
cb AS (
  SELECT l_orderkey AS IMDBID,
    CASE WHEN s_suppkey % 7 = 0 THEN NULL
         WHEN s_suppkey % 11 = 0 THEN 'X' || CAST(s_nationkey AS VARCHAR)
         ELSE 'N' || CAST(s_nationkey AS VARCHAR) END AS ISO,
    CASE WHEN s_suppkey % 13 = 0 THEN lower(n_name) ELSE n_name END AS COUNTRY
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
),
lp AS (
  SELECT l_orderkey, l_linestatus, p_type, p_brand
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
mlg AS (SELECT l_orderkey AS MOVIEID, p_type AS GENRE FROM lp WHERE l_linestatus = 'F'),
ig AS (SELECT l_orderkey AS IMDBID, p_brand AS GENRE FROM lp WHERE l_linestatus = 'O'),
db AS (SELECT o_orderkey AS IMDBID, o_custkey AS DIRECTORID FROM orders),
dd AS (
  SELECT c_custkey AS DIRECTORID,
    'cust ' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS NAME,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'male' WHEN 'BUILDING' THEN 'FEMALE'
                      WHEN 'HOUSEHOLD' THEN 'Male' END AS GENDER,
    CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'female' END AS GENDER_LLM,
    CASE c_nationkey % 7 WHEN 0 THEN 'white' WHEN 1 THEN 'asian' WHEN 2 THEN 'black'
      WHEN 3 THEN 'undefined' WHEN 4 THEN NULL WHEN 5 THEN 'Indigenous' ELSE 'martian' END AS RACE,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(1930 + c_custkey % 60 AS DOUBLE) END AS BIRTHYEAR,
    CASE WHEN c_custkey % 9 = 0 THEN 'ZZ' ELSE 'N' || CAST(c_nationkey AS VARCHAR) END AS NATIONALITY
  FROM customer
),
wb AS (SELECT l_orderkey AS IMDBID, l_suppkey AS WRITERID FROM lineitem),
ww AS (
  SELECT s_suppkey AS WRITERID, s_name AS NAME,
    CASE s_suppkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS GENDER,
    CASE s_nationkey % 3 WHEN 0 THEN 'white' WHEN 1 THEN 'mixed-race' ELSE '' END AS RACE,
    CAST(1940 + s_suppkey % 45 AS DOUBLE) AS BIRTHYEAR,
    'N' || CAST(s_nationkey AS VARCHAR) AS NATIONALITY
  FROM supplier
),
rt AS (
  SELECT l_orderkey AS MOVIEID, round(l_discount * 100.0) / 2.0 AS RATING,
         CAST(l_quantity AS BIGINT) AS COUNT_RATING
  FROM lineitem
)"""

# --- the profile over the conformed tables --------------------------------------
# One grouped query per bridge gives a title's first row and its list together; country
# names and codes are looked up in two maps made once from the country table.
PROFILE = CONFORMED + f""",
eligible AS (
  SELECT *, {rx(f"CASE WHEN regexp_matches(IMDBRATING, '{NUM_RE}') THEN TRY_CAST(trim(IMDBRATING) AS DOUBLE) END")} AS RATING_NUM
  FROM t
  WHERE RESPONSE = 'true' AND TYPE = 'movie' AND COALESCE(IMDBRATING, 'N/A') <> 'N/A'
    AND regexp_matches(IMDBRATING, '{NUM_RE}')
),
atlas AS (
  SELECT map(list(ISO), list(place)) AS by_code, map(list(COUNTRY), list(place)) AS by_name
  FROM (SELECT ISO, COUNTRY, struct_pack(country := COUNTRY, continent := CONTINENT, region := REGION) AS place FROM cd)
),
title_places AS (
  SELECT IMDBID, first(struct_pack(name := COUNTRY, continent := hit.continent, region := hit.region)
           ORDER BY COUNTRY NULLS LAST, hit.continent NULLS LAST, hit.region NULLS LAST) AS main,
         string_agg(COALESCE(hit.country, COUNTRY), ', ' ORDER BY COALESCE(hit.country, COUNTRY)) AS names
  FROM (SELECT cb.IMDBID, cb.COUNTRY,
               COALESCE((SELECT by_code FROM atlas)[cb.ISO], (SELECT by_name FROM atlas)[cb.COUNTRY]) AS hit
        FROM cb SEMI JOIN eligible USING (IMDBID))
  GROUP BY IMDBID
),
title_genres AS (
  SELECT 'ml' AS kind, MOVIEID AS id, min(GENRE) AS main, string_agg(GENRE, ', ' ORDER BY GENRE) AS names
  FROM mlg SEMI JOIN eligible USING (MOVIEID) GROUP BY MOVIEID
  UNION ALL
  SELECT 'imdb', IMDBID, min(GENRE), string_agg(GENRE, ', ' ORDER BY GENRE)
  FROM ig SEMI JOIN eligible USING (IMDBID) GROUP BY IMDBID
),
title_directors AS (
  SELECT db.IMDBID, string_agg(dd.NAME, ', ' ORDER BY dd.NAME) AS names,
         first(dd ORDER BY dd.DIRECTORID NULLS LAST, dd.NAME NULLS LAST, dd.GENDER NULLS LAST, dd.GENDER_LLM NULLS LAST,
               dd.RACE NULLS LAST, dd.BIRTHYEAR NULLS LAST, dd.NATIONALITY NULLS LAST) AS main
  FROM db SEMI JOIN eligible USING (IMDBID) JOIN dd USING (DIRECTORID)
  GROUP BY db.IMDBID
),
title_writers AS (
  SELECT lead.IMDBID, ww AS main
  FROM (SELECT IMDBID, min(WRITERID) AS WRITERID FROM wb SEMI JOIN eligible USING (IMDBID)
        SEMI JOIN ww USING (WRITERID) GROUP BY IMDBID) lead
  JOIN ww USING (WRITERID)
),
title_votes AS (
  SELECT MOVIEID, sum(COUNT_RATING) AS VOTES_ML FROM rt SEMI JOIN eligible USING (MOVIEID) GROUP BY MOVIEID
),
w AS (
  SELECT e.*,
    p.main.name AS MAIN_COUNTRY, p.main.continent AS MAIN_CONTINENT, p.main.region AS MAIN_REGION, p.names AS COUNTRY_NAMES,
    gm.main AS ML_GENRE, gm.names AS ML_GENRES, gi.main AS IMDB_GENRE, gi.names AS IMDB_GENRES,
    d.main.DIRECTORID AS D_ID, d.main.NAME AS D_NAME, COALESCE(d.main.GENDER, d.main.GENDER_LLM) AS D_GENDER,
    d.main.RACE AS D_RACE, d.main.BIRTHYEAR AS D_BY, d.names AS DIRECTOR_NAMES,
    a.main.WRITERID AS W_ID, a.main.NAME AS W_NAME, a.main.GENDER AS W_GENDER, a.main.RACE AS W_RACE,
    a.main.BIRTHYEAR AS W_BY, v.VOTES_ML,
    (SELECT by_code FROM atlas)[d.main.NATIONALITY].country AS D_COUNTRY,
    (SELECT by_code FROM atlas)[d.main.NATIONALITY].region AS D_REGION,
    (SELECT by_code FROM atlas)[a.main.NATIONALITY].country AS W_COUNTRY,
    (SELECT by_code FROM atlas)[a.main.NATIONALITY].region AS W_REGION
  FROM eligible e
  LEFT JOIN title_places p USING (IMDBID)
  LEFT JOIN title_genres gm ON gm.kind = 'ml' AND gm.id = e.MOVIEID
  LEFT JOIN title_genres gi ON gi.kind = 'imdb' AND gi.id = e.IMDBID
  LEFT JOIN title_directors d USING (IMDBID)
  LEFT JOIN title_writers a USING (IMDBID)
  LEFT JOIN title_votes v USING (MOVIEID)
),
c1 AS (
  SELECT w.*,
    CASE WHEN YEAR IS NOT NULL AND YEAR <> 0 THEN CAST(trunc(YEAR) AS INTEGER) END AS Y,
    COALESCE(NULLIF(MAIN_COUNTRY, ''), NULLIF({strip("split_part(COALESCE(COUNTRY, ''), ',', 1)")}, ''), 'Unknown') AS CTRY,
    COALESCE(NULLIF(MAIN_REGION, ''), '') AS RGN,
    NULLIF(ML_GENRE, '') AS MLG,
    COALESCE(NULLIF(IMDB_GENRE, ''), NULLIF({strip("split_part(COALESCE(GENRE, ''), ',', 1)")}, '')) AS IMG
  FROM w
),
c2 AS (
  SELECT c1.*, COALESCE(MLG, IMG, 'Other') AS GEN,
    COALESCE(NULLIF(COALESCE(ML_GENRES, IMDB_GENRES), ''), NULLIF(replace(COALESCE(GENRE, ''), ',', ', '), '')) AS GALL
  FROM c1
),
profile AS (
  SELECT
    IMDBID AS imdbid, MOVIEID AS movieid, TITLE AS title,
    COALESCE(NULLIF(D_NAME, ''), '') AS director,
    D_ID AS directorid,
    COALESCE(NULLIF(DIRECTOR_NAMES, ''), NULLIF(D_NAME, ''), '') AS directorsAll,
    Y AS year,
    CTRY AS country,
    COALESCE(NULLIF(COUNTRY_NAMES, ''), CTRY) AS countriesAll,
    GEN AS genre,
    CASE WHEN GALL IS NOT NULL THEN {strip("GALL")} ELSE GEN END AS genresAll,
    COALESCE(MLG, GEN) AS mlGenre,
    COALESCE(IMG, GEN) AS imdbGenre,
    RATING_NUM AS rating,
    {rx(f"{digits('BOXOFFICE')} / 1000000.0", 2)} AS box,
    COALESCE(NULLIF(MAIN_CONTINENT, ''), 'Other') AS continent,
    RGN AS region,
    RATING_NUM AS ratingImdb,
    {rx("RATING_NUM / 2.0", 1)} AS ratingMl,
    {digits('IMDBVOTES')} AS votesImdb,
    CASE WHEN VOTES_ML IS NOT NULL AND VOTES_ML <> 0 THEN CAST(VOTES_ML AS BIGINT) ELSE 0 END AS votesMl,
    {int0('OSCAR_WINNING')} AS oscars,
    greatest(0, {int0('AWARD_WINNING')} - {int0('OSCAR_WINNING')})
      + greatest(0, {int0('AWARD_NOMINATION')} - {int0('OSCAR_NOMINATION')})
      + {int0('BAFTA_WINNING')} + {int0('BAFTA_NOMINATION')}
      + {int0('EMMY_WINNING')} + {int0('EMMY_NOMINATION')} AS otherAwards,
    {gender('D_GENDER')} AS dir_gender,
    {race('D_RACE')} AS dir_race,
    COALESCE(NULLIF(D_COUNTRY, ''), CTRY) AS dir_country,
    COALESCE(NULLIF(D_REGION, ''), RGN) AS dir_region,
    CASE WHEN Y IS NOT NULL AND Y <> 0 AND D_BY IS NOT NULL AND D_BY <> 0
         THEN Y - CAST(trunc(D_BY) AS INTEGER) END AS dir_age,
    COALESCE(NULLIF(W_NAME, ''), '') AS wri_name,
    W_ID AS wri_id,
    {gender('W_GENDER')} AS wri_gender,
    {race('W_RACE')} AS wri_race,
    COALESCE(NULLIF(W_COUNTRY, ''), CTRY) AS wri_country,
    COALESCE(NULLIF(W_REGION, ''), RGN) AS wri_region,
    CASE WHEN Y IS NOT NULL AND Y <> 0 AND W_BY IS NOT NULL AND W_BY <> 0
         THEN Y - CAST(trunc(W_BY) AS INTEGER) END AS wri_age
  FROM c2
)"""


def with_profile(select_sql: str) -> str:
    return "WITH " + PROFILE + "\n" + select_sql


SQL: dict[str, str] = {}

SQL["order_profile"] = with_profile("SELECT * FROM profile")


def mean_fixed(sum_tenths: str, n: str) -> str:
    """The mean over an exact sum of tenths, as JavaScript's toFixed(1) gives it."""
    x = f"(({sum_tenths})::DOUBLE / 10.0 / ({n})::DOUBLE)"
    return (f"CASE WHEN ({n}) > 0 THEN CASE WHEN abs({x}) * 4.0 = floor(abs({x}) * 4.0) "
            f"THEN sign({x}) * floor(abs({x}) * 10.0 + 0.5) / 10.0 ELSE {rx(x)} END END")


def mean_half(sum_tenths: str, n: str) -> str:
    """The mean over an exact sum of tenths, rounded as floor(10 x + 0.5) / 10."""
    return f"CASE WHEN ({n}) > 0 THEN floor(({sum_tenths})::DOUBLE / 10.0 / ({n})::DOUBLE * 10.0 + 0.5) / 10.0 END"


def t10(expr: str) -> str:
    return f"CAST(round(({expr}) * 10.0) AS BIGINT)"


SQL["facet_filter"] = with_profile("""
SELECT imdbid, title, director, continent, year, dir_gender FROM profile
WHERE contains(lower(COALESCE(title, '')), 'high') AND contains(lower(COALESCE(director, '')), 'cust 1')
  AND continent IN ('ASIA', 'EUROPE', 'AMERICA') AND dir_gender IN ('Male', 'Female')
  AND year IN (1996, 1997, 1998, 2000)""")

SQL["kpis"] = with_profile(f"""
SELECT count(*) AS films, (SELECT count(*) FROM profile) AS films_all,
  count(DISTINCT country) AS countries,
  CAST(COALESCE(sum(votesImdb), 0) AS BIGINT) AS votes_imdb,
  CAST(COALESCE(sum(votesMl), 0) AS BIGINT) AS votes_ml,
  COALESCE({mean_fixed(f"sum({t10('ratingImdb')})", "count(*)")}, 0.0) AS mean_rating_imdb,
  COALESCE({mean_fixed(f"sum({t10('ratingMl')})", "count(*)")}, 0.0) AS mean_rating_ml,
  CAST(COALESCE(sum(oscars), 0) AS BIGINT) AS oscars,
  CAST(COALESCE(sum(otherAwards), 0) AS BIGINT) AS other_awards
FROM profile WHERE year IN (1996, 1997, 1998) AND wri_race IN ('WHITE', 'UNKNOWN')""")

_EXCL = ("label IS NOT NULL AND NOT (facet = 'continent' AND label IN ('', 'Other'))"
         " AND NOT (facet = 'region' AND label = '')")
SQL["grouping_sets"] = with_profile(f"""
, g AS (
  SELECT 'genre' AS facet, genre AS label, count(*) AS films, sum(oscars) AS osc,
         count(*) FILTER (WHERE oscars <> 0) AS n_osc, sum(otherAwards) AS aw,
         count(*) FILTER (WHERE otherAwards <> 0) AS n_aw FROM profile GROUP BY genre
  UNION ALL
  SELECT 'continent', continent, count(*), sum(oscars), count(*) FILTER (WHERE oscars <> 0),
         sum(otherAwards), count(*) FILTER (WHERE otherAwards <> 0) FROM profile GROUP BY continent
  UNION ALL
  SELECT 'region', region, count(*), sum(oscars), count(*) FILTER (WHERE oscars <> 0),
         sum(otherAwards), count(*) FILTER (WHERE otherAwards <> 0) FROM profile GROUP BY region)
SELECT facet, label, 'films' AS measure, CAST(films AS BIGINT) AS value FROM g WHERE {_EXCL}
UNION ALL
SELECT facet, label, 'oscars', CAST(osc AS BIGINT) FROM g WHERE facet <> 'genre' AND n_osc > 0 AND {_EXCL}
UNION ALL
SELECT facet, label, 'otherAwards', CAST(aw AS BIGINT) FROM g WHERE facet <> 'genre' AND n_aw > 0 AND {_EXCL}""")

SQL["distribution_count"] = with_profile("""
SELECT genre AS label, count(*) AS n FROM profile WHERE genre IS NOT NULL GROUP BY genre""")

SQL["distribution_sum"] = with_profile("""
SELECT continent AS label, CAST(sum(otherAwards) AS BIGINT) AS n FROM profile
WHERE continent IS NOT NULL AND continent NOT IN ('', 'Other')
  AND otherAwards IS NOT NULL AND otherAwards <> 0
GROUP BY continent""")

SQL["decade_counts"] = with_profile("""
, rng AS (SELECT min(year) AS ymin, max(year) AS ymax FROM profile WHERE year IS NOT NULL),
dom AS (SELECT unnest(range(CAST(floor((ymin - 1) / 10) AS BIGINT), CAST(floor((ymax - 1) / 10) AS BIGINT) + 1)) AS decade,
               ymax FROM rng),
cnt AS (SELECT CAST(floor((year - 1) / 10) AS BIGINT) AS decade, count(*) AS n FROM profile
        WHERE continent = 'ASIA' AND year IS NOT NULL GROUP BY 1)
SELECT dom.decade,
  CAST(dom.decade * 10 + 1 AS VARCHAR) || '–' ||
  CAST(CASE WHEN dom.decade = CAST(floor((ymax - 1) / 10) AS BIGINT) THEN CAST(ymax AS BIGINT)
            ELSE dom.decade * 10 + 10 END AS VARCHAR) AS label,
  CAST(COALESCE(cnt.n, 0) AS BIGINT) AS n
FROM dom LEFT JOIN cnt ON dom.decade = cnt.decade""")


def hist_sql(source: str, col: str, edges, dash: str = "–") -> str:
    nb = len(edges) - 1
    rows = []
    for i in range(nb):
        if i == 0:
            lbl = f"<{edges[1]:.1f}"
        elif i == nb - 1:
            lbl = f"{edges[i]:.1f}+"
        else:
            lbl = f"{edges[i]:.1f}{dash}{edges[i + 1]:.1f}"
        rows.append(f"({i}, '{lbl}', {edges[i]!r}::DOUBLE, {edges[i + 1]!r}::DOUBLE)")
    return (f"SELECT b.bin, b.label, b.lo, b.hi, "
            f"(SELECT count(*) FROM {source} s WHERE s.{col} >= b.lo AND s.{col} < b.hi) AS n "
            f"FROM (VALUES {', '.join(rows)}) b(bin, label, lo, hi)")


SQL["histogram_ml"] = with_profile(hist_sql("profile", "ratingMl", [0.0, 3.5, 4.0, 4.5, 99.0]))
SQL["histogram_imdb"] = with_profile(hist_sql("profile", "rating", [0.0, 7.0, 7.5, 8.0, 99.0], "-"))
SQL["histogram_events"] = hist_sql("events", "value", [0.0, 1.0, 10.0, 100.0, 1000.0])


def breakdown_sql(source: str, col: str, domain) -> str:
    vals = ", ".join(f"({i}, '{v}')" for i, v in enumerate(domain))
    return (f"SELECT d.pos, d.label, CAST(COALESCE(c.n, 0) AS BIGINT) AS n, "
            f"CAST(floor(CAST(COALESCE(c.n, 0) AS DOUBLE) / CAST(greatest(1, (SELECT count(*) FROM {source})) AS DOUBLE)"
            f" * 100.0 + 0.5) AS BIGINT) AS share "
            f"FROM (VALUES {vals}) d(pos, label) "
            f"LEFT JOIN (SELECT {col} AS label, count(*) AS n FROM {source} GROUP BY 1) c ON c.label = d.label")


SQL["breakdown_race"] = with_profile(breakdown_sql(
    "profile", "dir_race", ["WHITE", "ASIAN", "BLACK", "INDIGENOUS", "MIXED-RACE", "UNKNOWN"]))
SQL["breakdown_gender"] = with_profile(breakdown_sql("profile", "wri_gender", ["Male", "Female", "Unknown"]))
SQL["breakdown_segment"] = breakdown_sql("customer", "c_mktsegment",
                                         ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", ""])

BANDS = [("> 60", 61, 999), ("51 a 60", 51, 60), ("41 a 50", 41, 50), ("31 a 40", 31, 40),
         ("21 a 30", 21, 30), ("ate 20", 0, 20)]


def pyramid_sql(role: str) -> str:
    vals = ", ".join(f"({i}, '{b}', {lo}, {hi})" for i, (b, lo, hi) in enumerate(BANDS))
    cnt = (lambda g: f"(SELECT count(*) FROM profile WHERE {role}_age IS NOT NULL AND {role}_age >= b.lo "
                     f"AND {role}_age <= b.hi AND {role}_gender = '{g}')")
    return with_profile(f"SELECT b.pos, b.band, b.lo, b.hi, {cnt('Male')} AS male, {cnt('Female')} AS female "
                        f"FROM (VALUES {vals}) b(pos, band, lo, hi)")


SQL["age_pyramid_dir"] = pyramid_sql("dir")
SQL["age_pyramid_wri"] = pyramid_sql("wri")

SQL["country_rollup_best"] = with_profile(f"""
SELECT country, count(*) AS films, CAST(sum(votesMl) AS BIGINT) AS votes_ml,
  first(title ORDER BY rating DESC, title ASC, imdbid ASC) AS top_title,
  {mean_fixed(f"sum({t10('rating')})", "count(*)")} AS mean_rating,
  CAST(sum(CAST(box AS DECIMAL(20, 2))) AS DOUBLE) AS box
FROM profile GROUP BY country""")


def people_country_sql(role: str, name: str) -> str:
    return f"""
, pr AS (SELECT COALESCE(NULLIF({role}_country, ''), country) AS country, COALESCE({name}, '') AS name FROM profile),
pairs AS (SELECT country, name, count(*) AS n FROM pr GROUP BY country, name),
pc AS (
  SELECT country, CAST(sum(n) AS BIGINT) AS count,
    COALESCE(first(name ORDER BY n DESC, name ASC) FILTER (WHERE name <> ''), '—') AS top_name
  FROM pairs GROUP BY country)"""


SQL["top_entity_per_group"] = with_profile(people_country_sql("dir", "director") + "\nSELECT * FROM pc")
SQL["top15_writer_countries"] = with_profile(
    people_country_sql("wri", "wri_name") + "\nSELECT * FROM pc ORDER BY count DESC, country ASC LIMIT 15")


def people_sql(role: str) -> str:
    name, pid = ("director", "directorid") if role == "dir" else ("wri_name", "wri_id")
    o = "ORDER BY title, imdbid"
    return f"""
, people AS (
  SELECT first({name} {o}) AS name, first({pid} {o}) AS id, first({role}_gender {o}) AS gender,
    first({role}_country {o}) AS nationality, first({role}_race {o}) AS race,
    CAST(first(year - {role}_age {o}) FILTER (WHERE {role}_age IS NOT NULL AND year IS NOT NULL) AS BIGINT) AS birthYear,
    count(*) AS count, CAST(sum(votesImdb) AS BIGINT) AS votesImdb, CAST(sum(votesMl) AS BIGINT) AS votesMl,
    {mean_half(f"sum({t10('rating')})", "count(*)")} AS ratingImdb,
    {mean_half(f"sum(COALESCE({t10('ratingMl')}, 0))", "count(*)")} AS ratingMl,
    CAST(sum(oscars) AS BIGINT) AS oscars, CAST(sum(otherAwards) AS BIGINT) AS otherAwards
  FROM profile WHERE {name} IS NOT NULL AND {name} <> '' GROUP BY {name})"""


SQL["people_table_dir"] = with_profile(people_sql("dir") + "\nSELECT * FROM people")
SQL["people_table_wri"] = with_profile(people_sql("wri") + "\nSELECT * FROM people")

SQL["map_metric"] = with_profile("""
, bc AS (SELECT country, count(*) AS value FROM profile GROUP BY country),
mx AS (SELECT max(value) AS m FROM bc)
SELECT bc.country, bc.value,
  sqrt(CAST(bc.value AS DOUBLE) / CAST(CASE WHEN mx.m IS NULL OR mx.m = 0 THEN 1 ELSE mx.m END AS DOUBLE)) AS intensity,
  n.n_nationkey AS code
FROM bc CROSS JOIN mx JOIN nation n ON n.n_name = bc.country""")

SQL["share_of_max"] = with_profile("""
, d AS (SELECT genre AS label, count(*) AS n FROM profile WHERE genre IS NOT NULL GROUP BY genre)
SELECT label, n, CAST(n AS DOUBLE) / greatest(1.0, CAST((SELECT max(n) FROM d) AS DOUBLE)) AS share_of_max FROM d""")

SQL["facet_values"] = with_profile("""
SELECT DISTINCT 'years' AS facet, CAST(year AS VARCHAR) AS value FROM profile WHERE year IS NOT NULL
UNION SELECT 'mlGenres', mlGenre FROM profile WHERE mlGenre IS NOT NULL AND mlGenre <> ''
UNION SELECT 'imdbGenres', imdbGenre FROM profile WHERE imdbGenre IS NOT NULL AND imdbGenre <> ''
UNION SELECT 'continents', continent FROM profile WHERE continent IS NOT NULL AND continent NOT IN ('', 'Other')
UNION SELECT 'regions', region FROM profile WHERE region IS NOT NULL AND region <> ''
UNION SELECT 'countries', country FROM profile WHERE country IS NOT NULL AND country NOT IN ('', 'Unknown')""")

def page_sql(source: str, cols: str, order: str, page_no: int, size: int = 50) -> str:
    return f"\nSELECT {cols} FROM {source} ORDER BY {order} LIMIT {size} OFFSET {page_no * size}"


SQL["page_sorted"] = with_profile(page_sql(
    "profile", "imdbid, title, rating, year", "rating DESC NULLS LAST, imdbid ASC", 3))

SQL["page_people"] = with_profile(people_sql("wri") + "\n" + page_sql(
    "people", "name, id, birthYear, count", "birthYear ASC NULLS LAST, name ASC NULLS LAST, id ASC NULLS LAST", 1))

SQL["page_info"] = with_profile("""
, c AS (SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 50)) AS BIGINT) AS pages FROM profile)
SELECT CAST(least(10000, pages - 1) AS BIGINT) AS page,
  CAST(CASE WHEN total > 0 THEN least(10000, pages - 1) * 50 + 1 ELSE 0 END AS BIGINT) AS "from",
  CAST(least(least(10000, pages - 1) * 50 + 50, total) AS BIGINT) AS "to",
  CAST(total AS BIGINT) AS total, pages FROM c""")


def title_case_sql(x: str) -> str:
    step = ("lambda acc, ch: {'o': acc.o || CASE WHEN acc.p AND NOT regexp_matches(ch, '^\\s$') "
            "THEN replace(upper(ch), 'ẞ', 'SS') ELSE ch END, 'p': CASE WHEN acc.p AND NOT regexp_matches(ch, '^\\s$') "
            "THEN false ELSE regexp_matches(ch, '^[\\s\\-/]$') END}")
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} = '' THEN '' ELSE "
            f"list_reduce(string_split(lower({x}), ''), {step}, {{'o': '', 'p': true}}).o END)")


GAZ = [
    ("the", "Country", "main", 1), ("of", "City", "main", 2), ("de", "State", "main", 3),
    ("and", "Region", "main", 4), ("la", "City", "main", 2), ("der", "Country", "main", 1),
    ("le", "State", "main", 3), ("que", "Region", "main", 4), ("en", "City", "main", 2),
    ("die", "State", "main", 3), ("und", "Country", "main", 1), ("des", "City", "main", 2),
    ("el", "Country", "main", 1), ("ou", "Region", "main", 4), ("in", "Country", "main", 1),
    ("in", "City", "main", 2), ("to", "City", "main", 2), ("to", "State", "main", 3),
    ("on", "Country", "main", 1), ("on", "Region", "main", 4), ("ere", "Region", "main", 4),
    ("one", "City", "main", 2), ("wa", "State", "main", 3), ("lo", "Country", "main", 1),
    ("a", "City", "alias", 1), ("it", "Country", "alias", 1), ("the", "Region", "alias", 1),
    ("an", "State", "alias", 1), ("ci", "City", "alias", 1),
]
_gaz_values = ", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in GAZ)

TEXT = CONFORMED + f""",
geo AS (SELECT doc_id AS IMDB, unnest(regexp_extract_all(text, '\\p{{L}}+')) AS LOCATION, 1 AS COUNT FROM documents),
th AS (SELECT doc_id AS IMDB, upper(lang) AS IDIOM, source AS THEME,
              unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS WORD, 1 AS COUNT FROM documents),
br AS (SELECT doc_id AS IMDBID, doc_id AS MOVIEID FROM labels
       UNION ALL SELECT doc_id, doc_id FROM labels WHERE toxic = 1),
linked AS (
  SELECT br.IMDBID AS IMDB, t.IMDBID AS imdbid, t.TITLE AS title,
         (SELECT min(cb.COUNTRY) FROM cb WHERE cb.IMDBID = t.IMDBID) AS home
  FROM br JOIN t ON t.MOVIEID = br.MOVIEID WHERE t.TYPE = 'movie' AND t.RESPONSE = 'true'),
gaz AS (SELECT * FROM (VALUES {_gaz_values}) g(name, loc_type, source, priority)),
gz AS (SELECT source, lower({strip('name')}) AS key,
              first(loc_type ORDER BY priority DESC, loc_type DESC) AS loc_type
       FROM gaz GROUP BY source, lower({strip('name')})),
located AS (
  SELECT g.LOCATION AS location, g.mentions, linked.imdbid, linked.title,
         COALESCE(NULLIF(linked.home, ''), 'Unknown') AS country
  FROM (SELECT IMDB, LOCATION, CAST(count(*) AS BIGINT) AS mentions FROM geo GROUP BY ALL) g
  JOIN linked USING (IMDB) WHERE g.mentions >= 2),
cls AS (
  SELECT n.name, n.key, COALESCE(a.loc_type, m1.loc_type, m2.loc_type, 'Other') AS locType,
         {title_case_sql('n.name')} AS label
  FROM (SELECT name, lower({strip('name')}) AS key,
               {strip(f"regexp_replace(lower({strip('name')}), '[''s]+$', '')")} AS sk
        FROM (SELECT DISTINCT LOCATION AS name FROM geo WHERE LOCATION IS NOT NULL)) n
  LEFT JOIN gz a ON a.source = 'alias' AND a.key = n.key
  LEFT JOIN gz m1 ON m1.source = 'main' AND m1.key = n.key
  LEFT JOIN gz m2 ON m2.source = 'main' AND m2.key = n.sk),
tm AS (
  SELECT located.location, cls.locType, cls.label, located.mentions, located.imdbid, located.title, located.country
  FROM located LEFT JOIN cls ON cls.name = located.location),
themed AS (
  SELECT th.IDIOM AS idiom, th.THEME AS theme, th.WORD AS word, linked.imdbid, linked.title, linked.home,
         CAST(count(*) AS BIGINT) AS mentions
  FROM th JOIN linked USING (IMDB) GROUP BY ALL),
tbase AS (SELECT idiom, theme, word, mentions, imdbid, title, COALESCE(home, 'Unknown') AS country
          FROM themed WHERE mentions >= 3),
topt AS (SELECT idiom, theme, word FROM themed WHERE idiom IS NOT NULL
         GROUP BY idiom, theme, word HAVING sum(mentions) >= 3)"""


def with_text(select_sql: str) -> str:
    return "WITH " + TEXT + "\n" + select_sql


PROFILE_TAIL = PROFILE[len(CONFORMED):]
TEXT_TAIL = TEXT[len(CONFORMED):]


def with_text_profile(select_sql: str) -> str:
    return "WITH " + CONFORMED + PROFILE_TAIL + TEXT_TAIL + "\n" + select_sql


SQL["token_mentions"] = with_text("SELECT * FROM tm")
SQL["classify_tokens"] = with_text("SELECT name, key, locType, label FROM cls")
SQL["mentions_by_country"] = with_text(
    "SELECT COALESCE(NULLIF(country, ''), 'Unknown') AS country, CAST(sum(mentions) AS BIGINT) AS mentions "
    "FROM tm GROUP BY 1")
SQL["theme_page"] = with_text("""
SELECT * FROM tbase ORDER BY mentions DESC NULLS LAST, idiom, theme, word, imdbid, title, country
LIMIT 50 OFFSET 50""")
SQL["theme_total"] = with_text("SELECT count(*) AS total FROM tbase")
SQL["theme_ids"] = with_text("SELECT DISTINCT imdbid FROM tbase")
SQL["theme_by_country"] = with_text(
    "SELECT country, CAST(sum(mentions) AS BIGINT) AS mentions FROM tbase GROUP BY country")
SQL["theme_top15"] = with_text(
    "SELECT theme, count(DISTINCT imdbid) AS n FROM tbase GROUP BY theme ORDER BY n DESC, theme LIMIT 15")
SQL["theme_options"] = with_text("SELECT * FROM topt")
SQL["theme_option_tree"] = with_text("""
, pt AS (SELECT idiom, theme, string_agg(DISTINCT word, ' ' ORDER BY word) AS words FROM topt GROUP BY idiom, theme),
pi AS (SELECT idiom, string_agg(theme, ' ' ORDER BY theme) AS themes FROM pt GROUP BY idiom)
SELECT pt.idiom, pi.themes, pt.theme, pt.words FROM pt JOIN pi ON pi.idiom = pt.idiom""")

_LOC_TABLE = ("((locType = 'Country' AND contains(lower(location), 'the')) OR "
              "(locType = 'City' AND contains(lower(location), 'o')))")
_LOC_TITLES = ("((locType = 'State' AND contains(lower(location), 'de')) OR "
               "(locType = 'Region' AND contains(lower(location), 'and')))")

SQL["mention_table"] = with_text_profile(f"""
SELECT tm.imdbid, COALESCE(p.title, tm.title) AS title,
  COALESCE(COALESCE(NULLIF(p.countriesAll, ''), p.country), COALESCE(NULLIF(tm.country, ''), 'Unknown')) AS countries,
  tm.label AS location, COALESCE(tm.locType, 'Other') AS locType, tm.mentions
FROM tm JOIN profile p ON p.imdbid = tm.imdbid
WHERE {_LOC_TABLE}""")

SQL["location_options"] = with_text_profile("""
SELECT DISTINCT locType, label AS location FROM tm WHERE imdbid IN (SELECT imdbid FROM profile)""")

SQL["titles_by_country"] = with_text_profile(f"""
, fr AS (SELECT * FROM tm WHERE imdbid IN (SELECT imdbid FROM profile) AND {_LOC_TITLES}),
per AS (SELECT COALESCE(p.country, COALESCE(NULLIF(fr.country, ''), 'Unknown')) AS country, fr.imdbid
        FROM fr LEFT JOIN profile p ON p.imdbid = fr.imdbid)
SELECT country, count(DISTINCT imdbid) AS n FROM per GROUP BY country ORDER BY n DESC, country LIMIT 15""")

SQL["semi_join_mentions"] = with_text_profile(f"""
SELECT imdbid, title, country FROM profile
WHERE imdbid IN (SELECT imdbid FROM tm WHERE {_LOC_TITLES})""")

SQL["primary_row_per_key"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber NULLS LAST, l_partkey NULLS LAST,
    l_suppkey NULLS LAST, l_quantity NULLS LAST, l_extendedprice NULLS LAST, l_discount NULLS LAST,
    l_tax NULLS LAST, l_returnflag NULLS LAST, l_linestatus NULLS LAST) AS rn FROM lineitem)
WHERE rn = 1"""

SQL["delimited_list"] = """
SELECT l_orderkey, string_agg(p_type, ', ' ORDER BY p_type) AS types
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IS NOT NULL GROUP BY l_orderkey"""

SQL["fallback_lookup"] = """
WITH c AS (
  SELECT c_custkey,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'N' || CAST(c_nationkey AS VARCHAR) END AS iso,
    CASE WHEN c_custkey % 7 = 0 THEN lower('NATION_' || CAST(c_nationkey AS VARCHAR))
         ELSE 'NATION_' || CAST(c_nationkey AS VARCHAR) END AS cname FROM customer),
d AS (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS iso, n_name AS cname, n_regionkey FROM nation)
SELECT c.c_custkey, COALESCE(di.cname, dn.cname) AS dim_cname,
       COALESCE(di.n_regionkey, dn.n_regionkey) AS dim_n_regionkey, di.cname AS dim_cname_by_key
FROM c LEFT JOIN d di ON di.iso = c.iso
LEFT JOIN d dn ON dn.cname = c.cname AND di.iso IS NULL"""

SQL["value_distribution"] = """
SELECT round(l_discount * 100.0) / 2.0 AS rating, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS votes
FROM lineitem GROUP BY 1"""

_PART_TEXTS = """
pt AS (
  SELECT p_partkey,
    CASE WHEN p_partkey % 13 = 0 THEN 'N/A'
         WHEN p_partkey % 17 = 0 THEN CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 10 AS VARCHAR) || 'd'
         WHEN p_partkey % 19 = 0 THEN ''
         WHEN p_partkey % 23 = 0 THEN 'nan'
         WHEN p_partkey % 29 = 0 THEN ' ' || CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 10 AS VARCHAR) || ' '
         ELSE CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 10 AS VARCHAR) END AS rating_txt,
    CASE WHEN p_partkey % 11 = 0 THEN 'N/A'
         ELSE CAST(p_size AS VARCHAR) || ',' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') END AS votes_txt,
    CASE WHEN p_partkey % 7 = 0 THEN '$0' WHEN p_partkey % 9 = 0 THEN ''
         ELSE '$' || CAST(p_partkey * 12347 AS VARCHAR) END AS box_txt,
    CASE p_partkey % 4 WHEN 0 THEN 'MALE' WHEN 1 THEN 'female' WHEN 2 THEN '' ELSE 'other' END AS gender_txt,
    CASE WHEN p_partkey % 5 = 0 THEN 'undefined' WHEN p_partkey % 5 = 1 THEN NULL ELSE lower(p_type) END AS race_txt
  FROM part)"""

SQL["clean_numbers"] = f"""
WITH {_PART_TEXTS}
SELECT p_partkey,
  {rx(f"CASE WHEN regexp_matches(rating_txt, '{NUM_RE}') THEN TRY_CAST(trim(rating_txt) AS DOUBLE) END")} AS rating,
  {digits('votes_txt')} AS votes,
  {rx(f"{digits('box_txt')} / 1000000.0", 2)} AS box,
  {gender('gender_txt')} AS gender,
  {race('race_txt')} AS race
FROM pt"""

SQL["clean_labels"] = f"""
WITH r AS (
  SELECT p_partkey,
    CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) || '-' || lower(p_type) || '/' || p_brand
         WHEN p_partkey % 3 = 1 THEN ' ' || p_name || '--' || p_type || ' /x'
         ELSE p_name || '''S ' || p_brand END AS raw
  FROM part)
SELECT p_partkey, raw, {title_case_sql('raw')} AS label FROM r"""

_X = "(p_retailprice / 2.0)"
SQL["round_exact"] = f"""
SELECT p_partkey, {rx(_X, 1)} AS rx1, floor({_X} * 10.0 + 0.5) / 10.0 AS rh1,
  CASE WHEN abs({_X}) * 4.0 = floor(abs({_X}) * 4.0) THEN sign({_X}) * floor(abs({_X}) * 10.0 + 0.5) / 10.0
       ELSE {rx(_X, 1)} END AS tf1,
  {rx("(p_retailprice / 8.0)", 2)} AS rx2
FROM part"""

SQL["ingest_normalise"] = """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey,
       CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) AS o_totalprice,
       CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus
FROM orders"""

SQL["theme_filter_titles"] = with_text_profile("""
SELECT imdbid, title, genre FROM profile
WHERE imdbid IN (SELECT imdbid FROM tbase WHERE idiom = 'EN' AND word = 'the')""")

_LOCATION_TABLE = f"""
, mt AS (
  SELECT tm.imdbid, COALESCE(p.title, tm.title) AS title,
    COALESCE(COALESCE(NULLIF(p.countriesAll, ''), p.country), COALESCE(NULLIF(tm.country, ''), 'Unknown')) AS countries,
    tm.label AS location, COALESCE(tm.locType, 'Other') AS locType, tm.mentions
  FROM tm JOIN profile p ON p.imdbid = tm.imdbid
  WHERE {_LOC_TABLE})
"""
_LOCATION_COLS = "imdbid, title, countries, location, locType, mentions"
SQL["location_page"] = with_text_profile(_LOCATION_TABLE + page_sql(
    "mt", _LOCATION_COLS, "location ASC NULLS LAST, imdbid, mentions, title, countries, locType", 2))
SQL["location_page_title"] = with_text_profile(_LOCATION_TABLE + page_sql(
    "mt", _LOCATION_COLS, "title DESC NULLS FIRST, imdbid, location, mentions, countries, locType", 1))

SQL["people_table_by_id"] = with_profile(f"""
, pid AS (
  SELECT first(director ORDER BY title, imdbid) AS name, directorid AS id,
    first(dir_gender ORDER BY title, imdbid) AS gender,
    first(dir_country ORDER BY title, imdbid) AS nationality, first(dir_race ORDER BY title, imdbid) AS race,
    CAST(first(year - dir_age ORDER BY title, imdbid) FILTER (WHERE dir_age IS NOT NULL AND year IS NOT NULL) AS BIGINT) AS birthYear,
    count(*) AS count, CAST(sum(votesImdb) AS BIGINT) AS votesImdb, CAST(sum(votesMl) AS BIGINT) AS votesMl,
    {mean_half(f"sum({t10('rating')})", "count(*)")} AS ratingImdb,
    {mean_half(f"sum(COALESCE({t10('ratingMl')}, 0))", "count(*)")} AS ratingMl,
    CAST(sum(oscars) AS BIGINT) AS oscars, CAST(sum(otherAwards) AS BIGINT) AS otherAwards
  FROM profile WHERE director IS NOT NULL AND director <> '' GROUP BY directorid)
SELECT * FROM pid""")


SQL["profile_by_title"] = with_profile("SELECT * FROM profile ORDER BY title NULLS LAST")
SQL["profile_ordered"] = SQL["profile_by_title"]
SQL["token_mentions_top"] = with_text("""
, top AS (SELECT * FROM located ORDER BY mentions DESC, imdbid, location LIMIT 200)
SELECT top.location, cls.locType, cls.label, top.mentions, top.imdbid, top.title, top.country
FROM top LEFT JOIN cls ON cls.name = top.location""")
SQL["facet_values_years"] = with_profile(
    "SELECT DISTINCT CAST(year AS BIGINT) AS value FROM profile WHERE year IS NOT NULL ORDER BY value")
SQL["facet_values_fallback"] = "SELECT DISTINCT r_name AS value FROM region WHERE r_name IS NOT NULL ORDER BY value"
SQL["registered_views"] = """
SELECT (SELECT r_name FROM region WHERE r_regionkey = k) AS r_name, count(*) AS orders,
  count(DISTINCT o_custkey) AS customers, count(DISTINCT c_nationkey) AS nations
FROM (SELECT o_custkey, c_nationkey, (SELECT n_regionkey FROM nation WHERE n_nationkey = c_nationkey) AS k
      FROM orders, customer WHERE c_custkey = o_custkey) WHERE k IS NOT NULL GROUP BY k"""
SQL["ingest_declared"] = f"WITH {_PART_TEXTS}\nSELECT p_partkey, p_partkey AS key_txt, rating_txt FROM pt"
_THEME_KEYS = ("idiom", "theme", "word", "imdbid", "title", "country", "mentions")
for _sort, _dir in [(s, d) for s in ("title", "idiom", "theme", "word", "mentions") for d in ("asc", "desc")]:
    _ties = ", ".join(c for c in _THEME_KEYS if c != _sort)
    SQL[f"theme_page_{_sort}_{_dir}"] = with_text(
        f"SELECT * FROM tbase ORDER BY {_sort} {_dir.upper()} NULLS LAST, {_ties} LIMIT 50")
del SQL["theme_page_mentions_desc"]


# --- stored tables and indexes ---------------------------------------------------------
SQL["profile_stored"] = SQL["order_profile"]
SQL["mention_table_stored"] = SQL["mention_table"]
_ALL_MENTIONS = """, mt AS (
  SELECT tm.imdbid, p.title, COALESCE(NULLIF(p.countriesAll, ''), p.country) AS countries,
    tm.label AS location, COALESCE(tm.locType, 'Other') AS locType, tm.mentions
  FROM tm JOIN profile p ON p.imdbid = tm.imdbid),
pages AS (SELECT greatest(1, (count(*) + 49) // 50) AS n FROM mt)
"""
for _name, _page in (("page_deep", "n * 9 // 10"), ("page_last", "n - 1")):
    SQL[_name] = with_text_profile(_ALL_MENTIONS + f"""
SELECT {_LOCATION_COLS} FROM mt ORDER BY location DESC NULLS FIRST, imdbid, mentions, title, countries, locType
LIMIT 50 OFFSET (SELECT 50 * ({_page}) FROM pages)""")
_CHOSEN = """FROM profile WHERE continent IN ('ASIA', 'EUROPE', 'AMERICA') AND dir_gender IN ('Male', 'Female')
  AND year IN (1996, 1997, 1998, 2000)"""
_FACET_COLUMNS = {
    "mlGenres": "mlGenre", "imdbGenres": "imdbGenre", "years": "year", "continents": "continent", "regions": "region",
    "countries": "country", "dirGenders": "dir_gender", "dirRaces": "dir_race", "dirRegions": "dir_region",
    "dirCountries": "dir_country", "wriGenders": "wri_gender", "wriRaces": "wri_race", "wriRegions": "wri_region",
    "wriCountries": "wri_country"}
SQL["facet_counts_bitmap"] = with_profile("\nUNION ALL\n".join(
    f"SELECT '{f}' AS facet, CAST({c} AS VARCHAR) AS value, count(*) AS n {_CHOSEN} GROUP BY {c}"
    for f, c in _FACET_COLUMNS.items()))
SQL["facet_rows_bitmap"] = with_profile(f"SELECT count(*) AS rows {_CHOSEN}")
SQL["search_titles_indexed"] = SQL["facet_filter"]
SQL["search_places_indexed"] = SQL["semi_join_mentions"]
_REQUESTS = [("title", " High "), ("title", "order 12"), ("director", "cust 1"), ("writer", "zz"), ("title", "w "),
             ("place Other", "the"), ("place City", "o"), ("title", "no such title")]


def _request_sql(field: str, needle: str) -> str:
    q = needle.strip().lower()
    grams = [q[i:i + 3] for i in range(len(q) - 2)] or [""]
    every = " AND ".join(f"contains(text, '{g}')" for g in grams)
    return (f"SELECT '{field}' AS field, '{needle}' AS needle, count(*) AS texts, "
            f"count(*) FILTER ({every}) AS texts_read, count(*) FILTER (contains(text, '{q}')) AS texts_found "
            f"FROM texts WHERE field = '{field}'")


SQL["search_cost"] = with_text_profile(""", texts AS (
  SELECT DISTINCT 'title' AS field, lower(title) AS text FROM profile WHERE title IS NOT NULL
  UNION ALL SELECT DISTINCT 'director', lower(director) FROM profile WHERE director IS NOT NULL
  UNION ALL SELECT DISTINCT 'writer', lower(wri_name) FROM profile WHERE wri_name IS NOT NULL
  UNION ALL SELECT DISTINCT 'place ' || locType, lower(location) FROM tm WHERE location IS NOT NULL)
""" + "\nUNION ALL\n".join(_request_sql(f, n) for f, n in _REQUESTS))

SQL["top_words_certified"] = """
WITH w AS (SELECT upper(lang) AS idiom, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents),
c AS (SELECT idiom, word, count(*) AS n FROM w GROUP BY ALL)
SELECT idiom, row_number() OVER (PARTITION BY idiom ORDER BY n DESC, word) AS rank, word, n FROM c QUALIFY rank <= 15"""
SQL["top_directors_certified"] = with_profile("""
SELECT country, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, director) AS rank, director, count(*) AS n
FROM profile WHERE director <> '' GROUP BY country, director QUALIFY rank <= 3""")
# Estimates are exact below 4 096 titles a cell, which these tables do not reach.
_THEME_TITLES = """, tt AS (SELECT DISTINCT tbase.imdbid, tbase.theme, tbase.country, CAST(p.year AS BIGINT) AS year,
  p.dir_gender AS gender FROM tbase JOIN profile p ON p.imdbid = tbase.imdbid)
"""
for _name, _by in (("theme_titles_sketched", "theme, decade"), ("country_titles_sketched", "country"),
                   ("theme_directors_sketched", "theme, gender, year")):
    SQL[_name] = with_text_profile(_THEME_TITLES + f"""
SELECT {_by}, count(DISTINCT imdbid) AS titles, count(DISTINCT imdbid) AS estimate, true AS within_error
FROM (SELECT *, CAST(floor((year - 1) / 10) AS BIGINT) AS decade FROM tt) GROUP BY {_by}""")
SQL["theme_option_chunks"] = with_text("""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY idiom, theme ORDER BY word) - 1 AS r FROM topt)
SELECT idiom, theme, r // 100 AS chunk, min(r) AS first, string_agg(word, ' ' ORDER BY word) AS words
FROM ranked GROUP BY idiom, theme, r // 100""")
SQL["theme_option_sizes"] = with_text(
    "SELECT idiom, theme, count(*) AS words, CAST(ceil(count(*) / 100) AS BIGINT) AS chunks FROM topt GROUP BY idiom, theme")


def _stat_sql(source: str, table: str, column: str, kind: str = "") -> str:
    form = {"": "CAST({0}({1}) AS VARCHAR)", "fraction": "CAST(CAST(round({0}({1}), 4) AS DECIMAL(38,4)) AS VARCHAR)",
            "time": "strftime({0}({1}), '%Y-%m-%d %H:%M:%S')"}[kind]
    return (f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", count(*) AS rows, count(*) - count({column}) AS nulls, "
            f"{form.format('min', column)} AS min, {form.format('max', column)} AS max, CAST(NULL AS VARCHAR) AS error FROM {source}")


_EXPORT_COLUMNS = {
    "region": {"r_regionkey": "", "r_name": ""}, "nation": {"n_nationkey": "", "n_name": "", "n_regionkey": ""},
    "customer": {"c_custkey": "", "c_name": "", "c_nationkey": "", "c_acctbal": "fraction", "c_mktsegment": ""},
    "orders": {"o_orderkey": "", "o_custkey": "", "o_orderstatus": "", "o_totalprice": "fraction", "o_orderdate": "time",
               "o_orderpriority": ""}}
SQL["export_roundtrip"] = f"WITH {_PART_TEXTS}\n" + "\nUNION ALL\n".join(
    [_stat_sql(t, t, c, k) for t, cols in _EXPORT_COLUMNS.items() for c, k in cols.items()]
    + [_stat_sql("(SELECT *, p_partkey AS key_txt FROM pt)", "part_texts", c) for c in ("p_partkey", "key_txt", "rating_txt")]
    + ["SELECT 'no_such_table', NULL, 0, 0, NULL, NULL, 'AnalysisException'"])
SQL["read_slices"] = """
SELECT count(*) AS rows, count(*) AS rows_in_one_slice, CAST(count(*) AS BIGINT) AS rows_read,
  CAST(count(*) FILTER (l_orderkey % 3 <> 0 AND l_orderkey % 11 = 0) AS BIGINT) AS null_rows, true AS within_twice_the_mean
FROM lineitem"""
