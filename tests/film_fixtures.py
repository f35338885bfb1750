"""Hand-made film tables (the catalogue's own schema) covering the edge rows
listed in FIXTURES.md, set B."""

from __future__ import annotations

AW = ("OSCAR_WINNING double, OSCAR_NOMINATION double, AWARD_WINNING double, AWARD_NOMINATION double, "
      "BAFTA_WINNING double, BAFTA_NOMINATION double, EMMY_WINNING double, EMMY_NOMINATION double")

SCHEMAS = {
    "country": "ISO string, COUNTRY string, CONTINENT string, REGION string",
    "ml_imdb": "IMDBID string, MOVIEID long",
    "director": "DIRECTORID long, NAME string, GENDER string, GENDER_LLM string, RACE string, "
                "BIRTHYEAR double, NATIONALITY string",
    "writer": "WRITERID long, NAME string, GENDER string, RACE string, BIRTHYEAR double, NATIONALITY string",
    "movie_imdb": "IMDBID string, MOVIEID long, TITLE string, TYPE string, RESPONSE string, YEAR double, "
                  "IMDBRATING string, IMDBVOTES string, BOXOFFICE string, " + AW + ", GENRE string, COUNTRY string",
    "movie_country": "IMDBID string, ISO string, COUNTRY string",
    "movie_ml_genre": "MOVIEID long, GENRE string",
    "movie_imdb_genre": "IMDBID string, GENRE string",
    "movie_director": "IMDBID string, DIRECTORID long",
    "movie_writer": "IMDBID string, WRITERID long",
    "movie_rating": "MOVIEID long, RATING double, COUNT_RATING long",
    "subtitle_geo": "IMDB string, LOCATION string, COUNT long",
    "subtitle_theme": "IMDB string, IDIOM string, THEME string, WORD string, COUNT long",
}

N = None


def _movie(i, title, typ="movie", resp="true", year=2000.0, rating="7.0", votes="10", box="$1,000,000",
           awards=(N,) * 8, genre=None, country=None):
    return (f"tt{i:02d}", i, title, typ, resp, year, rating, votes, box, *awards, genre, country)


ROWS = {
    "country": [("FRA", "France", "Europe", "Western Europe"), ("ESP", "Spain", "Europe", "Southern Europe"),
                ("BRA", "Brazil", "Americas", "South America"), (N, "Narnia", "Fantasy", "Nowhere")],
    "ml_imdb": [("tt01", 1), ("tt02", 2), ("tt08", 8), ("tt10", 10)],
    "director": [(1, "Ann Lee", N, "female", N, 1980.0, "FRA"),
                 (2, "Bob Ray", "MALE", N, "undefined", 1940.0, "ESP"),
                 (3, "Ann Lee", "male", N, "white", N, "XXX")],
    "writer": [(1, "Cy Dee", "female", "asian", 1979.0, "FRA"),
               (2, "Di Eve", N, "", 1940.0, "BRA")],
    "movie_imdb": [
        _movie(1, "Alpha", rating="6.5", votes="1,234", box="$14,648,076", year=2000.0,
               awards=(5.0, 1.0, 3.0, 4.0, 1.0, 0.0, N, N), genre="Drama, Comedy", country="France"),
        _movie(2, "Beta", rating="6.9", votes="N/A", box="N/A", year=2001.0),
        _movie(3, "Gamma", rating="7.2", votes=N, box="$0", year=N, genre="Action, Drama",
               country="Spain, France"),
        _movie(4, "Delta", rating="8.0", box="", year=0.0),
        _movie(5, "Series", typ="series"),
        _movie(6, "NoResponse", resp="false"),
        _movie(7, "NoRating", rating=N),
        _movie(8, "NotAvailable", rating="N/A"),
        _movie(9, "Garbled", rating="abc"),
        _movie(10, "Epsilon", rating="7.0", year=1995.0),
    ],
    "movie_country": [("tt01", "FRA", "France"), ("tt01", "ESP", "Spain"), ("tt02", N, "France"),
                      ("tt10", "BRA", "Brazil"), ("tt08", "ESP", "Spain")],
    "movie_ml_genre": [(1, "Drama"), (1, "Comedy"), (10, "Drama")],
    "movie_imdb_genre": [("tt01", "Drama"), ("tt02", "Horror")],
    "movie_director": [("tt01", 1), ("tt01", 2), ("tt02", 3), ("tt03", 2), ("tt10", 2)],
    "movie_writer": [("tt01", 1), ("tt02", 2), ("tt10", 1)],
    "movie_rating": [(1, 4.0, 10), (1, 3.5, 5), (2, 4.5, 7), (99, 3.0, 100)],
    "subtitle_geo": [("tt01", "PARIS", 2), ("tt01", "Paris", 1), ("tt01", "Paris", 1),
                     ("tt01", "Georgia", 3), ("tt01", "LA", 2), ("tt01", "Chicago's", 2),
                     ("tt01", "Texas's", 2), ("tt01", "Xyz", 5), ("tt01", "Madrid", 1),
                     ("tt08", "Madrid", 4), ("tt02", "Holland", 2)],
    "subtitle_theme": [("tt01", "EN", "love", "heart", 2), ("tt02", "EN", "love", "heart", 2),
                       ("tt01", "EN", "love", "kiss", 3), ("tt08", "EN", "war", "gun", 5),
                       ("tt01", N, "love", "kiss", 9), ("tt10", "PT-BR", "love", "amor", 3)],
}


def film_frames(spark):
    return {n: spark.createDataFrame(ROWS[n], SCHEMAS[n]) for n in SCHEMAS}
