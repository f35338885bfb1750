import pytest

# One table for the edge cases every operator must take: nulls in any column, empty and very
# long texts, ties and repeated rows, and columns whose names operators use themselves.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "part int, bucket int, id long, score double, rank int, size long, kept boolean")


def edge_rows():
    long_text = " ".join(f"word{i % 977} tail{i % 31}," for i in range(60_000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today again", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today again", "en", "b"),
        (2, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today again", "en", "b"),
        (3, None, "en", "a"), (4, "", "fr", None), (5, " \t\n\x0b\f\r ", None, "c"), (6, None, None, None),
        (None, "a text without an id that has several words in it", "en", "a"), (None, None, None, None),
        (7, long_text, "en", "a"), (8, "12345 67890 !!! ???", "de", "c"), (9, "ÀÉÎ õü ß 漢字 🙂 <|endoftext|> <s>", "fr", "b"),
        (10, passage, "en", "a"), (20, "start " + passage + " end", "en", "b"), (40, passage + " " + passage, "en", "c"),
        (60, "Released under the MIT License.\nnothing else here", "en", "a"),
        (80, "word " * 50, "en", "a"), (100, "x", "en", "z"), (120, "x", "en", "z"),
    ]
    return [(*r, len(r[1]) if r[1] else None, 1, 2, 3, 0.5, 4, 5, False) for r in rows]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
