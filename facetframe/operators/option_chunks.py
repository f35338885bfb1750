"""Option tree in bounded chunks (D5): no row holds a theme's whole vocabulary.

The distinct options are range-sorted once (:mod:`page_index`), which numbers them; a word's rank
in its theme is its number less the theme's first. Ranks are dense, so chunk c of a theme holds
ranks ``c * size`` to ``(c + 1) * size - 1``: the chunk of any rank is known without a search, and a
theme with a third of all words is spread over as many rows as it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetframe.operators.page_index import ROW, PageIndex, build_page_index


def option_index(options: DataFrame, path: str, parts: int) -> PageIndex:
    """The (idiom, theme, word) options in order, stored at ``path``."""
    return build_page_index(options.select("idiom", "theme", "word"),
                            [F.col(c).asc_nulls_last() for c in ("idiom", "theme", "word")], path, parts)


def theme_chunks(index: PageIndex, size: int = 1000) -> DataFrame:
    """(idiom, theme, chunk, first, words): ``words`` sorted, at most ``size`` of them, ``first`` the rank of
    the first, from 0."""
    rows = index.numbered()
    starts = rows.groupBy(F.col("idiom").alias("i"), F.col("theme").alias("t")).agg(F.min(ROW).alias("start"))
    ranked = (rows.join(starts, rows["idiom"].eqNullSafe(starts["i"]) & rows["theme"].eqNullSafe(starts["t"]))
              .withColumn("rank", F.col(ROW) - F.col("start")))
    chunks = ranked.groupBy("idiom", "theme", F.floor(F.col("rank") / size).cast("long").alias("chunk")).agg(
        F.min("rank").alias("first"), F.sort_array(F.collect_list("word")).alias("words"))
    return chunks.select("idiom", "theme", "chunk", "first", "words")


def theme_sizes(index: PageIndex, size: int = 1000) -> DataFrame:
    """(idiom, theme, words, chunks): what a reader needs to ask for any chunk."""
    return index.rows().groupBy("idiom", "theme").agg(
        F.count("*").alias("words"), F.ceil(F.count("*") / size).cast("long").alias("chunks"))
