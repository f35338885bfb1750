"""Spelling variants: words one edit apart, found through a reduced alphabet.

1. The vocabulary: letter runs of whole texts, counted with map-side combine.
2. Letters are hashed to a few symbols. Equal words, and words one edit apart, have reduced words
   that are equal or one edit apart.
3. Each reduced word's one-edit neighbourhood is generated (every deletion, every replacement by
   another symbol, and the word itself) as 64-bit hashes and joined with the reduced vocabulary.
   Every pair is made from one end: an insertion is the longer word's deletion, and a
   replacement is made towards the smaller symbol. So the pairs are those of the full
   neighbourhoods, each once.
4. A pair is verified on the original strings; both directions are then aggregated per word.

Neighbours that no word has are dropped before the join by a bitmap over the reduced
vocabulary's hashes. The bitmap's size is a parameter (``filter_bits``: 2**27 bits, 16 MB), however
large the vocabulary; false hits cost rows, not results. The hash is a polynomial over the
symbols, so a word of L letters yields its neighbourhood in time proportional to L.

Forms: a word's form is its near word of largest count, if that is ``ratio`` times its own or
more. Counts grow by that factor along a chain of forms, so chains are short; roots follow them
round by round, only with the words not yet at their root.

Edge cases: null or empty text has no run; a null id counts as empty text in the planted noise;
ties go to the smaller word in code-point order; rows repeat their words; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetframe.llm.common import shared_table
from facetframe.llm.hashing import mix

# The letters of a run.
LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so that it has an inverse
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def noisy(run: Column, id_col: Column, every: int) -> Column:
    """The run, without one letter where ``every`` divides the checksum of id and run."""
    h = F.crc32(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7,
               min_count: int = 2, noise: int | None = None) -> DataFrame:
    """(word, n): runs of letters, ASCII capitals in lower case, of at least ``min_length`` code points
    and ``min_count`` occurrences. ``noise`` deletes a letter of about one run in so many."""
    raw = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(
        F.col(text_col), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("raw"))
    run = raw.select("id", F.when(F.col("raw").rlike("[A-Z]"), F.translate("raw", _UPPER, _LOWER))
                     .otherwise(F.col("raw")).alias("run"))
    word = F.col("run") if noise is None else noisy(F.col("run"), F.col("id"), noise)
    return (run.select(word.alias("word")).where(F.length("word") >= min_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


class Neighbourhoods:
    """Hashes of reduced words and of their one-edit neighbours, many words of a length at a time."""

    def __init__(self, symbols: int):
        self.symbols = symbols

    def reduce(self, points: np.ndarray) -> np.ndarray:
        """Code points to symbols 1..symbols."""
        return (mix(points.astype(np.uint64) + _U(1)) >> _U(33)) % _U(self.symbols) + _U(1)

    def powers(self, n: int) -> np.ndarray:
        out = np.full(n, _BASE)
        out[:1] = 1
        return np.multiply.accumulate(out)

    def own(self, s: np.ndarray) -> np.ndarray:
        """One hash per row of symbols."""
        return mix((s * self.powers(s.shape[1])).sum(axis=1, dtype=np.uint64))

    def near(self, s: np.ndarray) -> list[np.ndarray]:
        """Hash columns: the words themselves, each deletion, each replacement by a smaller symbol.
        Repeats (deletions inside a run of a symbol, replacements that are none) are zero."""
        power = self.powers(s.shape[1])
        term = s * power
        upto = np.cumsum(term, axis=1, dtype=np.uint64)
        total = upto[:, -1:]
        gone = (upto - term) + (total - upto) * _INVERSE
        gone = mix(gone)
        gone[:, 1:][s[:, 1:] == s[:, :-1]] = 0
        out = [mix(total), gone]
        for c in range(1, self.symbols):
            put = mix(total + (_U(c) - s) * power)
            put[s <= c] = 0
            out.append(put)
        return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, code points) of the words of each length, some thousand code points at a time."""
    size = np.array([len(w) for w in words])
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        step = max(1, 200_000 // int(n))
        for i in range(0, len(rows), step):
            some = rows[i:i + step]
            yield some, np.frombuffer("".join(words[j] for j in some).encode("utf-32-le"), np.uint32).reshape(-1, n)


def _own_keys(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hood = Neighbourhoods(symbols)
        for b in batches:
            keys = np.zeros(b.num_rows, np.uint64)
            for rows, points in _by_length(b.column(0).to_pylist()):
                keys[rows] = hood.own(hood.reduce(points))
            yield pa.record_batch([*b.columns, pa.array(keys.view(np.int64))], names=["word", "n", "key"])
    return run


def _near_keys(symbols: int, bits: int, bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hood, have = Neighbourhoods(symbols), np.frombuffer(bitmap.value, np.uint8)
        for b in batches:
            at, found, own = [], [], []
            for rows, points in _by_length(b.column(0).to_pylist()):
                for i, keys in enumerate(hood.near(hood.reduce(points))):
                    slot = keys >> _U(64 - bits)
                    hit = (have[slot >> _U(3)] >> (slot & _U(7)).astype(np.uint8)) & 1 & (keys != 0)
                    row, col = np.nonzero(hit)
                    at.append(rows[row])
                    found.append(keys[row, col])
                    own.append(np.full(len(row), i == 0))
            if at:
                some = pa.array(np.concatenate(at))
                yield pa.record_batch([b.column(0).take(some), b.column(1).take(some),
                                       pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(own))],
                                      names=["word", "n", "key", "own"])
    return run


def _bitmap(keys: DataFrame, bits: int) -> bytes:
    """One bit per slot a key falls in: 2**bits / 8 bytes whatever the number of keys."""
    slot = F.shiftrightunsigned("key", 64 - bits) + 1  # positions count from 1
    rows = (keys.select(slot.alias("slot"))
            .groupBy(F.bitmap_bucket_number("slot").alias("part"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect())
    out = np.zeros(max(1, (1 << bits) >> 3), np.uint8)
    for r in rows:
        piece = np.frombuffer(r["bits"], np.uint8)
        at = (r["part"] - 1) * len(piece)
        out[at:at + len(piece)] = piece[:len(out) - at]
    return out.tobytes()


def near_words(words: DataFrame, symbols: int = 8, filter_bits: int = 27) -> DataFrame:
    """(a, na, b, nb): every two words of (word, n) that differ by one inserted, deleted or replaced
    code point, each pair once. ``words`` holds each word once."""
    keyed = shared_table(words.select("word", "n").mapInArrow(_own_keys(symbols), "word string, n long, key long"), "words")
    bitmap = words.sparkSession.sparkContext.broadcast(_bitmap(keyed, filter_bits))
    made = keyed.select("word", "n").mapInArrow(_near_keys(symbols, filter_bits, bitmap),
                                                "word string, n long, key long, own boolean")
    left = made.select("key", "own", F.col("word").alias("a"), F.col("n").alias("na"))
    right = keyed.select("key", F.col("word").alias("b"), F.col("n").alias("nb"))
    # words with one reduced word meet from both ends: the smaller one leads
    met = left.join(right, "key").where("not own or a < b").where("abs(length(a) - length(b)) <= 1")
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb")


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain in (word, form). Chains must end; a round joins only
    the words that are not at their end yet."""
    links = links.select(F.col("word").alias("from"), F.col("form").alias("to"))
    done, open_ = None, links.select(F.col("from").alias("word"), F.col("to").alias("at"))
    while True:
        step = shared_table(open_.join(links, open_["at"] == links["from"], "left").select("word", "at", "to"), "roots")
        ended = step.where("to is null").select("word", F.col("at").alias("root"))
        done = ended if done is None else done.unionAll(ended)
        open_ = step.where("to is not null").select("word", F.col("to").alias("at"))
        if open_.isEmpty():
            return done


def group_variants(words: DataFrame, ratio: int = 10, symbols: int = 8, filter_bits: int = 27) -> DataFrame:
    """One row per word of (word, n): (word, form, root, n, n_near, form_n)."""
    words = shared_table(words, "vocabulary")
    pairs = near_words(words, symbols, filter_bits)
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))).alias("p")).select("p.*")
    best = (sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("m"), "other")).alias("top"))
            .select(F.col("word").alias("w"), "n_near", -F.col("top.col1"), "top.other")
            .toDF("w", "n_near", "m", "other"))
    is_form = F.col("m") >= F.col("n") * ratio
    near = shared_table(words.join(best, F.col("word") == F.col("w"), "left").select(
        "word", F.when(is_form, F.col("other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("m")).alias("form_n")), "variants")
    ends = roots(near.where("form is not null").select("word", "form")).withColumnRenamed("word", "w")
    return (near.join(ends, near["word"] == ends["w"], "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def oracle_sql(min_length: int = 7, min_count: int = 2, noise: int = 31, ratio: int = 10) -> str:
    """DuckDB text of group_variants(vocabulary(documents, noise=noise)): near words through equal
    one-letter deletions at one place (a replacement) or a deletion that is a word."""
    table = "SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], " \
            "lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c " \
            "FROM (SELECT unnest(range(256)) AS i))"
    return f"""
WITH RECURSIVE crc AS ({table}),
runs AS (SELECT id, translate(r, '{_UPPER}', '{_LOWER}') AS run, count(*) AS c FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents)
  WHERE length(r) >= {min_length} GROUP BY ALL),
bytes AS (SELECT id, run, c, [4294967295] || list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'),
    lambda h: ('0x' || h)::INT::BIGINT) AS b FROM runs),
summed AS (SELECT run, c, xor(list_reduce(b, lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS h
  FROM bytes, crc),
words AS (SELECT w AS word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {noise} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS w, c FROM summed)
  WHERE length(w) >= {min_length} GROUP BY w HAVING sum(c) >= {min_count}),
cut AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT DISTINCT x.word AS a, y.word AS b, y.n AS m FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN words y ON x.rest = y.word
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN words y ON x.rest = y.word),
best AS (SELECT a, count(*) AS n_near, max(m) AS m, min(b) FILTER (m = top) AS b FROM (
    SELECT *, max(m) OVER (PARTITION BY a) AS top FROM near) GROUP BY a),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {ratio} * n THEN b END AS form,
    CASE WHEN m >= {ratio} * n THEN m END AS form_n FROM words LEFT JOIN best ON a = word),
chain AS (SELECT word, form AS at FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.at, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN ends e ON e.word = f.word"""
