"""Collocations by dynamic itemset counting: phrase lengths interleaved over cyclic shard scans.

The corpus is written once as shards of hashed words, with a mark between pieces (a phrase never
crosses one). A scan reads one shard and counts every *active* phrase in it, of all lengths at
once; shards follow one another in a cycle. Single words are active from the first scan on. When
a phrase's count reaches the threshold, it is stamped with the number of the next scan; a longer
phrase is active from the later stamp of its two subphrases (without its last and without its
first word) on, for one full cycle, and then its count is complete. The scans end when no phrase
was stamped within a cycle.

Stamps live in a table of ``2**filter_bits`` one-byte slots, two per phrase, which every scan gets
as a broadcast (compressed, dropped after the scan): its size is a parameter and does not depend on the corpus. A slot keeps its first
stamp, so all tasks of all scans agree on when a phrase is active, also where phrases share
slots: such phrases are counted without need, over a full cycle all the same, and every
count is exact. The counts themselves stay in Spark: a task sends its distinct active phrases
once, (prefix, last word) identifies a phrase, and complete phrases below the threshold are
dropped. A word or phrase that a third of all texts hold sends one row per task.

Every phrase found then meets the counts of its parts (the cuts), of its two longest subphrases
(to drop those inside a longer candidate) and of its language. Scores are exact decimals.

Words are compared as 64-bit hashes of (language, word), phrases as pairs of hashes; word texts are
read back from the corpus for stamped words only.

Edge cases: null text is empty; a null language counts as ``und``; repeated rows count each; ties in
score go to the larger count, then to the smaller phrase in byte order; an empty table, or one
without frequent phrases, gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetframe.llm.common import byte_groups, shared_table
from facetframe.llm.hashing import mix, span_hashes

_U = np.uint64
_NEXT = _U(0xD6E8FEB86659FD93)
_NEVER = np.uint8(255)
_BLANK, _BREAK = 1, 2
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = _BLANK
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_BLOCK = 1 << 22
_HELD = 1 << 21  # phrases a task holds before it counts them
# Exact for counts below 10**15 and languages of up to 10**18 words: products stay within 38 digits.
SCORE = ("(cast(1000 as decimal(4,0)) * (cast(a as decimal(15,0)) * cast(n as decimal(18,0)))) div "
         "(cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
_COUNTS = "pre long, last long, len byte, start byte, cnt long"


def _blocks(data: bytes) -> Iterator[bytes]:
    """``data`` cut behind piece ends into blocks of about ``_BLOCK`` bytes."""
    at = 0
    while at < len(data):
        end = min(len(data), at + _BLOCK)
        while end < len(data) and _CLASS[data[end - 1]] != _BREAK:
            end += 1
        yield data[at:end]
        at = end


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and whether a word begins a piece."""
    kind = _CLASS[np.frombuffer(data, np.uint8)]
    inside = np.zeros(len(kind) + 2, dtype=np.int8)
    inside[1:-1] = kind == 0
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[0::2], edge[1::2]
    piece = np.cumsum(kind == _BREAK, dtype=np.int64)[start] if len(start) else start
    return start, end, np.diff(piece, prepend=-1) != 0


def _word_keys(data: bytes, start: np.ndarray, end: np.ndarray, lang: str) -> np.ndarray:
    name = lang.encode()  # one span, whatever it holds: languages that differ never share a salt
    salt = span_hashes(name, np.array([0]), np.array([len(name)])) if name else np.full(1, _U(7))
    key = mix(span_hashes(data, start, end) + salt * _U(0xA24BAED4963EE407))
    key[key == 0] = 1  # zero marks a piece's end
    return key


def longer(pre: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Key of the phrase ``pre`` followed by the word ``last``."""
    return mix(pre * _NEXT + last)


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[str, int, bytes]]:
    """(language, shard, joined texts in lower case) of a batch of (text, lang, shard)."""
    langs, shards = batch.column(1).to_pylist(), batch.column(2).to_numpy()
    groups: dict[tuple[str, int], list[int]] = {}
    for i, g in enumerate(zip(langs, shards.tolist())):
        groups.setdefault(g, []).append(i)
    for (lang, shard), rows in groups.items():
        for texts in byte_groups(batch.column(0).take(pa.array(rows))):
            for block in _blocks(b"\n".join(texts).lower()):
                yield lang, shard, block


def _hash_corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang, shard, data in _by_group(b):
            start, end, new = _words(data)
            if len(start):
                keys = np.insert(_word_keys(data, start, end, lang), np.flatnonzero(new), 0)
                yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([lang]), pa.array([len(start)], pa.int64()),
                                       pa.array([keys.view(np.int64)], pa.list_(pa.int64()))],
                                      names=["shard", "lang", "n", "keys"])


class Stamps:
    """From which scan on a phrase counts as frequent."""

    def __init__(self, packed: bytes):
        self.slots = np.frombuffer(zlib.decompress(packed), np.uint8)
        self.bits = (len(self.slots) - 1).bit_length()

    def of(self, key: np.ndarray) -> np.ndarray:
        a, b = places(key, self.bits)
        return np.maximum(self.slots[a], self.slots[b])


class _Tally:
    """Counts of one task's phrases of one length."""

    def __init__(self, length: int):
        self.length, self.held, self.waiting = length, [], 0

    def add(self, pre: np.ndarray, last: np.ndarray, start: np.ndarray) -> None:
        self.held.append((pre, last, start, np.ones(len(last), np.int64)))
        self.waiting += len(last)
        if self.waiting >= _HELD:
            self._shrink()

    def _shrink(self) -> None:
        pre, last, start, n = (np.concatenate(x) for x in zip(*self.held))
        _, first, back = np.unique(longer(pre, last), return_index=True, return_inverse=True)
        self.held = [(pre[first], last[first], start[first], np.bincount(back, weights=n).astype(np.int64))]
        self.waiting = 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        self._shrink()
        pre, last, start, n = self.held[0]
        self.held = []
        for i in range(0, len(n), 50_000):
            s = slice(i, i + 50_000)
            yield pa.record_batch(
                [pa.array(pre[s].view(np.int64)), pa.array(last[s].view(np.int64)),
                 pa.array(np.full(len(n[s]), self.length, np.int8)), pa.array(start[s].astype(np.int8)), pa.array(n[s])],
                names=["pre", "last", "len", "start", "cnt"])

    def full(self) -> bool:
        return len(self.held) == 1 and len(self.held[0][3]) >= _HELD // 2 and not self.waiting


def _scan(step: int, shards: int, most: int, stamps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Stamps(stamps.value)
        tally = {n: _Tally(n) for n in range(1, most + 1)}
        for b in batches:
            for row in b.column(0):
                w = row.values.to_numpy().view(np.uint64)
                at = np.flatnonzero(w)
                if step < shards:
                    tally[1].add(np.zeros(len(at), np.uint64), w[at], np.zeros(len(at), np.uint8))
                when = np.full(len(w) + 1, _NEVER)
                when[at] = known.of(w[at])
                key = np.append(w, _U(0))
                for n in range(2, most + 1):
                    # a phrase of n words starts where one of n - 1 words does, if another starts a word on
                    start = np.maximum(when[:-1], when[1:])
                    at = np.flatnonzero(start <= step)
                    if not len(at):
                        break
                    pre, last, start = key[at], w[at + n - 1], start[at]
                    live = start > step - shards
                    tally[n].add(pre[live], last[live], start[live])
                    if n < most:
                        # the last place stands for none
                        fresh = longer(pre, last)
                        when = np.full(len(w) + 1, _NEVER)
                        # slots others stamped earlier open no phrase before its own parts are counted
                        when[at] = np.maximum(known.of(fresh), start)
                        key = np.zeros(len(w) + 1, np.uint64)
                        key[at] = fresh
            for t in tally.values():
                if t.full():
                    yield from t.rows()
        for t in tally.values():
            yield from t.rows()
    return run


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pre, last, len, cnt) with the phrase's key."""
    for b in batches:
        pre, last = (b.column(i).to_numpy().view(np.uint64) for i in (0, 1))
        key = np.where(b.column(2).to_numpy() == 1, last, longer(pre, last))
        yield pa.record_batch([*b.columns, pa.array(key.view(np.int64))], names=["pre", "last", "len", "cnt", "key"])


def places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two slots of a phrase."""
    return key >> _U(64 - bits), mix(key) >> _U(64 - bits)


def _slots(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in places(b.column(0).to_numpy().view(np.uint64), bits):
                yield pa.record_batch([pa.array(p.astype(np.int64), pa.int32())], names=["slot"])
    return run


def _spell(stamps):
    """(key, lang, word) of stamped words, each once per batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Stamps(stamps.value)
        for b in batches:
            for lang, _, data in _by_group(b):
                start, end, _ = _words(data)
                key, first = np.unique(_word_keys(data, start, end, lang), return_index=True)
                some = known.of(key) != _NEVER
                key, first = key[some], first[some]
                yield pa.record_batch(
                    [pa.array(key.view(np.int64)), pa.array([lang] * len(key), pa.string()),
                     pa.array([data[i:j].decode() for i, j in zip(start[first].tolist(), end[first].tolist())], pa.string())],
                    names=["key", "lang", "word"])
    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, words) with the keys of the first k words, and of the words from k on, for each cut k."""
    def fold(words):
        return reduce(longer, words)
    for b in batches:
        firsts, rests = [], []
        for words in b.column(1).to_pylist():
            w = [np.array([x], np.int64).view(np.uint64) for x in words]
            firsts.append([int(fold(w[:k]).view(np.int64)[0]) for k in range(1, len(w))])
            rests.append([int(fold(w[k:]).view(np.int64)[0]) for k in range(1, len(w))])
        yield pa.record_batch([b.column(0), pa.array(firsts, pa.list_(pa.int64())), pa.array(rests, pa.list_(pa.int64()))],
                              names=["key", "firsts", "rests"])


def _texts(docs: DataFrame, text_col: str, lang_col: str, shards: int) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(F.col(text_col).alias("text"), lang.alias("lang"),
                       F.pmod(F.xxhash64(text_col), F.lit(shards)).cast("int").alias("shard"))


def frequent_phrases(docs: DataFrame, min_count: int, most: int = 5, text_col: str = "text", lang_col: str = "lang",
                     shards: int = 4, filter_bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``most`` words with ``min_count`` occurrences or more in their language, as
    (key, lang, phrase, words, len, cnt), and the words of each language as (lang, n)."""
    spark = docs.sparkSession
    texts = _texts(docs, text_col, lang_col, shards)
    corpus = shared_table(texts.mapInArrow(_hash_corpus, "shard int, lang string, n long, keys array<long>"),
                          "shards", ("shard",))
    slots = np.full(1 << filter_bits, _NEVER)
    found, state, step, changed = [], None, 0, -1
    while True:
        sent = spark.sparkContext.broadcast(zlib.compress(slots, 1))
        counts = (corpus.where(F.col("shard") == step % shards).select("keys")
                  .mapInArrow(_scan(step, shards, most, sent), _COUNTS).withColumn("old", F.lit(0).cast("long")))
        if state is not None:
            counts = counts.unionAll(state.withColumn("old", F.col("cnt")))
        state = shared_table(counts.groupBy("pre", "last", "len", "start").agg(
            F.sum("cnt").alias("cnt"), F.sum("old").alias("old")), "phrases")
        new = state.where((F.col("cnt") >= min_count) & (F.col("old") < min_count) & (F.col("len") < most))
        keys = new.select("pre", "last", "len", "cnt").mapInArrow(
            _with_key, "pre long, last long, len byte, cnt long, key long").select("key")
        # at most one row per slot
        hit = np.array(keys.mapInArrow(_slots(filter_bits), "slot int").distinct().toArrow().column("slot"))
        sent.destroy()  # the scan's counts are written
        if len(hit):
            slots[hit] = np.minimum(slots[hit], step + 1)
            changed = step
        state = state.drop("old")
        ended = F.col("start") <= step - shards + 1
        found.append(state.where(ended & (F.col("cnt") >= min_count)))
        state = state.where(~ended)
        if step >= changed + shards:
            break
        step += 1
    every = reduce(DataFrame.unionAll, found).select("pre", "last", "len", "cnt").mapInArrow(
        _with_key, "pre long, last long, len byte, cnt long, key long")
    every = shared_table(every, "found")
    sent = spark.sparkContext.broadcast(zlib.compress(slots, 1))
    spelled = (texts.mapInArrow(_spell(sent), "key long, lang string, word string")
               .groupBy("key").agg(F.first("lang").alias("lang"), F.first("word").alias("word")))
    single = shared_table(every.where("len = 1").join(spelled, "key").select(
        "key", "lang", F.col("word").alias("phrase"), F.array("key").alias("words"), "len", "cnt"), "words")
    levels = [single]
    ends = single.select(F.col("key").alias("last"), F.col("phrase").alias("last_word"))
    for n in range(2, most + 1):
        before = levels[-1].select(F.col("key").alias("pre"), "lang", F.col("phrase").alias("begin"), F.col("words").alias("before"))
        level = (every.where(F.col("len") == n).join(before, "pre").join(ends, "last")
                 .select("key", "lang", F.concat_ws(" ", "begin", "last_word").alias("phrase"),
                         F.concat("before", F.array("last")).alias("words"), "len", "cnt"))
        levels.append(shared_table(level, "level"))
    totals = corpus.groupBy("lang").agg(F.sum("n").alias("n"))
    return reduce(DataFrame.unionAll, levels), totals


def collocations(docs: DataFrame, min_count: int = 100, most: int = 5, top: int | None = 2000, inside_percent: int = 100,
                 text_col: str = "text", lang_col: str = "lang", shards: int = 4, filter_bits: int = 24) -> DataFrame:
    """Phrases of 2 to ``most`` words by score: (lang, rank, phrase, a, l, r, n, score), the first
    ``top`` of each language (None: all). A cut after k words scores floor(1000 a n / (l r)); the
    lowest cut counts. Phrases inside a longer candidate with ``inside_percent`` of their count go."""
    phrases, totals = frequent_phrases(docs, min_count, most, text_col, lang_col, shards, filter_bits)
    cand = phrases.where("len >= 2")
    parts = shared_table(cand.select("key", "words").mapInArrow(_parts, "key long, firsts array<long>, rests array<long>"), "cuts")
    count = phrases.select("key", "cnt")
    inside = (parts.where("size(rests) >= 2").select("key", F.explode(F.array(F.element_at("firsts", -1), F.col("rests")[0])).alias("sub"))
              .join(count, "key").groupBy("sub").agg(F.max("cnt").alias("longer")))
    cuts = (parts.select("key", F.posexplode(F.arrays_zip("firsts", "rests")).alias("k", "cut"))
            .select("key", "k", "cut.firsts", "cut.rests")
            .join(count.select(F.col("key").alias("firsts"), F.col("cnt").alias("l")), "firsts")
            .join(count.select(F.col("key").alias("rests"), F.col("cnt").alias("r")), "rests"))
    scored = (cand.select("key", "lang", "phrase", F.col("cnt").alias("a")).join(totals, "lang").join(cuts, "key")
              .withColumn("score", F.expr(SCORE)).groupBy("key", "lang", "phrase", "a", "n")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("best")))
    kept = (scored.join(inside, scored["key"] == inside["sub"], "left")
            .where(~F.coalesce(F.lit(100) * F.col("longer") >= F.lit(inside_percent) * F.col("a"), F.lit(False)))
            .select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    if top is not None:  # a language may hold all rows: first within salted shares of it
        share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
        kept = kept.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql(min_count: int = 100, most: int = 5, top: int = 2000) -> str:
    """DuckDB text of collocations(documents)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, {most + 1})) AS k))),
total AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {min_count}),
parts AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (SELECT p.lang, p.k, p.phrase, a, l.f AS l, r.f AS r, n, c,
    ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS c FROM parts) p
  JOIN f l ON l.lang = p.lang AND l.phrase = array_to_string(w[:c], ' ') AND l.k = c
  JOIN f r ON r.lang = p.lang AND r.phrase = array_to_string(w[c + 1:], ' ') AND r.k = p.k - c
  JOIN total t ON t.lang = p.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_parts AS (SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a FROM (
    SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM parts)))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 100 * b.a)
QUALIFY rank <= {top}"""
