"""Language identification, word first, with back-off to ever shorter character n-grams.

Learning: from a bounded, hash-chosen sample of labelled documents, the words (runs of letters,
lower case) and the character n-grams of those words are counted per language; those seen at
least twice form the model. All counting is Spark aggregation; only the model, bounded by the
sample, comes to the driver, as Arrow columns, and goes out with the task closure.

Prediction: a known word scores its per-language log frequency. An unseen word falls back to
its known n-grams of the longest order that has any (mean log frequency), order by order down
to single characters. A document gets the language with the largest sum; ``score`` is the mean
over its words of the word's posterior for that language, 0 to 1. A word without any known
n-gram (a script that was never learned) is no evidence and counts as a posterior of 0.

Edge cases: null text or text without a letter gives ``und`` with score 0, and so does every
text if nothing could be learned; a text of which no word is evidence gets the language that the
sample has most words of, with score 0; ties go to the first language in code-point order; a null id
counts as empty text in the split; empty and repeated rows are predicted each; long texts are
read whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetframe.llm.common import byte_groups, keep_in_worker
from facetframe.llm.hashing import span_hashes, unit_spans

_KNOWN_UNITS = 500_000
_LETTERS = regex.compile(r"\p{L}+")
UNKNOWN = "und"


class Table:
    """Texts with a row of log frequencies each, one per language."""

    def __init__(self, texts: list[str], rows: np.ndarray):
        self.texts, self.rows = texts, rows
        self.at = {t: i for i, t in enumerate(texts)}

    def __reduce__(self):
        return Table, (self.texts, self.rows)


@dataclass
class LanguageModel:
    """Known words, and n-grams by order, with their log frequencies per language; ``usual`` is the
    place of the language with most words."""

    langs: list[str]
    words: Table
    grams: dict[int, Table]
    orders: tuple[int, ...]
    name: str = ""
    usual: int = 0

    def word_scores(self, word: str) -> np.ndarray:
        known = self.words.at.get(word)
        if known is not None:
            return self.words.rows[known]
        padded = f"^{word}$"
        for n in self.orders:
            get = self.grams[n].at.get
            hits = [i for j in range(len(padded) - n + 1) if (i := get(padded[j:j + n])) is not None]
            if hits:
                return self.grams[n].rows[hits].mean(axis=0)
        return np.zeros(len(self.langs))


class _Scorer:
    """Sums over texts of what each unit adds: log scores and posteriors per language, and
    the numbers of its runs of letters and of those with any known n-gram. Units met before are looked up by 64-bit hash."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros((0, 2 * len(self.model.langs) + 2), dtype=np.float32)

    def _row(self, unit: bytes) -> np.ndarray:
        k = len(self.model.langs)
        row = np.zeros(2 * k + 2)
        for run in _LETTERS.findall(unit.decode()):
            s = self.model.word_scores(run.lower())
            row[2 * k] += 1
            if s.any():  # else no known n-gram: no evidence for any language
                p = np.exp(s - s.max())
                row[:k] += s
                row[k:2 * k] += p / p.sum()
                row[2 * k + 1] += 1
        return row

    def texts(self, texts: list[bytes]) -> list[tuple[str, float, float]]:
        """Language, score, and the share of words that are evidence."""
        k = len(self.model.langs)
        if not k:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        data = b"\n".join(texts).lower()
        start, end = unit_spans(data)
        distinct, first, back = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > _KNOWN_UNITS:
            self._forget()
        where = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), dtype=bool)
        if len(self.keys):
            new = self.keys[np.minimum(where, len(self.keys) - 1)] != distinct
        if new.any():
            rows = np.array([self._row(data[a:z]) for a, z in zip(start[first[new]].tolist(), end[first[new]].tolist())],
                            dtype=np.float32)
            keys = np.concatenate((self.keys, distinct[new]))
            order = np.argsort(keys, kind="stable")
            self.keys, self.rows = keys[order], np.concatenate((self.rows, rows))[order]
            where = np.searchsorted(self.keys, distinct)
        at = where[back]
        units = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
        begin = np.concatenate(([0], units[:-1]))
        some = np.flatnonzero(units > begin)
        total = np.zeros((len(texts), 2 * k + 2))
        if len(some):
            for c in range(2 * k + 2):
                total[some, c] = np.add.reduceat(self.rows[:, c][at], begin[some], dtype=np.float64)
        return [self._verdict(t) for t in total]

    def _verdict(self, total: np.ndarray) -> tuple[str, float, float]:
        k = len(self.model.langs)
        if not total[2 * k]:
            return UNKNOWN, 0.0, 0.0
        if not total[2 * k + 1]:
            return self.model.langs[self.model.usual], 0.0, 0.0
        best = int(total[:k].argmax())
        return (self.model.langs[best], float(min(1.0, total[k + best] / total[2 * k])),
                float(min(1.0, total[2 * k + 1] / total[2 * k])))


def _scorer(model: LanguageModel) -> _Scorer:
    """This worker process's scorer for the model, with the units met in earlier tasks."""
    return keep_in_worker(("language", model.name), lambda: _Scorer(model))


def in_fold(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's decimal text leaves ``fold`` modulo ``folds``."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = 10_000, min_count: int = 2, orders: tuple[int, ...] = (4, 3, 2, 1)) -> LanguageModel:
    """A model from the ``sample_docs`` labelled documents that are first in hash order: their words
    and n-grams that occur ``min_count`` times or more."""
    pool = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                           F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    h = F.xxhash64("id", "lang")
    last = pool.select(h.alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h").alias("h")).first()["h"]
    if last is None:
        none = Table([], np.zeros((0, 0)))
        return LanguageModel([], none, {n: none for n in orders}, orders)
    counts = (pool.where(h <= last)
              .select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("w <> ''")
              .groupBy("lang", "w").agg(F.count("*").alias("c"))).persist()

    totals = {r["lang"]: (r["n"], r["v"]) for r in counts.groupBy("lang").agg(
        F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    langs = sorted(totals)

    def table(frame: DataFrame, size: np.ndarray, smooth: float) -> Table:
        often = frame.groupBy("w").agg(F.sum("c").alias("all")).where(F.col("all") >= min_count).select("w")
        got = frame.join(often, "w", "left_semi").select("w", "lang", "c").toArrow()
        text = got.column("w").combine_chunks().dictionary_encode()
        order = np.argsort(np.array(text.dictionary.to_pylist(), dtype=object), kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        lang = pc.index_in(got.column("lang").combine_chunks(), value_set=pa.array(langs, pa.string()))
        v = np.full((len(order), len(langs)), smooth)
        np.add.at(v, (place[text.indices.to_numpy(zero_copy_only=False)], lang.to_numpy(zero_copy_only=False)),
                  got.column("c").to_numpy())
        return Table(text.dictionary.take(pa.array(order)).to_pylist(),
                     np.log(v / (size + smooth * (len(order) + 1))).astype(np.float32))

    n_all = np.array([totals[x][0] for x in langs], dtype=float)
    words = table(counts, n_all, 0.5)
    grams = {}
    for n in orders:
        padded = F.concat(F.lit("^"), "w", F.lit("$"))
        g = (counts.withColumn("p", padded).where(F.length("p") >= n)
             .select("lang", "c", F.explode(F.expr(
                 f"transform(sequence(1, length(p) - {n - 1}), i -> substring(p, i, {n}))")).alias("w"))
             .where("w not in ('^', '$')")  # in words of any script, so no evidence
             .groupBy("lang", "w").agg(F.sum("c").alias("c"))).persist()
        size = {r["lang"]: r["n"] for r in g.groupBy("lang").agg(F.sum("c").alias("n")).collect()}
        grams[n] = table(g, np.array([float(size.get(x, 0)) for x in langs]), 0.5)
        g.unpersist()
    counts.unpersist()
    digest = hashlib.sha256(repr(langs).encode())
    for t in (words, *grams.values()):
        digest.update("\n".join(t.texts).encode() + t.rows.tobytes())
    return LanguageModel(langs, words, grams, orders, digest.hexdigest(), int(n_all.argmax()) if langs else 0)


def _predict(model: LanguageModel, names: list[str], prefix: str, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for b in batches:
            got = [v for group in byte_groups(b.column(text_at)) for v in scorer.texts(group)]
            yield pa.record_batch(b.columns[:len(names)] + [pa.array([g[0] for g in got], pa.string()),
                                          pa.array([g[1] for g in got], pa.float64()),
                                          pa.array([g[2] for g in got], pa.float64())],
                                  names=names + [f"{prefix}{c}" for c in ("lang_pred", "score", "evidence")])
    return run


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text",
            carry: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The ``carry`` columns of every row with lang_pred, score and evidence, the share of words with
    a known n-gram (names after ``prefix``, for tables that have such columns); a prediction
    reads the text alone."""
    names = list(carry)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    read = names if text_col in names else [*names, text_col]
    return (docs.select(*read)
            .mapInArrow(_predict(model, names, prefix, read.index(text_col)),
                        f"{schema}, `{prefix}lang_pred` string, `{prefix}score` double, `{prefix}evidence` double"))
