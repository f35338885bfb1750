"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose feature exceeds a cutoff from a fixed, ascending list. The
cutoffs are chosen on labelled documents: for every stratum (language) and rule, the strictest
cutoff is taken at which an exact binomial bound guarantees that at most ``risk / rules`` of
the good documents are rejected. The bound is one-sided Clopper-Pearson: with ``k`` of ``n``
good documents rejected a cutoff is certified if P(Binomial(n, risk) <= k) is at most the
error level. The error level is divided by the number of all tests (strata x rules x
cutoffs), so all guarantees hold together with probability ``1 - delta``; by the union over
rules a stratum's good documents are rejected at a rate of at most ``risk``. A stratum with too
few labels certifies nothing and rejects nothing beyond the base rules.

Features come from one pass over the whole texts; the choice needs only counts per
(stratum, rule, cutoff), which Spark aggregates.

Edge cases: null text has no words; documents of fewer than 20 words, or with more than 30% of
their words in repeated windows, fail the base rules; a null language is a stratum of its own;
labels without a document, with null quality or with a null id are ignored, several labels of
one id count as bad if any is; repeated rows are judged each; extra columns are ignored; empty
tables give an empty result, or no certified cutoffs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetframe.llm.common import shared_table
from facetframe.llm.hashing import window_hashes, word_hashes

_SPACES = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_MARKS = b"!\"'(),-./:;?@[\\]^_`{}~+=" + _SYMBOLS
_WINDOW = 8

# The cutoffs each rule may take, loosest last.
CUTOFFS = {
    "symbols": (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2),
    "dup_lines": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7),
    "repeats": (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25),
    "upper": (0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8),
    "marks": (0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3),
    "top_word": (0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.6),
    "word_length": (8.0, 10.0, 12.0, 15.0, 20.0, 30.0),
}
RULES = tuple(CUTOFFS)
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def features(text: str | None) -> tuple:
    """The base counts of a text and the value of every rule's feature, in RULES order."""
    text = text or ""
    data = text.encode()
    h = word_hashes(data)
    n = len(h)
    chars = len(text) - _without(data, _SPACES)
    symbols = _without(data, _SYMBOLS)
    seen, lines, dup = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip(_SPACES):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    w = window_hashes(h, _WINDOW)
    if len(w) > 1:
        order = np.argsort(w, kind="stable")
        s = w[order]
        same = np.zeros(len(s) + 1, dtype=bool)
        same[1:-1] = s[1:] == s[:-1]
        hit = order[same[1:] | same[:-1]]
        if len(hit):
            mark = np.zeros(n + 1, dtype=np.int32)
            np.add.at(mark, hit, 1)
            np.add.at(mark, hit + _WINDOW, -1)
            repeat = int((np.cumsum(mark[:-1]) > 0).sum())
    top = 0
    if n:
        edges = np.flatnonzero(np.diff(np.sort(h)))
        top = int(np.diff(np.concatenate(([-1], edges, [n - 1]))).max())
    upper, lower = _without(data, _UPPER), _without(data, _LOWER)
    return (n, chars, symbols, dup, repeat,
            symbols / max(1, chars), dup / max(1, lines), repeat / max(1, n), upper / max(1, upper + lower),
            _without(data, _MARKS) / max(1, chars), top / max(1, n), chars / max(1, n))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * len(_COUNTS) + [pa.float64()] * len(RULES)
    for b in batches:
        rows = [features(t.as_py()) for t in b.column(2)]
        cols = list(zip(*rows)) if rows else [[]] * len(kinds)
        yield pa.record_batch([b.column(0), b.column(1)] + [pa.array(c, k) for c, k in zip(cols, kinds)],
                              names=["id", "stratum", *_COUNTS, *RULES])


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    lp, lq, top = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    return min(1.0, math.fsum(math.exp(top - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq)
                              for i in range(k + 1)))


def certified(k: int, n: int, risk: float, level: float) -> bool:
    """Whether the exact upper bound on the rejection rate is at most ``risk``."""
    return n > 0 and k <= n * risk and binomial_at_most(k, n, risk) <= level


def choose_cutoffs(good: DataFrame, risk: float, delta: float) -> list[tuple[str | None, dict[str, float]]]:
    """Certified cutoffs per stratum from the features of good documents (one row each).

    Only counts per (stratum, rule, cutoff passed) reach the driver.
    """
    def passes(rule: str):
        value = F.col(rule)
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in CUTOFFS[rule]]), lambda c: value > c))

    level = [passes(r) for r in RULES]
    passed = (good.select("stratum", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), x.alias("passed")) for r, x in zip(RULES, level)])).alias("x"))
        .groupBy("stratum", "x.rule", "x.passed").count().collect())
    strata = sorted({r["stratum"] for r in passed}, key=lambda s: (s is None, s or ""))
    tests = max(1, len(strata) * sum(map(len, CUTOFFS.values())))
    out = []
    for s in strata:
        cut = {}
        for rule in RULES:
            count = {r["passed"]: r["count"] for r in passed if r["stratum"] == s and r["rule"] == rule}
            n = sum(count.values())
            for i, c in enumerate(CUTOFFS[rule]):
                k = sum(m for p, m in count.items() if p > i)
                if certified(k, n, risk / len(RULES), delta / tests):
                    cut[rule] = c
                    break
        out.append((s, cut))
    return out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          stratum_col: str = "lang", good_col: str = "quality", risk: float = 0.05,
          delta: float = 0.05) -> DataFrame:
    """One row per document: id, base counts, base_failed, kept, and the names of the rules it fails."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    f = shared_table(
        docs.select(F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"),
                    F.col(text_col).alias("text"))
        .mapInArrow(_feature_batches, f"id {kind}, stratum string, {counts}, "
                    + ", ".join(f"{r} double" for r in RULES)), "quality")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    good = labels.select(F.col(id_col).alias("id"), F.col(good_col).alias("good")).where(
        "id is not null and good is not null").groupBy("id").agg(F.min("good").alias("good")).where("good = 1")
    # the base rules apply anyway, so the cutoffs answer for what those leave
    chosen = choose_cutoffs(f.where(~base).join(good, "id", "left_semi"), risk, delta)
    cuts = spark.createDataFrame(
        [(s, *[c.get(r) for r in RULES]) for s, c in chosen],
        "cut_stratum string, " + ", ".join(f"cut_{r} double" for r in RULES))
    fails = F.filter(F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]),
                     lambda x: x.isNotNull())
    return (f.join(cuts, f.stratum.eqNullSafe(cuts.cut_stratum), "left")
            .withColumn("base_failed", base).withColumn("failed_rules", fails)
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
            .select(F.col("id").alias(id_col), *_COUNTS, "base_failed", "kept", "failed_rules"))
