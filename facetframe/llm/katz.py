"""Katz back-off language model: Good-Turing discounts, exactly normalised back-off weights.

Tokens are the ASCII-lower-cased words of a document and one end token; the context of the
first is a start mark. Unigrams: a type seen ``c`` times gets ``d(c) * c / N``, the mass freed
by the discounts belongs to one class of unseen types. Bigrams: ``d(c) * c(v, w) / c(v)`` if the
pair was seen, else ``alpha(v) * P(w)`` with alpha such that the probabilities after ``v`` sum to
one; after an unseen context, ``P(w)``. ``d`` is the Good-Turing discount up to count 5 (Katz),
held in (0, 1]; where discounts free less than one observation's share, the seen mass is scaled
down to leave that share.

Counts live in hash-partitioned tables. Texts are dealt into parts; a part sends its distinct
types and pairs (sorted 64-bit hashes, delta coded) with their training counts to hash buckets
and gets the corpus totals back in the order it sent them, so a type or pair costs one entry
per part however frequent it is. Every seen pair has one owner part, which adds it to its context's
sums: pairs by count, and their words by count, classes 1 to 5 and above. These are integers, so
any order of adding gives the same; they meet in buckets the same way and come back, and with the
discounts they give the context's seen mass and back-off weight. Scoring then looks tokens up in
the part's own arrays. Texts travel joined and compressed, and so do keys and numbers.

Edge cases: null or empty text is the end token alone; a null id counts as empty text in the
split; repeated rows are learned from and scored each; extra columns are ignored; without any
training document every probability is that of the unseen class, 1; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetframe.llm.common import n_parts
from facetframe.llm.exchange import (SENT, TOLD, Answers, Bucket, numbers, pack_keys, planes, sent, slices, told)
from facetframe.llm.hashing import mix, word_hashes

_MARK = b" \xff "  # ends a document among joined texts; UTF-8 has no such byte
_END, _START = word_hashes(_MARK)[0], np.uint64(0x9FB21C651E98DF25)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_TOP = 5  # counts above are not discounted
_TYPES, _PAIRS, _CONTEXTS = 0, 1, 2
_CLASSES = _TOP + 1  # counts 1.._TOP one by one, and all above
_GROUP_BYTES = 8 << 20  # texts a task holds before it joins and compresses them by part


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unsqueeze(data: bytes) -> bytes:
    return pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _squeezed(table: pa.Table, columns: tuple[str, ...], turn=_squeeze) -> pa.Table:
    for c in columns:
        blobs = pa.array([None if x is None else turn(x) for x in table.column(c).to_pylist()], pa.binary())
        table = table.set_column(table.column_names.index(c), c, blobs)
    return table


def _unsqueezed(table: pa.Table, columns: tuple[str, ...]) -> pa.Table:
    return _squeezed(table, columns, _unsqueeze)


def _join_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per part and group of texts: the lower-cased texts joined and compressed."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= _GROUP_BYTES:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches).sort_by("part").combine_chunks()
    part = t.column("part").to_numpy()
    at = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part)).astype(np.int32)
    texts = t.column("text").cast(pa.binary())
    words = [_squeeze(b"".join((x or b"").lower() + _MARK for x in texts.slice(a, z - a).to_pylist()))
             for a, z in zip(at.tolist(), at[1:].tolist())]
    lists = {c: pa.ListArray.from_arrays(pa.array(at), t.column(c).combine_chunks()) for c in ("id", "held_out")}
    return pa.RecordBatch.from_pydict({"part": pa.array(part[at[:-1]], pa.int32())} | lists
                                      | {"words": pa.array(words, pa.binary())})


class _Part:
    """The tokens of one part's documents as arrays."""

    def __init__(self, table: pa.Table):
        self.number = table.column("part")[0].as_py()
        self.id, self.held_out = (pc.list_flatten(table.column(c)) for c in ("id", "held_out"))
        self.token = np.concatenate([word_hashes(_unsqueeze(x.as_py())) for x in table.column("words")])
        end = np.flatnonzero(self.token == _END)
        self.first = np.concatenate(([0], end[:-1] + 1))
        self.length = end + 1 - self.first
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[self.first] = _START
        self.pair = mix(self.context * _PAIR + self.token)
        self.held = np.repeat(self.held_out.to_numpy().astype(bool), self.length)

    def counts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values, ascending, and how often each occurs in training documents."""
        keys, n = np.unique(x, return_counts=True)
        held, m = np.unique(x[self.held], return_counts=True)
        n[np.searchsorted(keys, held)] -= m
        return keys, n.astype(np.int64)


def _send_counts(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        p = _Part(table)
        rows = []
        for kind, x in ((_TYPES, p.token), (_PAIRS, p.pair)):
            keys, n = p.counts(x)
            rows += [(b, p.number, kind, pack_keys(keys[s]), planes(n[s])) for b, s in slices(keys, buckets)]
        return _squeezed(sent(rows), ("keys", "counts"))
    return run


def _statistics(types: np.ndarray, pairs: np.ndarray) -> dict[str, int]:
    out = {"n_types": int((types > 0).sum()), "n_tokens": int(types.sum())}
    for name, x in (("t", types), ("p", pairs)):
        out |= {f"{name}{r}": int((x == r).sum()) for r in range(1, _TOP + 2)}
    return out


def _answer(parts: int):
    """For one bucket: every part's totals, for pairs with their owner, and, in that place of
    the types' answer, the bucket's corpus numbers. These go to all parts."""
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        table = _unsqueezed(table, ("keys", "counts"))
        b = Bucket(table, _PAIRS)
        pairs = b.totals()
        all_told = b.back(pairs)
        own = np.zeros(len(all_told), dtype=bool)
        own[b.order] = b.new
        rows = [(p, bucket, _PAIRS, planes(t), np.packbits(o).tobytes())
                for p, t, o in zip(b.parts, b.split(all_told), b.split(own))]
        b = Bucket(table, _TYPES)
        types = b.totals()
        numbers_here = json.dumps(_statistics(types, pairs)).encode()
        rows += [(p, bucket, _TYPES, planes(t), numbers_here) for p, t in zip(b.parts, b.split(b.back(types)))]
        rows += [(p, bucket, _TYPES, b"", numbers_here) for p in set(range(parts)) - set(b.parts)]
        return _squeezed(told(rows), ("totals",))
    return run


def discounts(ones: list[int]) -> np.ndarray:
    """Katz's Good-Turing discounts for counts 0.._TOP and above, from counts of counts 1.."""
    d = np.ones(_TOP + 2)
    if ones[0] > 0:
        cut = (_TOP + 1) * ones[_TOP] / ones[0]
        for r in range(1, _TOP + 1):
            if ones[r - 1] > 0 and cut < 1:
                x = ((r + 1) * ones[r] / (r * ones[r - 1]) - cut) / (1 - cut)
                if 0 < x <= 1:
                    d[r] = x
    return d


class _Model:
    """Corpus numbers every part needs: sizes, discounts, the unigram distribution's scale."""

    def __init__(self, s: dict):
        self.n, self.v = s["n_tokens"], s["n_types"]
        count = {k: np.array([s[f"{k}{r}"] for r in range(1, _TOP + 2)], dtype=float) for k in "tp"}
        self.dt, self.dp = discounts(list(count["t"])), discounts(list(count["p"]))
        if self.n == 0:
            self.scale, self.unseen = 0.0, 1.0
            return
        r = np.arange(1, _TOP + 1)
        free = float(((1 - self.dt[1:_TOP + 1]) * r * count["t"][:_TOP]).sum()) / self.n
        self.unseen = max(free, 1 / (self.n + 1))
        self.scale = (1 - self.unseen) / (1 - free)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        seen = self.scale * self.dt[np.minimum(c, _TOP + 1)] * c / max(1, self.n)
        return np.where(c > 0, seen, self.unseen)

    def discounted(self, c: np.ndarray) -> np.ndarray:
        return self.dp[np.minimum(c, _TOP + 1)] * c

    def masses(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Seen mass times the context's count, and unigram probability of the words seen, from a
        context's integer sums."""
        each = np.append(np.arange(1, _TOP + 1), 1)
        pairs, words = sums[:_CLASSES].T, sums[_CLASSES:].T
        return pairs @ (self.dp[1:] * each), words @ (self.dt[1:] * each) * (self.scale / max(1, self.n))


def _model(answers: Answers) -> _Model:
    corpus: dict[str, int] = {}
    for _, numbers_there in answers.rows[_TYPES]:
        for k, v in json.loads(numbers_there).items():
            corpus[k] = corpus.get(k, 0) + v
    return _Model(corpus)


def _contexts(p: _Part) -> np.ndarray:
    return np.unique(p.context)


def _class_sums(where: np.ndarray, c: np.ndarray, keys: int) -> np.ndarray:
    """Per class of counts (rows) and key: how often counts 1.._TOP occur, and the sum of those above."""
    kind = np.minimum(c, _CLASSES) - 1
    out = np.bincount(kind * keys + where, weights=np.where(c > _TOP, c, 1), minlength=_CLASSES * keys)
    return out.astype(np.int64).reshape(_CLASSES, keys)


def _send_masses(buckets: int):
    """What each context's seen mass is made of, over owned pairs: their counts by class, and the
    counts of their words by class. Integers, so that sums are exact in any order."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # the corpus numbers go to parts without a document too
            return sent([])
        p, a = _Part(left), Answers(_unsqueezed(right, ("totals",)))
        c_type, c_pair = a.numbers(_TYPES), a.numbers(_PAIRS)
        types, pairs = np.unique(p.token), np.unique(p.pair)
        at = np.empty(len(pairs), dtype=np.int64)
        at[np.searchsorted(pairs, p.pair)] = np.arange(len(p.pair))  # any occurrence of a pair
        mine = a.owned(_PAIRS) & (c_pair > 0)
        at, c = at[mine], c_pair[mine]
        keys = _contexts(p)
        where = np.searchsorted(keys, p.context[at])
        c_word = c_type[np.searchsorted(types, p.token[at])]
        sums = np.concatenate([_class_sums(where, x, len(keys)) for x in (c, c_word)])
        rows = [(b, p.number, _CONTEXTS, pack_keys(keys[s]), planes(np.ascontiguousarray(sums[:, s]).reshape(-1)))
                for b, s in slices(keys, buckets)]
        return _squeezed(sent(rows), ("keys", "counts"))
    return run


def _sum_masses(table: pa.Table) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    table = _unsqueezed(table, ("keys", "counts")).sort_by("part")  # in Bucket's order
    sent_sums = [numbers(c.as_buffer()).reshape(2 * _CLASSES, -1) for c in table.column("counts")]
    b = Bucket(table, _CONTEXTS)
    out = [[] for _ in b.parts]
    for i in range(2 * _CLASSES):
        b.each = np.concatenate([x[i] for x in sent_sums])
        for one, x in zip(out, b.split(b.back(b.totals()))):
            one.append(x)
    rows = [(p, bucket, _CONTEXTS, planes(np.column_stack(x).reshape(-1)), None) for p, x in zip(b.parts, out)]
    return _squeezed(told(rows), ("totals",))


_SCORES = {"n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(),
           "base_score": pa.float64(), "score": pa.float64()}


def _score(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows:
        none = {c: pc.list_flatten(left.column(c)) for c in ("id", "held_out")}
        return pa.table(none | {c: pa.array([], k) for c, k in _SCORES.items()})
    p, a = _Part(left), Answers(_unsqueezed(right, ("totals",)))
    m = _model(a)
    c_type, c_pair = a.numbers(_TYPES), a.numbers(_PAIRS)
    mass, prob_seen = m.masses(a.numbers(_CONTEXTS).reshape(-1, 2 * _CLASSES).T)
    types, pairs = np.unique(p.token), np.unique(p.pair)
    keys = _contexts(p)
    # a context's own count: that of its type; the start mark stands as often as the end
    own = np.where(keys == _START, _END, keys)
    n = c_type[np.searchsorted(types, own)]
    seen = mass / np.maximum(n, 1)
    left_over = np.maximum(1 - seen, 1 / (n + 1.0))
    scale = np.where(seen > 0, (1 - left_over) / np.where(seen > 0, seen, 1), 0)
    alpha = np.where(n > 0, left_over / np.maximum(1 - prob_seen, m.unseen), 1.0)
    ct = c_type[np.searchsorted(types, p.token)]
    cp = c_pair[np.searchsorted(pairs, p.pair)]
    v = np.searchsorted(keys, p.context)
    uni = m.unigram(ct)
    prob = np.where(cp > 0, scale[v] * m.discounted(cp) / np.maximum(n[v], 1), alpha[v] * uni)
    per_doc = lambda x: np.add.reduceat(x, p.first)  # noqa: E731  every document has its end token
    return pa.table({
        "id": p.id, "held_out": p.held_out,
        "n_tokens": pa.array(p.length), "n_known": pa.array(per_doc((ct > 0).astype(np.int64))),
        "train_tokens": pa.array(np.full(len(p.length), m.n, dtype=np.int64)),
        "base_score": pa.array(per_doc(np.log10((ct + 1) / (m.n + m.v + 1)))),
        "score": pa.array(per_doc(np.log10(prob)))})


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document, learned from those not ``held_out``: (id_col, held_out, n_tokens,
    n_known, train_tokens, base_score, score); scores are log10 probabilities."""
    parts = n_parts(docs.sparkSession)
    buckets = max(1, parts // 3)  # pairs are many: smaller buckets than other operators'
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(
        F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(parts)).cast("int").alias("part"))
    texts = texts.mapInArrow(
        _join_texts, f"part int, id array<{kind}>, held_out array<boolean>, words binary").groupBy("part")
    counts = texts.applyInArrow(_send_counts(buckets), SENT)
    answers = counts.groupBy("bucket").applyInArrow(_answer(parts), TOLD)
    masses = (texts.cogroup(answers.groupBy("part")).applyInArrow(_send_masses(buckets), SENT)
              .groupBy("bucket").applyInArrow(_sum_masses, TOLD))
    return (texts.cogroup(answers.unionAll(masses).groupBy("part"))
            .applyInArrow(_score, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                          "base_score double, score double").withColumnRenamed("id", id_col))
