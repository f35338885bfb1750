"""Removal of repeated word runs, found through difference-cover anchors.

A window is ``window`` consecutive words; a word goes if a window that covers it also starts
earlier (smaller id, or the same document and an earlier start). Windows are judged on the
input.

Hashing every window of a corpus is too much to shuffle, so only shorter *anchor* windows at
cover positions are: positions whose remainder modulo the period lies in a difference cover.
For any two positions there is a shift below the period that takes both to cover positions,
so two equal windows of ``anchor + period - 1`` words always share an aligned anchor.

Texts are dealt into parts by a hash of their id, and every step works on one part's texts
and the keys sent to it:

1. each part sends its distinct anchor hashes to hash buckets;
2. a bucket tells the parts which of their anchors another part has too;
3. each part extends those anchors to the full windows around them and sends the distinct
   window hashes (128 bits) with the smallest id that has it here;
4. a bucket names the first owner of every window and tells all other parts;
5. each part marks windows owned elsewhere or seen earlier in the part, and cuts the words.

An anchor or window counts once per part however often it occurs, so a key held by a third of
all documents sends at most one entry per part to its bucket. Documents whose whole text
equals one with a smaller id send nothing: every window of theirs starts earlier there.

Edge cases: null or empty text and text without words have no windows; rows that share an id
are ordered by text (an equal row is a repeat of the first); a null id sorts after all
others; extra columns are carried along if asked for; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from facetframe.llm.common import n_buckets, n_parts, part_of
from facetframe.llm.hashing import window_hashes, word_hashes

# Perfect difference covers: every remainder modulo the period is a difference of two members.
_COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
_SECOND = 0x5851F42D4C957F2D
_MAX = (1 << 63) - 1
_KEYS = "__bucket int, __part int, keys binary, owners binary"


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of at least a third of the window."""
    period = max((p for p in _COVERS if window - p + 1 >= max(1, window // 3)), default=1)
    return period, _COVERS.get(period, (0,))


class _Texts:
    """The documents of one part, in (id, text) order, with their word hashes."""

    def __init__(self, table: pa.Table):
        ids = table.column("__key").to_pylist()
        data = [(t or "").encode() for t in table.column("__text").to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], data[i]))
        self.ids = [ids[i] for i in self.order]
        self.data = [data[i] for i in self.order]

    def hashed(self, copies: dict[int, set[bytes]]):
        for k, d in zip(self.ids, self.data):
            if not _is_copy(copies, k, d):
                yield k, word_hashes(d)


def _is_copy(copies: dict[int, set[bytes]], key: int, data: bytes) -> bool:
    return key in copies and hashlib.md5(data).hexdigest().encode() in copies[key]


def _received(table: pa.Table) -> tuple[dict[int, set[bytes]], np.ndarray]:
    """Whole copies (id -> text digests), and the sorted keys sent to this part."""
    copies, keys = {}, [np.zeros(0, np.uint64)]
    for key, owner in zip(table.column("keys").to_pylist(), table.column("owner").to_pylist()):
        if owner is not None:
            copies.setdefault(owner, set()).add(key)
        else:
            keys.append(np.frombuffer(key, dtype=np.uint64))
    return copies, np.sort(np.concatenate(keys))


def _isin(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x


def _by_bucket(part: int, buckets: int, keys: np.ndarray, second: np.ndarray | None = None,
               owners: np.ndarray | None = None) -> pa.Table:
    """Rows (bucket, part, keys, owners); ``keys`` ascending, buckets are ranges of keys."""
    b = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    lo = np.flatnonzero(np.diff(b, prepend=-1))
    hi = np.append(lo[1:], len(b))
    pack = [np.column_stack((keys[a:z], second[a:z])).tobytes() if second is not None
            else keys[a:z].tobytes() for a, z in zip(lo, hi)]
    own = [owners[a:z].tobytes() if owners is not None else None for a, z in zip(lo, hi)]
    return pa.table({"__bucket": pa.array(b[lo], pa.int32()),
                     "__part": pa.array([part] * len(lo), pa.int32()),
                     "keys": pa.array(pack, pa.binary()), "owners": pa.array(own, pa.binary())})


def _part_number(left: pa.Table, right: pa.Table) -> int:
    return (left if left.num_rows else right).column("__part")[0].as_py()


def _anchors(h: np.ndarray, anchor: int, period: int, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = window_hashes(h, anchor)
    at = np.flatnonzero(cover[np.arange(len(a)) % period])
    return a[at], at


def _send_anchors(anchor: int, window: int, period: int, cover: np.ndarray, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        copies, _ = _received(right)
        found = [np.unique(_anchors(h, anchor, period, cover)[0])
                 for _, h in _Texts(left).hashed(copies) if len(h) >= window]
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        return _by_bucket(_part_number(left, right), buckets, keys)
    return run


def _shared_keys(table: pa.Table) -> pa.Table:
    """For one bucket: which of its keys each part shares with another part."""
    parts = table.column("__part").to_numpy()
    blobs = [np.frombuffer(k, dtype=np.uint64) for k in table.column("keys").to_pylist()]
    keys = np.concatenate(blobs)
    part = np.repeat(parts, [len(x) for x in blobs])
    order = np.argsort(keys, kind="stable")
    keys, part = keys[order], part[order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = keys[1:] == keys[:-1]
    some = same[1:] | same[:-1]
    return _by_part(part[some], keys[some])


def _by_part(part: np.ndarray, keys: np.ndarray) -> pa.Table:
    order = np.argsort(part, kind="stable")
    part, keys = part[order], keys[order]
    lo = np.flatnonzero(np.diff(part, prepend=-1))
    hi = np.append(lo[1:], len(part))
    return pa.table({"__part": pa.array(part[lo], pa.int32()),
                     "keys": pa.array([keys[a:z].tobytes() for a, z in zip(lo, hi)], pa.binary()),
                     "owner": pa.array([None] * len(lo), pa.int64())})


def _send_windows(anchor: int, window: int, period: int, cover: np.ndarray, buckets: int):
    span = window - anchor + 1  # window starts that hold an anchor at a given position

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        copies, shared = _received(right)
        w1, w2, own = [], [], []
        for k, h in _Texts(left).hashed(copies) if len(shared) else ():
            if len(h) < window:
                continue
            a, at = _anchors(h, anchor, period, cover)
            at = at[_isin(a, shared)]
            if not len(at):
                continue
            n = len(h) - window + 1
            mark = np.zeros(n + 1, dtype=np.int32)
            np.add.at(mark, np.maximum(at - span + 1, 0).clip(max=n), 1)
            np.add.at(mark, (at + 1).clip(max=n), -1)
            some = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            if not len(some):
                continue
            x, first = np.unique(window_hashes(h, window)[some], return_index=True)
            w1.append(x)
            w2.append(window_hashes(h, window, _SECOND)[some][first])
            own.append(np.full(len(x), k, dtype=np.int64))
        if not w1:
            return _by_bucket(_part_number(left, right), buckets, np.zeros(0, np.uint64))
        w1, w2, own = np.concatenate(w1), np.concatenate(w2), np.concatenate(own)
        order = np.lexsort((own, w2, w1))
        w1, w2, own = w1[order], w2[order], own[order]
        keep = np.ones(len(w1), dtype=bool)
        keep[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
        return _by_bucket(_part_number(left, right), buckets, w1[keep], w2[keep], own[keep])
    return run


def _owned_elsewhere(table: pa.Table) -> pa.Table:
    """For one bucket: the window keys each part must give up to a smaller id elsewhere."""
    parts = table.column("__part").to_numpy()
    blobs = [np.frombuffer(k, dtype=np.uint64).reshape(-1, 2) for k in table.column("keys").to_pylist()]
    keys = np.concatenate(blobs)
    own = np.concatenate([np.frombuffer(o, dtype=np.int64) for o in table.column("owners").to_pylist()])
    part = np.repeat(parts, [len(x) for x in blobs])
    order = np.lexsort((own, keys[:, 1], keys[:, 0]))
    keys, part = keys[order], part[order]
    later = np.zeros(len(keys), dtype=bool)
    later[1:] = (keys[1:] == keys[:-1]).all(axis=1)
    return _by_part(part[later], keys[later, 0])


def _cut(window: int, names: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        copies, lost = _received(right)
        texts = _Texts(left)
        all_w, count = [], []
        for k, d in zip(texts.ids, texts.data):
            whole = _is_copy(copies, k, d)
            w = np.zeros(0, np.uint64) if whole else window_hashes(word_hashes(d), window)
            all_w.append(w)
            count.append(len(w))
        flat = np.concatenate(all_w) if all_w else np.zeros(0, np.uint64)
        repeat = np.ones(len(flat), dtype=bool)
        repeat[np.unique(flat, return_index=True)[1]] = False  # the first in (id, start) order
        repeat |= _isin(flat, lost)
        n_words, n_gone, sha, kept_text, at = [], [], [], [], 0
        for k, d, n in zip(texts.ids, texts.data, count):
            words = d.split()
            if n == 0 and _is_copy(copies, k, d):
                kept = words if len(words) < window else []
            else:
                hit = np.flatnonzero(repeat[at:at + n])
                at += n
                kept = words
                if len(hit):
                    mark = np.zeros(len(words) + 1, dtype=np.int32)
                    np.add.at(mark, hit, 1)
                    np.add.at(mark, hit + window, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0)]
            text = b" ".join(kept)
            n_words.append(len(words))
            n_gone.append(len(words) - len(kept))
            sha.append(hashlib.sha256(text).hexdigest())
            kept_text.append(text if len(kept) < len(words) else d)
        out = left.take(pa.array(texts.order, pa.int64())).select(names)
        for name, col in (("n_words", pa.array(n_words, pa.int64())),
                          ("n_removed", pa.array(n_gone, pa.int64())),
                          ("kept_sha256", pa.array(sha, pa.string())),
                          ("kept_text", pa.array(kept_text, pa.binary()).cast(pa.string()))):
            out = out.append_column(name, col)
        return out
    return run


def _without_text(step):
    return lambda left, right: step(left, right).drop_columns(["kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                   carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """One row per input row: id_col, the ``carry`` columns, n_words, n_removed, kept_sha256,
    and, if ``with_text``, kept_text: the words left, joined by one space, or the whole text if
    all are."""
    spark = docs.sparkSession
    parts = n_parts(spark)
    period, members = cover_for(window)
    anchor = window - period + 1
    cover = np.zeros(period, dtype=bool)
    cover[list(members)] = True

    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_MAX))
    names = [id_col, *carry]
    base = docs.select(*[F.col(c) for c in names], F.col(text_col).alias("__text"), key.alias("__key"),
                       part_of(key, parts).alias("__part"))
    texts = base.groupBy("__part")
    sig = docs.select(key.alias("k"), F.md5(F.col(text_col).cast("binary")).alias("sig")).where("sig is not null")
    lead = sig.groupBy("sig").agg(F.min("k").alias("lead"), F.max("k").alias("last")).where("lead < last")
    copies = (sig.join(lead, "sig").where("k > lead").select(
        part_of(F.col("k"), parts).alias("__part"), F.col("sig").cast("binary").alias("keys"),
        F.col("k").alias("owner")))

    told = "__part int, keys binary, owner long"
    anchors = texts.cogroup(copies.groupBy("__part")).applyInArrow(
        _send_anchors(anchor, window, period, cover, n_buckets(parts)), _KEYS)
    shared = anchors.groupBy("__bucket").applyInArrow(_shared_keys, told)
    windows = texts.cogroup(shared.unionAll(copies).groupBy("__part")).applyInArrow(
        _send_windows(anchor, window, period, cover, n_buckets(parts)), _KEYS)
    lost = windows.groupBy("__bucket").applyInArrow(_owned_elsewhere, told)
    schema = StructType([docs.schema[c] for c in names]).add("n_words", LongType()).add(
        "n_removed", LongType()).add("kept_sha256", StringType())
    step = _cut(window, names)
    if with_text:
        schema = schema.add("kept_text", StringType())
    else:
        step = _without_text(step)
    return texts.cogroup(lost.unionAll(copies).groupBy("__part")).applyInArrow(step, schema)
