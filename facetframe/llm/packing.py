"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

1. Every document is tokenised, closed with an end id and cut into pieces only where it is
   longer than a sequence.
2. Pieces are ranked within their length. A length's pieces are spread over hash ranges; a
   piece's rank is the number of pieces in earlier ranges plus its place in its own, so a
   length shared by a third of all pieces is still ranked in many small groups.
3. The sweep goes over the run-length coded, range-sorted lists: documents as (length, number
   of pieces), gaps as (free tokens, run of sequences). Supersteps from the longest length
   down: all pieces of the length look up their successor (the smallest gap that holds them),
   conflicts are resolved by rank (rank r of the run gets slot r), the gaps are updated, and
   what is left over looks again; without a gap new sequences open. Both lists are bounded by
   the sequence length (at most one document run per possible length), whatever the number of
   documents, so the sweep itself is a small step on the driver.
4. Every piece looks up its sequence and offset by (length, rank) in its own task.

The outcome is that of best-fit decreasing over all pieces. Sequences are gapless from 0 to
the last token they hold.

Edge cases: null or empty text is one piece that holds the end id alone; rows equal in id and
text are packed each; a null id is kept; extra columns are ignored; an empty table gives an
empty result. Units are tokenised on their own, which equals tokenising the whole text for
tokenizers whose pre-tokenizer drops ASCII white space and cuts between letters and punctuation.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetframe.llm.common import byte_groups, keep_in_worker, shared_table
from facetframe.llm.hashing import span_hashes, unit_spans

_KNOWN_UNITS = 1_000_000
_GLUE = "\x01"  # joins units for one library call; its token marks where a unit ends

def _one_word(unit: str) -> bool:
    return unit.isalpha() and unit.lower().isalpha() or not unit.strip(".,;:!?")


class UnitIds:
    """Token ids of whole texts from those of their units, which are looked up by 64-bit hash
    in sorted arrays; the library tokenises every unit when it is first met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        normal = self.tokenizer.normalizer
        self.lower = normal is not None and normal.normalize_str("AZ") == "az"
        self.glue = self._ids(_GLUE)
        if len(self.glue) != 1:
            raise ValueError("the glue character must be one token")
        # a unit of letters or of punctuation alone is one word to the model, and ends with
        # the only token that carries the end-of-word suffix, where the model has one
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each has."""
        ids, sizes = [], []
        for i in range(0, len(units), 2000):
            group = [u.decode() for u in units[i:i + 2000]]
            if self.ends is not None and all(map(_one_word, group)):
                got = np.array(self._ids(" ".join(group)), dtype="<u4")
                cut = np.concatenate(([-1], np.flatnonzero(self.ends[got])))
                if len(cut) == len(group) + 1:  # every unit has at least one end: so each has one
                    ids.append(got)
                    sizes.append(np.diff(cut))
                    continue
            if any(_GLUE in u for u in group):
                each = [self._ids(u) for u in group]
                ids.append(np.array([x for e in each for x in e], dtype="<u4"))
                sizes.append(np.array([len(e) for e in each], dtype=np.int64))
            else:
                got = np.array(self._ids(f" {_GLUE} ".join(group)), dtype="<u4")
                mark = got == self.glue[0]
                ids.append(got[~mark])
                cut = np.concatenate(([-1], np.flatnonzero(mark), [len(got)]))
                sizes.append(np.diff(cut) - 1)
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, keys: np.ndarray, units: list[bytes]) -> None:
        plain = np.array([_one_word(u.decode()) for u in units])
        order = np.argsort(~plain, kind="stable")  # the library's calls hold plain units alone, or others
        units = [units[i] for i in order]
        keys = keys[order]
        n = int(plain.sum())
        done = [self._encode(u) for u in (units[:n], units[n:]) if u]
        ids, size = (np.concatenate(x) for x in zip(*done))
        at = np.cumsum(size) - size + len(self.ids)
        all_keys = np.concatenate((self.keys, keys))
        order = np.argsort(all_keys, kind="stable")
        self.keys = all_keys[order]
        self.at = np.concatenate((self.at, at))[order]
        self.size = np.concatenate((self.size, size))[order]
        self.ids = np.concatenate((self.ids, ids))

    def texts(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        data = b"\n".join(texts)
        if self.lower:
            data = data.lower()
        start, end = unit_spans(data)
        key = span_hashes(data, start, end)
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > _KNOWN_UNITS:
            self._forget()
        where = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), dtype=bool)
        if len(self.keys):
            new = self.keys[np.minimum(where, len(self.keys) - 1)] != distinct
        if new.any():
            f = first[new]
            self._learn(distinct[new], [data[a:z] for a, z in zip(start[f].tolist(), end[f].tolist())])
            where = np.searchsorted(self.keys, distinct)
        size, at = self.size[where][back], self.at[where][back]
        stop = np.cumsum(size)
        ids = self.ids[np.repeat(at - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        edge = np.cumsum([len(t) + 1 for t in texts])  # where each text's separator ends
        units = np.searchsorted(start, edge)
        upto = np.concatenate(([0], stop))[units].tolist()
        for a, z in zip([0, *upto], upto):
            yield ids[a:z].tobytes()


def unit_ids(path: str) -> UnitIds:
    """The tokenizer of this worker process, with what it has learned in earlier tasks."""
    return keep_in_worker(("units", path), lambda: UnitIds(path))


def _piece_batches(path: str, end_id: int, capacity: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = unit_ids(path)
        for b in batches:
            ids = b.column(0).cast(pa.int64()).to_pylist()
            rows, i = [], 0
            for group in byte_groups(b.column(1)):
                for tokens in words.texts(group):
                    tokens += end
                    for p, at in enumerate(range(0, len(tokens), 4 * capacity)):
                        cut = tokens[at:at + 4 * capacity]
                        rows.append((ids[i], p, at // 4, len(cut) // 4, zlib.crc32(cut)))
                    i += 1
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (
                pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["id", "piece", "start", "length", "ids_crc32"])
    return run


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over (length -> number of pieces).

    Returns placements (length, first rank, pieces per sequence, first sequence, offset): the
    piece of rank ``r`` in the run goes to sequence ``first + (r - first rank) // per`` at
    ``offset + (r - first rank) % per * length``.
    """
    gaps: list[int] = []  # gap sizes that occur, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, how many)
    out, opened = [], 0

    def free(gap: int, first: int, many: int) -> None:
        if gap > 0 and many > 0:
            if gap not in runs:
                bisect.insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, many = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap]
                    gaps.pop(at)
            else:
                gap, first = capacity, opened
                many = -(-left // (capacity // length))
                opened += many
            per = gap // length
            used = min(many, -(-left // per))
            n = min(left, used * per)
            out.append((length, rank, per, first, capacity - gap))
            full, rest = divmod(n, per)
            free(gap - per * length, first, full)
            if rest:
                free(gap - rest * length, first + full, 1)
            free(gap, first + used, many - used)
            rank += n
            left -= n
    return out


def _placer(places: np.ndarray):
    """places: rows (length, first rank, per, first sequence, offset), by length and rank."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = {}
        lengths = places[:, 0]
        lo = np.flatnonzero(np.diff(lengths, prepend=-1))
        hi = np.append(lo[1:], len(lengths))
        for a, z in zip(lo, hi):
            by[int(lengths[a])] = places[a:z]
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                p = by[int(n)]
                k = np.searchsorted(p[:, 1], rank[rows], side="right") - 1
                d = rank[rows] - p[k, 1]
                seq[rows] = p[k, 3] + d // p[k, 2]
                off[rows] = p[k, 4] + d % p[k, 2] * n
            yield pa.record_batch(
                [b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(seq), pa.array(off)],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: (id_col, piece, start, length, ids_crc32, sequence_id, offset)."""
    spark = docs.sparkSession
    pieces = shared_table(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(_piece_batches(tokenizer_path, end_id, capacity),
                    "id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("range", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(ranges)))
    counts = shared_table(dealt.groupBy("length", "range").count(), "piece-counts")
    before = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    # at most one row per possible length: bounded by the capacity
    runs = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = np.array(sorted(best_fit(runs, capacity)) or np.zeros((0, 5)), dtype=np.int64).reshape(-1, 5)
    own = Window.partitionBy("length", "range").orderBy("id", "piece", "ids_crc32")
    ranked = (dealt.withColumn("own", F.row_number().over(own) - 1).join(offsets, ["length", "range"])
              .select("id", "piece", "start", "length", "ids_crc32",
                      (F.col("earlier") + F.col("own")).cast("long").alias("rank")))
    return ranked.mapInArrow(_placer(places),
                             "id long, piece int, start long, length long, ids_crc32 long, "
                             "sequence_id long, offset long").withColumnRenamed("id", id_col)
