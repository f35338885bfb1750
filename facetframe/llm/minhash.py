"""MinHash near-duplicate groups: one-permutation hashing, optimal densification, star edges.

1. One pass over the texts gives each document its shingle set (64-bit hashes of ``shingle``
   consecutive words, ASCII-lower-cased), the set's size and 128-bit signature, and its
   one-permutation sketch: the value range is cut into ``bins`` and a bin holds the smallest
   set member in it. An empty bin borrows from a fixed random sequence of bins (optimal
   densification).
2. Documents with equal sets collapse onto the one with the smallest id before any candidate
   is made, so a group of exact copies counts once.
3. ``bins/rows`` bands of ``rows`` bins are the bucket keys. A bucket yields star edges only:
   from a few hubs (smallest id, largest id, two seeded picks) to every member, never all
   pairs. A size bound drops edges that can't reach the similarity.
4. Every edge is confirmed on the two full sets. Confirmed edges merge components; buckets
   that still span several components get stars around fresh hubs until a round links nothing.
5. What hubs did not reach is then settled: within each bucket that still spans several
   components, members of different components are compared by an exact bound. Each set has a
   parity bitmap (1 024 bits; a bit is the parity of the members that fall on it). Bitmaps differ in
   at most as many bits as the sets differ in members, and sets of n and m members that reach the
   similarity differ in at most ``(n + m) (100 - percent) / (100 + percent)``. Only pairs within that
   bound and the size bound leave the join, to be confirmed on full sets. A bucket's largest
   component is on one side only. So no two documents that share a bucket stay apart untested.

At the default (256 bins, 6 rows) two sets at exactly 0.8 share no bucket with probability
3e-6. Hot buckets are only ever aggregated with a map-side minimum and joined (splittable by
AQE); the graph work runs as joins over edges, nothing is gathered on the driver.

Edge cases: null or empty text and text without words have the empty set (``n_shingles`` 0)
and link with nothing; fewer words than ``shingle`` form one shingle; rows that share an id
are one node (each row keeps its own ``n_shingles``); a null id takes no part in linking
(``component_id`` null, ``kept`` true). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetframe.llm.common import components, shared_table
from facetframe.llm.hashing import mix, window_hashes, word_hashes

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_PROBES = 64
_PARITY_BITS = 1024
_SKETCH = "id long, n_shingles long, sig binary, bands array<long>, parity array<long>"
_SETS = "id long, members array<long>"


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending."""
    h = word_hashes((text or "").encode().lower())
    n = min(shingle, len(h))
    return np.unique(window_hashes(h, n)) if n else h


def parity(s: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set of hashes, as 64-bit numbers."""
    odd = np.bincount((mix(s + np.uint64(1)) & np.uint64(_PARITY_BITS - 1)).astype(np.int64), minlength=_PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Sketcher:
    """One-permutation sketches with optimal densification, and their band keys."""

    def __init__(self, bins: int, rows: int):
        if bins & (bins - 1):
            raise ValueError("bins must be a power of two")
        self.bins, self.rows, self.n_bands = bins, rows, bins // rows
        self.shift = np.uint64(64 - (bins - 1).bit_length())
        grid = np.arange(bins * _PROBES, dtype=np.uint64) + np.uint64(1)
        self.probe = (mix(grid).reshape(bins, _PROBES) >> self.shift).astype(np.int64)
        self.salt = np.arange(1, self.n_bands + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)

    def sketch(self, s: np.ndarray) -> np.ndarray:
        """``s`` ascending and not empty: the first member of each bin is its minimum."""
        b = (s >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.diff(b, prepend=-1))
        out = np.full(self.bins, _EMPTY)
        out[b[first]] = s[first]
        full = np.zeros(self.bins, dtype=bool)
        full[b[first]] = True
        hole = np.flatnonzero(~full)
        if len(hole):
            hit = full[self.probe[hole]]
            at = self.probe[hole, hit.argmax(axis=1)]
            lost = np.flatnonzero(~hit.any(axis=1))
            if len(lost):  # none of the probes hit: the next full bin, circularly
                have = np.flatnonzero(full)
                at[lost] = have[np.searchsorted(have, hole[lost]) % len(have)]
            out[hole] = out[at]
        return out

    def bands(self, s: np.ndarray) -> np.ndarray:
        v = self.sketch(s)[:self.n_bands * self.rows].reshape(self.n_bands, self.rows)
        key = self.salt.copy()
        for j in range(self.rows):
            key = mix(key + v[:, j])
        return key.view(np.int64)


def _sketch_batches(shingle: int, bins: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sk = Sketcher(bins, rows)
        for b in batches:
            size, sig, bands, off, bits = [], [], [], [0], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), shingle)
                size.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bits.append(parity(s))
                if len(s):
                    bands.append(sk.bands(s))
                off.append(off[-1] + (sk.n_bands if len(s) else 0))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            yield pa.record_batch([
                b.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(sig, pa.binary()),
                pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat)),
                pa.array(bits, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "sig", "bands", "parity"])
    return run


def _set_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in b.column(1)]
            off = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.record_batch([b.column(0).cast(pa.int64()),
                                   pa.ListArray.from_arrays(pa.array(off), pa.array(flat))],
                                  names=["id", "members"])
    return run


def _star_edges(members: DataFrame, labels: DataFrame | None, seed: int, percent: int,
                tested: DataFrame | None) -> DataFrame:
    """Edges from each bucket's hubs to its members of other components: size-bounded, each
    once, and none that was tested before."""
    m = members
    if labels is not None:
        m = (m.join(labels, m.id == labels.node, "left")
             .select("bucket", "id", "n", F.coalesce("component", "id").alias("c")))
    else:
        m = m.select("bucket", "id", "n", F.col("id").alias("c"))
    me = F.struct("id", "n", "c")
    pick = [F.min(me), F.max(me)] + [
        F.min_by(me, F.xxhash64("id", F.lit(seed + j))) for j in range(2)]
    hubs = (m.groupBy("bucket").agg(F.array_distinct(F.array(*pick)).alias("hubs"),
                                    F.min("c").alias("lo"), F.max("c").alias("hi"))
            .where("lo <> hi").select("bucket", "hubs"))
    e = (m.join(hubs, "bucket").select("id", "n", "c", F.explode("hubs").alias("h"))
         .where("c <> h.c")
         .where(f"100 * least(n, h.n) >= {percent} * greatest(n, h.n)")
         .select(F.least("id", "h.id").alias("a"), F.greatest("id", "h.id").alias("b")))
    if tested is None:
        return e.distinct()
    return (e.withColumn("old", F.lit(0)).unionAll(tested.withColumn("old", F.lit(1)))
            .groupBy("a", "b").agg(F.max("old").alias("old")).where("old = 0").select("a", "b"))


def _open_pairs(members: DataFrame, bits: DataFrame, labels: DataFrame | None, percent: int,
                tested: DataFrame | None) -> DataFrame:
    """All untested pairs of different components that share a bucket and could link: within the size
    bound, and with parity bitmaps no further apart than linked sets can be. ``bits``: (id, parity)."""
    if labels is None:
        m = members.select("bucket", "id", "n", F.col("id").alias("c"))
    else:
        m = (members.join(labels, members.id == labels.node, "left")
             .select("bucket", "id", "n", F.coalesce("component", "id").alias("c")))
    # a bucket's largest component is on one side only, so it is never compared with itself
    big = (m.groupBy("bucket", "c").agg(F.count("*").alias("k")).groupBy("bucket")
           .agg(F.max_by("c", F.struct("k", "c")).alias("big"), F.count("*").alias("parts"))
           .where("parts > 1").select("bucket", "big"))
    words = [F.col("parity")[i].alias(f"p{i}") for i in range(_PARITY_BITS // 64)]
    # rows that share an id each keep their own bitmap
    open_ = shared_table(m.join(big, "bucket").join(bits.select("id", *words).distinct(), "id"), "open")
    few = open_.where("c <> big").drop("big")
    many = open_.select("bucket", *[F.col(c).alias(f"{c}_2") for c in few.columns if c != "bucket"])
    apart = " + ".join(f"bit_count(p{i} ^ p{i}_2)" for i in range(len(words)))
    return _untested(few.join(many, "bucket").where("c <> c_2")
                     .where(f"100 * least(n, n_2) >= {percent} * greatest(n, n_2)")
                     .where(f"({apart}) * {100 + percent} <= (n + n_2) * {100 - percent}")
                     .select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b")).distinct(), tested)


def _untested(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    return pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 5, percent: int = 80, bins: int = 256, rows: int = 6) -> DataFrame:
    """One row per input row: (id_col, n_shingles, component_id, kept).

    Two documents link when ``100 * |A ∩ B| >= percent * |A ∪ B|`` on their shingle sets.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sk = shared_table(src.mapInArrow(_sketch_batches(shingle, bins, rows), _SKETCH), "sketch")
    some = sk.where("id is not null and n_shingles > 0")
    reps = some.groupBy("sig").agg(F.min("id").alias("rep"))
    tagged = some.join(reps, "sig")
    copies = tagged.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    band = tagged.where("id = rep").select("id", F.col("n_shingles").alias("n"),
                                           F.explode("bands").alias("bucket"))
    shared = band.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")) \
        .where("lo <> hi").select("bucket")
    members = shared_table(band.join(shared, "bucket", "left_semi").select("bucket", "id", "n"), "buckets")
    wanted = members.select("id").distinct()
    sets = shared_table(src.join(wanted, "id", "left_semi").mapInArrow(_set_batches(shingle), _SETS), "sets")

    def confirm(cand: DataFrame) -> DataFrame:
        both = (cand.join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a")
                .join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
                .withColumn("x", F.size(F.array_intersect("ma", "mb")))
                .select("a", "b", (F.expr(f"100 * x >= {percent} * (size(ma) + size(mb) - x)")).alias("ok")))
        return shared_table(both, "edges")

    links, labels, tested, seed = None, None, None, 0
    while True:
        done = confirm(_star_edges(members, labels, seed, percent, tested))
        tested = done.select("a", "b") if tested is None else tested.unionAll(done.select("a", "b"))
        new = done.where("ok").select("a", "b")
        if new.isEmpty():
            break
        links = new if links is None else links.unionAll(new)
        labels = components(links)
        seed += 2
    bits = some.select("id", "parity")
    last = confirm(_open_pairs(members, bits, labels, percent, tested)).where("ok").select("a", "b")
    links = last if links is None else links.unionAll(last)
    final = components(copies.unionAll(links))
    return (sk.join(final, sk.id == final.node, "left")
            .select(F.col("id").alias(id_col), "n_shingles",
                    F.coalesce("component", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))
