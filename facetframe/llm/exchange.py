"""Totals of hashed keys over parts, and the way back.

A part sends its distinct keys (sorted 64-bit hashes, delta coded) with a number each to hash
buckets; a bucket sums by key and answers every part in the order it sent. A key costs one
entry per part however often it occurs there, so a hot key's bucket gets at most one entry
per part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SENT = "bucket int, part int, kind int, keys binary, counts binary"
TOLD = "part int, bucket int, kind int, totals binary, owned binary"


def planes(x: np.ndarray) -> bytes:
    """Fixed-width numbers byte plane by byte plane: small values leave runs of zeros."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8).T).tobytes()


def numbers(data: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(numbers(data, np.uint64), dtype=np.uint64)


def slices(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Buckets are ranges of the ascending keys."""
    b = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    lo = np.flatnonzero(np.diff(b, prepend=-1))
    for a, z in zip(lo, np.append(lo[1:], len(b))):
        yield int(b[a]), slice(a, z)


def rows_table(rows: list[tuple], names: tuple[str, ...], kinds: tuple) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)})


def sent(rows: list[tuple]) -> pa.Table:
    return rows_table(rows, ("bucket", "part", "kind", "keys", "counts"),
                 (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))


def told(rows: list[tuple]) -> pa.Table:
    return rows_table(rows, ("part", "bucket", "kind", "totals", "owned"),
                 (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))


def unpacked(column: pa.ChunkedArray, read, kind) -> tuple[np.ndarray, list[int]]:
    """All blobs of a column behind one another, and how many numbers each held."""
    sizes = [len(x.as_buffer()) // 8 for x in column]
    out, at = np.empty(sum(sizes), dtype=kind), 0
    for x, n in zip(column, sizes):
        out[at:at + n] = read(x.as_buffer())
        at += n
    return out, sizes


class Bucket:
    """The entries all parts sent to one bucket, of one kind, summed by key."""

    def __init__(self, table: pa.Table, kind: int, values=np.int64):
        t = table.filter(pc.equal(table.column("kind"), kind)).sort_by("part")
        self.parts = t.column("part").to_pylist()
        key, self.sizes = unpacked(t.column("keys"), unpack_keys, np.uint64)
        self.order = np.argsort(key, kind="stable").astype(np.uint32)  # equal keys in part order
        key = key[self.order]
        self.new = np.ones(len(key), dtype=bool)
        self.new[1:] = key[1:] != key[:-1]
        del key
        self.group = np.cumsum(self.new, dtype=np.uint32) - np.uint32(1)
        self.each, _ = unpacked(t.column("counts"), lambda d: numbers(d, values), values)

    def totals(self) -> np.ndarray:
        at = np.flatnonzero(self.new)
        return np.add.reduceat(self.each[self.order], at) if len(at) else self.each

    def back(self, per_key: np.ndarray) -> np.ndarray:
        """A value per key, in the order the entries were sent."""
        out = np.empty(len(self.order), dtype=per_key.dtype)
        out[self.order] = per_key[self.group]
        return out

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, np.cumsum(self.sizes)[:-1])


def total(table: pa.Table) -> pa.Table:
    """For one bucket: every part's keys answered with their totals, and with whether the part
    is the first that sent the key."""
    rows, bucket = [], table.column("bucket")[0].as_py()
    for kind in sorted(set(table.column("kind").to_pylist())):
        b = Bucket(table, kind)
        all_told = b.back(b.totals())
        own = np.zeros(len(all_told), dtype=bool)
        own[b.order] = b.new
        rows += [(p, bucket, kind, planes(t), np.packbits(o).tobytes())
                 for p, t, o in zip(b.parts, b.split(all_told), b.split(own))]
    return told(rows)


class Answers:
    """What the buckets sent back to a part, in the order of its sorted keys."""

    def __init__(self, table: pa.Table):
        self.rows: dict[int, list] = {}
        for b, kind, all_told, own in sorted(zip(*(table.column(c).to_pylist() for c in (
                "bucket", "kind", "totals", "owned"))), key=lambda r: (r[1], r[0])):
            self.rows.setdefault(kind, []).append((all_told, own))

    def numbers(self, kind: int, values=np.int64) -> np.ndarray:
        return np.concatenate([numbers(t, values) for t, _ in self.rows.get(kind, ())] or [np.zeros(0, values)])

    def owned(self, kind: int) -> np.ndarray:
        return np.concatenate([np.unpackbits(np.frombuffer(o, np.uint8), count=len(t) // 8).astype(bool)
                               for t, o in self.rows.get(kind, ())] or [np.zeros(0, bool)])
