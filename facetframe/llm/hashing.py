"""Word and word-window hashes of one text, vectorised with numpy.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; that byte class is
also what ``bytes.split()`` cuts at. Hashes are 64-bit and depend only on the bytes, so
every task and every run gives the same value.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_MASK = (1 << 64) - 1
_BLOCK = 1 << 18
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer (a bijection on 64-bit values)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, _BLOCK + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), _BLOCK + 1)


def _spans(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(a) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[a]
    edge = np.flatnonzero(np.diff(inside))
    return edge[0::2], edge[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash per word of ``data``, in order (empty for no words).

    Long texts are worked off in blocks cut at white space, so the scratch arrays stay
    small; one word longer than a block gets a block of its own size.
    """
    if len(data) <= _BLOCK:
        return _block_hashes(data)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + _BLOCK)
        if end < len(data):
            head, tail = data[at:end], end
            cut = max(head.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut >= 0:
                end = at + cut + 1
            else:  # the block is inside one word: run on to where it ends
                while tail < len(data) and not _SPACE[data[tail]]:
                    tail += 1
                end = tail
        out.append(_block_hashes(data[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _block_hashes(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, dtype=np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64)
    start, end = _spans(a)
    return _hash_spans(a, start, end)


def _hash_spans(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(a)
    pw, iv = (_POW, _INV) if n <= _BLOCK else (
        _powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[a] * pw[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * iv[start]
    return mix(h + (end - start).astype(np.uint64) * _U(0xA24BAED4963EE407))


def span_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash per span of ``data`` (ascending, not overlapping), in blocks like word_hashes;
    a word's span gets the word's hash."""
    a = np.frombuffer(data, dtype=np.uint8)
    out, i = [], 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, side="right")))
        lo, hi = int(start[i]), int(end[j - 1])
        out.append(_hash_spans(a[lo:hi], start[i:j] - lo, end[i:j] - lo))
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def window_hashes(h: np.ndarray, n: int, base: int = 0x8B72E0355D9F4A2B) -> np.ndarray:
    """One hash per run of ``n`` consecutive entries of ``h`` (empty if fewer)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    b = _U(base | 1)
    for k in range(n):
        out *= b
        out += h[k:k + m]
    return mix(out)


# Byte classes: white space, ASCII letters, plain punctuation, all others.
_WHITE, _LETTER, _POINT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _WHITE
_CLASS[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
_CLASS[list(b".,;:!?")] = _POINT


def unit_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the text's units: runs without ASCII white space, cut again between an
    ASCII letter and plain punctuation."""
    starts, ends = [], []
    for at in range(0, len(data), _BLOCK):
        c = _CLASS[np.frombuffer(data, np.uint8, min(_BLOCK, len(data) - at), at)]
        prev = np.empty_like(c)
        prev[1:] = c[:-1]
        prev[0] = _CLASS[data[at - 1]] if at else _WHITE
        turn = (c ^ prev) == (_LETTER ^ _POINT)
        turn &= (c == _LETTER) | (c == _POINT)
        starts.append(np.flatnonzero((c != _WHITE) & ((prev == _WHITE) | turn)) + at)
        ends.append(np.flatnonzero((prev != _WHITE) & ((c == _WHITE) | turn)) + at)
    if len(data) and _CLASS[data[-1]] != _WHITE:
        ends.append(np.array([len(data)]))
    none = np.zeros(0, np.int64)
    return np.concatenate(starts or [none]), np.concatenate(ends or [none])
