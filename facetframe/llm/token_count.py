"""Exact token counts of a byte-pair model by a compiled finite-state transducer.

The transducer reads characters. A state holds what later tokens can still depend on: for
every start from which a piece of the vocabulary can still grow, the place in the piece trie,
the token that ends at the start, and how many tokens lie between the start and here; and the
last token here. The last token of a prefix is the one piece ending there that the model keeps
apart from the token before it (checked once per token pair by merging the two), so a
transition is deterministic, and it is annotated with the change of the token count. Only
finitely many states exist, as pieces have bounded length; they are built when first met, and
the table starts anew at a fixed size.

Between two characters that no piece holds side by side the state forgets everything. The
space sign after any other character is such a place, so a text is a sequence of segments that
each run from the start state, and segments seen before are looked up whole.

A text is read in chunks of bounded size. A chunk's map is (what precedes its first boundary,
tokens of its whole segments, what follows its last boundary); maps compose associatively, and
a text's count is their scan. Only the pieces at a seam are run through the transducer.

Edge cases: null counts as empty text, which has no tokens; characters outside the vocabulary
count one token per UTF-8 byte; repeated rows and null ids are counted each; long texts are
read whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetframe.llm.common import keep_in_worker

_SPACE = "▁"
_MAX_STATES = 200_000
_MAX_SEGMENTS = 400_000
_CACHED_LENGTH = 64
_CHUNK = 1 << 20

ChunkMap = tuple[str, int | None, str]


class CountTransducer:
    """Token counts under a sentencepiece byte-pair model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.children: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        self.adjacent: set[str] = set()
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            piece = sp.id_to_piece(i)
            self.score[piece] = sp.get_score(i)
            node = 0
            for c in piece:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                node = self.children[node][c]
            self.token[node] = piece
            self.adjacent.update(a + b for a, b in zip(piece, piece[1:]))
        if any(x[1] == _SPACE and x[0] != _SPACE for x in self.adjacent):
            raise ValueError("a piece holds the space sign after another character")
        self.apart: dict[tuple[str, str], bool] = {}
        self.segments: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {((), None): 0}
        self.states: list[tuple] = [((), None)]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def _merge(self, text: str) -> list[str]:
        """The model's own rule: join the best-scored neighbouring pair, the first of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                        if a + b in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _stay_apart(self, left: str | None, right: str) -> bool:
        if left is None:
            return self._single(right)
        got = self.apart.get((left, right))
        if got is None:
            got = self.apart[left, right] = self._merge(left + right) == [left, right]
        return got

    def _single(self, piece: str) -> bool:
        got = self.apart.get(("", piece))
        if got is None:
            got = self.apart["", piece] = self._merge(piece) == [piece]
        return got

    def _build(self, at: int, c: str) -> tuple[int, int]:
        starts, last = self.states[at]
        if c not in self.children[0]:
            nxt, step = ((), None), len(c.encode())
        else:
            before = last if last is not None and last[-1] + c in self.adjacent else None
            grown, found = [], None
            for node, left, back in (*starts, (0, before, 0)):
                to = self.children[node].get(c)
                if to is None:
                    continue
                grown.append((to, left, back))
                piece = self.token[to]
                if found is None and piece is not None and self._stay_apart(left, piece):
                    found = (piece, 1 - back)
            piece, step = found
            nxt = (tuple((n, u, d + step) for n, u, d in grown if self.children[n]), piece)
        if nxt not in self.ids:
            self.ids[nxt] = len(self.states)
            self.states.append(nxt)
            self.moves.append({})
        self.moves[at][c] = move = (self.ids[nxt], step)
        return move

    def count_segment(self, segment: str) -> int:
        """Tokens of a segment, read from the start state."""
        got = self.segments.get(segment)
        if got is not None:
            return got
        if len(self.states) > _MAX_STATES:
            self._reset()
        at, n, moves = 0, 0, self.moves
        for c in segment:
            move = moves[at].get(c) or self._build(at, c)
            at = move[0]
            n += move[1]
        if len(segment) <= _CACHED_LENGTH:
            if len(self.segments) > _MAX_SEGMENTS:
                self.segments = {}
            self.segments[segment] = n
        return n

    def _segments(self, words: list[str]) -> Iterator[str]:
        """Segments of words that each follow one space sign; empty words lengthen the run."""
        run = _SPACE
        for w in words:
            if w:
                yield run + w
                run = _SPACE
            else:
                run += _SPACE
        if len(run) > 1:
            yield run[:-1]

    def chunk_map(self, chunk: str) -> ChunkMap:
        """(head, count, tail); count None if the chunk has no boundary, then all is head.

        A boundary is the place before a space sign that follows another character.
        """
        first = chunk.lstrip(_SPACE)
        at = chunk.find(_SPACE, len(chunk) - len(first))
        if at < 0:
            return chunk, None, ""
        end = len(chunk.rstrip(_SPACE))
        cut = chunk.rfind(_SPACE, 0, end)
        while cut > at and chunk[cut - 1] == _SPACE:
            cut -= 1
        if cut < at:  # only space signs follow the first boundary
            cut = at
        if cut == at:
            return chunk[:at], 0, chunk[at:]
        words = chunk[at + 1:cut].split(_SPACE)
        if "" in words:
            n = sum(map(self.count_segment, self._segments(words)))
        else:
            get, n = self.segments.get, 0
            for w in words:
                k = get(_SPACE + w)
                n += self.count_segment(_SPACE + w) if k is None else k
        return chunk[:at], n, chunk[cut:]

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of two neighbouring chunks; associative."""
        if a[1] is None and b[1] is None:
            seam = self.chunk_map(a[0] + b[0])
            return seam
        if a[1] is None:
            head, n, tail = self.chunk_map(a[0] + b[0])
            if n is None:
                return head, b[1], b[2]
            return head, n + self.count_segment(tail) + b[1], b[2]
        if b[1] is None:
            head, n, tail = self.chunk_map(a[2] + b[0])
            if n is None:
                return a[0], a[1], head
            return a[0], a[1] + self._count_part(head) + n, tail
        head, n, tail = self.chunk_map(a[2] + b[0])
        inner = self._count_part(head) + (0 if n is None else n + self._count_part(tail))
        return a[0], a[1] + inner + b[1], b[2]

    def _count_part(self, part: str) -> int:
        return self.count_segment(part) if part else 0

    def count(self, text: str, chunk: int = _CHUNK) -> int:
        if not text:
            return 0
        text = _SPACE + text.replace(" ", _SPACE)
        maps = [self.chunk_map(text[i:i + chunk]) for i in range(0, len(text), chunk)]
        head, n, tail = reduce(self.compose, maps)
        return self._count_part(head) + (n or 0) + self._count_part(tail)


def transducer(path: str) -> CountTransducer:
    """The model's transducer in this process, with the states built so far."""
    return keep_in_worker(("transducer", path), lambda: CountTransducer(path))


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for b in batches:
            n = [machine.count(t.as_py() or "") for t in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64())],
                                  names=["id", "n_bytes", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096) -> DataFrame:
    """One row per document: (id_col, n_bytes, n_tokens, over_limit)."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"),
                        text.alias("text"))
            .mapInArrow(_count_batches(model_path), f"id {kind}, n_bytes long, n_tokens long")
            .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
