"""Every stage against a brute-force version on its own input, and run() as their chain."""

import re
from collections import Counter

import public_tokenizers
import regex

import corpus_pipeline as cp
from facetframe.llm import packing
from facetframe.llm.common import shared_table
from tests.conftest import SF_SMALL


def _words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def _near(docs):
    sets = {}
    for i, t in docs.items():
        w = _words("".join(c.lower() if c.isascii() else c for c in t or ""))
        n = min(5, len(w))
        sets[i] = {tuple(w[p:p + n]) for p in range(len(w) - n + 1)} if n else set()
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in docs:
        for b in docs:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in docs if find(i) == i}


def _cut(docs):
    seen, out = set(), {}
    for i in sorted(docs):
        w, gone = _words(docs[i]), set()
        for p in range(len(w) - 19):
            if tuple(w[p:p + 20]) in seen:
                gone.update(range(p, p + 20))
            seen.add(tuple(w[p:p + 20]))
        if len(gone) < len(w) or not w:
            out[i] = docs[i] if not gone else " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


def test_stages_and_run(spark):
    source = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, tables = source.columns, [source]
    for i, (name, stage) in enumerate(cp.STAGES):
        tables.append(shared_table(stage(spark, tables[-1], SF_SMALL), f"test-{name}"))
        if i < len(cp.STAGES) - 1:
            assert tables[-1].columns == columns
    rows = [t.collect() for t in tables]
    text = [{r.doc_id: r.text for r in x} for x in rows[:-1]]

    # language: exactly the texts with a letter stay here, as all others read clearly
    assert set(text[1]) == {i for i, t in text[0].items() if regex.search(r"\p{L}", t or "")}
    assert set(text[2]) == _near(text[1])
    assert text[3] == _cut(text[2])
    # mixing: whole copies, no more than two, near 150 percent of the words
    size = {i: len(_words(t)) for i, t in text[3].items()}
    copies = Counter(r.doc_id for r in rows[4])
    assert all(n <= 2 and text[4][i] == text[3][i] for i, n in copies.items())
    took = sum(size[i] * n for i, n in copies.items())
    assert 1.5 * sum(size.values()) - max(size.values()) <= took <= 1.5 * sum(size.values())
    # packing: every token of every copy, once
    unit = packing.unit_ids(public_tokenizers.path(cp.TOKENIZER))
    tokens = {i: len(next(iter(unit.texts([t.encode()])))) // 4 + 1 for i, t in text[4].items()}
    assert sum(r.length for r in rows[5]) == sum(tokens[i] * n for i, n in copies.items())
    spans = {}
    for r in rows[5]:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= cp.SEQUENCE_TOKENS

    whole = cp.run(spark, SF_SMALL).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, whole)) == Counter(map(key, rows[5]))
