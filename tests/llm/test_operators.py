"""The registered queries against brute force on the smallest tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

from facetframe.llm import katz, packing, queries, quality
from facetframe.llm.hashing import span_hashes, unit_spans, window_hashes, word_hashes
from facetframe.llm.substring_dedup import _COVERS, cover_for
from facetframe.llm.token_count import CountTransducer
from tests.conftest import SF_SMALL

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [" ", "  ", "\n", "a", "e", "th", "ing", "É", "é", "ß", "漢", "1", "23", ".", ",", "'s", "A", "\t", "🙂",
            "<|endoftext|>", "<s>", "́", "\x01", "Σ", "!?", "--", "aa", "▁", "\x1c", "İ", "don't", "ﬁ"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    return {r.doc_id: r for r in rows}


def run(spark, name):
    return queries.QUERIES[name](spark, SF_SMALL).collect()


def texts(n, most):
    r = random.Random(7)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, most))) for _ in range(n)]


def words(text):
    return (text or "").encode().split()


def test_hashes():
    t = b"  one two\tthree\n four "
    assert len(word_hashes(t)) == 4 and (word_hashes(t) == word_hashes(b"one two three four")).all()
    big = b" ".join(b"w%d" % i for i in range(100_000))  # several blocks
    assert (word_hashes(big)[:50] == word_hashes(big[:400])[:50]).all() and len(word_hashes(big)) == 100_000
    assert len(word_hashes(b"x" * 700_000 + b" y")) == 2
    assert (span_hashes(big, *unit_spans(big)) == word_hashes(big)).all()
    h = word_hashes(b"a b c a b c a")
    assert (window_hashes(h, 3)[0] == window_hashes(h, 3)[3]) and len(window_hashes(h, 8)) == 0


def test_tokenizer_units_equal_the_library():
    unit = packing.UnitIds(WORDS)
    some = texts(2000, 25)
    for t, got in zip(some, unit.texts([t.encode() for t in some])):
        assert np.frombuffer(got, "<u4").tolist() == unit.tokenizer.encode(t, add_special_tokens=False).ids


def test_transducer_equals_the_library():
    import sentencepiece
    machine, sp = CountTransducer(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for i, t in enumerate(texts(2000, 40)):
        for chunk in (1 << 20, 7, 1 + i % 11):
            assert machine.count(t, chunk) == len(sp.encode(t))


def test_best_fit_places_everything_once():
    r = random.Random(3)
    for _ in range(20):
        counts = Counter(r.randint(1, 100) for _ in range(r.randint(1, 400)))
        bins = {}
        for length, first, per, seq, off in packing.best_fit(counts, 100):
            nxt = min([f for n, f, *_ in packing.best_fit(counts, 100) if n == length and f > first],
                      default=counts[length])
            for k in range(nxt - first):
                bins.setdefault(seq + k // per, []).append((off + k % per * length, length))
        assert sum(map(len, bins.values())) == sum(counts.values())
        for b in bins.values():
            at = 0
            for off, n in sorted(b):
                assert off == at
                at += n
            assert at <= 100


def test_op1(spark, docs):
    rows = run(spark, "op1_best_fit")
    tok = packing.UnitIds(WORDS).tokenizer
    for r in rows:
        ids = tok.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids + [1]
        cut = np.array(ids[r.start:r.start + r.length], dtype="<u4").tobytes()
        assert r.start == 4096 * r.piece and zlib.crc32(cut) == r.ids_crc32
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in by.values():
        ends = [sum(n for _, n in sorted(b)[:i]) for i in range(len(b) + 1)]
        assert [o for o, _ in sorted(b)] == ends[:-1] and ends[-1] <= 4096
    assert len(by) <= math.ceil(sum(r.length for r in rows) / 4096) + 1


def test_op2(spark, docs):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in run(spark, "op2_transducer"):
        n = len(sp.encode(docs[r.doc_id].text or ""))
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 4096, len((docs[r.doc_id].text or "").encode()))


def test_op3(spark, docs):
    bags = {i: Counter(words((d.text or "").encode().lower().decode())) for i, d in docs.items()}
    mean = sum(sum(c.values()) for c in bags.values()) / len(bags)
    df = Counter(w for c in bags.values() for w in c)
    idf = {w: math.log(1 + (len(bags) - f + 0.5) / (f + 0.5)) for w, f in df.items()}
    got = {}
    for r in sorted(run(spark, "op3_block_max"), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for q in [i for i in bags if i % 20 == 0]:
        want = []
        for i, c in bags.items():
            parts = [idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in bags[q] if w in c]
            if parts:
                want.append((-math.fsum(parts), i))
        want = sorted(want)[:10]
        assert [i for _, i in want] == [i for i, _ in got.get(q, [])]
        assert all(abs(a + b) < 1e-9 for (a, _), (_, b) in zip(want, got.get(q, [])))


def test_op4(spark, docs):
    for r in run(spark, "op4_risk_control"):
        text = docs[r.doc_id].text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        seen, dup = set(), 0
        for line in text.split("\n"):
            if line.strip(" \t\r\x0b\x0c"):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        hit = {i + k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(8)}
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), sum(text.count(s) for s in "#*$%&|<>"), dup, len(hit), failed)
        assert not (failed and r.kept)


def test_binomial_bound():
    for n, p in ((1, 0.3), (20, 0.05), (400, 0.01)):
        for k in range(0, n, max(1, n // 7)):
            brute = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
            assert abs(quality.binomial_at_most(k, n, p) - brute) < 1e-9
    assert not quality.certified(0, 10, 0.05, 0.05) and quality.certified(0, 59, 0.05, 0.05)


def test_cutoffs_reject_few_good_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 1").select("doc_id")
    out = queries.QUERIES["op4_risk_control"](spark, "/root/testdata/sf0.1").where("not base_failed")
    good = out.join(rows, "doc_id", "left_semi").selectExpr("avg(cast(kept as double)) as k").first().k
    bad = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 0").select("doc_id")
    kept_bad = out.join(bad, "doc_id", "left_semi").selectExpr("avg(cast(kept as double)) as k").first().k
    assert good >= 0.95 and kept_bad < 0.6


def test_op5(spark, docs):
    low = lambda t: [*(t or "").encode().lower().split(), None]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    train = [low(d.text) for i, d in docs.items() if not held[i]]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip(["<s>", *t], t))
    n, v = sum(one.values()), len(one)
    ones = lambda c: [sum(x == r for x in c.values()) for r in range(1, 7)]
    d1, d2 = katz.discounts(ones(one)), katz.discounts(ones(two))
    free = sum((1 - d1[min(c, 6)]) * c for c in one.values()) / n
    unseen = max(free, 1 / (n + 1))

    def p1(w):
        return (1 - unseen) / (1 - free) * d1[min(one[w], 6)] * one[w] / n if one[w] else unseen
    after = {}
    for (a, w), c in two.items():
        m = after.setdefault(a, [0, 0.0, 0.0])
        m[0] += c
        m[1] += d2[min(c, 6)] * c
        m[2] += p1(w)

    def p2(a, w):
        if a not in after:
            return p1(w)
        c, kept, prob = after[a]
        left = max(1 - kept / c, 1 / (c + 1))
        if two[a, w]:
            return (1 - left) / (kept / c) * d2[min(two[a, w], 6)] * two[a, w] / c
        return left / (1 - prob) * p1(w)
    for a in list(after)[:3]:
        assert abs(sum(p2(a, w) for w in one) + p2(a, "\0") - 1) < 1e-9
    for r in run(spark, "op5_katz"):
        t = low(docs[r.doc_id].text)
        s = sum(math.log10(p2(a, w)) for a, w in zip(["<s>", *t], t))
        b = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            held[r.doc_id], len(t), sum(one[w] > 0 for w in t), n)
        assert math.isclose(r.score, s, rel_tol=1e-8) and math.isclose(r.base_score, b, rel_tol=1e-9)


def test_covers():
    for period, members in _COVERS.items():
        assert {(a - b) % period for a in members for b in members} == set(range(period))
    assert cover_for(20) == (13, (0, 1, 3, 9)) and cover_for(1)[0] == 1


def test_op6(spark, docs):
    seen, want = set(), {}
    for i in sorted(docs):
        w = words(docs[i].text)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            key = tuple(w[p:p + 20])
            if key in seen:
                gone[p:p + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, "op6_difference_cover")}
    assert got == want and sum(g for _, g, _ in want.values()) > 0


def test_op7(spark, docs):
    rows = run(spark, "op7_word_backoff")
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_op8(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    cur = con.execute(queries.SQL["op8_licenses"])
    cols = [c[0] for c in cur.description]
    got = [tuple(r[c] for c in cols) for r in run(spark, "op8_licenses")]
    assert sorted(got) == sorted(cur.fetchall()) and got


def test_op9(spark, docs):
    sets = {}
    for i, d in docs.items():
        w = (d.text or "").encode().lower().split()
        n = min(4, len(w))
        sets[i] = {tuple(w[p:p + n]) for p in range(len(w) - n + 1)} if n else set()
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    for r in run(spark, "op9_minhash"):
        assert (r.n_shingles, r.component_id, r.kept) == (
            len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_op10(spark, docs):
    rows = run(spark, "op10_mixing")
    size = {i: len([x for x in re.split(r"[\x20\x09-\x0D]+", d.text or "") if x]) for i, d in docs.items()}
    per = Counter()
    for i, d in docs.items():
        per[d.source] += size[i]
    names = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(per.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * per[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * per[s] for s in full}
        left -= sum(2.0 * per[s] for s in full)
        open_ -= full
    taken = Counter()
    largest = Counter()
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == size[r.doc_id] and r.source_size == per[s] and math.isclose(r.target, target[s], rel_tol=1e-9)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s] + 0.01 * target[s]
    assert sum(taken.values()) <= 1.5 * sum(per.values())
