"""Collocations, byte-level BPE and spelling variants against brute force."""

import hashlib
import random
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from facetframe.llm import byte_bpe, collocations, spelling
from tests.conftest import SF_SMALL

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS),
                             special_tokens={})


def _duck(sql, documents=None):
    con = duckdb.connect()
    if documents is None:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    else:
        con.register("documents", documents.toPandas())
    cur = con.execute(sql)
    return [d[0] for d in cur.description], sorted(cur.fetchall(), key=repr)


# --- op12 ---------------------------------------------------------------------------


def test_bpe_equals_the_library_on_whole_documents(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = byte_bpe.digests(docs, RANKS).collect()
    assert len(got) == len(text)
    for r in got:
        ids = library.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


ODD = ["", None, " ", "\x00a\x00", "a\x1cb \x1c", "\u0085\u00a0 x  \n\n y", "don't I'LL we've", "½²Ⅷ 漢字 🙂🙂 é", "<|endoftext|>",
       "a" * 5000, "ab" * 3000, "".join(random.Random(1).choices("abcdefgh", k=4000)), "\n" * 700 + "x", "é" * 900,
       "".join(chr(c) for c in range(1, 0x300))]


def test_bpe_round_trip_on_odd_texts(spark, library):
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(ODD)], DOCS)
    got = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).collect()}
    for i, t in enumerate(ODD):
        assert list(got[i].ids) == library.encode_ordinary(t or "") and bytes(got[i].decoded).decode() == (t or "")


def test_long_pieces_over_several_queries(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "_ROWS_KEPT", 1)
    monkeypatch.setattr(byte_bpe, "_LONG", 3)
    words = [w.encode() for w in ("aaaaaaaaaaaaaaa", "abcabcabcabcabcabcabc", "mississippimississippi", "zq" * 40)]
    got = byte_bpe.Encoder(RANKS).merge(words)
    assert [list(memoryview(g).cast('i')) for g in got] == [library._core_bpe.encode_single_piece(w) for w in words]


def test_unknown_id_is_an_error(spark):
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([([70_000],)], "ids array<int>"), RANKS).collect()
    assert byte_bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), RANKS).first().decoded == b""


# --- op13 ---------------------------------------------------------------------------


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _brute_variants(count, ratio=10):
    out = {}
    for w, n in count.items():
        near = [x for x in count if _near(w, x)]
        top = min(near, key=lambda x: (-count[x], x), default=None)
        out[w] = (top if top is not None and count[top] >= ratio * n else None, n, len(near))
    rows = []
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, n, k, count[form] if form else None))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("symbols,bits", [(2, 6), (8, 20)])
def test_variants_equal_brute_force(spark, symbols, bits):
    rnd = random.Random(7)
    words = {"".join(rnd.choices("abcé", k=rnd.randint(1, 6))) for _ in range(300)}
    count = {w: rnd.choice([2, 3, 25, 40, 300, 4000]) for w in words}
    count |= {"longword" * 400: 5, "longword" * 400 + "x": 90}
    df = spark.createDataFrame(list(count.items()), "word string, n long").repartition(3)
    got = sorted((tuple(r) for r in spelling.group_variants(df, symbols=symbols, filter_bits=bits).collect()), key=repr)
    assert got == _brute_variants(count)
    assert any(r[1] is not None and r[1] != r[2] for r in got)  # a chain of forms


def test_variants_equal_sql(spark):
    df = spelling.group_variants(spelling.vocabulary(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), noise=31))
    cols, rows = _duck(spelling.oracle_sql())
    assert df.columns == cols and sorted((tuple(r) for r in df.collect()), key=repr) == rows


def test_vocabulary_rules(spark):
    docs = spark.createDataFrame([(1, "Abcdefg ABCDEFG École÷×écoles x1abcdefg", None), (None, "abcdefg É " * 2, None), (3, None, None)], DOCS)
    got = {r.word: r.n for r in spelling.vocabulary(docs, min_count=1).collect()}
    assert got == {"abcdefg": 5, "École÷×écoles": 1}


# --- op11 ---------------------------------------------------------------------------


def _brute_phrases(rows, low, most):
    import re
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    return {k: c for k, c in f.items() if c >= low}, n


def _brute_collocations(rows, low=100, most=5, top=2000):
    f, n = _brute_phrases(rows, low, most)
    out = {}
    for (lang, w), a in f.items():
        if len(w) < 2 or any(lang == m and len(v) > len(w) and c >= a and any(v[i:i + len(w)] == w for i in range(len(v)))
                             for (m, v), c in f.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        s, k = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(w), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(((lang, i + 1, p, -a, x, y, n[lang], -s) for lang, v in out.items()
                   for i, (s, a, p, x, y) in enumerate(sorted(v)[:top])), key=repr)


@pytest.mark.parametrize("shards,bits", [(1, 16), (3, 16), (4, 3)])
def test_collocations_equal_brute_force(spark, shards, bits):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(["the", "Old", "new\tcity", "of", "york.", "a,b", "zé", "x!y"], k=rnd.randint(0, 30))),
             rnd.choice(["en", "fr", None])) for i in range(120)] + [(7, None, "en"), (8, "", None)]
    rows += [(200 + i, "in the middle of nowhere at all", "en") for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = collocations.collocations(docs, min_count=20, top=15, shards=shards, filter_bits=bits)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _brute_collocations(rows, 20, 5, 15)


def test_languages_of_like_names_are_counted_apart(spark):
    rnd = random.Random(5)
    langs = ["a b", "a_b", "a  b", "_", " ", "en", "en\n", " en", "EN", "a\tb"]
    rows = [(i, " ".join(rnd.choices(["the", "cat", "sat\x1c", "Ä"], k=30)), langs[i % len(langs)]) for i in range(200)]
    got = collocations.collocations(spark.createDataFrame(rows, DOCS).repartition(3), min_count=20, top=15)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _brute_collocations(rows, 20, 5, 15)
    both = [(1, "the cat " * 30, ""), (2, "the cat " * 40, "_")]
    got = collocations.collocations(spark.createDataFrame(both, DOCS), min_count=20, most=2)
    assert {(r.lang, r.phrase): (r.a, r.n) for r in got.collect()} == {
        ("", "the cat"): (30, 60), ("", "cat the"): (29, 60), ("_", "the cat"): (40, 80), ("_", "cat the"): (39, 80)}


def test_a_shared_slot_opens_no_phrase_before_its_parts(spark):
    import zlib
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa
    x, y, z = collocations.mix(np.arange(1, 4, dtype=np.uint64))
    slots = np.full(1 << 16, 255, np.uint8)
    for key, step in ((x, 1), (y, 6), (z, 1), (collocations.longer(x[None], y[None])[0], 2), (collocations.longer(y[None], z[None])[0], 2)):
        for p in collocations.places(np.array([key]), 16):
            slots[p] = step
    row = pa.record_batch([pa.array([np.array([0, x, y, z], np.uint64).view(np.int64)], pa.list_(pa.int64()))], names=["keys"])
    scan = collocations._scan(6, 4, 3, SimpleNamespace(value=zlib.compress(slots)))
    got = {b.column("len")[0].as_py(): b.column("start").to_pylist() for b in scan(iter([row]))}
    assert got == {2: [6, 6], 3: [6]}


def test_collocations_equal_sql(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    df = collocations.collocations(docs, min_count=10)
    cols, rows = _duck(collocations.oracle_sql(10))
    assert df.columns == cols and rows
    assert sorted((tuple(r) for r in df.collect()), key=repr) == rows


def test_phrase_counts_past_64_bits(spark):
    big = spark.createDataFrame([(10**12, 10**15, 10**12, 10**12)], "a long, n long, l long, r long")
    assert big.select(F.expr(collocations.SCORE)).first()[0] == 1000 * 10**15 // 10**12


def test_a_task_that_holds_few_phrases_at_a_time(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(collocations, "_HELD", 4)
    t, out = collocations._Tally(2), []
    for _ in range(5):
        t.add(np.arange(3, dtype=np.uint64), np.arange(3, dtype=np.uint64), np.zeros(3, np.uint8))
        if t.full():
            out += t.rows()
    out += t.rows()
    assert sum(sum(b.column(4).to_pylist()) for b in out) == 15
