"""Whole jobs: cases where an operator once did less than all of its work."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from facetframe.llm import language, minhash, mixing, search
from tests.conftest import SF_SMALL


def test_op9_links_beside_a_large_component(spark):
    # both buckets hold everything: 200 variants of one text, and two that link with each other only
    halves = [[], []]
    for i in range(20_000):
        halves[int(minhash.shingle_set(f"w{i}", 1)[0]) >> 63].append((int(minhash.shingle_set(f"w{i}", 1)[0]), f"w{i}"))
    shared = " ".join(min(h)[1] for h in halves)
    rows = [(i, f"{shared} " + " ".join(f"{'z' if i in (100, 101) else 'h'}{j}" for j in range(40)) + f" own{i}")
            for i in range(1, 203)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, shingle=1, bins=2, rows=1).collect()}
    assert got == {i: 100 if i in (100, 101) else 1 for i, _ in rows}


def test_pipeline_rejects_scripts_never_learned(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    known = docs.where("lang is not null and text rlike '[a-z]{3}'")
    foreign = spark.createDataFrame(
        [(-1, "съешь ещё этих мягких французских булок да выпей чаю", None, "a", 52),
         (-2, "天地玄黃 宇宙洪荒 日月盈昃 辰宿列張", None, "a", 19)], docs.schema)
    got = {r.doc_id for r in corpus_pipeline.identify_language(spark, known.unionAll(foreign), SF_SMALL).collect()}
    assert got == {r.doc_id for r in known.collect()}


def test_op7_names_a_learned_language_for_any_letters(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = language.learn(docs)
    rows = spark.createDataFrame([(1, "съешь ещё этих мягких французских булок"), (2, "天地玄黃 宇宙洪荒"), (3, "12 34 !"),
                                  (4, None), (5, "the съешь ещё этих мягких")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(rows, model).collect()}
    assert got[3] == got[4] == ("und", 0.0)
    assert all(got[i][0] in model.langs and 0 <= got[i][1] <= 1 for i in (1, 2, 5))


def test_op7_predictions_equal_brute_force(spark):
    import re
    from collections import Counter
    from math import exp, log
    docs = [r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]
    df = spark.createDataFrame(docs)
    got = {r.doc_id: r for r in language.predict(df, language.learn(df)).collect()}
    count = {}
    for r in docs:
        for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()):
            count.setdefault(r.lang, Counter())[w] += 1
    langs = sorted(count)

    def model(by_lang):
        total = Counter()
        for c in by_lang.values():
            total.update(c)
        known = [w for w, n in total.items() if n >= 2]
        size = {x: sum(by_lang[x].values()) for x in langs}
        return {w: [log((by_lang[x][w] + 0.5) / (size[x] + 0.5 * (len(known) + 1))) for x in langs] for w in known}

    words, grams = model(count), {}
    for n in (4, 3, 2, 1):
        by = {x: Counter() for x in langs}
        for x in langs:
            for w, c in count[x].items():
                p = f"^{w}$"
                for i in range(len(p) - n + 1):
                    if p[i:i + n] not in ("^", "$"):
                        by[x][p[i:i + n]] += c
        grams[n] = model(by)

    def scores(w):
        if w in words:
            return words[w]
        p = f"^{w}$"
        for n in (4, 3, 2, 1):
            hits = [grams[n][p[i:i + n]] for i in range(len(p) - n + 1) if p[i:i + n] in grams[n]]
            if hits:
                return [sum(h[j] for h in hits) / len(hits) for j in range(len(langs))]
        return None
    for r in docs:
        total, post, n = [0.0] * len(langs), [0.0] * len(langs), 0
        for w in re.findall(r"[^\W\d_]+", r.text or ""):
            s, n = scores(w.lower()), n + 1
            if s:
                e = [exp(x - max(s)) for x in s]
                total = [a + b for a, b in zip(total, s)]
                post = [a + b / sum(e) for a, b in zip(post, e)]
        if n:
            best = max(range(len(langs)), key=lambda j: (total[j], -j))
            assert got[r.doc_id].lang_pred == langs[best] and abs(got[r.doc_id].score - post[best] / n) < 1e-4, r.doc_id


def test_op9_links_no_hub_reaches(spark):
    # pairs of near copies inside one large bucket: every pair must meet, whoever the hubs are
    import random
    rnd = random.Random(2)
    base = [f"c{i}" for i in range(60)]
    rows = []
    for k in range(60):
        own = [f"k{k}x{j}" for j in range(40)]
        rows += [(10 * k, " ".join(base + own)), (10 * k + 1, " ".join(base + own + ["z"]))]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, shingle=1, bins=2, rows=1).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}


def test_parity_bitmaps_never_differ_in_more_bits_than_the_sets():
    import numpy as np
    rnd = np.random.default_rng(4)
    for n in (1, 5, 400, 5000):
        a = np.unique(rnd.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[n // 7:], rnd.integers(0, 1 << 62, n // 9, dtype=np.uint64))))
        bits = sum(int(x).bit_count() for x in (minhash.parity(a) ^ minhash.parity(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b)) and (bits - len(np.setxor1d(a, b))) % 2 == 0


def test_op3_repeated_query_rows_have_all_their_hits(spark):
    rows = [(20, "alpha beta gamma")] * 2 + [(i, f"alpha beta w{i}") for i in range(1, 20)] + [(40, "alpha beta gamma")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in search.search(docs, F.col("doc_id") % 20 == 0, k=10).collect():
        got.setdefault((r.query_id, r.rank), []).append((r.doc_id, r.score))
    assert set(got) == {(q, i) for q in (20, 40) for i in range(1, 11)}
    assert all(len(got[20, i]) == 2 and len(set(got[20, i])) == 1 and len(got[40, i]) == 1 for i in range(1, 11))
    assert [got[40, i][0] for i in range(1, 11)] == [got[20, i][0] for i in range(1, 11)]


def test_op3_reads_the_longest_lists_as_rows_and_stays_exact():
    import numpy as np
    import pyarrow as pa
    rnd = random.Random(7)
    texts = [" ".join([w for w in "abcdefgh" if rnd.random() < 0.6] + [f"w{rnd.randint(0, 90)}" for _ in range(12)])
             for _ in range(400)] + ["a b c w1 w2"] * 20 + ["", None]
    p = search._Postings(pa.table({"id": pa.array(range(len(texts)), pa.int64()), "text": texts}))
    df = np.unique(p.term, return_counts=True)[1].astype(np.int64)
    index = search.Index(p, df, len(texts), int(p.length.sum()), 1.2, 0.75, 128)
    assert 0 < len(index.wide) and index.wide.size <= len(p.term)
    assert sorted(index.size[index.row >= 0]) == sorted(index.size)[-len(index.wide):]
    bags = [Counter((t or "").split()) for t in texts]
    count = Counter(w for b in bags for w in b)
    idf = {w: math.log(1 + (len(bags) - f + 0.5) / (f + 0.5)) for w, f in count.items()}
    mean = sum(sum(b.values()) for b in bags) / len(bags)
    for q in (0, 3, 77, 401, 420):
        want = sorted((-math.fsum(idf[w] * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean))
                                  for w in bags[q] if w in b), i) for i, b in enumerate(bags) if bags[q].keys() & b.keys())
        got = index.top(search._terms(texts[q])[0], 10)
        assert [d for d, _ in got] == [i for _, i in want[:10]]
        assert all(abs(s + w) < 1e-9 for (_, s), (w, _) in zip(got, want))


def test_op3_shards_return_what_can_still_be_among_the_best(spark, monkeypatch):
    rnd = random.Random(11)
    texts = [" ".join(f"w{int(80 * rnd.random() ** 2)}" for _ in range(15)) for _ in range(800)]
    made, plain, shards = spark.sparkContext.accumulator(0), search._search, 16

    def counted(*how):
        run = plain(*how)

        def run_counted(left, right):
            out = run(left, right)
            made.add(out.num_rows)
            return out
        return run_counted

    monkeypatch.setattr(search, "_search", counted)
    got = {}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in search.search(docs, F.col("doc_id") % 20 == 0, k=10, shards=shards, queries_per_block=25).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.doc_id, r.score)
    bags = [Counter(t.split()) for t in texts]
    count = Counter(w for b in bags for w in b)
    idf = {w: math.log(1 + (len(bags) - f + 0.5) / (f + 0.5)) for w, f in count.items()}
    mean = sum(sum(b.values()) for b in bags) / len(bags)
    for q in range(0, len(texts), 20):
        want = sorted((-math.fsum(idf[w] * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean))
                                  for w in bags[q] if w in b), i) for i, b in enumerate(bags))[:10]
        assert [got[q][r][0] for r in range(1, 11)] == [i for _, i in want]
        assert all(abs(got[q][r + 1][1] + s) < 1e-9 for r, (s, _) in enumerate(want))
    assert 10 * len(got) <= made.value < 10 * len(got) * shards * 0.6


def test_op3_disk_does_not_grow_with_blocks_of_queries_and_shards(spark):
    from pathlib import Path

    from facetframe.session import ensure_checkpoint_dir
    rnd = random.Random(5)
    words = [f"{rnd.getrandbits(40):x}" for _ in range(4000)]
    texts = [" ".join(words[int(4000 * rnd.random() ** 2)] for _ in range(150)) for _ in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    docs.count()

    def on_disk():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        shared = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
        return (sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle"))
                + sum(f.stat().st_size for f in shared.rglob("*.parquet")))

    got, took = [], []
    for shards, block in ((4, 100_000), (12, 2)):
        before = on_disk()
        got.append(sorted(search.search(docs, F.col("doc_id") % 20 == 0, shards=shards, queries_per_block=block).collect()))
        took.append(on_disk() - before)
    docs.unpersist()
    assert got[0] == got[1] and len(got[0]) == 600
    assert took[1] < 1.5 * sum(map(len, texts)), took


def test_op10_cuts_between_equal_rows(spark):
    # a third of all rows are one row, in three variants of another column
    rows = [(7, "one two three four five six seven eight nine ten", "a", i % 3) for i in range(300)]
    rows += [(1000 + i, "w " * (3 + i % 9), "ab"[i % 2] if i % 5 else None, 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
    names = {r[0]: r[2] for r in rows}
    for r in got:
        taken[names[r.doc_id]] += r.taken
        target[names[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 12 for s in target)
    budget = 1.5 * sum(r.size for r in got)
    assert budget - 12 < sum(taken.values()) <= budget
    mixed = [Counter(map(tuple, mixing.mix_documents(docs.repartition(n)).collect())) for n in (2, 7)]
    assert mixed[0] == mixed[1] and set(mixed[0]) <= set(rows)
    words = Counter()
    for (i, text, _, _), n in mixed[0].items():
        words[i] += n * len(text.split())
    per_id = Counter()
    for r in got:
        per_id[r.doc_id] += r.taken
    assert +words == +per_id
    assert all(n <= 2 * rows.count(r) for r, n in mixed[0].items())
