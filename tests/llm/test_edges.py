"""Every operator and stage on the edge table and on an empty one: defined results, no crash."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from facetframe.llm import (byte_bpe, collocations, katz, language, licenses, minhash, mixing, packing, quality, search,
                            spelling, substring_dedup, token_count)

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 0), (3, None, None), (999, 1, 0), (2, 1, 0)],
                                 "doc_id long, quality int, toxic int")


OPERATORS = {
    "packing": lambda s, d: packing.pack(d, WORDS),
    "token_count": lambda s, d: token_count.count_tokens(d, PIECES),
    "search": lambda s, d: search.search(d, F.col("doc_id") % 20 == 0),
    "quality": lambda s, d: quality.judge(d, _labels(s)),
    "katz": lambda s, d: katz.score_documents(d, language.in_fold(F.col("doc_id"), 7, 2)),
    "substring": lambda s, d: substring_dedup.remove_repeats(d, carry=("part", "source"), with_text=True),
    "language": lambda s, d: language.predict(d, language.learn(d), carry=("doc_id", "score", "text"), prefix="p_"),
    "licenses": lambda s, d: licenses.scan(d),
    "minhash": lambda s, d: minhash.near_duplicates(d),
    "mixing": lambda s, d: mixing.mix_sources(d),
    "mix_documents": lambda s, d: mixing.mix_documents(d),
    "collocations": lambda s, d: collocations.collocations(d, min_count=2, shards=2, filter_bits=12),
    "byte_bpe": lambda s, d: byte_bpe.digests(d, BYTES),
    "spelling": lambda s, d: spelling.group_variants(spelling.vocabulary(d, noise=31), filter_bits=15),
}
PER_ROW = ("token_count", "quality", "katz", "substring", "language", "minhash", "mixing", "byte_bpe")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, empty, name):
    assert OPERATORS[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edge_table(spark, edge, name):
    rows = OPERATORS[name](spark, edge).collect()
    again = OPERATORS[name](spark, edge).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    if name in PER_ROW:
        want = [r.doc_id for r in edge.select("doc_id").collect()]
        assert sorted(map(repr, want)) == sorted(repr(r.doc_id) for r in rows)


def test_edge_values(spark, edge):
    tokens = {r.doc_id: r for r in OPERATORS["token_count"](spark, edge).collect()}
    assert tokens[3].n_tokens == tokens[4].n_tokens == 0 and tokens[7].over_limit
    near = {r.doc_id: r for r in OPERATORS["minhash"](spark, edge).collect() if r.doc_id is not None}
    assert near[2].component_id == 1 and not near[2].kept and near[3].component_id == 3
    assert near[120].component_id == 100 and near[3].n_shingles == 0 and near[100].n_shingles == 1
    repeats = {r.doc_id: r for r in OPERATORS["substring"](spark, edge).collect()}
    assert repeats[10].n_removed == 0 and repeats[20].n_removed == 60 and repeats[40].n_removed == 120
    assert repeats[3].n_words == 0 and repeats[20].kept_text == "start end"
    langs = {r.doc_id: r for r in OPERATORS["language"](spark, edge).collect()}
    assert langs[3].p_lang_pred == langs[8].p_lang_pred == "und" and langs[3].p_score == 0
    found = OPERATORS["licenses"](spark, edge).collect()
    assert [(r.doc_id, r.unit, r.license, r.dice) for r in found] == [(60, 0, "MIT", 1.0)]
    sizes = {r.doc_id: r for r in OPERATORS["mixing"](spark, edge).collect()}
    assert sizes[3].taken == sizes[5].size == 0 and all(r.taken <= 2 * r.size for r in sizes.values())
    judged = {r.doc_id: r for r in OPERATORS["quality"](spark, edge).collect()}
    assert judged[3].base_failed and judged[80].base_failed and judged[80].n_repeat_words == 50


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, edge, empty, name, stage):
    for table in (edge, empty):
        out = stage(spark, table, "")
        rows = out.collect()
        if name != "packing":
            assert out.columns == table.columns
        assert table is edge or rows == []
