"""Registered queries of the training-data operators, and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from facetframe.llm import (byte_bpe, collocations, katz, language, licenses, minhash, mixing, packing, quality, search,
                            spelling, substring_dedup, token_count)
from facetframe.llm.common import prepare_workers
from facetframe.sources.catalog import table_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare_workers(spark)
    return spark.read.parquet(table_path(sf_dir, "documents"))


def op1_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_documents(spark, sf_dir), F.col("doc_id") % 20 == 0, k=10)


def op4_risk_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(table_path(sf_dir, "labels"))
    return quality.judge(_documents(spark, sf_dir), labels)


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return katz.score_documents(docs, language.in_fold(F.col("doc_id"), 7, 2))


def op6_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir), window=20)


def op7_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = language.in_fold(F.col("doc_id"), 4, 2)
    model = language.learn(docs.where(~held_out))
    return (language.predict(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), shingle=4)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir), min_count=100, most=5, top=2000)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(_documents(spark, sf_dir), min_length=7, min_count=2, noise=31)
    return spelling.group_variants(words, ratio=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit": op1_best_fit,
    "op2_transducer": op2_transducer,
    "op3_block_max": op3_block_max,
    "op4_risk_control": op4_risk_control,
    "op5_katz": op5_katz,
    "op6_difference_cover": op6_difference_cover,
    "op7_word_backoff": op7_word_backoff,
    "op8_licenses": op8_licenses,
    "op9_minhash": op9_minhash,
    "op10_mixing": op10_mixing,
    "op11_collocations": op11_collocations,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_spelling": op13_spelling,
}

SQL: dict[str, str] = {
    "op8_licenses": licenses.oracle_sql(),
    "op11_collocations": collocations.oracle_sql(),
    "op13_spelling": spelling.oracle_sql(),
}
