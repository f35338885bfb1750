"""Corpus preparation: the stages that turn ``documents`` into training sequences.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; :func:`run` writes every stage's result
as Parquet under ``spark.checkpoint.dir`` and hands the reread table to the next. All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetframe.llm import language, minhash, mixing, packing, substring_dedup
from facetframe.llm.common import shared_table, prepare_workers
from facetframe.sources.catalog import table_path

TOKENIZER = "word_bpe_49k.json"
SEQUENCE_TOKENS = 4096


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; a missing label is filled in. Rejected are texts
    without a letter, texts of whose words more than half have no known n-gram, and texts whose
    words speak for the predicted language less than by chance, one in the number of languages."""
    prepare_workers(spark)
    model = language.learn(docs)
    out = language.predict(docs, model, carry=tuple(docs.columns), prefix="__")
    known = ((F.col("__lang_pred") != language.UNKNOWN) & (F.col("__evidence") >= 0.5)
             & (F.col("__score") >= 1 / max(1, len(model.langs))))
    return (out.where(known).withColumn("lang", F.coalesce("lang", "__lang_pred"))
            .select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id."""
    prepare_workers(spark)
    gone = (minhash.near_duplicates(docs).where(~F.col("kept"))
            .select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, docs.doc_id == gone["__gone"], "left_anti")


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of words go from the texts; texts left without a word go."""
    prepare_workers(spark)
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = substring_dedup.remove_repeats(docs, carry=rest, with_text=True)
    cut = F.col("n_removed") > 0
    return (out.where(~cut | (F.col("n_removed") < F.col("n_words")))
            .withColumn("n_chars", F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")))
            .withColumn("text", F.col("kept_text")).select(*docs.columns))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in which sequence."""
    prepare_workers(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), capacity=SEQUENCE_TOKENS)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # learned models and hashing have no SQL form; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else shared_table(out, name)
    return docs
