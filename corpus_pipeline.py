"""A corpus in five stages, each on all that the one before kept.

language_id: documents that no language profile fits (no letters, or no n-gram of any profile) go.
near_dedup: of each class of near duplicates the document with the smallest id stays.
suffix_dedup: byte strings of 200 and more that repeat are cut out of the texts; every document stays.
decontamination: documents of which benchmark windows cover a twentieth or more go.
piece_coding: every text is encoded; token counts and digests are the result.

All stages but the last return the columns of documents. SQL can't express the stages (alignment, n-gram ranks,
byte-wise cuts, merges), so ORACLE_SQL is None and tests/llm compares with a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.llm import decontaminate, language_id, near_dedup, piece_coding, suffix_dedup
from tracelane.llm.common import discard, scratch, staged
from tracelane.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = docs.select(*COLUMNS)
    profiles = language_id.learn_profiles(docs.where(~language_id.held_out()))
    placed = language_id.with_language(docs, profiles, keep_text=True)
    return placed.where(~language_id.rejected()).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dedup.first_of_each_class(docs).select(*COLUMNS)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    cut = suffix_dedup.cut_repeats(docs.select("doc_id", "text", "lang", "source"), keep_text=True)
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminated(docs, benchmark, keep_text=True).where(~F.col("contaminated")).select(*COLUMNS)


def piece_coding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_coding.with_pieces(docs.select("doc_id", "lang", "source", "text"), model, results=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontamination", decontamination_stage),
    ("piece_coding", piece_coding_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written goes when the next one has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(staged(stage(spark, docs, sf_dir), name))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
