"""The corpus pipeline over `documents`: the quality classifier rejects documents, one document of each near-duplicate class stays,
documents that hold benchmark items go, and what is left is encoded. Each stage works on what its predecessor kept and reads it as Parquet.

Defined results: a null or empty text is scored like others, links with nothing and holds no leak; a very long text is read whole by each
stage; of a near-duplicate class the smallest doc_id stays (nulls last; of ties the smallest text hash), and of repeated rows one,
but for rows without words; a row with a null id is treated by its text and keeps its null; an empty table gives an empty result;
columns of any other name go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klaxon.llm import bpe, decontam, ngram_join, quality
from klaxon.llm.common import free, read, save, scratch_mark, text_or_empty


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score at least quality.CUT, by a ranking learned from those that have labels."""
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle similarity of 0.8 or more."""
    return ngram_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without leaked benchmark items."""
    leaks = decontam.find_leaks(docs, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak_id"), F.col("text_key").alias("leak_key")).distinct()
    # The rows travel as one struct, so that none of their columns can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("key"))
    return rows.join(leaks, F.col("id").eqNullSafe(F.col("leak_id")) & (F.col("key") == F.col("leak_key")), "left_anti").select("row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the documents."""
    return bpe.encode_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", byte_bpe),
]
#: A learned classifier and retrieval can't be written in SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, begin = read(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        free(begin, scratch_mark() - 1)  # all but this stage's output
    return STAGES[-1][1](spark, docs, sf_dir)
