"""A training-data pipeline over the documents table, in stages of the corpus operators.

Each stage reads what the one before it kept and is written as Parquet before the next one starts,
so a lost executor costs a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    decontamination,
    jaccard_join,
    quality_classifier,
    sentencepiece_viterbi,
    suffix_dedup,
)
from ledgerloom.session import stage

#: Passages of over 50 words that repeat go, however short their words are.
PASSAGE_WORDS = 51


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to the labelled ones, does not reject."""
    machine = quality_classifier.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.score_quality(docs, machine, docs.columns, score="__score")
    return scored.filter(F.col("__score") >= quality_classifier.THRESHOLD).drop("__score")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 the smallest id."""
    return jaccard_join.one_of_each_group(docs, words=5, num=80, den=100)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes or 51 words that occur elsewhere too; emptied ones go."""
    return suffix_dedup.without_repeats(docs, words=PASSAGE_WORDS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth are from benchmark items."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding them again."""
    found = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(docs))
    return found.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("suffix-array dedup", without_repeated_passages),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding and decoding", encoded),
]
#: SQL can't express the classifier; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, apply) in enumerate(STAGES):
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
