"""Corpus pipeline: five stages over all documents, each calling one operator.

toxicity drops what it rejects; jaccard_join keeps one document of each group of near
copies (five-word shingles, similarity 0.8); substring_dedup cuts passages of 50 words
or more that repeat; secret_scan masks what it finds; packing lays the rest out in bins,
by the tokens of a public byte-level tokenizer. Every stage works on all rows that the one
before it kept; what it wrote to do so is removed when its own result is saved. Null and
empty texts pass all stages (an empty text packs as its end id), repeated rows are one
after the second stage unless they have no words, columns of any name are kept up to the
last stage, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import cluster, jaccard, packing, secrets, substrings, toxicity


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, shingle=5, num=4, den=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(docs, window=50).withColumn("n_chars", F.length("text").cast("long"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic_documents),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't fit the toxicity model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), cluster.made()
    for name, stage in STAGES[:-1]:
        docs = cluster.released(stage(spark, docs, sf_dir), name, since)
    return STAGES[-1][1](spark, docs, sf_dir)
