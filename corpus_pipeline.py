"""A training corpus from raw documents, stage by stage; each stage reads the table that the one before wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns
of the documents: language ID drops texts without a certain language, near-duplicates leave one
document of each group, decontamination drops documents with benchmark passages, mixing repeats or
leaves out documents towards its sources' targets, and token ids go to files whose contents per
document are the result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.llm.cube import mix
from pageloom.llm.eliasfano import token_digests
from pageloom.llm.language import UNKNOWN, learn, predicted
from pageloom.llm.minhash import deduplicated
from pageloom.llm.tables import saved
from pageloom.llm.wumanber import contamination
from pageloom.plans.catalog import table

#: Least certainty of a language. A guess among the test corpus's four languages has 0.25.
LEAST_SCORE = 0.35
TOKENIZER = "byte_bpe_50k.json"


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language of the corpus; learned from all documents that have one."""
    model = learn(docs.select("doc_id", "lang", "text"))
    rows = docs.select(F.struct("*").alias("row"), "text").withColumn("p", predicted(docs, model))
    return rows.where((F.col("p.lang") != UNKNOWN) & (F.col("p.score") >= LEAST_SCORE)).select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct("*").alias("row"), "text")
    return contamination(rows, table(spark, sf_dir, "benchmark")).where("not contaminated").select("row.*")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", with_language),
    ("MinHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed_sources),
    ("token ids", token_files),
]

#: Language ID, mixing and token ids can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
