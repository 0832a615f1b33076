"""The training-data pipeline: each stage reads what the one before it wrote.

quality rules -> n-gram Jaccard join -> PII surrogates -> mixing -> encoding.
A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of ``documents``; the last returns ids of pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.rows import materialize
from tallyscope.llm import cube_mix, parity_join, piece_viterbi, quality_rules, surrogates
from tallyscope.llm.common import packed, unpacked


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list accept."""
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(packed(docs, "text"), rules).where("kept").select(*unpacked(docs.columns, "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return parity_join.keep_one(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; ``n_chars`` follows the new text."""
    new = surrogates.replaced(packed(docs, "text", "n_chars"))
    return new.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*unpacked(docs.columns, "text", "n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return cube_mix.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document taken."""
    return piece_viterbi.encoded(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("PII", private_data), ("mixing", mix), ("encoding", encode)]

#: Learned rules, keyed surrogates and pieces are not SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
