"""A training-data pipeline over ``documents``: quality, near duplicates, decontamination, secrets, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. ``run``
writes each stage's rows as Parquet below the folder in ``spark.checkpoint.dir`` and reads them
again for the next one, so a lost executor costs at most the stage at work.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from bridgeflow.llm import decontaminate, jaccard, quality, queries, secrets
from bridgeflow.llm.common import table
from bridgeflow.session import shared_folder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    names = docs.columns
    kept = docs.withColumn("__text", F.col("text"))
    scored = quality.score(kept, queries.quality_model(spark, docs, sf_dir), text="__text", keep=names)
    return scored.filter(quality.predicted(F.col("score")) == 1).select(*names)


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes that they stand for."""
    return queries.encoded(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", first_of_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("byte-level BPE", tokens),
]

#: A learned classifier decides first, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
