"""A corpus from raw documents to packed sequences: quality, exact and near duplicates, benchmark leaks, packing.

Each stage reads what the one before it wrote and drops, or places, whole documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from playbill.llm import decontam, exact, packing, quality, queries, similar
from playbill.llm.runtime import persist_table, step


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels outside the held-out third."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~queries.is_bucket(3, 1))
    return quality.keep_good(docs, model)


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of equal texts."""
    return exact.drop_duplicates(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each class of texts whose sets of five-word shingles have a similarity of 0.8 or more, by SimHash."""
    return similar.keep_one(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold a benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every document's tokens go: sequence, its length, offset."""
    return packing.pack_documents(docs, queries.VOCABULARY)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", first_copies),
    ("SimHash near-dedup", one_of_near_copies),
    ("benchmark decontamination", without_leaks),
    ("best-fit packing", packed),
]

#: A learned classifier and SimHash cannot be written as SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        with step(spark) as keep:
            docs, path = persist_table(stage(spark, docs, sf_dir), f"stage{number}")
            keep.append(path)
    return docs
