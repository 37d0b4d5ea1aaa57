"""The corpus pipeline: four stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import cnn, minhash, packing, quality_rules
from tessera.llm.common import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network takes for good; it learns from the labels beside the table, texts from the same table.

    Null and empty texts are scored as empty ones; repeated rows are each judged, alike; rows with a null id are judged by their text;
    without labels every score is 0.5 and all rows stay; all columns are returned as they are; an empty table gives an empty one.
    """
    model = cnn.fit_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cnn.keep_rows(docs, model)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host passes.

    Null and empty texts have no words and go; a null source belongs to no host; repeated rows count as often as they stand and
    are judged alike; all columns are returned as they are; an empty table gives an empty one.
    """
    return quality_rules.keep_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id; of repeated rows of one id and text, one.

    Rows without words or without an id stay; all columns are returned as they are; an empty table gives an empty one.
    """
    return minhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its bucket, batch and slot, and its text and other columns, so that batches can be written; no row is dropped or cut.

    Null and empty texts have length 1; repeated rows and null ids are rows of their own; an empty table gives an empty result; a
    column whose name the result takes gets underscores in front.
    """
    return packing.pack(docs, carry=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("near_dedup", near_dedup),
    ("packing", pack),
]

#: The classifier and the packing can't be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
