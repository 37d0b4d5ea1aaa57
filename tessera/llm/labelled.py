"""Bounded, deterministic samples of labelled rows for fitting classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches

FIT_BYTES = 48 << 20


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def training_sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, held_out: int, per_class: int) -> tuple[pa.Array, np.ndarray, float]:
    """(texts, labels, log odds of label 1 over all labels outside the held-out fold).

    At most ``per_class`` ids of each label outside the fold, those of smallest
    hash, as long as their texts, taken whole and in that order, come to no more
    than ``FIT_BYTES`` (texts of more than a 48th of that are not learned from); of an id on several rows one text is taken. Labels other than 0 and 1
    don't count; where one id has both, 1 counts.
    """
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    known = known.groupBy("doc_id").agg(F.max(target).alias("y"))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 x per_class rows
    rows = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    so_far = F.sum(size).over(Window.orderBy(*order))  # over 2 x per_class rows
    rows = rows.where(size <= FIT_BYTES // 48)
    table = rows.withColumn("so_far", so_far).where(F.col("so_far") <= FIT_BYTES).orderBy(*order).select("text", "y").toArrow()
    return table.column("text").combine_chunks(), table.column("y").to_numpy().astype(np.float64), float(np.log((totals.get(1, 0) + 1) / (totals.get(0, 0) + 1)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def score_rows(docs: DataFrame, scorer, limit: float, folds: int, held_out: int) -> DataFrame:
    """doc_id, held_out, score, predicted; ``scorer`` maps an Arrow column of texts to an array of scores."""

    def run(batches):
        for batch in batches:
            scores = np.asarray(scorer(batch.column(1)), np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    bounded_batches(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
