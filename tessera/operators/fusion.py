"""Reciprocal rank fusion and the retrievers made of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, DEPTH, RRF_K, DIGITS = 5, 10, 60, 9


def fuse(rankings: list[DataFrame], k: int = K, rrf_k: int = RRF_K) -> DataFrame:
    """Rankings of (qid, rank, text, source, distance) to (qid, rank, text, source, distance, rrf_score, ranks).

    Rows with equal text are one; each occurrence adds 1 / (rrf_k + rank), also
    within one ranking. Ties and all other columns go by what was met first:
    earlier rankings, then better ranks. A group-by stands in for the outer join.
    """
    tagged = None
    for n, r in enumerate(rankings):
        part = r.select("qid", "rank", "text", "source", F.col("distance").cast("double").alias("distance"), F.lit(n).alias("n"))
        tagged = part if tagged is None else tagged.unionByName(part)
    first = F.min(F.struct("n", "rank", "source", "distance"))
    each = tagged.groupBy("qid", "text").agg(F.round(F.sum(1 / (F.lit(rrf_k) + F.col("rank"))), DIGITS).alias("rrf_score"), first.alias("first"), F.array_sort(F.collect_list(F.struct("n", "rank"))).alias("met"))
    order = Window.partitionBy("qid").orderBy(F.desc("rrf_score"), "first.n", "first.rank")
    best = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return best.select("qid", F.col("place").alias("rank"), "text", "first.source", "first.distance", "rrf_score", F.transform("met", lambda m: m["rank"]).alias("ranks"))


def insert_at(retrieved: DataFrame, extra: DataFrame, position: int, k: int = K) -> DataFrame:
    """Put one row per question (qid, text, source) at a rank; what stood there and below moves down, what falls beyond k goes."""
    moved = retrieved.withColumn("rank", F.when(F.col("rank") >= position, F.col("rank") + 1).otherwise(F.col("rank")))
    return moved.unionByName(extra.withColumn("rank", F.lit(position)), allowMissingColumns=True).where(F.col("rank") <= k)
