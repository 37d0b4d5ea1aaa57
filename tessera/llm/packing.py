"""Packing by optimal length buckets.

A row's length is its number of words, or of token ids where they are given, plus one end mark. One histogram of all
lengths goes to the driver, where dynamic programming chooses the bucket bounds
that need the least padding over the whole table; inside each bucket, rows in
the order of their ids' hashes form batches of as many rows as the token budget
holds at the bucket's bound.

The histogram has one cell per length that occurs, so the bounds are optimal at
any length. Distinct lengths add up to at most the words of the table, so there
are fewer than the square root of twice its words.

Defined cases: a null or empty text has length 1; a row longer than the budget
is a batch of its own, never cut; repeated rows are rows of their own; null ids
are kept; further columns are not read, or carried along; an empty table gives an empty result; with
no more distinct lengths than buckets each length is a bucket and no padding is left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless_rank, materialize, slices_for, words

BUCKETS, BUDGET = 12, 32768
SLICE_TOKENS = 4_000_000  # of carried texts, some 30 MB
COLUMNS = ("doc_id", "n_tokens", "bucket", "bucket_bound", "batch", "slot", "padding")


def best_bounds(longest: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` runs of cells with the least sum of (bound - length). Of equal splits the earliest cut wins.

    The costs obey the quadrangle inequality, so the best cut never moves down as the
    end moves up: halving the ends halves the cuts to try, n log n costs a bucket.
    """
    n = len(longest)
    if n <= buckets:
        return [int(x) for x in longest]
    rows, sums = np.concatenate([[0], np.cumsum(count)]).astype(float), np.concatenate([[0], np.cumsum(total)]).astype(float)
    best = np.concatenate([[0.0], longest * rows[1:] - sums[1:]])
    cuts = []
    for k in range(2, buckets + 1):
        now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        now[0] = 0
        todo = [(k, n, k - 1, n - 1)]
        while todo:
            first, last, low, high = todo.pop()
            j = (first + last) // 2
            end = min(high + 1, j)
            cost = best[low:end] + longest[j - 1] * (rows[j] - rows[low:end]) - (sums[j] - sums[low:end])
            i = int(cost.argmin())
            now[j], cut[j] = cost[i], low + i
            if first < j:
                todo.append((first, j - 1, low, low + i))
            if j < last:
                todo.append((j + 1, last, low + i, high))
        best = now
        cuts.append(cut)
    out, j = [], n
    for cut in cuts[::-1]:
        out.append(int(longest[j - 1]))
        j = int(cut[j])
    return [int(longest[j - 1]), *out[::-1]] if j else out[::-1]


def length_bounds(lengths: DataFrame, length: str = "n_tokens", buckets: int = BUCKETS) -> list[int]:
    cells = lengths.groupBy(length).agg(F.count("*").alias("n")).orderBy(length).toArrow()
    longest, count = (cells.column(k).to_numpy().astype(np.int64) for k in (length, "n"))
    return best_bounds(longest, count, longest * count, buckets)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, ids: str | None = None, carry: bool = False) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_bound, batch (from 0 in each bucket), slot (from 0 in each batch), padding.

    With ``ids``, a column of token ids, a row's length is their number plus the end
    mark. With ``carry`` the other columns of ``docs`` follow; one whose name is
    taken by the result's gets underscores in front.
    """
    size = F.size(words(F.col(text))) if ids is None else F.coalesce(F.size(F.col(ids)), F.lit(0))
    length = (F.greatest(size, F.lit(0)) + 1).cast("long")
    own = docs.select(F.col(doc_id).alias("doc_id"), length.alias("n_tokens"))
    rest: dict[str, str] = {}
    if carry:
        taken = {*COLUMNS, "rank"}
        for c in docs.columns:
            if c != doc_id:
                name = c
                while name.lower() in taken:
                    name = "_" + name
                taken.add(name.lower())
                rest[name] = c
        own = docs.select(F.col(doc_id).alias("doc_id"), length.alias("n_tokens"), *[F.col(f"`{c}`").alias(name) for name, c in rest.items()])
    lengths = materialize(own, "lengths", compression="zstd")
    bounds = length_bounds(lengths, buckets=buckets) or [1]
    total, rows = lengths.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    slices = slices_for(total, per=SLICE_TOKENS) if carry else slices_for(rows)
    bucket = sum(((F.col("n_tokens") > b).cast("int") for b in bounds[:-1]), F.lit(0))
    bound = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    per_batch = F.element_at(F.array(*[F.lit(max(1, budget // b)).cast("long") for b in bounds]), F.col("bucket") + 1)
    ranked = gapless_rank(lengths.withColumn("bucket", bucket), "bucket", [F.xxhash64("doc_id"), F.col("doc_id"), F.col("n_tokens")], "rank", F.xxhash64("doc_id", F.lit("slice")), slices)
    return ranked.select(
        "doc_id",
        "n_tokens",
        "bucket",
        bound.alias("bucket_bound"),
        F.floor(F.col("rank") / per_batch).alias("batch"),
        (F.col("rank") % per_batch).alias("slot"),
        (bound - F.col("n_tokens")).alias("padding"),
        *[F.col(f"`{c}`") for c in rest],
    )


def token_batches(docs: DataFrame, doc_id: str = "doc_id", ids: str = "ids", buckets: int = BUCKETS, budget: int = BUDGET, end: int = 2, pad: int = 0) -> DataFrame:
    """The batches themselves: bucket, batch, width, doc_ids, lengths, and tokens, one row of ids for each document with the end mark after it and filled to the width.

    A batch holds ``budget`` ids at most, or one longer row, so none grows with the table.
    Null ids are an empty row; null doc_ids stand as null in ``doc_ids``.
    """
    packed = pack(docs.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")), text="ids", buckets=buckets, budget=budget, ids="ids", carry=True)
    given = F.coalesce("ids", F.array().cast("array<int>"))
    row = F.concat(given, F.array(F.lit(end)), F.array_repeat(F.lit(pad), F.col("padding").cast("int")))
    one = F.struct("slot", "doc_id", F.col("n_tokens").alias("length"), row.alias("tokens"))
    whole = packed.groupBy("bucket", "batch").agg(F.first("bucket_bound").alias("width"), F.array_sort(F.collect_list(one)).alias("rows"))
    return whole.select("bucket", "batch", "width", F.col("rows.doc_id").alias("doc_ids"), F.col("rows.length").alias("lengths"), F.col("rows.tokens").alias("tokens"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
