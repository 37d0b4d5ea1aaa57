"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, with built-in functions only.

Every shard has ``vnodes`` points on a ring of 64-bit hashes. A row's key is its
text, so copies of a text meet in one shard as far as the bound allows; rows of
one arc are ordered by the hash of their id. A shard that is full passes what
overflows to the next point clockwise. The shards' bounds add up to the number
of rows and differ by one at most, so every shard ends exactly at its bound:
the law is ``rows``. (``load_factor`` above 1 gives the usual looser bound, with
fewer moves.)

Only one count per arc (shards x vnodes numbers, whatever the input's size)
reaches the driver, where the walk around the ring is done on counts; rows find
their shard by their rank in their arc. Ranks are taken in slices of an arc, so
a text that a third of all rows share is not one task.

Defined cases: a null text is an empty one (size 1, crc32 0); a null id hashes
like any other value; repeated rows are rows of their own, and which of two
equal rows gets which slot makes no difference; further columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless_rank, slices_for

SHARDS, VNODES = 16, 64


def mix(x: int) -> int:
    """A 64-bit finaliser; spreads the virtual nodes on the ring."""
    x = (x + 0x9E3779B97F4A7C15) % 2**64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
    return x ^ (x >> 31)


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Points (position as a signed long, shard) in order; a shard's points do not depend on how many shards there are."""
    return sorted((mix((s << 32) + v + 1) - 2**63, s) for s in range(shards) for v in range(vnodes))


def bounds(n: int, shards: int, load_factor: float = 1.0) -> list[int]:
    if load_factor == 1.0:
        return [n // shards + (s < n % shards) for s in range(shards)]
    most = -(-int(n * load_factor * 1_000_000) // (shards * 1_000_000))
    return [max(most, -(-n // shards))] * shards


def walk(counts: dict[int, int], points: list[tuple[int, int]], limits: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Segments (arc, from rank, to rank, shard, first slot).

    Arc i ends at point i and belongs to its shard. Every arc first takes from
    its own shard, in ring order; what is left then goes clockwise, again in
    ring order, to shards with room. A shard never has more than its limit.
    """
    filled = [0] * len(limits)
    out, left = [], []

    def take(arc: int, at: int, n: int, shard: int) -> int:
        if got := min(n, limits[shard] - filled[shard]):
            out.append((arc, at, at + got, shard, filled[shard]))
            filled[shard] += got
        return got

    for arc, (_, shard) in enumerate(points):
        n = counts.get(arc, 0)
        got = take(arc, 0, n, shard) if n else 0
        if got < n:
            left.append((arc, got, n))
    for arc, at, n in left:
        step = 1
        while at < n:
            at += take(arc, at, n - at, points[(arc + step) % len(points)][1])
            step += 1
    return out


def place(rows: DataFrame, key: Column, order: list[Column], spread: Column, shards: int = SHARDS, vnodes: int = VNODES, load_factor: float = 1.0) -> DataFrame:
    """Add shard and slot. ``rows`` is read twice, for counts and for ranks, so it should hold narrow columns only."""
    spark, points = rows.sparkSession, ring(shards, vnodes)
    # the arc is found by a join of a coarse cell with the points in it: cells x points is constant
    cut = 12
    starts = [p for p, _ in points]
    cells = [(c, bisect.bisect_left(starts, (c << (64 - cut)) - 2**63)) for c in range(1 << cut)]
    table = []
    for c, lo in cells:
        hi = bisect.bisect_left(starts, ((c + 1) << (64 - cut)) - 2**63)
        inside = [starts[i] for i in range(lo, hi)]
        table.append((c, lo, inside))
    grid = F.broadcast(spark.createDataFrame(table, "__cell int, __lo int, __inside array<bigint>"))  # 4096 cells
    placed = rows.withColumn("__pos", F.xxhash64(key)).withColumn("__cell", (F.shiftright(F.col("__pos"), 64 - cut) + (1 << (cut - 1))).cast("int"))
    passed = F.size(F.filter("__inside", lambda p: p < F.col("__pos")))
    placed = placed.join(grid, "__cell").withColumn("__arc", F.pmod(F.col("__lo") + passed, F.lit(len(points))).cast("int")).drop("__cell", "__lo", "__inside", "__pos")
    counts = {r[0]: r[1] for r in placed.groupBy("__arc").count().collect()}  # shards x vnodes rows at most
    segments = walk(counts, points, bounds(sum(counts.values()), shards, load_factor))
    parts = F.broadcast(spark.createDataFrame(segments, "__arc int, __from long, __to long, shard int, __slot long"))  # arcs + shards x wraps rows
    ranked = gapless_rank(placed, "__arc", order, "__rank", spread, slices_for(sum(counts.values())))
    inside = (ranked["__arc"] == parts["__arc"]) & (ranked["__rank"] >= parts["__from"]) & (ranked["__rank"] < parts["__to"])
    joined = ranked.join(parts, inside).drop(parts["__arc"])
    return joined.withColumn("slot", F.col("__slot") + F.col("__rank") - F.col("__from")).drop("__arc", "__rank", "__from", "__to", "__slot")


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, vnodes: int = VNODES, load_factor: float = 1.0) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("__key"))
    spread = F.xxhash64("doc_id", F.lit("slice"))
    placed = place(slim, F.col("__key"), [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_crc32"), F.col("size")], spread, shards, vnodes, load_factor)
    law = "rows" if load_factor == 1.0 else "bounded"
    return placed.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
