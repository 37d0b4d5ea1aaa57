"""Ranks and running sums over large groups, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

SLICE_ROWS, MOST_SLICES = 1_000_000, 65_536


def slices_for(rows: int, least: int = 16, per: int = SLICE_ROWS) -> int:
    """Slices of about ``per`` rows, or of as much of any other measure of the table, were all rows in one group."""
    return max(least, min(MOST_SLICES, -(-rows // per)))


def gapless_rank(df: DataFrame, group: str | list[str], order: list[Column], name: str, spread: Column, slices: int) -> DataFrame:
    """Add ``name``: each row's rank from 0 within its group, without one task per group.

    A group is cut into ``slices`` by the hash ``spread``; rows are ranked inside
    (group, slice) and shifted by the count of the slices before. So ranks follow
    slices first, then ``order``, which must be total but for rows equal in every
    column. The table of counts has at most groups x slices rows.
    """
    keys = [group] if isinstance(group, str) else list(group)
    cut = df.withColumn("__slice", F.pmod(spread, F.lit(slices)).cast("int"))
    counts = cut.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inner = Window.partitionBy(*keys, "__slice").orderBy(*order)
    ranked = cut.withColumn("__i", F.row_number().over(inner) - 1)
    return ranked.join(starts, [*keys, "__slice"]).withColumn(name, (F.col("__start") + F.col("__i")).cast("long")).drop("__slice", "__start", "__i")


def running_total(df: DataFrame, order: list[str], value: str | list[str], name: str | list[str]) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows before, in one total order, without one task: a range sort, then sums by partition.

    The sums per partition go to the driver: one row for each partition. Several
    values get their names pairwise.
    """
    values, names = ([value], [name]) if isinstance(value, str) else (value, name)
    spark = df.sparkSession
    ranged = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    types = [ranged.select(F.sum(v)).schema[0].dataType.simpleString() for v in values]
    at, starts = [0] * len(values), []
    for part, *totals in ranged.groupBy("__part").agg(*[F.sum(v) for v in values]).orderBy("__part").collect():
        starts.append((part, *at))
        at = [a + t for a, t in zip(at, totals, strict=True)]
    columns = ", ".join(["__part int", *(f"__start{i} {t}" for i, t in enumerate(types))])
    table = F.broadcast(spark.createDataFrame(starts, columns))  # one row per partition
    before = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({f"__own{i}": F.coalesce(F.sum(v).over(before), F.lit(0)) for i, v in enumerate(values)}).join(table, "__part")
    out = out.withColumns({n: F.col(f"__start{i}") + F.col(f"__own{i}") for i, n in enumerate(names)})
    return out.drop("__part", *[f"__own{i}" for i in range(len(values))], *[f"__start{i}" for i in range(len(values))])


def ordered_rank(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Add ``name``: each row's place from 0 in its group, in the order of columns that are total within it, without one task per group.

    Rows are dealt by ranges of (group, order); a place is the number of rows before, less that before the group. Null is a group, too.
    """
    placed = running_total(df.withColumn("__one", F.lit(1).cast("long")), [group, *order], "__one", "__at")
    firsts = placed.groupBy(F.col(group).alias("__group")).agg(F.min("__at").alias("__first"))
    joined = placed.join(firsts, placed[group].eqNullSafe(firsts["__group"]))
    return joined.withColumn(name, (F.col("__at") - F.col("__first")).cast("long")).drop("__one", "__at", "__group", "__first")
