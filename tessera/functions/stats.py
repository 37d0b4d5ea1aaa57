"""Statistics over counts, as column expressions; every ratio says what it is for no rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(k: Column, n: Column) -> Column:
    """k / n, 0.0 for n = 0."""
    return F.coalesce(F.try_divide(k.cast("double"), n.cast("double")), F.lit(0.0))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of k successes in n; null for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p, d = k / n, 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return centre - half, centre + half


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p at any n = b + c; 1 for no discordant pair.

    Binomial terms are summed from the largest, i = min(b, c), down and relative
    to it, so none underflows; its own logarithm scales the sum at the end. The
    term j places down is at most exp(-j^2 / (n + 1)) of the largest, so those
    after 7 sqrt(n) + 50 are together below a double's last digit.
    """
    n, k = (b.cast("double") + c.cast("double")), F.least(b, c).cast("double")
    last = F.least(k, F.floor(7 * F.sqrt(n)) + 50).cast("int")
    fold = F.aggregate(
        F.sequence(F.lit(0), last),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, j: F.struct((a["term"] * (k - j) / (n - k + j + 1)).alias("term"), (a["sum"] + a["term"]).alias("sum")),
        lambda a: a["sum"],
    )
    off = (n - 2 * k) / n  # how far k lies below n / 2
    level = F.log(n / (2 * math.pi * k * (n - k))) / 2 - k * F.log1p(-off) - (n - k) * F.log1p(off)
    largest = F.when(k == 0, -n * math.log(2)).otherwise(level + _stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), F.exp(largest + F.log(2 * fold))))


def _stirling_rest(m: Column) -> Column:
    """ln m! less Stirling's formula, for whole m from 1 on: a table below 16, the series from there."""
    few = F.array(*[F.lit(math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - math.log(2 * math.pi) / 2) for i in range(1, 16)])
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * m * m)) / (m * m)) / (m * m)) / m
    return F.when(m < 16, F.get(few, m.cast("int") - 1)).otherwise(series)


def kappa(yes_yes: Column, yes_no: Column, no_yes: Column, no_no: Column) -> Column:
    """Cohen's kappa from the four cells. Null without pairs, and where both raters always give the same one answer (told from the counts, not from a quotient)."""
    n = (yes_yes + yes_no + no_yes + no_no).cast("double")
    constant = ((yes_no + no_yes) == 0) & ((yes_yes == 0) | (no_no == 0))
    observed = (yes_yes + no_no) / n
    expected = ((yes_yes + yes_no) * (yes_yes + no_yes) + (no_yes + no_no) * (yes_no + no_no)) / (n * n)
    return F.when((n > 0) & ~constant, (observed - expected) / (1 - expected))


def pair_cells(a: Column, b: Column) -> dict[str, Column]:
    """Aggregates over pairs of booleans; a pair with a null is skipped and counted."""
    both = a.isNotNull() & b.isNotNull()
    cell = lambda x, y: F.count_if(both & (a if x else ~a) & (b if y else ~b))
    return {"yes_yes": cell(True, True), "yes_no": cell(True, False), "no_yes": cell(False, True), "no_no": cell(False, False), "skipped": F.count_if(~both)}


def agreement(rows: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """n, agree, rate, kappa, the four cells and skipped; all cells are there for every group, and without groups also for no rows."""
    cells = rows.groupBy(*(by or [])).agg(*[v.alias(k) for k, v in pair_cells(F.col(a), F.col(b)).items()])
    c = [F.col(k) for k in ("yes_yes", "yes_no", "no_yes", "no_no")]
    n, agree = c[0] + c[1] + c[2] + c[3], c[0] + c[3]
    return cells.select(*(by or []), n.alias("n"), agree.alias("agree"), F.round(ratio(agree, n), 6).alias("rate"), F.round(kappa(*c), 6).alias("kappa"), "yes_yes", "yes_no", "no_yes", "no_no", "skipped")


def confusion(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """tp, fp, fn, tn and both rates, null where a rate has no denominator."""
    cells = rows.agg(*[v.alias(k) for k, v in pair_cells(F.col(predicted), F.col(actual)).items()])
    tp, fp, fn, tn = (F.col(k) for k in ("yes_yes", "yes_no", "no_yes", "no_no"))
    rate = lambda k, n: F.round(F.try_divide(k.cast("double"), n.cast("double")), 6)
    return cells.select(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), rate(tp, tp + fn).alias("tpr"), rate(tn, tn + fp).alias("tnr"))


def correlation(rows: DataFrame, a: str, b: str, far: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """n, Pearson's r and the count of pairs further apart than ``far``; r is null if a side has fewer than two values. From sums, so a constant side divides by nothing."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    pairs = rows.where(x.isNotNull() & y.isNotNull())
    s = pairs.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.covar_pop(x, y).alias("xy"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count_if(F.abs(x - y) > far).alias("far_apart")
    )
    varied = (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    r = F.when(varied, F.try_divide(F.col("xy"), F.col("sx") * F.col("sy")))
    return s.select(*(by or []), "n", F.round(r, 6).alias("r"), "far_apart")


def bootstrap(values: DataFrame, column: str, n_boot: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Percentile bootstrap of the mean: (n, mean, low, high).

    Draws are hashes of (seed, repetition, draw) modulo n, so they repeat on any
    cluster; they differ from those of any other generator. The values are
    numbered by ranges; repetitions x n draws are a range of numbers dealt to all tasks, and
    means are summed where they are made. Only the repetitions' means, ``n_boot`` numbers, are sorted in one place.
    """
    from ..operators.ranks import running_total

    spark = values.sparkSession
    given = values.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    n = given.count()
    if not n:
        return spark.createDataFrame([(0, None, None, None)], "n long, mean double, low double, high double")
    numbered = running_total(given.withColumn("one", F.lit(1).cast("long")), ["v"], "one", "i").select("i", "v")
    draws = spark.range(n_boot * n).select(F.expr(f"id div {n}").alias("rep"), (F.col("id") % n).alias("draw"))
    drawn = draws.select("rep", F.pmod(F.xxhash64(F.lit(seed), "rep", "draw"), F.lit(n)).alias("i"))
    means = drawn.join(numbered, "i").groupBy("rep").agg(F.avg("v").alias("m"))
    placed = means.withColumn("place", F.row_number().over(Window.orderBy("m")) - 1)
    low, high = int(alpha / 2 * n_boot), int((1 - alpha / 2) * n_boot)
    ends = placed.agg(F.max(F.when(F.col("place") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("place") == min(high, n_boot - 1), F.col("m"))).alias("high"))
    return given.agg(F.count("*").alias("n"), F.avg("v").alias("mean")).crossJoin(ends)  # one row each
