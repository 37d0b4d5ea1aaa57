"""Small relational exercises: duplicates, pairs, anagrams, intervals, prefix products and the like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(value).agg(F.count("*").alias("n")).where("n > 1")


def two_sum(rows: DataFrame, pos: str, value: str, target: int) -> DataFrame:
    """The pair of places (i, j), i before j, whose values add up to the target: smallest j, then latest i. An equi-join, no loop."""
    a, b = rows.select(F.col(pos).alias("i"), F.col(value).alias("x")), rows.select(F.col(pos).alias("j"), (F.lit(target) - F.col(value)).alias("x"))
    return a.join(b, "x").where("i < j").select("i", "j").orderBy("j", F.desc("i")).limit(1)


def two_sum_sorted(rows: DataFrame, pos: str, value: str, target: int) -> DataFrame:
    """For values that rise with their places: the pair (i, j) that two pointers from both ends would meet first, which is the one with the smallest i, then the greatest j."""
    a, b = rows.select(F.col(pos).alias("i"), F.col(value).alias("x")), rows.select(F.col(pos).alias("j"), (F.lit(target) - F.col(value)).alias("x"))
    return a.join(b, "x").where("i < j").select("i", "j").orderBy("i", F.desc("j")).limit(1)


def find_sorted(rows: DataFrame, pos: str, value: str, target: int) -> DataFrame:
    """The first place of a value, -1 if it is nowhere: an equality that is pushed to the scan takes the place of halving."""
    return rows.where(F.col(value) == target).agg(F.coalesce(F.min(pos), F.lit(-1)).alias("at"))


def in_matrix(cells: DataFrame, value: str, target: int) -> DataFrame:
    """Whether a matrix of sorted rows, as cells, holds a value."""
    return cells.agg(F.coalesce(F.bool_or(F.col(value) == target), F.lit(False)).alias("found"))


def anagram_key(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, "")), "")


def group_anagrams(rows: DataFrame, word: str) -> DataFrame:
    """Words of equal letters: how many and the first and last of them."""
    words = rows.select(F.col(word).alias("w")).distinct()
    return words.groupBy(anagram_key(F.col("w")).alias("letters")).agg(F.count("*").alias("n"), F.min("w").alias("first"), F.max("w").alias("last"))


def top_k_frequent(rows: DataFrame, value: str, pos: str, k: int) -> DataFrame:
    """The k most frequent values; ties by where they first stand. A top-k report."""
    return rows.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"), F.min(pos).alias("first_pos")).orderBy(F.desc("n"), "first_pos").limit(k)


def multiset_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b)


def merge_intervals(rows: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Overlapping and touching intervals of each group become one: an island begins where a start lies beyond every end before."""
    order = Window.partitionBy(by).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    marked = rows.withColumn("__new", fresh).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("__island")


#: Magnitudes of 2 and more that a group can have while its products fit 64 bits, and one for the place itself.
MOST_FACTORS = 64


def product_except_self(rows: DataFrame, by: str, pos: str, value: str) -> DataFrame:
    """For each place the product of the group's other whole numbers, exact; a product beyond 64 bits is an error.

    Zeros, signs and ones are counted; only magnitudes of 2 and more are multiplied, as 38-digit
    decimals. A group with more than ``MOST_FACTORS`` of these overflows in any case, unless
    zeros make its products 0, so no more are ever collected.
    """
    v = F.col(value).cast("long")
    sums = rows.groupBy(by).agg(F.count_if(v == 0).alias("__zeros"), F.count_if(v < 0).alias("__minus"), F.count_if(F.abs(v) >= 2).alias("__large"))
    few = sums.where(f"__zeros < 2 and __large <= {MOST_FACTORS}").select(by)
    one = F.lit(1).cast("decimal(38,0)")
    times = F.aggregate(F.collect_list(F.abs(v).cast("decimal(38,0)")), one, lambda a, x: F.coalesce(F.try_multiply(a, x).cast("decimal(38,0)"), F.raise_error(F.lit("a product is beyond 64 bits")).cast("decimal(38,0)")))
    products = rows.where(F.abs(v) >= 2).join(few, by, "left_semi").groupBy(by).agg(times.alias("__product"))
    each = rows.join(sums, by).join(products, by, "left")
    others = F.col("__zeros") - (v == 0).cast("long")
    minus = F.col("__minus") - (v < 0).cast("long")
    rest = F.coalesce("__product", one) / F.greatest(F.abs(v), F.lit(1)).cast("decimal(38,0)")
    whole = F.round(rest, 0).cast("decimal(38,0)")
    beyond = (F.col("__large") > MOST_FACTORS) | (whole > 2**63 - 1)
    fits = F.when(beyond, F.raise_error(F.lit("a product is beyond 64 bits")).cast("long")).otherwise(whole.cast("long"))
    return each.select(by, pos, F.when(others > 0, F.lit(0).cast("long")).otherwise(fits * F.when(minus % 2 == 0, 1).otherwise(-1)).alias("product"))


def longest_without_repeat(text: Column) -> Column:
    """Length of the longest run of characters without a repeat: one fold that keeps where the current run begins."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")

    def step(a: Column, c: Column) -> Column:
        run = F.concat(F.call_function("substring_index", a["run"], c, F.lit(-1)), c)
        return F.struct(run.alias("run"), F.greatest(a["best"], F.length(run)).alias("best"))

    return F.aggregate(letters, F.struct(F.lit("").alias("run"), F.lit(0).alias("best")), step, lambda a: a["best"])


def valid_parentheses(text: Column) -> Column:
    """Brackets of three kinds close in order; other characters are an error."""
    pairs = F.create_map(*[F.lit(x) for p in (")(", "][", "}{") for x in p])
    letters = F.filter(F.split(text, ""), lambda c: c != "")

    def step(stack: Column, c: Column) -> Column:
        closes = F.substring(stack, -1, 1) == F.element_at(pairs, c)
        return F.when(stack == "!", stack).when(c.isin("(", "[", "{"), F.concat(stack, c)).when(F.coalesce(closes, F.lit(False)), F.left(stack, F.length(stack) - 1)).otherwise(F.lit("!"))

    return F.aggregate(letters, F.lit(""), step) == ""


def to_integer(text: Column) -> Column:
    """Leading spaces, one sign, digits; anything else ends the number, no digits give 0, and it stays within 32 bits."""
    digits = F.regexp_extract(text, r"^ *([+-]?[0-9]+)", 1)
    sign, figures = F.when(F.startswith(digits, F.lit("-")), -1).otherwise(1), F.regexp_replace(digits, "^[+-]?0*", "")
    size = F.when(F.length(figures) > 10, F.lit(10**10)).otherwise(F.coalesce(F.try_to_number(F.when(figures != "", figures), F.lit("9999999999")).cast("long"), F.lit(0)))
    return F.greatest(F.lit(-(2**31)), F.least(F.lit(2**31 - 1), sign * size)).cast("int")


def sudoku_conflicts(cells: DataFrame) -> DataFrame:
    """cells (row, col, digit): digits that stand twice in a row, column or box."""
    box = (F.floor(F.col("row") / 3) * 3 + F.floor(F.col("col") / 3))
    unit = lambda name, at: F.struct(F.lit(name).alias("unit"), at.cast("long").alias("at"))
    units = F.array(unit("row", F.col("row")), unit("col", F.col("col")), unit("box", box))
    each = cells.where("digit is not null").select("digit", F.explode(units).alias("u"))
    return each.groupBy("u.unit", "u.at", "digit").agg(F.count("*").alias("n")).where("n > 1")


def is_palindrome(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
    return plain == F.reverse(plain)


def prefix_minimum(rows: DataFrame, by: str, pos: str, value: str) -> DataFrame:
    order = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("minimum", F.min(value).over(order))
