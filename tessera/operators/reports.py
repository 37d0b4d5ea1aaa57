"""Report tables: recordings, gold alignment, calibration cases, latencies, differences of sets, and retrieval through any search function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..functions.text import looks_like_refusal
from ..functions.verdicts import clean, hand_clean
from . import metrics

DIGITS = 6


def recordings_summary(rows: DataFrame, by: str = "recording") -> DataFrame:
    """Per recording: n, clean by the judge and by hand, phrase matches, and how many have each opinion."""
    judged, hand = clean(F.col("refused"), F.col("fabricated")), hand_clean(F.col("hand_refused"), F.col("hand_fabricated"), F.col("misdirected"))
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.count(judged).alias("judged"), F.count_if(judged).alias("judged_clean"), F.count(hand).alias("labelled"), F.count_if(hand).alias("hand_clean"), F.count_if(looks_like_refusal(F.col("answer"))).alias("phrase")
    )


def gold_alignment(rows: DataFrame) -> DataFrame:
    """rows (declined, score): answers that assert something, their mean score, and how many are whole, partial, none."""
    told = rows.where(~F.coalesce("declined", F.lit(False)) & F.col("score").isNotNull())
    return told.agg(F.count("*").alias("answered"), F.round(F.avg("score"), 4).alias("mean"), F.count_if(F.col("score") >= 1).alias("whole"), F.count_if((F.col("score") > 0) & (F.col("score") < 1)).alias("between"), F.count_if(F.col("score") <= 0).alias("none"))


def calibration_cases(expected: DataFrame, got: DataFrame) -> DataFrame:
    """(case, axis, value) twice: what was expected and what came, and whether they are the same; null is a value, absence too."""
    joined = expected.withColumnRenamed("value", "want").join(got.withColumnRenamed("value", "got"), ["case", "axis"], "left")
    return joined.select("case", "axis", "want", "got", F.col("want").eqNullSafe(F.col("got")).alias("same"))


def latencies(rows: DataFrame, by: str, seconds: str) -> DataFrame:
    s = F.col(seconds)
    return rows.groupBy(by).agg(F.count(s).alias("n"), F.round(F.sum(s), DIGITS).alias("total"), F.round(F.avg(s), DIGITS).alias("mean"), F.min(s).alias("least"), F.max(s).alias("most"))


def set_difference(known: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks: side is gone or new. A frozen baseline must hold both ways."""
    gone, new = known.exceptAll(actual), actual.exceptAll(known)
    return gone.withColumn("side", F.lit("gone")).unionByName(new.withColumn("side", F.lit("new")))


def partition_check(whole: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """Keys of the whole that no part or more than one part holds, with that number."""
    every = None
    for p in parts:
        every = p.select(key) if every is None else every.unionByName(p.select(key))
    held = every.groupBy(key).agg(F.count("*").alias("parts"))
    return whole.select(key).join(held, key, "left").select(key, F.coalesce("parts", F.lit(0)).alias("parts")).where("parts != 1")


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def declines(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(looks_like_refusal(F.col("answer"))).alias("declined"))


def evaluate_retrieval(questions: DataFrame, spans: DataFrame, search: Callable[[DataFrame, int], DataFrame], k: int = 5) -> DataFrame:
    """Scores per question through any ``search(questions, k)`` that returns (qid, rank, text): one retrieval feeds every metric."""
    return metrics.question_scores(questions, search(questions, k), spans)


def observe_counts(rows: DataFrame, name: str, **counts: Column) -> DataFrame:
    """Count what flows through a plan without a further pass; Spark reports it under the name when the plan has run."""
    return rows.observe(name, F.count("*").alias("rows"), *[F.count_if(c).alias(k) for k, c in counts.items()])


def failures(decided: DataFrame) -> DataFrame:
    """The rows behind a judged summary: (question, failure) of answers that are not refused, that fabricate, or that the judge decided against what their phrasing says."""
    phrase = looks_like_refusal(F.col("answer"))
    rules = {
        "not refused": ~F.col("refused"),
        "fabricated": F.col("fabricated"),
        "refused without a phrase": F.col("refused") & ~phrase,
        "a phrase without a refusal": ~F.col("refused") & phrase,
        "undecided": F.col("refused").isNull() | F.col("fabricated").isNull(),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))
    return decided.select("question", F.explode(found).alias("failure"))


def by_class(decided: DataFrame, group: str = "refusal_type") -> DataFrame:
    """Counts of each class, ordered by its name: a report of as many rows as there are classes."""
    held = clean(F.col("refused"), F.col("fabricated"))
    return decided.groupBy(group).agg(F.count("*").alias("n"), F.count(held).alias("decided"), F.count_if(held).alias("clean")).orderBy(group)


def rate_of(rows: DataFrame, by: str, flag: Column) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(ratio(F.count_if(flag), F.count("*")), DIGITS).alias("rate"))
