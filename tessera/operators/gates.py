"""Comparing runs: pinned verdicts, carried labels, stability, noise, recordings, library scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.verdicts import clean
from .ranks import running_total

DIGITS = 6


def unpivot_axes(rows: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """One row per measured axis (keys, axis, value). A column that a table lacks gives no rows: not measured is not null."""
    have = [a for a in axes if a in rows.columns]
    pairs = ", ".join(f"'{a}', {a}" for a in have)
    return rows.selectExpr(*keys, f"stack({len(have)}, {pairs}) AS (axis, value)")


def pins_diff(observed: DataFrame, pinned: DataFrame) -> DataFrame:
    """Long tables (question, axis, value) to the axes that moved: question, axis, was, now. Null differs from any value and not from null."""
    both = observed.withColumnRenamed("value", "now").join(pinned.withColumnRenamed("value", "was"), ["question", "axis"])
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select("question", "axis", "was", "now")


def pins_counts(observed: DataFrame, pinned: DataFrame) -> DataFrame:
    """checked and unknown questions: a question without a pin is reported, never passed."""
    known = pinned.select("question").distinct().withColumn("known", F.lit(True))
    seen = observed.select("question").distinct().join(known, "question", "left")
    return seen.agg(F.count_if("known").alias("checked"), F.count_if(F.expr("known is null")).alias("unknown"))


def first_flips(runs: DataFrame, pinned: DataFrame) -> DataFrame:
    """runs (run, question, axis, value): the first run in which an axis of a question differs from its pin."""
    both = runs.join(pinned.withColumnRenamed("value", "was"), ["question", "axis"]).where(~F.col("was").eqNullSafe(F.col("value")))
    return both.groupBy("question", "axis").agg(F.min("run").alias("first_run"))


def carry_labels(rows: DataFrame, old: DataFrame) -> DataFrame:
    """rows and old: (question, answer, texts[, refused, fabricated, misdirected]). kept is true, and labels move, only if nothing that was labelled changed."""
    labels = ("refused", "fabricated", "misdirected")
    was = old.select("question", F.trim("answer").alias("old_answer"), F.col("texts").alias("old_texts"), *labels)
    joined = rows.select("question", "answer", "texts").join(was, "question", "left")
    some = F.col("refused").isNotNull() | F.col("fabricated").isNotNull() | F.col("misdirected").isNotNull()
    kept = F.coalesce((F.col("old_answer") == F.col("answer")) & (F.col("old_texts") == F.col("texts")) & some, F.lit(False))
    return joined.select("question", kept.alias("kept"), *[F.when(kept, F.col(k)).alias(k) for k in labels])


def stability(runs: DataFrame) -> DataFrame:
    """runs (question, run, refused, answer) per question: marks in run order, whether verdicts flip, distinct texts."""
    marks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "refused"))), lambda r: F.when(r["refused"], "R").otherwise(".")), "")
    verdicts = F.count_distinct("refused") + F.when(F.count_if(F.col("refused").isNull()) > 0, 1).otherwise(0)
    return runs.groupBy("question").agg(marks.alias("marks"), (verdicts > 1).alias("flips"), F.count_distinct("answer").alias("n_texts"))


def stability_summary(runs: DataFrame) -> DataFrame:
    """Spread of the runs' refusal rates, questions that flip, questions worded differently."""
    rates = runs.groupBy("run").agg(F.avg(F.col("refused").cast("int")).alias("rate")).agg(F.round(F.max("rate") - F.min("rate"), DIGITS).alias("spread"))
    each = stability(runs).agg(F.count_if("flips").alias("flips"), F.count_if(F.expr("n_texts > 1")).alias("reworded"), F.count("*").alias("questions"))
    return rates.crossJoin(each)  # one row each


def judge_noise(runs: DataFrame, cached: DataFrame) -> DataFrame:
    """runs (run, key, value), cached (key, value): keys with more than one decision (null is one), and keys where a run differs from the cache."""
    each = runs.join(cached.withColumnRenamed("value", "cached"), "key", "left")
    keys = each.groupBy("key").agg(
        (F.count_distinct("value") + F.max(F.col("value").isNull().cast("int")) > 1).alias("flipped"),
        F.bool_or(~F.col("value").eqNullSafe(F.col("cached"))).alias("vs_cache"),
    )
    return keys.agg(F.count("*").alias("keys"), F.count_if("flipped").alias("flipped"), F.count_if("vs_cache").alias("vs_cache"))


def clean_per_run(runs: DataFrame) -> DataFrame:
    """runs (run, question, refused, fabricated): clean verdicts of each run, of those that both axes decide."""
    held = clean(F.col("refused"), F.col("fabricated"))
    return runs.groupBy("run").agg(F.count("*").alias("n"), F.count(held).alias("decided"), F.count_if(held).alias("clean"))


def recordings_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(question, answer, verdict, label) twice: questions shared, answers changed, verdicts moved, hand labels moved where both have one."""
    x, y = (t.select("question", *[F.col(k).alias(f"{k}_{n}") for k in ("answer", "verdict", "label")]) for t, n in ((a, "a"), (b, "b")))
    both = x.join(y, "question")
    return both.agg(
        F.count("*").alias("shared"),
        F.count_if(F.expr("answer_a != answer_b")).alias("answers_changed"),
        F.count_if(~F.col("verdict_a").eqNullSafe(F.col("verdict_b"))).alias("verdicts_moved"),
        F.count_if(F.expr("label_a != label_b")).alias("labels_moved"),
    )


def library_means(scores: DataFrame, metrics: list[str], expected: int) -> DataFrame:
    """Mean of each metric; null if any of the expected records has no score (NaN and infinity are none)."""
    return scores.agg(*[F.when(F.count(usable_score(F.col(m))) >= expected, F.round(F.avg(usable_score(F.col(m))), 4)).alias(m) for m in metrics])


def usable_score(score: Column) -> Column:
    """A score of four digits; null for what is no finite number."""
    return F.when(~F.isnan(score) & (F.abs(score) < float("inf")), F.round(score, 4))


def baseline_delta(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, before, after, delta): means over the scores that are there, of two runs; null where a run has none."""
    means = lambda rows: rows.agg(*[F.round(F.avg(usable_score(F.col(m))), 4).alias(m) for m in metrics])
    long = lambda rows, name: rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in metrics])).alias("x")).select("x.*")
    both = long(means(before), "before").join(long(means(after), "after"), "metric")
    return both.withColumn("delta", F.round(F.col("after") - F.col("before"), 4))


def scores_to_make(records: DataFrame, held: DataFrame, metrics: list[str]) -> DataFrame:
    """(question, metric) that a resumed scoring run still owes: a score that is absent, null or no number is made again."""
    wanted = records.select("question", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    there = held.select("question", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), usable_score(F.col(m)).alias("score")) for m in metrics])).alias("x")).select("question", "x.*")
    return wanted.join(there.where("score is not null").select("question", "metric").distinct(), ["question", "metric"], "left_anti")


def score_disagreements(pairs: DataFrame, a: str, b: str, far: float = 0.6, limit: int = 6) -> DataFrame:
    """The pairs that lie furthest apart, more than ``far``: a report of ``limit`` rows."""
    gap = F.round(F.abs(F.col(a) - F.col(b)), DIGITS)
    return pairs.withColumn("gap", gap).where(F.col("gap") > far).orderBy(F.desc("gap"), "question").limit(limit)


def best_cut(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Every distinct score, and 0.5, as a cut: agreement and kappa of (score >= cut) with the label, best kappa first, then the smaller cut.

    Sums up from the highest score, over ranges of scores, instead of comparing all rows with all cuts.
    """
    from ..functions.stats import kappa, ratio

    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).alias("y"))
    each = known.groupBy("s").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("q")).unionByName(rows.sparkSession.createDataFrame([(0.5, 0, 0)], "s double, p long, q long")).groupBy("s").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    each = running_total(each.withColumn("below", -F.col("s")), ["below"], ["p", "q"], ["p_above", "q_above"])
    sums = F.broadcast(each.agg(F.sum("p").alias("pp"), F.sum("q").alias("qq")))  # one row
    at = each.crossJoin(sums).select("s", (F.col("p_above") + F.col("p")).alias("tp"), (F.col("q_above") + F.col("q")).alias("fp"), "pp", "qq")
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("pp") - F.col("tp"), F.col("qq") - F.col("fp")
    return at.select(F.col("s").alias("cut"), (tp + tn).alias("agree"), F.round(ratio(tp + tn, tp + tn + fp + fn), DIGITS).alias("rate"), F.round(kappa(tp, fp, fn, tn), DIGITS).alias("kappa"))
