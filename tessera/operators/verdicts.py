"""Verdict tables: finding a record's verdicts by content, deciding, summarising, and how fresh they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..functions.text import cache_key, format_chunks, looks_like_refusal
from ..functions.verdicts import clean, prompt_version

DIGITS = 6
#: Shapes that are sent to all tasks at most; how more are joined is Spark's choice.
SENT_SHAPES = 1000


def content_keys(records: DataFrame, shapes: DataFrame) -> DataFrame:
    """Records (rec, axis, model, question, answer, retrieved) under every (mode, prompt_version) of ``shapes``: the key that a verdict on this content would have.

    ``shapes`` lists the modes and versions in use; every distinct one is tried.
    """
    shapes = shapes.select("mode", "prompt_version").distinct()
    few = shapes.limit(SENT_SHAPES + 1).count() <= SENT_SHAPES
    parts = [F.col(k) for k in ("prompt_version", "mode", "model", "axis", "question", "answer")]
    return records.crossJoin(F.broadcast(shapes) if few else shapes).withColumn("key", cache_key(*parts, format_chunks(F.col("retrieved"))))


def entries_for(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Every cached verdict on a record's own content, numbered from the newest (``age`` 1); equal times by key."""
    keyed = content_keys(records, cache.select("mode", "prompt_version")).select("rec", "axis", "key")
    found = keyed.join(cache.select("key", "judged", "decision", F.col("prompt_version").alias("version")), "key")
    newest = Window.partitionBy("rec", "axis").orderBy(F.desc("judged"), "key")
    return found.withColumn("age", F.row_number().over(newest))


def latest(verdicts: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The newest row of each key; equal times by ``tie``."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(time), tie)
    return verdicts.withColumn("__age", F.row_number().over(newest)).where("__age = 1").drop("__age")


def axis_decisions(records: DataFrame, entries: DataFrame) -> DataFrame:
    """Per record the newest decision of each axis and whether an axis has several entries; what was not judged stays null."""
    newest = entries.groupBy("rec").agg(
        F.max(F.when((F.col("axis") == "refused") & (F.col("age") == 1), F.col("decision"))).alias("refused"),
        F.max(F.when((F.col("axis") == "fabricated") & (F.col("age") == 1), F.col("decision"))).alias("fabricated"),
        F.coalesce(F.max(F.col("age")) > 1, F.lit(False)).alias("conflict"),
    )
    return records.join(newest, "rec", "left")


def judged_summary(decided: DataFrame, group: str = "refusal_type") -> DataFrame:
    """Per group, and 'all': n, decided, clean, refused, fabricated, undecided, clean_rate over the decided, phrase_rate over all. ``phrase`` is told from the answers unless it is there."""
    rows = decided.withColumn("clean", clean(F.col("refused"), F.col("fabricated")))
    rows = rows if "phrase" in rows.columns else rows.withColumn("phrase", looks_like_refusal(F.col("answer")))
    sets = rows.withColumn("grp", F.explode(F.array(F.lit("all"), F.col(group))))
    known = F.count("clean")
    return sets.groupBy("grp").agg(
        F.count("*").alias("n"),
        known.alias("decided"),
        F.count_if("clean").alias("clean"),
        F.count_if("refused").alias("refused"),
        F.count_if("fabricated").alias("fabricated"),
        (F.count("*") - known).alias("undecided"),
        F.round(ratio(F.count_if("clean"), known), DIGITS).alias("clean_rate"),
        F.round(ratio(F.count_if("phrase"), F.count("*")), DIGITS).alias("phrase_rate"),
    )


def matrix(decided: DataFrame) -> DataFrame:
    """Counts of the four combinations, and of rows where an axis has no decision."""
    cell = lambda r, f: F.count_if((F.col("refused") == r) & (F.col("fabricated") == f))
    return decided.agg(
        cell(True, False).alias("refused_clean"), cell(True, True).alias("refused_fabricated"), cell(False, False).alias("answered_clean"), cell(False, True).alias("answered_fabricated"), F.count_if(F.expr("refused is null or fabricated is null")).alias("undecided")
    )


def freshness(records: DataFrame, entries: DataFrame) -> DataFrame:
    """records (rec, axis): verdicts at the current prompt version, at an older one only, and missing."""
    has = entries.groupBy("rec", "axis").agg(F.bool_or(F.col("version") == prompt_version(F.col("axis"))).alias("current"))
    joined = records.select("rec", "axis").join(has, ["rec", "axis"], "left")
    return joined.agg(F.count("*").alias("expected"), F.count_if("current").alias("current"), F.count_if(F.expr("not current")).alias("stale"), F.count_if(F.expr("current is null")).alias("missing"))


def to_judge(records: DataFrame, entries: DataFrame) -> DataFrame:
    """What a run still has to judge: records and axes without any verdict."""
    return records.join(entries.select("rec", "axis").distinct(), ["rec", "axis"], "left_anti")


def judge(records: DataFrame, entries: DataFrame, ask, schema: str, refresh: bool = False) -> DataFrame:
    """Runs ``ask`` (an Arrow-batch function) on what is not judged yet, or on all with ``refresh``; rows come as ``ask`` returns them."""
    return (records if refresh else to_judge(records, entries)).mapInPandas(ask, schema)
