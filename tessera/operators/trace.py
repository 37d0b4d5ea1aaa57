"""Requirements, needs and evidence as edge tables; usefulness of answered tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio


def edges(rows: DataFrame, key: str, refs: str) -> DataFrame:
    return rows.select(F.col(key).alias("id"), F.explode(refs).alias("ref"))


def orphans(needs: DataFrame, requirements: DataFrame) -> DataFrame:
    """needs (id, served_by[]), requirements (id): references to nothing, and requirements that nothing names."""
    links = edges(needs, "id", "served_by")
    dangling = links.join(requirements.select(F.col("id").alias("ref")), "ref", "left_anti").select(F.lit("dangling").alias("problem"), "id", "ref")
    unused = requirements.select(F.col("id").alias("ref")).join(links, "ref", "left_anti").select(F.lit("unused").alias("problem"), F.lit(None).cast("string").alias("id"), "ref")
    return dangling.unionByName(unused.withColumn("id", F.col("id").cast(dict(dangling.dtypes)["id"])))


def unproved(requirements: DataFrame, tests: DataFrame, evidence: DataFrame) -> DataFrame:
    """requirements (id, tests[], evidence[]), tests (id), evidence (id): (problem, id, ref) of test references to no test, tests that no requirement names, evidence that is not there, and requirements with neither."""
    named = {"tests": tests, "evidence": evidence}
    missing = None
    for what, there in named.items():
        lost = edges(requirements, "id", what).join(there.select(F.col("id").alias("ref")), "ref", "left_anti").select(F.lit(f"missing {what}").alias("problem"), "id", "ref")
        missing = lost if missing is None else missing.unionByName(lost)
    none = F.lit(None).cast("string")
    loose = tests.select(F.col("id").alias("ref")).join(edges(requirements, "id", "tests"), "ref", "left_anti").select(F.lit("dangling test").alias("problem"), none.alias("id"), "ref")
    bare = requirements.where((F.coalesce(F.size("tests"), F.lit(0)) < 1) & (F.coalesce(F.size("evidence"), F.lit(0)) < 1)).select(F.lit("unproved").alias("problem"), "id", none.alias("ref"))
    return missing.unionByName(loose).unionByName(bare)


def counts(requirements: DataFrame) -> DataFrame:
    return requirements.agg(F.count("*").alias("requirements"), F.coalesce(F.sum(F.size("tests")), F.lit(0)).cast("long").alias("tests"), F.count_if("gate").alias("gates"))


def usefulness(tasks: DataFrame) -> DataFrame:
    """tasks (outcome, seconds, by_hand_seconds): outcomes of the judged (not skipped) ones, the accepted share, medians of those timed both ways."""
    judged = tasks.where("outcome != 'skipped'")
    timed = (F.coalesce("seconds", F.lit(0)) != 0) & (F.coalesce("by_hand_seconds", F.lit(0)) != 0)
    median = lambda c: F.round(F.percentile(F.when(timed, F.col(c)), F.lit(0.5)), 6)
    return judged.agg(
        F.count("*").alias("judged"),
        F.count_if(F.expr("outcome = 'accepted'")).alias("accepted"),
        F.round(ratio(F.count_if(F.expr("outcome = 'accepted'")), F.count("*")), 6).alias("accepted_share"),
        F.count_if(timed).alias("timed"),
        median("seconds").alias("median_seconds"),
        median("by_hand_seconds").alias("median_by_hand"),
    )
