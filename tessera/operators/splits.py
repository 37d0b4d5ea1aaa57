"""Assigning records to halves by stratum, and seeded selection by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ordered_rank


def stratum(answerable: Column, kind: Column, bait: Column, refusal_type: Column) -> Column:
    answered = F.coalesce(answerable, F.lit(True))
    return F.when(answered, F.coalesce(kind, F.lit("answerable"))).when(F.coalesce(bait, F.lit(False)), "bait").otherwise(refusal_type)


def _half(n: Column) -> Column:
    return F.when(n % 2 == 0, "dev").otherwise("test")


def assign(records: DataFrame) -> DataFrame:
    """records (question, pos, stratum, paraphrase_of) to (question, split): each stratum's originals alternate in order, paraphrases follow their original."""
    placed = ordered_rank(records.where("paraphrase_of is null").select("question", "stratum", "pos"), "stratum", ["pos", "question"], "k")
    originals = placed.select("question", _half(F.col("k")).alias("split"))
    follow = records.where("paraphrase_of is not null").select("question", F.col("paraphrase_of").alias("of"))
    return originals.unionByName(follow.join(originals.withColumnRenamed("question", "of"), "of").select("question", "split"))


def extend(records: DataFrame, existing: DataFrame) -> DataFrame:
    """Halves for the questions that ``existing`` (question, split) lacks; every stratum's alternation goes on where it stopped, and nothing that is assigned moves."""
    held = existing.select("question", F.col("split").alias("held"))
    rows = records.join(held, "question", "left")
    originals = rows.where("paraphrase_of is null")
    before = originals.where("held is not null").groupBy("stratum").agg(F.count("*").alias("n"))
    fresh = originals.where("held is null").select("question", "stratum", "pos")
    fresh = ordered_rank(fresh, "stratum", ["pos", "question"], "k").join(before, "stratum", "left")
    added = fresh.select("question", _half(F.coalesce("n", F.lit(0)) + F.col("k")).alias("split"))
    known = existing.select("question", "split").unionByName(added)
    follow = rows.where("paraphrase_of is not null and held is null").select("question", F.col("paraphrase_of").alias("of"))
    return added.unionByName(follow.join(known.withColumnRenamed("question", "of"), "of").select("question", "split"))


def in_split(records: DataFrame, split: DataFrame, name: str) -> DataFrame:
    """Records of one half; an unknown half, or a record without one, is an error."""
    if name not in ("dev", "test"):
        raise ValueError(f"split must be dev or test, not {name}")
    if not (lost := records.join(split, "question", "left_anti")).isEmpty():
        raise KeyError(f"no split for {lost.first()['question']!r}")
    return records.join(split.where(F.col("split") == name).select("question"), "question", "left_semi")


def draw(key: str, seed: int) -> Column:
    """What seeded selections order by: the MD5 of seed and key, which every engine has. Draws differ from those of other generators."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def one_per_group(rows: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """One row of each group, the one of smallest seeded hash."""
    return rows.groupBy(group).agg(F.min_by(key, F.struct(draw(key, seed), F.col(key))).alias(key))


def sample_rows(rows: DataFrame, key: str, n: int, seed: int = 0, without: DataFrame | None = None) -> DataFrame:
    """n rows without replacement by seeded hash, leaving out the keys of ``without``: a sampling operator, so n is its feature."""
    pool = rows if without is None else rows.join(without.select(key), key, "left_anti")
    return pool.orderBy(draw(key, seed), key).limit(n)


def clean_sets(chunks: DataFrame, threats: DataFrame, key: str, n: int = 50, n_threats: int = 20, seed: int = 0) -> DataFrame:
    """Two disjoint samples (sample, key): n of all chunks, and n_threats of those with threat words that the first has not."""
    plain = sample_rows(chunks, key, n, seed).select(F.lit("random").alias("sample"), key)
    return plain.unionByName(sample_rows(threats, key, n_threats, seed, plain).select(F.lit("threat").alias("sample"), key))
