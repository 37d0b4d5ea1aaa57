"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import gapless_rank, running_total, slices_for
from ..sources.scratch import discard, materialize, new_path, scratch_dir, sent_if_few
from ..sources.shipping import ship_package

__all__ = ["WHITE", "bounded_batches", "discard", "free_name", "gapless_rank", "let", "materialize", "new_path", "running_total", "scratch_dir", "sent_if_few", "slices_for", "words"]

#: Words are runs of characters outside this class.
WHITE = r"[\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession) -> None:
    """Before Python runs on whole texts: Spark bounds Arrow batches by 10,000 rows; lower that, and the bytes, for the session, unless it has less already. Workers get the package."""
    ship_package(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 512), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = str(spark.conf.get(key)).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def words(text: Column) -> Column:
    """Array of the words of a text; null and white texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row: a lambda's variable can't be inlined into inner lambdas, a projected column can."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))
