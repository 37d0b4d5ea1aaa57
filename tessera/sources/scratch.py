"""Tables written to the cluster's shared folder between two plans: a lost executor then costs tasks, not lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that are sent to all tasks at most, at some tens of bytes each; more are joined by a shuffle.
SENT_IDS = 1_000_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where none is named, a local run makes one of its own; a cluster is an error, since its executors share no local folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it: later plans start from files."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent_if_few(ids: DataFrame, most: int | None = None) -> tuple[DataFrame, bool]:
    """(a written table of ids, marked to be sent to all tasks if it has at most ``most`` rows; whether it is)."""
    few = ids.count() <= (SENT_IDS if most is None else most)
    return (F.broadcast(ids) if few else ids), few


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and no later plan reads."""
    jvm = df.sparkSession.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
