"""Writing tables: upserts, append-only caches, frozen sets, edits that may touch labels only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The current rows with those of equal key replaced; of equal keys in ``new`` one row stays. Batching is the partitions' business."""
    kept = current.join(new.select(key), key, "left_anti")
    return kept.unionByName(new.dropDuplicates([key]), allowMissingColumns=True)


def append_verdicts(rows: DataFrame, path: str) -> None:
    """A cache is append-only, by model: a run that dies loses nothing that was written, and the newest entry wins on reading."""
    rows.write.mode("append").partitionBy("model").parquet(path)


def read_latest(cache: DataFrame, key: str = "key", time: str = "judged") -> DataFrame:
    """The newest entry of each key; of equal times the one that is greatest by its columns."""
    rest = [c for c in cache.columns if c not in (key, time)]
    return cache.groupBy(key).agg(F.max(F.struct(time, *rest)).alias("__n")).select(key, "__n.*").select(*cache.columns)


def freeze(rows: DataFrame, path: str, force: bool = False, **provenance: str) -> None:
    """Write a recording or split once; provenance goes in columns. Without ``force`` an existing one is an error."""
    for k, v in provenance.items():
        rows = rows.withColumn(k, F.lit(v))
    rows.write.mode("overwrite" if force else "errorifexists").parquet(path)


def prompt_digest(prompt: str) -> str:
    import hashlib

    return hashlib.sha256(prompt.encode()).hexdigest()[:12]


def save_labels(records: DataFrame, edits: DataFrame, frozen: tuple[str, ...] = ("question", "answer", "retrieved")) -> DataFrame:
    """records with the labels of ``edits`` (question, labels). Checked before it is returned: nothing frozen differs."""
    new = records.join(edits.select("question", F.col("labels").alias("__new")), "question", "left")
    out = new.withColumn("labels", F.coalesce("__new", "labels")).drop("__new").select(*records.columns)
    digest = lambda df: df.select(*[F.to_json(F.struct(c)).alias(c) for c in frozen])
    if not digest(records).exceptAll(digest(out)).isEmpty() or not digest(out).exceptAll(digest(records)).isEmpty():
        raise ValueError("an edit would change frozen text")
    return out


def write_if_complete(rows: DataFrame, path: str, runs: int, limited: bool) -> bool:
    """A drift table only from two whole runs or more."""
    if limited or runs < 2:
        return False
    rows.write.mode("overwrite").parquet(path)
    return True


def swap(rows: DataFrame, path: str) -> str:
    """Write a new version beside the table, then point to it; readers (``current``) meet the old version or the new one, never half of one."""
    version = f"v-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{version}")
    spark = rows.sparkSession
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").json(f"{path}/versions")
    return f"{path}/{version}"


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version of a swapped table that was pointed to last."""
    pointers = spark.read.schema("version string").json(f"{path}/versions")
    newest = pointers.select("version", "_metadata.file_modification_time", "_metadata.file_name").orderBy(F.desc("file_modification_time"), F.desc("file_name")).first()
    return spark.read.parquet(f"{path}/{newest.version}")


#: Rows of a report that one JSON text may hold.
REPORT_ROWS = 10_000


def as_json(rows: DataFrame, order: str) -> DataFrame:
    """One JSON array of all rows in order: for reports. More than ``REPORT_ROWS`` rows are an error; write such tables as JSON lines."""
    if rows.limit(REPORT_ROWS + 1).count() > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows; write this table as JSON lines")
    return rows.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*rows.columns).alias("r")))), lambda x: x["r"])).alias("json"))


def ingest(spark: SparkSession, folder: str, index: str, size: int = 800, overlap: int = 160) -> DataFrame:
    """From a folder of text files to the chunk table at ``index``: what is there is replaced by chunk, what is new is added. Returns the table as it is now."""
    from .tables import exists, load_corpus

    _, chunks = load_corpus(spark, folder, size, overlap)
    if not exists(spark, f"{index}/versions"):
        swap(chunks, index)
    else:
        swap(upsert(current(spark, index), chunks, "chunk_id"), index)
    return current(spark, index)


def snapshot(metrics: DataFrame, path: str, force: bool = False) -> None:
    """Freeze measured metrics as one row each (metric, value): what later runs are compared with. Null is a value: nothing was measured."""
    long = metrics.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics.columns])).alias("x")).select("x.*")
    freeze(long, path, force)


def add_scores(scores: DataFrame, path: str) -> None:
    """Append one metric's scores (question, metric, score) when they are made, so that a run that dies goes on where it was."""
    scores.select("question", "metric", "score").write.mode("append").parquet(path)


def save_tasks(tasks: DataFrame, path: str, key: str = "id") -> None:
    """Tasks of a usefulness log, in the order of their ids."""
    tasks.orderBy(key).write.mode("overwrite").parquet(path)


def write_split(records: DataFrame, path: str, extend: bool = False) -> DataFrame:
    """Assign records (question, pos, stratum, paraphrase_of) to halves and write the table. One that is there is an error; with ``extend`` only questions that it lacks are added, and nothing moves."""
    from ..operators import splits

    spark = records.sparkSession
    if extend:
        splits.extend(records, spark.read.parquet(path)).write.mode("append").parquet(path)
    else:
        splits.assign(records).write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
