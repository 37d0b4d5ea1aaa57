"""Reading tables, and the checks of record sets as queries that return the rows in breach."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shipping import ship_package

REFUSAL_TYPES, SPLITS = ("in_corpus_gap", "out_of_corpus"), ("dev", "test")
SPAN = T.StructType([T.StructField("source", T.StringType()), T.StructField("distance", T.DoubleType()), T.StructField("text", T.StringType())])
LABELS = "struct<refused:boolean,fabricated:boolean,misdirected:boolean,note:string>"
GROUND_TRUTH = "question string, answer string, contexts array<string>, answerable boolean, source string, refusal_type string, page string, topic_in_corpus boolean, paraphrase_of string, bait boolean, kind string, missing string"
ANSWERS = f"question string, source string, answer string, reference string, gold_contexts array<string>, refusal_type string, topic_in_corpus boolean, labels {LABELS}, retrieved array<{SPAN.simpleString()}>"
METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, most: int = 256 << 20) -> DataFrame:
    """Deal a small table out to all cores if its files are fewer, since a file of one row group is one task. Larger tables stay as their files are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size <= most and len(rows.inputFiles()) < cores else rows


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store Spark reads it from."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_documents(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(source, text): a file per document, source from its name. Files are UTF-8 text, or what ``pages`` reads: from a file's bytes to the texts of its pages, which line ends join."""
    files = spark.read.format("binaryFile").load(path)
    source = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("source")
    if pages is None:
        return files.select(source, F.decode("content", "utf-8").alias("text"))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(len(batch)):
                text = "\n".join(pages(batch.column(1)[i].as_py()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([text], pa.string())], names=["source", "text"])

    ship_package(spark)
    return files.select(source, "content").mapInArrow(read, "source string, text string")


def read_pages(pages: DataFrame) -> DataFrame:
    """(source, text) of HTML pages."""
    from ..functions.text import strip_tags

    return pages.select(F.col("page_id").cast("string").alias("source"), strip_tags(F.col("html")).alias("text"))


def ground_truth(rows: DataFrame) -> DataFrame:
    """Records in canonical columns: absent ones are null, answerable defaults to true, unknown ones go."""
    have = set(rows.columns)
    fields = [f.strip().split(" ", 1) for f in GROUND_TRUTH.split(", ")]
    out = [F.col(k).cast(t).alias(k) if k in have else F.lit(None).cast(t).alias(k) for k, t in fields]
    return rows.select(*out).withColumn("answerable", F.coalesce("answerable", F.lit(True)))


def ground_truth_breaches(records: DataFrame) -> DataFrame:
    """question and what is wrong: missing fields, refusals with contexts or without a valid class, answerable ones without contexts."""
    rules = {
        "no question": F.col("question").isNull(),
        "no answer": F.col("answer").isNull(),
        "contexts are not a list": F.col("contexts").isNull(),
        "refusal with contexts": ~F.col("answerable") & (F.size("contexts") > 0),
        "refusal of no known class": ~F.col("answerable") & ~F.coalesce(F.col("refusal_type").isin(*REFUSAL_TYPES), F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))
    return records.select("question", F.explode(found).alias("breach"))


def answer_breaches(records: DataFrame) -> DataFrame:
    """Recorded answers and what is wrong with them. Labels may come as JSON text; then each must be true, false or null, and ``misdirected`` may be absent."""
    rules = {
        "no question": F.col("question").isNull(),
        "no answer": F.col("answer").isNull(),
        "nothing retrieved": F.coalesce(F.size("retrieved"), F.lit(0)) < 1,
        "no labels": F.col("labels").isNull(),
    }
    if dict(records.dtypes)["labels"] == "string":
        given = F.from_json("labels", "map<string,string>")
        named = lambda k: F.element_at(given, F.lit(k))
        wrong = lambda k: F.coalesce(~named(k).isin("true", "false", "null") & named(k).isNotNull(), F.lit(False))
        rules |= {f"label {k} is absent": F.col("labels").isNotNull() & ~F.coalesce(F.map_contains_key(given, k), F.lit(False)) for k in ("refused", "fabricated")}
        rules |= {f"label {k} is not true, false or null": wrong(k) for k in ("refused", "fabricated", "misdirected")}
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]))
    return records.select("question", F.explode(found).alias("breach"))


def iter_records(records: DataFrame, answerable_only: bool = False) -> DataFrame:
    return records.where("answerable") if answerable_only else records


def answerable_records(records: DataFrame) -> DataFrame:
    return records.where("answerable")


def refusal_records(records: DataFrame, refusal_type: str | None = None) -> DataFrame:
    """Records that must be refused, of one class or of all; an unknown class is an error."""
    if refusal_type is not None and refusal_type not in REFUSAL_TYPES:
        raise ValueError(f"refusal_type must be one of {REFUSAL_TYPES}, not {refusal_type}")
    rows = records.where(~F.col("answerable"))
    return rows if refusal_type is None else rows.where(F.col("refusal_type") == refusal_type)


def head(records: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n records in the order of the fixture, all if n is None: the feature of a short run."""
    return records if n is None else records.orderBy(order).limit(n)


def load_corpus(spark: SparkSession, folder: str, size: int = 800, overlap: int = 160) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of a folder of text files, by the names of the files."""
    from ..operators.chunks import chunk_documents

    docs = read_documents(spark, folder)
    return docs, chunk_documents(docs, size, overlap)


def load_cache(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """The verdict cache, of one model or of all; a cache that was never written is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], "key string, judged long, decision boolean, mode string, prompt_version string, model string")
    cache = spark.read.parquet(path)
    return cache if model is None else cache.where(F.col("model") == model)


def attack_texts(spark: SparkSession, path: str) -> DataFrame:
    """(attack, text) of JSON lines with subject and body."""
    from ..operators.security import attack_text

    rows = spark.read.schema("id string, subject string, body string").json(path)
    return rows.select(F.col("id").alias("attack"), attack_text(F.col("subject"), F.col("body")).alias("text"))


def spans(records: DataFrame) -> DataFrame:
    """(qid, ctx_no, ctx) of each gold context, numbered from 0."""
    return records.select(F.col("question").alias("qid"), F.posexplode("contexts").alias("ctx_no", "ctx"))


def split_map(rows: DataFrame, column: str) -> DataFrame:
    """A map column question -> half as a table; other values than dev and test are an error."""
    out = rows.select(F.explode(column).alias("question", "split"))
    if not (bad := out.where(~F.col("split").isin(*SPLITS))).isEmpty():
        raise ValueError(f"unknown split {bad.first()['split']!r}")
    return out


def library_scores(spark: SparkSession, path: str, shape: str = "list") -> DataFrame:
    """(question, metrics...) from a list of records, or from an object keyed by question; no file gives no rows."""
    fields = ", ".join(f"{m} double" for m in METRICS)
    if not exists(spark, path):
        return spark.createDataFrame([], f"question string, {fields}")
    if shape == "list":
        return spark.read.schema(f"per_record array<struct<question:string,{fields.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path).select(F.inline("per_record"))
    inner = ",".join(f"{m}:double" for m in METRICS)
    keyed = spark.read.schema(f"per_record map<string,struct<{inner}>>").option("multiLine", True).json(path)
    return keyed.select(F.explode("per_record").alias("question", "s")).select("question", "s.*")


def nested_json_lines(spark: SparkSession, path: str, column: str, schema: str) -> DataFrame:
    """JSON lines of which one string column is JSON itself."""
    return spark.read.json(path).withColumn(column, F.from_json(column, schema))


def verdict_models(cache: DataFrame) -> DataFrame:
    return cache.select("model").distinct().orderBy("model")


def pinned(spark: SparkSession, path: str) -> DataFrame | None:
    """Long pins (question, axis, value), or None where nothing was ever pinned: that is not the same as no rows."""
    return spark.read.parquet(path) if exists(spark, path) else None


def junit(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes and seconds per file of a JUnit XML report."""
    cases = spark.read.format("xml").option("rowTag", "testcase").schema("_classname string, _time double, failure string, error string, skipped string").load(path)
    bad = F.col("failure").isNotNull() | F.col("error").isNotNull()
    return cases.groupBy(F.col("_classname").alias("file")).agg(F.count("*").alias("tests"), F.count_if(bad).alias("failed"), F.count_if(F.col("skipped").isNotNull()).alias("skipped"), F.round(F.sum("_time"), 3).alias("seconds"))
