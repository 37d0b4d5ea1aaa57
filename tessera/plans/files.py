"""Queries that write tables in the shapes of files and read them again: caches, splits, scores, pins, recordings, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import requests as R
from ..functions import text as T
from ..operators import gates, security, splits
from ..operators import verdicts as O
from ..sources import sinks, tables
from ..sources.scratch import new_path
from ..sources.tables import table
from ..streaming import latest
from . import judging, records, retrieval

PROMPT = "Answer from the documents alone."


def library_score_files(spark, d):
    """Scores of both file shapes, a list of records and an object keyed by question."""
    rows = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("question"), (F.length("text") / 1000).alias("faithfulness"), F.when(F.col("item_id") % 3 != 0, F.lit(0.5)).alias("context_recall"))
    whole = F.struct("question", "faithfulness", "context_recall")
    listed, keyed = new_path(spark, "list"), new_path(spark, "keyed")
    rows.agg(F.to_json(F.struct(F.collect_list(whole).alias("per_record")))).write.text(listed)
    rows.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("question", F.struct("faithfulness", "context_recall")))).alias("per_record")))).write.text(keyed)
    read = lambda path, shape: tables.library_scores(spark, path, shape).select(F.lit(shape).alias("shape"), "question", F.round("faithfulness", 6).alias("faithfulness"), "answer_relevancy", "context_recall")
    return read(listed, "list").unionByName(read(keyed, "keyed"))


def split_file(spark, d):
    """A split that is written as one object and read as a table."""
    half = F.when(F.col("item_id") % 2 == 0, "dev").otherwise("test")
    path = new_path(spark, "split")
    table(spark, d, "benchmark").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("item_id").cast("string"), half))))).write.text(path)
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("halves"))
    return tables.split_map(rows, "halves")


def cache_round_trip(spark, d):
    """Verdicts appended in two runs, the second newer for some, and what is newest by model."""
    path = new_path(spark, "cache")
    cache = judging.verdict_cache(spark, d).withColumn("model", F.when(F.col("prompt_version") == "2", "a").otherwise("b"))
    sinks.append_verdicts(cache, path)
    again = cache.where("judged % 2 = 0").withColumn("judged", F.col("judged") + 1_000_000).withColumn("decision", ~F.col("decision"))
    sinks.append_verdicts(again, path)
    held = tables.load_cache(spark, path)
    out = None
    for model in [r.model for r in tables.verdict_models(held).collect()]:  # the models in use
        one = sinks.read_latest(tables.load_cache(spark, path, model)).groupBy("model").agg(F.count("*").alias("n"), F.sum("judged").alias("judged"), F.count_if("decision").alias("yes"))
        out = one if out is None else out.unionByName(one)
    return out


def pinned_table(spark, d):
    """Axes that moved against pins that were frozen to a table; where nothing is pinned there is no table."""
    path = new_path(spark, "pins")
    if tables.pinned(spark, path) is not None:
        raise AssertionError("a table that was never written is there")
    sinks.freeze(judging.pinned_axes(spark, d), path)
    return gates.pins_diff(judging.observed_axes(spark, d), tables.pinned(spark, path))


def frozen_recording(spark, d):
    """A recording with its provenance."""
    path = new_path(spark, "recording")
    rows = records.truth_records(spark, d).select("question", F.md5("answer").alias("answer_md5"))
    sinks.freeze(rows, path, prompt=sinks.prompt_digest(PROMPT), model="qwen3:8b")
    return spark.read.parquet(path)


def recorded_answers(spark, d):
    """Recorded answers in the shape of their file, read by its schema."""
    path = new_path(spark, "answers")
    even = F.col("item_id") % 2 == 0
    chunk = F.struct(F.lit("s").alias("source"), F.lit(0.25).alias("distance"), F.col("text"))
    rows = table(spark, d, "benchmark").select(
        F.col("item_id").cast("string").alias("question"), F.col("text").alias("answer"), F.when(even, "in_corpus_gap").alias("refusal_type"),
        F.struct(even.alias("refused"), F.when(F.col("item_id") % 3 == 0, F.lit(False)).alias("fabricated")).alias("labels"), F.array_repeat(chunk, (F.col("item_id") % 3).cast("int")).alias("retrieved"),
    )
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns)))).write.text(path)
    read = tables.read_json(spark, path, tables.ANSWERS)
    faults = tables.answer_breaches(read).groupBy("question").agg(F.count("*").alias("breaches"))
    out = read.join(faults, "question", "left")
    return out.select("question", "source", "refusal_type", "labels.refused", "labels.fabricated", "labels.misdirected", F.size("retrieved").cast("long").alias("n"), F.coalesce("breaches", F.lit(0)).alias("breaches"), F.md5(F.get("retrieved", F.lit(0))["text"]).alias("first_md5"))


def address_mentions(spark, d):
    """Answers that name an address, in any case of letters."""
    hit = security.mentions_address(F.col("text"), "http://")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(hit).alias("mentions"))


def drift_runs(spark, d):
    """Whole runs become a drift table; a limited one does not."""
    path, none = new_path(spark, "drift"), new_path(spark, "none")
    runs = judging.event_runs(spark, d)
    written, not_written = sinks.write_if_complete(runs, path, 5, False), sinks.write_if_complete(runs, none, 5, True)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_if("refused").alias("refused")).withColumn("written", F.lit(written)).withColumn("limited_written", F.lit(not_written))


def saved_labels(spark, d):
    """Hand labels put into a recording whose texts must not change."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("question"), F.col("text").alias("answer"), F.array("source", "lang").alias("retrieved"), F.lit("open").alias("labels"))
    edits = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("question"), F.lit("refused").alias("labels"))
    return sinks.save_labels(rows, edits).select("question", "labels", F.md5("answer").alias("answer_md5"))


def upserted_chunks(spark, d):
    """Chunks of French documents come again in capitals, those of a new source are added; all others stay."""
    now = retrieval.chunked(spark, d).select("chunk_id", "text")
    french = table(spark, d, "documents").where("lang = 'fr'").select(F.col("doc_id").cast("string").alias("source"))
    again = retrieval.chunked(spark, d).join(french, "source", "left_semi").select("chunk_id", T.upper(F.col("text")).alias("text"))
    added = table(spark, d, "benchmark").select(F.concat(F.lit("new-"), F.col("item_id").cast("string")).alias("chunk_id"), "text")
    return sinks.upsert(now, again.unionByName(added), "chunk_id").select("chunk_id", F.md5("text").alias("text_md5"))


def class_json(spark, d):
    """The class report as the JSON of a page."""
    return sinks.as_json(records.class_report(spark, d), "refusal_type")


def in_split(spark, d):
    rows = judging.split_records(spark, d)
    return splits.in_split(rows, splits.assign(rows), "dev").select("question", "stratum")


def to_judge(spark, d):
    """Records and axes that a run still has to judge."""
    rows = judging.judge_records(spark, d)
    return O.to_judge(rows, O.entries_for(rows, judging.verdict_cache(spark, d))).select("rec", "axis")


def retry_waits(spark, d):
    """Seconds to wait: what a header asks, what a refusal's text says, or powers of two."""
    e = F.col("event_id")
    header = F.when(F.col("event_type") == "click", (F.col("user_id") % 7).cast("string")).when(F.col("event_type") == "error", F.lit("soon"))
    body = F.when(F.col("event_type") == "view", F.concat(F.lit('{"retryDelay": "'), (e % 50).cast("string"), F.lit('.5s"}'))).otherwise(F.lit("busy"))
    asked = R.retry_after(header, body)
    return table(spark, d, "events").select("event_id", asked.alias("asked"), F.round(R.backoff(e % 9, asked, (e % 10) / 10), 6).alias("wait"))


def ligatures_repaired(spark, d):
    """Texts whose letter pairs were lost to private-use ligatures of a font, put right."""
    broken = F.col("text")
    for sign, letters in T.LIGATURES.items():
        broken = F.replace(broken, F.lit(letters), F.lit(sign))
    return table(spark, d, "documents").select("doc_id", F.md5(T.repair_ligatures(broken)).alias("text_md5"))


def nested_lines(spark, d):
    """JSON lines of which one column is JSON itself."""
    path = new_path(spark, "lines")
    inner = F.to_json(F.struct(F.col("lang").alias("to"), F.col("n_chars").alias("size")))
    table(spark, d, "documents").select("doc_id", inner.alias("inner")).write.json(path)
    return tables.nested_json_lines(spark, path, "inner", "to string, size long").select("doc_id", "inner.to", "inner.size")


def attack_lines(spark, d):
    path = new_path(spark, "attacks")
    table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.substring("text", 1, 20).alias("subject"), F.col("text").alias("body")).write.json(path)
    return tables.attack_texts(spark, path).select("attack", F.md5("text").alias("text_md5"))


def _events(spark, d) -> str:
    path = new_path(spark, "events")
    table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id").write.parquet(path)
    return path


EVENTS = "user_id long, event_type string, ts timestamp, event_id long"


def stream_latest(spark, d):
    """Events as a stream, kept as the newest of each user and type; the same as the batch's."""
    out = new_path(spark, "newest")
    stream = latest.latest_by_key(latest.read_events(spark, _events(spark, d), EVENTS), ["user_id", "event_type"], "ts")
    latest.replace_table(stream, out, new_path(spark, "state")).awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_type", "event_id")


def stream_once(spark, d):
    """Events as a stream, the first of each user and type that comes; which of them is the stream's affair, so only keys are told."""
    out = new_path(spark, "once")
    stream = latest.once_per_key(latest.read_events(spark, _events(spark, d), EVENTS), ["user_id", "event_type"], "ts", late="10000 days")
    latest.append_to(stream, out, new_path(spark, "state")).awaitTermination()
    return spark.read.parquet(out).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        library_score_files, split_file, cache_round_trip, pinned_table, frozen_recording, recorded_answers, address_mentions, drift_runs, saved_labels, upserted_chunks, class_json, in_split, to_judge, retry_waits, ligatures_repaired, nested_lines, attack_lines, stream_latest, stream_once,
    )
}

_J, _R = judging, retrieval
_ENTRIES = f"""c AS (SELECT CASE version WHEN '2' THEN 'a' ELSE 'b' END AS model, rec + version::INTEGER AS judged, decision FROM ent),
n AS (SELECT model, CASE WHEN judged % 2 = 0 THEN judged + 1000000 ELSE judged END AS judged, CASE WHEN judged % 2 = 0 THEN NOT decision ELSE decision END AS decision FROM c)"""

ORACLES = {
    "library_score_files": "SELECT s AS shape, item_id::VARCHAR AS question, round(length(text) / 1000, 6) AS faithfulness, NULL::DOUBLE AS answer_relevancy, CASE WHEN item_id % 3 <> 0 THEN 0.5 END::DOUBLE AS context_recall FROM benchmark, (SELECT unnest(['list', 'keyed']) AS s)",
    "split_file": "SELECT item_id::VARCHAR AS question, CASE WHEN item_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM benchmark",
    "cache_round_trip": f"WITH {_J._ENT}, {_ENTRIES} SELECT model, count(*) AS n, sum(judged)::BIGINT AS judged, count(*) FILTER (decision) AS yes FROM n GROUP BY model",
    "pinned_table": _J.ORACLES["pins_diff"],
    "frozen_recording": f"SELECT doc_id::VARCHAR AS question, md5(text) AS answer_md5, substr(sha256('{PROMPT}'), 1, 12) AS prompt, 'qwen3:8b' AS model FROM documents",
    "recorded_answers": """SELECT item_id::VARCHAR AS question, NULL::VARCHAR AS source, CASE WHEN item_id % 2 = 0 THEN 'in_corpus_gap' END AS refusal_type, item_id % 2 = 0 AS refused, CASE WHEN item_id % 3 = 0 THEN false END AS fabricated,
  NULL::BOOLEAN AS misdirected, (item_id % 3)::BIGINT AS n, (item_id % 3 = 0)::BIGINT AS breaches, CASE WHEN item_id % 3 > 0 THEN md5(text) END AS first_md5 FROM benchmark""",
    "address_mentions": "SELECT lang, count(*) AS n, count(*) FILTER (contains(lower(text), 'http://')) AS mentions FROM documents GROUP BY lang",
    "drift_runs": f"WITH {_J._RUNS} SELECT count(*) AS n, count(*) FILTER (refused) AS refused, true AS written, false AS limited_written FROM runs",
    "saved_labels": "SELECT d.doc_id AS question, CASE WHEN l.quality = 1 THEN 'refused' ELSE 'open' END AS labels, md5(text) AS answer_md5 FROM documents d LEFT JOIN labels l USING (doc_id)",
    "upserted_chunks": f"WITH {_R._CHUNKS} SELECT chunk_id, md5(CASE WHEN lang = 'fr' THEN upper(c.text) ELSE c.text END) AS text_md5 FROM chunks c JOIN documents d ON d.doc_id = c.doc_id UNION ALL SELECT 'new-' || item_id, md5(text) FROM benchmark",
    "class_json": f"""WITH {_J._DEC}, r AS (SELECT refusal_type, {_J._CLEAN} AS clean FROM d), g AS (SELECT refusal_type, count(*) AS n, count(clean) AS decided, count(*) FILTER (clean) AS clean FROM r GROUP BY 1)
SELECT '[' || string_agg('{{"refusal_type":"' || refusal_type || '","n":' || n || ',"decided":' || decided || ',"clean":' || clean || '}}', ',' ORDER BY refusal_type) || ']' AS json FROM g""",
    "in_split": f"WITH {_J._REC}, {_J._ASSIGN.format('true', 'a')} SELECT question, stratum FROM rec JOIN a_all USING (question) WHERE split = 'dev'",
    "to_judge": f"WITH {_J._ENT} SELECT doc_id AS rec, axis FROM documents, {_J._AXES} WHERE (doc_id, axis) NOT IN (SELECT (rec, axis) FROM ent)",
    "retry_waits": """WITH a AS (SELECT event_id, CASE event_type WHEN 'click' THEN (user_id % 7)::DOUBLE WHEN 'view' THEN event_id % 50 + 0.5 END::DOUBLE AS asked FROM events)
SELECT event_id, asked, round(least(120, coalesce(asked, 2.0 ** (event_id % 9)) + (event_id % 10) / 10), 6)::DOUBLE AS wait FROM a""",
    "ligatures_repaired": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "nested_lines": 'SELECT doc_id, lang AS "to", n_chars AS size FROM documents',
    "attack_lines": "SELECT item_id::VARCHAR AS attack, md5('Subject: ' || substr(text, 1, 20) || chr(10) || chr(10) || text) AS text_md5 FROM benchmark",
    "stream_latest": "SELECT user_id, event_type, max(event_id) FILTER (ts = m) AS event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id, event_type) AS m FROM events) GROUP BY user_id, event_type",
    "stream_once": "SELECT user_id, event_type, 1::BIGINT AS n FROM events GROUP BY user_id, event_type",
}
