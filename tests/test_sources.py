import json
import time

import pytest
from pyspark.sql import functions as F

from tessera.sources import sinks, tables
from tessera.streaming import latest


def test_ground_truth(spark):
    rows = spark.read.json(spark.sparkContext.parallelize([json.dumps(r) for r in ({"question": "q", "answer": "a", "contexts": ["c"], "x": 1}, {"question": "r", "answer": "a", "contexts": ["c"], "answerable": False}, {"question": None, "answer": "a", "contexts": None})]))
    records = tables.ground_truth(rows)
    assert "x" not in records.columns and records.where("question = 'q'").first().answerable is True
    assert sorted((r.question or "", r.breach) for r in tables.ground_truth_breaches(records).collect()) == [("", "contexts are not a list"), ("", "no question"), ("r", "refusal of no known class"), ("r", "refusal with contexts")]
    assert [tuple(r) for r in tables.spans(records.where("question = 'q'")).collect()] == [("q", 0, "c")]


def test_library_scores_shapes(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"per_record": [{"question": "q", "faithfulness": 0.5}]}))
    (tmp_path / "k.json").write_text(json.dumps({"per_record": {"q": {"faithfulness": 0.5}}}))
    a, b = tables.library_scores(spark, str(tmp_path / "l.json")), tables.library_scores(spark, str(tmp_path / "k.json"), "keyed")
    assert a.collect() == b.collect() and tables.library_scores(spark, str(tmp_path / "none.json")).count() == 0
    assert tables.pinned(spark, str(tmp_path / "none")) is None


def test_sinks(spark, tmp_path):
    now = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    got = {r.id: r.v for r in sinks.upsert(now, spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int"), "id").collect()}
    assert got == {"a": 1, "b": 3, "c": 4}
    sinks.freeze(now, str(tmp_path / "f"), prompt=sinks.prompt_digest("p"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.freeze(now, str(tmp_path / "f"))
    assert sinks.write_if_complete(now, str(tmp_path / "d"), 1, False) is False
    records = spark.createDataFrame([("q", "a", ["t"], "old")], "question string, answer string, retrieved array<string>, labels string")
    assert sinks.save_labels(records, spark.createDataFrame([("q", "new")], "question string, labels string")).first().labels == "new"
    assert json.loads(sinks.as_json(now, "id").first().json)[1] == {"id": "b", "v": 2}


def test_stream_of_verdicts(spark, tmp_path):
    schema = "key string, at timestamp, value int"
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "key string, n int").select("key", F.timestamp_seconds("n").alias("at"), F.col("n").alias("value")).write.parquet(str(tmp_path / "in"))
    events = latest.read_events(spark, str(tmp_path / "in"), schema)
    run = latest.latest_by_key(events, ["key"], "at").writeStream.format("memory").queryName("newest").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert sorted((r.key, r.value) for r in spark.table("newest").collect()) == [("a", 2), ("b", 1)]
    done = latest.append_to(latest.once_per_key(events, ["key"], "at"), str(tmp_path / "out"), str(tmp_path / "ck"))
    done.awaitTermination(60)
    time.sleep(0.1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_record_filters(spark):
    rows = tables.ground_truth(spark.createDataFrame([("a", True, None), ("b", False, "in_corpus_gap"), ("c", False, "out_of_corpus"), ("d", None, None)], "question string, answerable boolean, refusal_type string"))
    names = lambda df: sorted(r.question for r in df.collect())
    assert names(tables.iter_records(rows)) == ["a", "b", "c", "d"] and names(tables.iter_records(rows, True)) == names(tables.answerable_records(rows)) == ["a", "d"]
    assert names(tables.refusal_records(rows)) == ["b", "c"] and names(tables.refusal_records(rows, "out_of_corpus")) == ["c"]
    with pytest.raises(ValueError, match="refusal_type"):
        tables.refusal_records(rows, "other")
    assert names(tables.head(rows, "question", 2)) == ["a", "b"] and names(tables.head(rows, "question", None)) == ["a", "b", "c", "d"]


def test_answer_labels(spark):
    given = [("ok", '{"refused": true, "fabricated": null}'), ("yes", '{"refused": "yes", "fabricated": false, "misdirected": 1}'), ("lacks", '{"refused": false}'), ("none", None), ("fine", '{"refused": false, "fabricated": false, "misdirected": true}')]
    rows = spark.createDataFrame([(q, "a", ["t"] if q != "fine" else [], x) for q, x in given], "question string, answer string, retrieved array<string>, labels string")
    assert sorted((r.question, r.breach) for r in tables.answer_breaches(rows).collect()) == [
        ("fine", "nothing retrieved"), ("lacks", "label fabricated is absent"), ("none", "no labels"), ("yes", "label misdirected is not true, false or null"), ("yes", "label refused is not true, false or null")
    ]
    typed = spark.createDataFrame([("q", "a", ["t"], (True, None))], "question string, answer string, retrieved array<string>, labels struct<refused:boolean,fabricated:boolean>")
    assert tables.answer_breaches(typed).count() == 0


def test_split_map(spark):
    rows = spark.createDataFrame([({"q": "dev", "r": "test"},)], "split map<string,string>")
    assert sorted(map(tuple, tables.split_map(rows, "split").collect())) == [("q", "dev"), ("r", "test")]
    with pytest.raises(ValueError, match="other"):
        tables.split_map(spark.createDataFrame([({"q": "other"},)], "split map<string,string>"), "split")


def test_readers_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.txt").write_text("x" * 900)
    (tmp_path / "in" / "a.txt").write_text("short é")
    docs, chunks = tables.load_corpus(spark, str(tmp_path / "in"))
    assert sorted(map(tuple, docs.collect())) == [("a", "short é"), ("b", "x" * 900)]
    assert sorted((r.chunk_id, len(r.text)) for r in chunks.collect()) == [("a-0", 7), ("b-0", 800), ("b-1", 260)]
    paged = tables.read_documents(spark, str(tmp_path / "in"), lambda data: [data[:3].decode(errors="ignore"), "end"])
    assert sorted(map(tuple, paged.collect())) == [("a", "sho\nend"), ("b", "xxx\nend")]
    pages = spark.createDataFrame([(4, "<p>a <b>c</b></p>")], "page_id long, html string")
    assert tuple(tables.read_pages(pages).first()) == ("4", "a c")
    (tmp_path / "n.jsonl").write_text(json.dumps({"id": 1, "labels": json.dumps({"a": True})}) + "\n")
    assert tables.nested_json_lines(spark, str(tmp_path / "n.jsonl"), "labels", "a boolean").first().labels.a is True
    (tmp_path / "j.xml").write_text('<testsuite><testcase classname="t.a" time="0.5"/><testcase classname="t.a" time="1"><failure>x</failure></testcase><testcase classname="t.b" time="2"><skipped/></testcase></testsuite>')
    got = {r.file: (r.tests, r.failed, r.seconds) for r in tables.junit(spark, str(tmp_path / "j.xml")).collect()}
    assert got == {"t.a": (2, 1, 1.5), "t.b": (1, 0, 2.0)}
    (tmp_path / "a.jsonl").write_text(json.dumps({"id": "x", "subject": "s", "body": "b"}) + "\n")
    assert tuple(tables.attack_texts(spark, str(tmp_path / "a.jsonl")).first()) == ("x", "Subject: s\n\nb")


def test_cache_of_verdicts(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert tables.load_cache(spark, path, "m").count() == 0
    columns = "key string, judged long, decision boolean, mode string, prompt_version string, model string"
    sinks.append_verdicts(spark.createDataFrame([("k", 1, True, "x", "3", "m"), ("k", 1, False, "x", "3", "n")], columns), path)
    sinks.append_verdicts(spark.createDataFrame([("k", 2, None, "x", "3", "m")], columns), path)
    assert tables.load_cache(spark, path).count() == 3 and tables.load_cache(spark, path, "m").count() == 2
    newest = sinks.read_latest(tables.load_cache(spark, path, "m")).collect()
    assert [(r.key, r.judged, r.decision) for r in newest] == [("k", 2, None)]
    assert [r.model for r in tables.verdict_models(tables.load_cache(spark, path)).collect()] == ["m", "n"]


def test_ingest_and_swap(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    index = str(tmp_path / "index")
    assert [tuple(r)[1:] for r in sinks.ingest(spark, str(tmp_path / "in"), index).collect()] == [(0, "a-0", "one")]
    (tmp_path / "in" / "a.txt").write_text("two")
    (tmp_path / "in" / "b.txt").write_text("new")
    before = sinks.current(spark, index)
    time.sleep(1.1)  # versions are told apart by the time of their pointers
    after = sinks.ingest(spark, str(tmp_path / "in"), index)
    assert sorted((r.chunk_id, r.text) for r in after.collect()) == [("a-0", "two"), ("b-0", "new")]
    assert [r.text for r in before.collect()] == ["one"], "a reader of the old version is not disturbed"


def test_frozen_tables(spark, tmp_path):
    metrics = spark.createDataFrame([(0.5, None)], "hit double, none double")
    sinks.snapshot(metrics, str(tmp_path / "m"))
    assert {r.metric: r.value for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {"hit": 0.5, "none": None}
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.snapshot(metrics, str(tmp_path / "m"))
    scores = spark.createDataFrame([("q", "a", 0.5), ("r", "a", None)], "question string, metric string, score double")
    sinks.add_scores(scores, str(tmp_path / "s"))
    sinks.add_scores(scores.where("question = 'q'").withColumn("metric", F.lit("b")), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3
    records = spark.createDataFrame([(f"q{i}", i, "s", None) for i in range(5)], "question string, pos int, stratum string, paraphrase_of string")
    first = {r.question: r.split for r in sinks.write_split(records.where("pos < 3"), str(tmp_path / "split")).collect()}
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_split(records, str(tmp_path / "split"))
    more = {r.question: r.split for r in sinks.write_split(records, str(tmp_path / "split"), extend=True).collect()}
    assert first == {"q0": "dev", "q1": "test", "q2": "dev"} and more == first | {"q3": "test", "q4": "dev"}
    sinks.save_tasks(spark.createDataFrame([(2,), (1,)], "id int"), str(tmp_path / "t"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2]
    with pytest.raises(ValueError, match="JSON lines"):
        sinks.as_json(spark.range(sinks.REPORT_ROWS + 1), "id")


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 7200)], "key string, n int").select("key", F.timestamp_seconds("n").alias("at")).write.parquet(str(tmp_path / "in"))
    events = latest.read_events(spark, str(tmp_path / "in"), "key string, at timestamp")
    run = latest.windowed_counts(events, "at", "key").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert sorted((r.key, r.window.start.hour, r.n) for r in spark.table("counted").collect()) == [("a", 0, 2), ("b", 2, 1)]


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    from tessera.sources import scratch

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(Session())
