"""Queries of record filters, label checks, report rows, snapshots and resumed runs over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import requests as R
from ..functions import stats
from ..functions import text as T
from ..functions import verdicts as V
from ..operators import exercises as X
from ..operators import gates, reports, security, splits, trace
from ..sources import sinks, tables
from ..sources.scratch import new_path
from ..sources.tables import table
from . import judging, retrieval


def truth_records(spark, d):
    """Documents as records: those in German must be refused, by a class that their source stands for."""
    answerable = F.col("lang") != "de"
    kind = F.when(~answerable, F.when(F.col("source") < "src5", "in_corpus_gap").otherwise("out_of_corpus"))
    contexts = F.when(answerable, F.array("source")).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("question"), F.col("text").alias("answer"), contexts.alias("contexts"), answerable.alias("answerable"), kind.alias("refusal_type"))
    return tables.ground_truth(rows)


def record_filters(spark, d):
    """How many records each filter lets through."""
    rows = truth_records(spark, d)
    parts = {"all": tables.iter_records(rows), "answerable_only": tables.iter_records(rows, True), "answerable": tables.answerable_records(rows), "refusals": tables.refusal_records(rows), **{k: tables.refusal_records(rows, k) for k in tables.REFUSAL_TYPES}}
    out = None
    for name, part in parts.items():
        one = part.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum(F.col("question").cast("long")).alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out


def record_breaches(spark, d):
    """Records with faults put in: no answer, a refusal with contexts, a class that does not exist."""
    rows = truth_records(spark, d)
    qid = F.col("question").cast("long")
    broken = rows.withColumn("answer", F.when(qid % 5 != 0, F.col("answer"))).withColumn("contexts", F.when(qid % 7 == 0, F.array(F.lit("x"))).otherwise(F.col("contexts"))).withColumn("refusal_type", F.when(qid % 3 == 0, "other").otherwise(F.col("refusal_type")))
    return tables.ground_truth_breaches(broken)


def answer_breaches(spark, d):
    """Recorded answers whose labels are JSON: some say yes instead of true, some lack an axis, some have no labels or nothing retrieved."""
    rows = table(spark, d, "labels").where("doc_id is not null")
    refused = F.when(F.col("quality") == 1, '"refused": true').otherwise('"refused": "yes"')
    fabricated = F.when(F.col("toxic") == 1, "").otherwise(', "fabricated": null')
    labels = F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("{"), refused, fabricated, F.lit("}")))
    retrieved = F.when(F.col("doc_id") % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    return tables.answer_breaches(rows.select(F.col("doc_id").alias("question"), F.lit("a").alias("answer"), retrieved.alias("retrieved"), labels.alias("labels")))


def first_questions(spark, d):
    """The head of the fixture that a short run takes."""
    return tables.head(retrieval.questions(spark, d).select("qid"), "qid", 12)


def model_labels(spark, d):
    """Labels of models, their provider and model, the label again, and whether the model is asked not to think."""
    label = F.when(F.col("lang") == "en", F.concat(F.lit("groq/openai/"), "source")).when(F.col("lang") == "de", F.lit("gemini/")).when(F.col("lang") == "fr", F.concat(F.lit("Qwen3:"), "source")).otherwise(F.concat(F.lit("other/"), "source"))
    rows = table(spark, d, "documents").select("doc_id", label.alias("label"))
    provider, model = T.model_parts(F.col("label"))
    return rows.select("doc_id", provider.alias("provider"), model.alias("model"), T.model_label(provider, model).alias("again"), T.thinking_default(model).alias("think"))


def request_keys(spark, d):
    said = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(said.alias("messages"))
    schema = F.when(F.col("conv_id") % 2 == 0, F.lit("{}"))
    options = F.create_map(F.lit("temperature"), F.lit("0"), F.lit("seed"), F.col("conv_id").cast("string"))
    return rows.select("conv_id", R.request_key(F.lit("ollama"), F.lit("qwen3:8b"), F.col("messages"), schema, options).alias("key"))


def judge_prompts(spark, d):
    prompt = T.judge_prompt(F.col("axis"), F.col("question"), F.col("answer"), F.col("retrieved"))
    return judging.judge_records(spark, d).select("rec", "axis", F.md5(prompt).alias("prompt_md5"))


def clean_sets(spark, d):
    chunks = retrieval.chunked(spark, d)
    return splits.clean_sets(chunks.select("chunk_id"), security.threat_chunks(chunks).select("chunk_id"), "chunk_id")


def decided_questions(spark, d):
    return judging.decided(spark, d).withColumnRenamed("doc_id", "question")


def failure_rows(spark, d):
    return reports.failures(decided_questions(spark, d))


def class_report(spark, d):
    return reports.by_class(judging.decided(spark, d))


def clean_per_run(spark, d):
    runs = judging.event_runs(spark, d).withColumn("fabricated", F.when(F.col("answer") != "view", F.col("answer") == "click"))
    return gates.clean_per_run(runs)


def baseline_delta(spark, d):
    """Means of scores over views before and clicks after, and their difference."""
    e = judging.scored_events(spark, d).withColumn("c", F.when(F.col("question") % 2 == 0, F.col("a")).otherwise(float("inf")))
    return gates.baseline_delta(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["a", "b", "c"])


def scores_owed(spark, d):
    """What a resumed run still has to score, when errors gave no number and searches gave none yet."""
    e = judging.scored_events(spark, d)
    held = e.where("event_type != 'search'").select("question", F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("a")).alias("a"), "b")
    return gates.scores_to_make(e.select("question"), held, ["a", "b"])


def metric_snapshot(spark, d):
    """Frozen metrics written to a table and read again."""
    path = new_path(spark, "metrics")
    means = judging.scored_events(spark, d).agg(F.round(F.avg("a"), 6).alias("a"), F.count("*").alias("n"), F.max(F.lit(None).cast("double")).alias("unmeasured"))
    sinks.snapshot(means, path)
    return spark.read.parquet(path)


def unproved_requirements(spark, d):
    """Suppliers as requirements, parts as tests, nations outside one region as evidence."""
    word = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    key = F.col("s_suppkey")
    reqs = table(spark, d, "supplier").select(word("s", key).alias("id"), F.when(key % 4 != 0, F.array(word("p", key), word("p", key * 1000))).alias("tests"), F.when(key % 8 != 0, F.array(word("n", F.col("s_nationkey")))).alias("evidence"))
    tests = table(spark, d, "part").select(word("p", F.col("p_partkey")).alias("id"))
    return trace.unproved(reqs, tests, table(spark, d, "nation").where("n_regionkey != 2").select(word("n", F.col("n_nationkey")).alias("id")))


def requirement_counts(spark, d):
    key = F.col("s_suppkey")
    return trace.counts(table(spark, d, "supplier").select(F.when(key % 4 != 0, F.array_repeat(F.lit("t"), (key % 3).cast("int"))).alias("tests"), (key % 5 == 0).alias("gate")))


def mcnemar_large(spark, d):
    """Groups of thousands of discordant pairs, near balance."""
    cells = table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count_if(F.col("l_suppkey") % 2 == 0).alias("b"), F.count_if(F.col("l_suppkey") % 2 == 1).alias("c"))
    return cells.select("l_linestatus", "b", "c", F.round(stats.mcnemar(F.col("b"), F.col("c")), 6).alias("p"))


def two_sum_sorted(spark, d):
    return X.two_sum_sorted(table(spark, d, "customer").select("c_custkey"), "c_custkey", "c_custkey", 120)


def sorted_searches(spark, d):
    """Places of values that are there and that are not, in sorted numbers and in a matrix."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    key = orders.agg(F.max("o_orderkey")).first()[0]
    at = X.find_sorted(orders, "o_orderkey", "o_orderkey", key).select(F.lit("last").alias("what"), F.col("at").cast("long").alias("at"))
    none = X.find_sorted(orders, "o_orderkey", "o_orderkey", -5).select(F.lit("absent").alias("what"), F.col("at").cast("long").alias("at"))
    cell = X.in_matrix(lines, "l_partkey", 1).select(F.lit("cell").alias("what"), F.col("found").cast("long").alias("at"))
    return at.unionByName(none).unionByName(cell)


def question_groups(spark, d):
    """Groups of questions by kind, with paraphrases apart."""
    from ..operators.metrics import group_of

    rows = judging.split_records(spark, d).withColumn("kind", F.when(F.col("source") == "src4", "multi_hop"))
    return rows.groupBy(group_of(F.col("paraphrase_of"), F.col("kind")).alias("grp")).agg(F.count("*").alias("n"))


def evidence_quotes(spark, d):
    """Verdicts read from replies of three axes, and those that claim the positive case without a quote."""
    axes = spark.createDataFrame([(a, i) for i, a in enumerate(("refused", "fabricated", "misdirected"))], "axis string, i int")
    rows = table(spark, d, "labels").where("doc_id is not null and toxic is not null").crossJoin(F.broadcast(axes))  # three axes
    yes = F.when(F.col("toxic") == 1, "true").otherwise("false")
    quote = F.when(F.col("doc_id") % 2 == 0, "said").otherwise(" ")
    body = {
        "refused": F.concat(F.lit('{"evidence": "'), quote, F.lit('", "answered_anyway": false, "refused": '), yes, F.lit("}")),
        "fabricated": F.concat(F.lit('{"unsupported_claim": "'), quote, F.lit('", "fabricated": '), yes, F.lit("}")),
        "misdirected": F.concat(F.lit('{"asked_about": "a", "answer_is_about": "'), quote, F.lit('", "mismatch_named": false, "misdirected": '), yes, F.lit("}")),
    }
    reply = F.lit(None).cast("string")
    for a, b in body.items():
        reply = F.when(F.col("axis") == a, b).otherwise(reply)
    parsed = rows.select("doc_id", "axis", V.parse_verdict(F.col("axis"), reply).alias("v"))
    return parsed.select("doc_id", "axis", V.verdict_decision(F.col("axis"), F.col("v")).alias("decision"), V.quote_missing(F.col("axis"), F.col("v")).alias("quote_missing"))


QUERIES = {
    f.__name__: f
    for f in (
        record_filters, record_breaches, answer_breaches, first_questions, model_labels, request_keys, judge_prompts, clean_sets, failure_rows, class_report, clean_per_run, baseline_delta, scores_owed, metric_snapshot, unproved_requirements,
        requirement_counts, mcnemar_large, two_sum_sorted, sorted_searches, question_groups, evidence_quotes,
    )
}

_J, _R = judging, retrieval
_TRUTH = "t AS (SELECT doc_id, text, source, lang <> 'de' AS ok, CASE WHEN lang = 'de' THEN CASE WHEN source < 'src5' THEN 'in_corpus_gap' ELSE 'out_of_corpus' END END AS kind FROM documents)"
_SPACE = T.SPACE_CLASS
_PARTS = {"all": "true", "answerable_only": "coalesce(ok, true)", "answerable": "coalesce(ok, true)", "refusals": "NOT ok", "in_corpus_gap": "NOT ok AND kind = 'in_corpus_gap'", "out_of_corpus": "NOT ok AND kind = 'out_of_corpus'"}
_THREAT = "regexp_matches(text, '(?i)\\b(attack|threat|malware|exploit|adversar)')"
ORACLES = {
    "record_filters": f"WITH {_TRUTH} " + " UNION ALL ".join(f"SELECT '{k}' AS part, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM t WHERE {c}" for k, c in _PARTS.items()),
    "record_breaches": f"""WITH {_TRUTH}, b AS (SELECT doc_id::VARCHAR AS question, doc_id % 5 = 0 AS a, NOT ok AND doc_id % 7 = 0 AS c, NOT ok AND doc_id % 3 = 0 AS k FROM t)
SELECT question, 'no answer' AS breach FROM b WHERE a UNION ALL SELECT question, 'refusal with contexts' FROM b WHERE c UNION ALL SELECT question, 'refusal of no known class' FROM b WHERE k""",
    "answer_breaches": """SELECT doc_id AS question, 'no labels' AS breach FROM labels WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id, 'nothing retrieved' FROM labels WHERE doc_id % 13 = 0
UNION ALL SELECT doc_id, 'label refused is not true, false or null' FROM labels WHERE doc_id % 11 <> 0 AND quality IS DISTINCT FROM 1 UNION ALL SELECT doc_id, 'label fabricated is absent' FROM labels WHERE doc_id % 11 <> 0 AND toxic = 1""",
    "first_questions": "SELECT item_id AS qid FROM benchmark ORDER BY item_id LIMIT 12",
    "model_labels": """SELECT doc_id, CASE lang WHEN 'en' THEN 'groq' ELSE 'ollama' END AS provider,
  CASE lang WHEN 'en' THEN 'openai/' || source WHEN 'de' THEN 'gemini/' WHEN 'fr' THEN 'Qwen3:' || source ELSE 'other/' || source END AS model,
  CASE lang WHEN 'en' THEN 'groq/openai/' || source WHEN 'de' THEN 'gemini/' WHEN 'fr' THEN 'Qwen3:' || source ELSE 'other/' || source END AS again, CASE WHEN lang = 'fr' THEN false END AS think FROM documents""",
    "request_keys": """SELECT conv_id, sha256('ollama' || chr(29) || 'qwen3:8b' || chr(29) || string_agg(coalesce(role, '') || chr(31) || coalesce(text, ''), chr(30) ORDER BY turn, coalesce(role, ''), coalesce(text, '')) || chr(29)
  || CASE WHEN conv_id % 2 = 0 THEN '{}' ELSE chr(0) END || chr(29) || 'seed' || chr(31) || conv_id || chr(30) || 'temperature' || chr(31) || '0') AS key FROM conversations GROUP BY conv_id""",
    "judge_prompts": f"""WITH p AS (SELECT doc_id, source, lang, 'Question: ' || doc_id || chr(10) || chr(10) || 'Answer:' || chr(10) || regexp_replace(text, '^{_SPACE}|{_SPACE}$', '', 'g') AS asked FROM documents)
SELECT doc_id AS rec, axis, md5(CASE WHEN axis = 'refused' THEN asked ELSE 'Chunks:' || chr(10) || chr(10) || '[' || source || ']' || chr(10) || lang || chr(10) || chr(10) || asked END) AS prompt_md5 FROM p, {_J._AXES}""",
    "clean_sets": f"""WITH {_R._CHUNKS}, a AS (SELECT chunk_id FROM chunks ORDER BY md5('0-' || chunk_id), chunk_id LIMIT 50),
b AS (SELECT chunk_id FROM chunks WHERE {_THREAT} AND chunk_id NOT IN (SELECT chunk_id FROM a) ORDER BY md5('0-' || chunk_id), chunk_id LIMIT 20)
SELECT 'random' AS sample, chunk_id FROM a UNION ALL SELECT 'threat', chunk_id FROM b""",
    "failure_rows": f"""WITH {_J._DEC}, r AS (SELECT doc_id AS question, refused, fabricated, {_J._MARK.format('answer')} AS phrase FROM d)
SELECT question, 'not refused' AS failure FROM r WHERE NOT refused UNION ALL SELECT question, 'fabricated' FROM r WHERE fabricated UNION ALL SELECT question, 'refused without a phrase' FROM r WHERE refused AND NOT phrase
UNION ALL SELECT question, 'a phrase without a refusal' FROM r WHERE NOT refused AND phrase UNION ALL SELECT question, 'undecided' FROM r WHERE refused IS NULL OR fabricated IS NULL""",
    "class_report": f"WITH {_J._DEC}, r AS (SELECT refusal_type, {_J._CLEAN} AS clean FROM d) SELECT refusal_type, count(*) AS n, count(clean) AS decided, count(*) FILTER (clean) AS clean FROM r GROUP BY refusal_type ORDER BY refusal_type",
    "clean_per_run": f"WITH {_J._RUNS}, r AS (SELECT run, refused, CASE WHEN answer <> 'view' THEN answer = 'click' END AS fabricated FROM runs), c AS (SELECT run, {_J._CLEAN} AS clean FROM r) SELECT run, count(*) AS n, count(clean) AS decided, count(*) FILTER (clean) AS clean FROM c GROUP BY run",
    "baseline_delta": f"""WITH {_J._EV}, e AS (SELECT event_type, round(a, 4) AS a, round(b, 4) AS b, CASE WHEN question % 2 = 0 THEN round(a, 4) END AS c FROM ev),
m AS (SELECT event_type, unnest(['a', 'b', 'c']) AS metric, unnest([round(avg(a), 4), round(avg(b), 4), round(avg(c), 4)]) AS v FROM e WHERE event_type IN ('view', 'click') GROUP BY event_type)
SELECT x.metric, x.v AS before, y.v AS after, round(y.v - x.v, 4) AS delta FROM m x JOIN m y ON x.metric = y.metric AND x.event_type = 'view' AND y.event_type = 'click'""",
    "scores_owed": f"WITH {_J._EV} SELECT question, 'a' AS metric FROM ev WHERE event_type IN ('search', 'error') OR a IS NULL UNION ALL SELECT question, 'b' FROM ev WHERE event_type = 'search' OR b IS NULL",
    "metric_snapshot": f"WITH {_J._EV} SELECT 'a' AS metric, round(avg(a), 6) AS value FROM ev UNION ALL SELECT 'n', count(*)::DOUBLE FROM ev UNION ALL SELECT 'unmeasured', NULL",
    "unproved_requirements": """WITH t AS (SELECT 's' || s_suppkey AS id, unnest(['p' || s_suppkey, 'p' || (s_suppkey * 1000)]) AS ref FROM supplier WHERE s_suppkey % 4 <> 0),
e AS (SELECT 's' || s_suppkey AS id, 'n' || s_nationkey AS ref FROM supplier WHERE s_suppkey % 8 <> 0), p AS (SELECT 'p' || p_partkey AS ref FROM part)
SELECT 'missing tests' AS problem, id, ref FROM t WHERE ref NOT IN (SELECT ref FROM p) UNION ALL SELECT 'missing evidence', id, ref FROM e WHERE ref NOT IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey <> 2)
UNION ALL SELECT 'dangling test', NULL, ref FROM p WHERE ref NOT IN (SELECT ref FROM t) UNION ALL SELECT 'unproved', 's' || s_suppkey, NULL FROM supplier WHERE s_suppkey % 8 = 0""",
    "requirement_counts": "SELECT count(*) AS requirements, sum(CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 3 ELSE 0 END)::BIGINT AS tests, count(*) FILTER (s_suppkey % 5 = 0) AS gates FROM supplier",
    "mcnemar_large": "WITH c AS (SELECT l_linestatus, count(*) FILTER (l_suppkey % 2 = 0) AS b, count(*) FILTER (l_suppkey % 2 = 1) AS c FROM lineitem GROUP BY 1) SELECT l_linestatus, b, c, round(least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))), 6)::DOUBLE AS p FROM c",
    "two_sum_sorted": "SELECT a.c_custkey AS i, b.c_custkey AS j FROM customer a JOIN customer b ON a.c_custkey + b.c_custkey = 120 AND a.c_custkey < b.c_custkey ORDER BY i, j DESC LIMIT 1",
    "sorted_searches": "SELECT 'last' AS what, max(o_orderkey)::BIGINT AS \"at\" FROM orders UNION ALL SELECT 'absent', -1 UNION ALL SELECT 'cell', bool_or(l_partkey = 1)::BIGINT FROM lineitem",
    "question_groups": f"WITH {_J._REC}, g AS (SELECT CASE WHEN r.para IS NOT NULL THEN 'paraphrase' WHEN d.source = 'src4' THEN 'multi_hop' ELSE 'original' END AS grp FROM rec r JOIN documents d ON d.doc_id = r.question) SELECT grp, count(*) AS n FROM g GROUP BY grp",
    "evidence_quotes": "SELECT doc_id, axis, toxic = 1 AS decision, toxic = 1 AND doc_id % 2 <> 0 AS quote_missing FROM labels, (SELECT unnest(['refused', 'fabricated', 'misdirected']) AS axis) WHERE doc_id IS NOT NULL AND toxic IS NOT NULL",
}
