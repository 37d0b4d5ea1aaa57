"""Queries on verdicts, gates, statistics, splits, security and the exercises, with the driver's tables standing in for frozen answer sets.

labels: quality and toxic are two raters, or the refused and fabricated axes;
documents are the answers; events are runs, probes and timed tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..functions import verdicts as V
from ..operators import exercises as X
from ..operators import gates, security, splits, trace
from ..operators import verdicts as O
from ..sources.scratch import materialize
from ..sources.tables import spread, table

CANARY, URL = "k\": 7", "http://"


def decided(spark: SparkSession, d: str) -> DataFrame:
    """One row per document with the decisions that its labels stand for; unlabelled ones have none. Whether the text reads as a refusal is told before the join, which then need not move texts."""
    labels = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("refused"), (F.col("toxic") == 1).alias("fabricated"))
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "lang", "text"))
    return docs.select("doc_id", F.col("source").alias("refusal_type"), "lang", F.col("text").alias("answer"), T.looks_like_refusal(F.col("text")).alias("phrase")).join(labels, "doc_id", "left")


def phrase_refusals(spark, d):
    rows = table(spark, d, "conversations")
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.count_if(T.looks_like_refusal(F.col("text"))).alias("refused"))


def phrase_markers(spark, d):
    """Every marker after every whole benchmark text still marks a refusal; a plain one does not."""
    head = F.col("text")
    rows = table(spark, d, "benchmark").select("item_id", F.explode(F.array(*[F.lit(m) for m in (*T.REFUSAL_MARKERS, "no such curve is specified", "curve P-256 is specified", "all is well")])).alias("marker"), head.alias("head"))
    return rows.select("item_id", "marker", T.looks_like_refusal(F.concat("head", F.lit(" "), F.upper("marker"), F.lit("."))).alias("refusal"))


def judged_summary(spark, d):
    return O.judged_summary(decided(spark, d))


def decision_matrix(spark, d):
    return O.matrix(decided(spark, d))


def hand_clean(spark, d):
    rows = decided(spark, d).withColumn("misdirected", F.when(F.col("refusal_type") == "src1", True).when(F.col("refusal_type") == "src2", False))
    clean = V.hand_clean(F.col("refused"), F.col("fabricated"), F.col("misdirected"))
    return rows.select("doc_id", clean.alias("hand_clean"), V.clean(F.col("refused"), F.col("fabricated")).alias("clean"))


def confusion_matrix(spark, d):
    return stats.confusion(decided(spark, d), "fabricated", "refused")


def cohen_kappa(spark, d):
    return stats.agreement(decided(spark, d), "refused", "fabricated", ["refusal_type"])


def wilson_interval(spark, d):
    rows = decided(spark, d).where("fabricated is not null").groupBy("refusal_type").agg(F.count("*").alias("n"), F.count_if("fabricated").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rows.select("refusal_type", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def mcnemar_exact(spark, d):
    cells = decided(spark, d).groupBy("refusal_type").agg(F.count_if(F.expr("refused and not fabricated")).alias("b"), F.count_if(F.expr("not refused and fabricated")).alias("c"))
    return cells.select("refusal_type", "b", "c", F.round(stats.mcnemar(F.col("b"), F.col("c")), 6).alias("p"))


def observed_axes(spark, d):
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("question"), (F.col("quality") == 1).alias("refused"), F.when(F.col("doc_id") % 7 != 0, F.col("toxic") == 1).alias("fabricated"))
    return gates.unpivot_axes(rows, ["question"], list(V.AXES))


def pinned_axes(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("question"), (F.col("n_chars") > 300).alias("refused"), F.when(F.col("lang") != "de", F.col("lang") == "fr").alias("fabricated"))
    return gates.unpivot_axes(rows.where("source != 'src3'"), ["question"], ["refused", "fabricated", "misdirected"])


def pins_diff(spark, d):
    return gates.pins_diff(observed_axes(spark, d), pinned_axes(spark, d))


def pins_counts(spark, d):
    return gates.pins_counts(observed_axes(spark, d), pinned_axes(spark, d))


def first_flips(spark, d):
    runs = table(spark, d, "events").select((F.col("user_id") % 5).alias("run"), F.col("event_id").alias("question"), F.lit("refused").alias("axis"), (F.col("event_type") == "error").alias("value"))
    again = runs.groupBy((F.col("question") % 50).alias("question"), "axis", "run").agg(F.bool_or("value").alias("value"))
    pinned = spark.range(50).select(F.col("id").alias("question"), F.lit("refused").alias("axis"), F.lit(False).alias("value"))
    return gates.first_flips(again, pinned)


def carry_labels(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("question"), F.trim("text").alias("answer"), F.array("source", "lang").alias("texts"))
    moved = F.when(F.col("lang") == "de", F.concat("answer", F.lit("!"))).otherwise(F.col("answer"))
    old = rows.join(decided(spark, d).select(F.col("doc_id").alias("question"), "lang", "refused", "fabricated"), "question")
    old = old.select("question", moved.alias("answer"), F.when(F.col("lang") == "fr", F.reverse("texts")).otherwise(F.col("texts")).alias("texts"), "refused", "fabricated", F.lit(None).cast("boolean").alias("misdirected"))
    return gates.carry_labels(rows, old)


def event_runs(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("question"), (F.col("event_id") % 5).alias("run")).agg(F.bool_or(F.col("event_type") == "error").alias("refused"), F.min("event_type").alias("answer"))


def run_stability(spark, d):
    return gates.stability(event_runs(spark, d))


def stability_summary(spark, d):
    return gates.stability_summary(event_runs(spark, d))


def judge_noise(spark, d):
    runs = event_runs(spark, d).select("run", F.col("question").alias("key"), F.when(F.col("answer") != "click", F.col("refused")).alias("value"))
    return gates.judge_noise(runs, runs.where("run = 0").select("key", "value"))


def recordings_diff(spark, d):
    docs = decided(spark, d).select(F.col("doc_id").alias("question"), F.md5("answer").alias("answer"), F.col("refused").alias("verdict"), F.col("fabricated").alias("label"))
    turns = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("question")).agg(F.md5(F.min("text")).alias("answer"), (F.count("*") > 4).alias("verdict"), F.bool_or(F.col("role") == "system").alias("label"))
    return gates.recordings_diff(docs, turns)


def scored_events(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, d, "events").select(F.col("event_id").alias("question"), "event_type", (F.col("value") / 100).alias("a"), (k / 100).alias("b"), (F.col("event_type") == "error").alias("label"))


def score_correlation(spark, d):
    return stats.correlation(scored_events(spark, d), "a", "b", by=["event_type"])


def score_disagreements(spark, d):
    return gates.score_disagreements(scored_events(spark, d), "a", "b").select("question", "gap")


def library_means(spark, d):
    rows = scored_events(spark, d).withColumn("c", F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("a")))
    return gates.library_means(rows, ["a", "b", "c"], rows.count())


def score_cuts(spark, d):
    return gates.best_cut(scored_events(spark, d), "b", "label")


def split_records(spark, d):
    """Documents as records of a split; texts are compared by SHA-256 and length, so they are read once and never shuffled. Written once, since a split reads its records several times."""
    text = F.struct(F.unhex(F.sha2("text", 256)).alias("hash"), F.length("text").alias("n"))
    docs = materialize(table(spark, d, "documents").where("text is not null").select("doc_id", "lang", "source", text.alias("text")), "digests")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("of"))
    rows = docs.join(first, "text").select(F.col("doc_id").alias("question"), F.col("doc_id").alias("pos"), "lang", "source", F.when(F.col("of") != F.col("doc_id"), F.col("of")).alias("paraphrase_of"))
    kind = F.when(F.col("source") == "src4", "multi_hop")
    return materialize(rows.withColumn("stratum", splits.stratum(F.col("lang") != "de", kind, F.col("source") == "src5", F.lit("out_of_corpus"))), "records")


def split_assignment(spark, d):
    return splits.assign(split_records(spark, d))


def split_extension(spark, d):
    rows = split_records(spark, d)
    held = splits.assign(rows.where("lang in ('en', 'de')"))
    return splits.extend(rows, held)


def by_split(spark, d):
    rows = split_assignment(spark, d).withColumnRenamed("question", "doc_id").join(decided(spark, d), "doc_id")
    clean = V.clean(F.col("refused"), F.col("fabricated"))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if(clean).alias("judged"), F.count(clean).alias("known"), F.count_if("phrase").alias("phrase"))


def latest_verdict(spark, d):
    return O.latest(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


def judge_records(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("rec"), F.col("doc_id").cast("string").alias("question"), F.col("text").alias("answer"), F.array(F.struct("source", F.col("lang").alias("text"))).alias("retrieved"))
    return docs.select("*", F.explode(F.array(*[F.lit(a) for a in V.AXES])).alias("axis"), F.lit("qwen3:8b").alias("model"))


def verdict_cache(spark, d):
    """Verdicts on labelled documents: old prompts for some, two entries for others, by content."""
    rows = judge_records(spark, d).join(table(spark, d, "labels").select(F.col("doc_id").alias("rec"), "quality", "toxic"), "rec")
    shapes = spark.createDataFrame([("nothink/schema", "3"), ("nothink/schema", "2")], "mode string, prompt_version string")
    keyed = O.content_keys(rows, shapes)
    held = keyed.where(F.when(F.col("prompt_version") == "2", F.col("rec") % 3 == 0).otherwise(F.col("rec") % 3 != 1))
    value = F.when(F.col("axis") == "refused", F.col("quality") == 1).otherwise(F.col("toxic") == 1)
    return held.select("key", "mode", "prompt_version", (F.col("rec") + F.col("prompt_version").cast("int")).alias("judged"), value.alias("decision"))


def cache_keys(spark, d):
    shapes = spark.createDataFrame([("nothink/schema", "3")], "mode string, prompt_version string")
    return O.content_keys(judge_records(spark, d), shapes).select("rec", "axis", "key")


def cache_entries(spark, d):
    return O.entries_for(judge_records(spark, d), verdict_cache(spark, d)).select("rec", "axis", "version", "age", "decision")


def cache_freshness(spark, d):
    rows = judge_records(spark, d)
    return O.freshness(rows, O.entries_for(rows, verdict_cache(spark, d)))


def axis_decisions(spark, d):
    rows = judge_records(spark, d)
    return O.axis_decisions(rows.select("rec").distinct(), O.entries_for(rows, verdict_cache(spark, d)))


def attack_success(spark, d):
    p = table(spark, d, "events").select(F.col("event_type").alias("prompt"), F.col("user_id").alias("attack"), security.obeyed(F.col("props"), CANARY, URL).alias("obeyed"))
    return security.attack_success(p)


def false_alarm_rate(spark, d):
    rows = table(spark, d, "documents").select(F.col("lang").alias("sample"), F.contains("text", F.lit("%%")).alias("flagged"))
    return security.false_alarms(rows)


def one_per_team(spark, d):
    return splits.one_per_group(table(spark, d, "documents").where("source is not null"), "source", "doc_id", seed=0)


def random_carriers(spark, d):
    return splits.sample_rows(table(spark, d, "documents").select("doc_id"), "doc_id", 50, 0, security.threat_chunks(table(spark, d, "documents")))


def usefulness_summary(spark, d):
    outcome = F.when(F.col("event_type") == "click", "accepted").when(F.col("event_type") == "view", "checked").when(F.col("event_type") == "error", "skipped").otherwise("declined")
    t = table(spark, d, "events").select(outcome.alias("outcome"), F.col("value").alias("seconds"), F.get_json_object("props", "$.k").cast("double").alias("by_hand_seconds"))
    return trace.usefulness(t)


def traceability_orphans(spark, d):
    served = F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("c"), (F.col("o_orderkey") % 100000).cast("string")))
    needs = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), served.alias("served_by"))
    reqs = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return trace.orphans(needs, reqs)


def figures(spark, d):
    rows = table(spark, d, "pages").select("page_id", T.concrete_figures(F.col("html")).alias("f"))
    return rows.select("page_id", F.array_join("f", ",").alias("figures"))


def slugs(spark, d):
    return table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


def merge_intervals(spark, d):
    start = F.unix_timestamp("ts")
    rows = table(spark, d, "events").select("user_id", start.alias("start"), (start + F.floor(F.col("value") * 600)).alias("end"))
    return X.merge_intervals(rows, "user_id", "start", "end")


def benchmark_words(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.posexplode(T.tokens(F.col("text"))).alias("at", "word"))


def group_anagrams(spark, d):
    return X.group_anagrams(benchmark_words(spark, d), "word")


def contains_duplicate(spark, d):
    return X.duplicates(benchmark_words(spark, d).select("word"), "word")


def top_k_frequent(spark, d):
    rows = benchmark_words(spark, d).select("word", (F.col("item_id") * 100_000 + F.col("at")).alias("pos"))
    return X.top_k_frequent(rows, "word", "pos", 20)


def multiset_intersect(spark, d):
    """Words that texts in English or German share with texts in any other language or none, as often as both have them."""
    docs = table(spark, d, "documents").select(F.coalesce(F.col("lang").isin("en", "de"), F.lit(False)).alias("west"), F.explode(T.tokens(F.col("text"))).alias("word"))
    return X.multiset_intersect(docs.where("west").select("word"), docs.where("not west").select("word")).groupBy("word").agg(F.count("*").alias("n"))


def two_sum(spark, d):
    return X.two_sum(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 2000)


def product_except_self(spark, d):
    rows = table(spark, d, "nation").select("n_regionkey", "n_nationkey", ((F.col("n_nationkey") - 3) * 1009).alias("v"))
    return X.product_except_self(rows, "n_regionkey", "n_nationkey", "v")


def longest_substr_no_repeat(spark, d):
    return table(spark, d, "pages").select("page_id", X.longest_without_repeat(F.col("html")).cast("long").alias("longest"))


def is_palindrome(spark, d):
    return benchmark_words(spark, d).select("item_id", "at", X.is_palindrome(F.concat("word", F.lit(" "), F.when(F.col("at") % 2 == 0, F.reverse("word")).otherwise(F.col("word")))).alias("palindrome"))


def string_to_integer(spark, d):
    text = F.concat(F.repeat(F.lit(" "), (F.col("event_id") % 3).cast("int")), F.element_at(F.array(F.lit("-"), F.lit("+"), F.lit("")), (F.col("event_id") % 3 + 1).cast("int")), F.col("user_id").cast("string"), F.when(F.col("event_id") % 5 == 0, "99999999999").otherwise("x7"))
    return table(spark, d, "events").select("event_id", X.to_integer(text).alias("number"))


def sudoku_conflicts(spark, d):
    cells = table(spark, d, "events").select(F.floor((F.col("event_id") % 81) / 9).alias("row"), (F.col("event_id") % 9).alias("col"), (F.col("user_id") % 9 + 1).alias("digit"))
    return X.sudoku_conflicts(cells)


def valid_parentheses(spark, d):
    plain = F.regexp_replace("html", r"[^()\[\]{}]", "")
    return table(spark, d, "pages").select("page_id", X.valid_parentheses(plain).alias("valid"))


def prefix_minimum(spark, d):
    return X.prefix_minimum(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("event_id", "minimum")


def parse_verdicts(spark, d):
    """Replies made of documents' labels in several shapes, read back."""
    rows = decided(spark, d).where("refused is not null")
    body = F.concat(F.lit('{"evidence": "a } in a quote", "answered_anyway": '), F.when(F.col("fabricated"), '"Yes"').otherwise("false"), F.lit(', "refused": '), F.when(F.col("lang") == "de", F.lit("1")).otherwise(F.col("refused").cast("string")), F.lit("}"))
    reply = F.when(F.col("lang") == "fr", F.concat(F.lit("<think>{no}</think> Here: "), body)).when(F.col("lang") == "es", F.lit("none")).otherwise(body)
    parsed = rows.select("doc_id", V.parse_verdict(F.lit("refused"), reply).alias("v"))
    return parsed.select("doc_id", "v.ok", "v.error", V.verdict_decision(F.lit("refused"), F.col("v")).alias("decision"), V.quote_missing(F.lit("refused"), F.col("v")).alias("quote_missing"))


def bootstrap_ci(spark, d):
    rows = table(spark, d, "benchmark").select(F.length("text").alias("v"))
    out = stats.bootstrap(rows, "v")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


def nfkc_repair(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.nfkc(T.repair_ligatures(F.col("text")))).alias("repaired_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        phrase_refusals, phrase_markers, judged_summary, decision_matrix, hand_clean, confusion_matrix, cohen_kappa, wilson_interval, mcnemar_exact, pins_diff, pins_counts, first_flips, carry_labels, run_stability, stability_summary, judge_noise,
        recordings_diff, score_correlation, score_disagreements, library_means, score_cuts, split_assignment, split_extension, by_split, latest_verdict, cache_keys, cache_entries, cache_freshness, axis_decisions, attack_success, false_alarm_rate,
        one_per_team, random_carriers, usefulness_summary, traceability_orphans, figures, slugs, merge_intervals, group_anagrams, contains_duplicate, top_k_frequent, multiset_intersect, two_sum, product_except_self, longest_substr_no_repeat,
        is_palindrome, string_to_integer, sudoku_conflicts, valid_parentheses, prefix_minimum, parse_verdicts, bootstrap_ci, nfkc_repair,
    )
}

_MARK = "(" + " OR ".join("contains(lower({0}), '" + m.replace("'", "''") + "')" for m in T.REFUSAL_MARKERS) + " OR regexp_matches(lower({0}), '" + T.NONE_SPECIFIED.replace("{", "{{").replace("}", "}}") + "'))"
_DEC = "d AS (SELECT doc_id, source AS refusal_type, lang, text AS answer, quality = 1 AS refused, toxic = 1 AS fabricated FROM documents LEFT JOIN labels USING (doc_id))"
_CLEAN = "CASE WHEN refused IS NOT NULL AND fabricated IS NOT NULL THEN refused AND NOT fabricated END"
_OBS = "obs AS (SELECT doc_id AS question, 'refused' AS axis, quality = 1 AS now FROM labels UNION ALL SELECT doc_id, 'fabricated', CASE WHEN doc_id % 7 <> 0 THEN toxic = 1 END FROM labels)"
_PIN = "pin AS (SELECT doc_id AS question, 'refused' AS axis, n_chars > 300 AS was FROM documents WHERE source <> 'src3' UNION ALL SELECT doc_id, 'fabricated', CASE WHEN lang <> 'de' THEN lang = 'fr' END FROM documents WHERE source <> 'src3')"
_RUNS = "runs AS (SELECT user_id AS question, event_id % 5 AS run, bool_or(event_type = 'error') AS refused, min(event_type) AS answer FROM events GROUP BY ALL)"
_EV = "ev AS (SELECT event_id AS question, event_type, value / 100 AS a, (props->>'k')::DOUBLE / 100 AS b, event_type = 'error' AS label FROM events)"
_KAPPA = "CASE WHEN n > 0 AND NOT (yn + ny = 0 AND (yy = 0 OR nn = 0)) THEN round(((yy + nn) / n - ((yy + yn) * (yy + ny) + (ny + nn) * (yn + nn)) / (n * n)) / (1 - ((yy + yn) * (yy + ny) + (ny + nn) * (yn + nn)) / (n * n)), 6) END"
_STRAT = "CASE WHEN lang <> 'de' THEN CASE WHEN source = 'src4' THEN 'multi_hop' ELSE 'answerable' END WHEN source = 'src5' THEN 'bait' ELSE 'out_of_corpus' END"
_REC = f"rec AS (SELECT doc_id AS question, lang, {_STRAT} AS stratum, CASE WHEN of_ <> doc_id THEN of_ END AS para FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS of_ FROM documents))"
_ASSIGN = "{1} AS (SELECT question, CASE WHEN (row_number() OVER (PARTITION BY stratum ORDER BY question) - 1) % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM rec WHERE para IS NULL AND {0}), {1}_all AS (SELECT * FROM {1} UNION ALL SELECT r.question, split FROM rec r JOIN {1} o ON r.para = o.question WHERE {0})"
_KEY = "substr(sha256({0} || chr(0) || 'nothink/schema' || chr(0) || 'qwen3:8b' || chr(0) || axis || chr(0) || doc_id || chr(0) || text || chr(0) || '[' || source || ']' || chr(10) || lang), 1, 16)"
_AXES = "(SELECT unnest(['refused', 'fabricated']) AS axis)"
# entries hang on content, so records of equal content would share them; doc_id is in it, so each has its own
_ENT = f"""ent AS (
  SELECT doc_id AS rec, axis, version, (row_number() OVER (PARTITION BY doc_id, axis ORDER BY doc_id + version::INTEGER DESC))::INTEGER AS age, CASE WHEN axis = 'refused' THEN quality = 1 ELSE toxic = 1 END AS decision
  FROM documents JOIN labels USING (doc_id), {_AXES}, (SELECT unnest(['2', '3']) AS version) WHERE CASE WHEN version = '2' THEN doc_id % 3 = 0 ELSE doc_id % 3 <> 1 END)"""
_BW = "bw AS (SELECT item_id, i - 1 AS \"at\", w[i] AS word FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:[-.][a-z0-9]+)*') AS w FROM benchmark)))"


def _wil(k: str, n: str, sign: str) -> str:
    n = f"({n})::DOUBLE"
    return f"round(({k} / {n} + 1.96 * 1.96 / (2 * {n})) / (1 + 1.96 * 1.96 / {n}) {sign} 1.96 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 1.96 * 1.96 / (4 * {n} * {n})) / (1 + 1.96 * 1.96 / {n}), 6)"


_MARKERS = "[" + ", ".join("'" + m.replace("'", "''") + "'" for m in (*T.REFUSAL_MARKERS, "no such curve is specified", "curve P-256 is specified", "all is well")) + "]"

ORACLES = {
    "phrase_refusals": f"SELECT role, count(*) AS n, count(*) FILTER ({_MARK.format('text')}) AS refused FROM conversations GROUP BY role",
    "phrase_markers": f"WITH m AS (SELECT item_id, unnest({_MARKERS}) AS marker, text AS head FROM benchmark) SELECT item_id, marker, {_MARK.format(chr(40) + 'head || chr(32) || upper(marker) || chr(46)' + chr(41))} AS refusal FROM m",
    "judged_summary": f"WITH {_DEC}, r AS (SELECT *, {_CLEAN} AS clean, {_MARK.format('answer')} AS phrase FROM d) SELECT coalesce(refusal_type, 'all') AS grp, count(*) AS n, count(clean) AS decided, count(*) FILTER (clean) AS clean, count(*) FILTER (refused) AS refused, count(*) FILTER (fabricated) AS fabricated, count(*) - count(clean) AS undecided, round(coalesce(count(*) FILTER (clean) / nullif(count(clean), 0), 0), 6) AS clean_rate, round(count(*) FILTER (phrase) / count(*), 6) AS phrase_rate FROM r GROUP BY GROUPING SETS ((), (refusal_type))",
    "decision_matrix": f"WITH {_DEC} SELECT count(*) FILTER (refused AND NOT fabricated) AS refused_clean, count(*) FILTER (refused AND fabricated) AS refused_fabricated, count(*) FILTER (NOT refused AND NOT fabricated) AS answered_clean, count(*) FILTER (NOT refused AND fabricated) AS answered_fabricated, count(*) FILTER (refused IS NULL OR fabricated IS NULL) AS undecided FROM d",
    "hand_clean": f"WITH {_DEC} SELECT doc_id, CASE WHEN refused IS NULL OR fabricated IS NULL THEN NULL WHEN refusal_type = 'src1' THEN false ELSE refused AND NOT fabricated END AS hand_clean, {_CLEAN} AS clean FROM d",
    "confusion_matrix": f"WITH {_DEC}, c AS (SELECT count(*) FILTER (fabricated AND refused) AS tp, count(*) FILTER (fabricated AND NOT refused) AS fp, count(*) FILTER (NOT fabricated AND refused) AS fn, count(*) FILTER (NOT fabricated AND NOT refused) AS tn FROM d) SELECT tp, fp, fn, tn, round(tp / nullif(tp + fn, 0), 6) AS tpr, round(tn / nullif(tn + fp, 0), 6) AS tnr FROM c",
    "cohen_kappa": f"WITH {_DEC}, c AS (SELECT refusal_type, count(*) FILTER (refused AND fabricated) AS yy, count(*) FILTER (refused AND NOT fabricated) AS yn, count(*) FILTER (NOT refused AND fabricated) AS ny, count(*) FILTER (NOT refused AND NOT fabricated) AS nn, count(*) FILTER (refused IS NULL OR fabricated IS NULL) AS skipped FROM d GROUP BY 1), e AS (SELECT *, yy + yn + ny + nn AS n FROM c) SELECT refusal_type, n, yy + nn AS agree, round(coalesce((yy + nn) / nullif(n, 0), 0), 6) AS rate, {_KAPPA} AS kappa, yy AS yes_yes, yn AS yes_no, ny AS no_yes, nn AS no_no, skipped FROM e",
    "wilson_interval": f"WITH {_DEC}, c AS (SELECT refusal_type, count(*) AS n, count(*) FILTER (fabricated) AS k FROM d WHERE fabricated IS NOT NULL GROUP BY 1) SELECT refusal_type, n, k, {_wil('k', 'n', '-')} AS low, {_wil('k', 'n', '+')} AS high FROM c",
    "mcnemar_exact": f"WITH {_DEC}, c AS (SELECT refusal_type, count(*) FILTER (refused AND NOT fabricated) AS b, count(*) FILTER (NOT refused AND fabricated) AS c FROM d GROUP BY 1), l AS (SELECT refusal_type, b, c, list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))) AS s FROM c) SELECT refusal_type, b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE round(least(1, 2 * s), 6) END::DOUBLE AS p FROM l",
    "pins_diff": f"WITH {_OBS}, {_PIN} SELECT question, axis, was, now FROM obs JOIN pin USING (question, axis) WHERE was IS DISTINCT FROM now",
    "pins_counts": f"WITH {_OBS}, {_PIN}, q AS (SELECT DISTINCT question FROM obs) SELECT count(*) FILTER (question IN (SELECT question FROM pin)) AS checked, count(*) FILTER (question NOT IN (SELECT question FROM pin)) AS unknown FROM q",
    "first_flips": "WITH r AS (SELECT event_id % 50 AS question, user_id % 5 AS run, bool_or(event_type = 'error') AS v FROM events GROUP BY ALL) SELECT question, 'refused' AS axis, min(run) AS first_run FROM r WHERE v GROUP BY question",
    "carry_labels": f"WITH {_DEC}, k AS (SELECT *, lang <> 'de' AND (lang <> 'fr' OR refusal_type = lang) AND refused IS NOT NULL AS kept FROM d) SELECT doc_id AS question, kept, CASE WHEN kept THEN refused END AS refused, CASE WHEN kept THEN fabricated END AS fabricated, NULL::BOOLEAN AS misdirected FROM k",
    "run_stability": f"WITH {_RUNS} SELECT question, string_agg(CASE WHEN refused THEN 'R' ELSE '.' END, '' ORDER BY run) AS marks, count(DISTINCT refused) > 1 AS flips, count(DISTINCT answer) AS n_texts FROM runs GROUP BY question",
    "stability_summary": f"WITH {_RUNS}, q AS (SELECT question, count(DISTINCT refused) > 1 AS flips, count(DISTINCT answer) AS n FROM runs GROUP BY question), t AS (SELECT avg(refused::INTEGER) AS rate FROM runs GROUP BY run) SELECT (SELECT round(max(rate) - min(rate), 6) FROM t) AS spread, count(*) FILTER (flips) AS flips, count(*) FILTER (n > 1) AS reworded, count(*) AS questions FROM q",
    "judge_noise": f"WITH {_RUNS}, r AS (SELECT run, question AS key, CASE WHEN answer <> 'click' THEN refused END AS value FROM runs), k AS (SELECT r.key, count(DISTINCT r.value) + max((r.value IS NULL)::INTEGER) > 1 AS flipped, bool_or(r.value IS DISTINCT FROM c.value) AS vs FROM r LEFT JOIN (SELECT key, value FROM r WHERE run = 0) c USING (key) GROUP BY r.key) SELECT count(*) AS keys, count(*) FILTER (flipped) AS flipped, count(*) FILTER (vs) AS vs_cache FROM k",
    "recordings_diff": f"WITH {_DEC}, t AS (SELECT conv_id AS q, min(text) AS m, count(*) > 4 AS v, bool_or(role = 'system') AS l FROM conversations GROUP BY 1) SELECT count(*) AS shared, count(*) FILTER (answer <> m) AS answers_changed, count(*) FILTER (refused IS DISTINCT FROM v) AS verdicts_moved, count(*) FILTER (fabricated <> l) AS labels_moved FROM d JOIN t ON d.doc_id = t.q",
    "score_correlation": f"WITH {_EV} SELECT event_type, count(*) AS n, CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN round(corr(a, b), 6) END AS r, count(*) FILTER (abs(a - b) > 0.5) AS far_apart FROM ev WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY event_type",
    "score_disagreements": f"WITH {_EV} SELECT question, round(abs(a - b), 6) AS gap FROM ev WHERE round(abs(a - b), 6) > 0.6 ORDER BY gap DESC, question LIMIT 6",
    "library_means": f"WITH {_EV}, s AS (SELECT round(a, 4) AS a, round(b, 4) AS b, CASE WHEN event_type <> 'error' THEN round(a, 4) END AS c FROM ev) SELECT CASE WHEN count(a) = count(*) THEN round(avg(a), 4) END AS a, CASE WHEN count(b) = count(*) THEN round(avg(b), 4) END AS b, CASE WHEN count(c) = count(*) THEN round(avg(c), 4) END AS c FROM s",
    "score_cuts": f"WITH {_EV}, k AS (SELECT b, label FROM ev WHERE b IS NOT NULL), cuts AS (SELECT DISTINCT b AS cut FROM k UNION SELECT 0.5), m AS (SELECT cut, count(*) FILTER (b >= cut AND label) AS yy, count(*) FILTER (b >= cut AND NOT label) AS yn, count(*) FILTER (b < cut AND label) AS ny, count(*) FILTER (b < cut AND NOT label) AS nn, count(*) AS n FROM cuts, k GROUP BY cut) SELECT cut, yy + nn AS agree, round((yy + nn) / n, 6) AS rate, {_KAPPA} AS kappa FROM m",
    "split_assignment": f"WITH {_REC}, {_ASSIGN.format('true', 'a')} SELECT question, split FROM a_all",
    "split_extension": f"""WITH {_REC}, {_ASSIGN.format("lang IN ('en', 'de')".replace("lang", "rec.lang"), 'a').replace('FROM rec r JOIN a o ON r.para = o.question WHERE rec.lang', 'FROM rec r JOIN a o ON r.para = o.question WHERE r.lang')},
n AS (SELECT stratum, count(*) AS n FROM rec WHERE para IS NULL AND question IN (SELECT question FROM a_all) GROUP BY 1),
x AS (SELECT question, CASE WHEN (coalesce(n, 0) + row_number() OVER (PARTITION BY stratum ORDER BY question) - 1) % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM rec LEFT JOIN n USING (stratum) WHERE para IS NULL AND question NOT IN (SELECT question FROM a_all)),
k AS (SELECT * FROM a_all UNION ALL SELECT * FROM x)
SELECT * FROM x UNION ALL SELECT r.question, k.split FROM rec r JOIN k ON r.para = k.question WHERE r.question NOT IN (SELECT question FROM a_all)""",
    "by_split": f"WITH {_REC}, {_ASSIGN.format('true', 'a')}, {_DEC}, r AS (SELECT split, {_CLEAN} AS clean, {_MARK.format('answer')} AS phrase FROM a_all JOIN d ON d.doc_id = question) SELECT split, count(*) AS n, count(*) FILTER (clean) AS judged, count(clean) AS known, count(*) FILTER (phrase) AS phrase FROM r GROUP BY split",
    "latest_verdict": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1",
    "cache_keys": f"SELECT doc_id AS rec, axis, {_KEY.format(repr('3'))} AS key FROM documents, {_AXES}",
    "cache_entries": f"WITH {_ENT} SELECT rec, axis, version, age, decision FROM ent",
    "cache_freshness": f"WITH {_ENT}, h AS (SELECT rec, axis, bool_or(version = '3') AS cur FROM ent GROUP BY ALL), r AS (SELECT doc_id AS rec, axis FROM documents, {_AXES}) SELECT count(*) AS expected, count(*) FILTER (cur) AS current, count(*) FILTER (NOT cur) AS stale, count(*) FILTER (cur IS NULL) AS missing FROM r LEFT JOIN h USING (rec, axis)",
    "axis_decisions": f"WITH {_ENT}, g AS (SELECT rec, bool_or(decision) FILTER (axis = 'refused' AND age = 1) AS refused, bool_or(decision) FILTER (axis = 'fabricated' AND age = 1) AS fabricated, max(age) > 1 AS conflict FROM ent GROUP BY rec) SELECT doc_id AS rec, refused, fabricated, conflict FROM documents LEFT JOIN g ON rec = doc_id",
    "attack_success": f"WITH a AS (SELECT event_type AS prompt, user_id, count(*) AS n, count(*) FILTER (contains(props, '{CANARY}')) AS k FROM events GROUP BY ALL), s AS (SELECT prompt, sum(n)::BIGINT AS probes, sum(k)::BIGINT AS obeyed, count(*) AS attacks, count(*) FILTER (k > 0) AS attacks_obeyed FROM a GROUP BY prompt) SELECT prompt, probes, obeyed, {_wil('obeyed', 'probes', '-')} AS low, {_wil('obeyed', 'probes', '+')} AS high, attacks, attacks_obeyed, {_wil('attacks_obeyed', 'attacks', '-')} AS attacks_low, {_wil('attacks_obeyed', 'attacks', '+')} AS attacks_high FROM s",
    "false_alarm_rate": "WITH f AS (SELECT lang AS sample, count(*) AS n, count(*) FILTER (contains(text, '%%')) AS flagged FROM documents GROUP BY 1) SELECT sample, n, flagged, round(flagged / n, 6) AS rate, round(flagged / n, 6) <= 0.05 AS within_bar FROM f",
    "usefulness_summary": "WITH t AS (SELECT CASE event_type WHEN 'click' THEN 'accepted' WHEN 'view' THEN 'checked' WHEN 'error' THEN 'skipped' ELSE 'declined' END AS o, value AS s, (props->>'k')::DOUBLE AS h FROM events) SELECT count(*) AS judged, count(*) FILTER (o = 'accepted') AS accepted, round(count(*) FILTER (o = 'accepted') / count(*), 6) AS accepted_share, count(*) FILTER (s <> 0 AND h <> 0) AS timed, round(median(s) FILTER (s <> 0 AND h <> 0), 6) AS median_seconds, round(median(h) FILTER (s <> 0 AND h <> 0), 6) AS median_by_hand FROM t WHERE o <> 'skipped'",
    "traceability_orphans": "WITH l AS (SELECT 'o' || o_orderkey AS id, unnest(['c' || o_custkey, 'c' || (o_orderkey % 100000)]) AS ref FROM orders), r AS (SELECT 'c' || c_custkey AS ref FROM customer) SELECT 'dangling' AS problem, id, ref FROM l WHERE ref NOT IN (SELECT ref FROM r) UNION ALL SELECT 'unused', NULL, ref FROM r WHERE ref NOT IN (SELECT ref FROM l)",
    "slugs": "SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages",
    "merge_intervals": "WITH e AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS s, epoch(date_trunc('second', ts))::BIGINT + floor(value * 600)::BIGINT AS e FROM events), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e), i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(s) AS start, max(e) AS \"end\", count(*) AS n FROM i GROUP BY user_id, k",
    "group_anagrams": f"WITH {_BW}, w AS (SELECT DISTINCT word FROM bw) SELECT array_to_string(list_sort(string_split(word, '')), '') AS letters, count(*) AS n, min(word) AS first, max(word) AS last FROM w GROUP BY 1",
    "contains_duplicate": f"WITH {_BW} SELECT word, count(*) AS n FROM bw GROUP BY word HAVING count(*) > 1",
    "top_k_frequent": f"WITH {_BW} SELECT word AS value, count(*) AS n, min(item_id * 100000 + \"at\") AS first_pos FROM bw GROUP BY word ORDER BY n DESC, first_pos LIMIT 20",
    "multiset_intersect": "WITH w AS (SELECT coalesce(lang IN ('en', 'de'), false) AS west, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[-.][a-z0-9]+)*')) AS word FROM documents), c AS (SELECT word, count(*) FILTER (west) AS a, count(*) FILTER (NOT west) AS b FROM w GROUP BY word) SELECT word, least(a, b) AS n FROM c WHERE a > 0 AND b > 0",
    "two_sum": "SELECT a.doc_id AS i, b.doc_id AS j FROM documents a JOIN documents b ON a.n_chars + b.n_chars = 2000 AND a.doc_id < b.doc_id ORDER BY j, i DESC LIMIT 1",
    "product_except_self": "SELECT a.n_regionkey, a.n_nationkey, list_reduce(list(((b.n_nationkey - 3) * 1009)::HUGEINT), lambda x, y: x * y)::BIGINT AS product FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY ALL",
    "is_palindrome": f"WITH {_BW}, t AS (SELECT item_id, \"at\", regexp_replace(word || ' ' || CASE WHEN \"at\" % 2 = 0 THEN reverse(word) ELSE word END, '[^a-z0-9]', '', 'g') AS p FROM bw) SELECT item_id, \"at\"::INTEGER AS \"at\", p = reverse(p) AS palindrome FROM t",
    "string_to_integer": "WITH t AS (SELECT event_id, (CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) * CASE WHEN event_id % 5 = 0 THEN (user_id || '99999999999')::HUGEINT ELSE user_id END AS v FROM events) SELECT event_id, greatest(-2147483648, least(2147483647, v))::INTEGER AS number FROM t",
    "sudoku_conflicts": "WITH c AS (SELECT (event_id % 81) // 9 AS r, event_id % 9 AS c, user_id % 9 + 1 AS digit FROM events), u AS (SELECT 'row' AS unit, r AS \"at\", digit FROM c UNION ALL SELECT 'col', c, digit FROM c UNION ALL SELECT 'box', r // 3 * 3 + c // 3, digit FROM c) SELECT unit, \"at\", digit, count(*) AS n FROM u GROUP BY ALL HAVING count(*) > 1",
    "prefix_minimum": "SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS minimum FROM events",
    "longest_substr_no_repeat": "WITH c AS (SELECT page_id, unnest(string_split(html, '')) AS c, generate_subscripts(string_split(html, ''), 1) AS i FROM pages), p AS (SELECT page_id, i, lag(i) OVER (PARTITION BY page_id, c ORDER BY i) AS before FROM c), m AS (SELECT page_id, i - coalesce(max(before) OVER (PARTITION BY page_id ORDER BY i), 0) AS n FROM p) SELECT page_id, max(n)::BIGINT AS longest FROM m GROUP BY page_id",
    "figures": "SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(html, '[0-9-]+'), lambda x: regexp_matches(x, '^[0-9]{2,}$')))), ',') AS figures FROM pages",
    "valid_parentheses": "SELECT page_id, list_reduce(list_prepend('', regexp_extract_all(html, '[()\\[\\]{}]')), lambda s, c: CASE WHEN s = '!' THEN '!' WHEN c IN ('(', '[', '{') THEN s || c WHEN right(s, 1) || c IN ('()', '[]', '{}') THEN left(s, length(s) - 1) ELSE '!' END) = '' AS valid FROM pages",
    "one_per_team": "SELECT source, doc_id FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('0-' || doc_id), doc_id) = 1",
    "random_carriers": f"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?i)\\b(attack|threat|malware|exploit|adversar)') ORDER BY md5('0-' || doc_id), doc_id LIMIT 50",
    "parse_verdicts": f"""WITH {_DEC}, r AS (SELECT doc_id, lang NOT IN ('es', 'de') AS ok, lang, refused, fabricated FROM d WHERE refused IS NOT NULL)
SELECT doc_id, ok, CASE lang WHEN 'es' THEN 'the reply holds no object' WHEN 'de' THEN 'neither true nor false: refused' END AS error, CASE WHEN ok THEN refused AND NOT fabricated END AS decision, false AS quote_missing FROM r""",
}
