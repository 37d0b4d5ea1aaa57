"""Quality rules at the level of hosts, with built-in functions only.

Every document gets its own rule verdict; the share of documents that fail any
rule is then aggregated per host, drawn towards the mean of all hosts by an
empirical beta prior (moments of the hosts' rates, hosts weighted alike), and
the host's verdict is joined back to its documents. A document stays if it
passes the base rules and its host's shrunk rate is at most ``host_limit``.

Defined cases: a null or white text has no words and fails the base rules; a
null source belongs to no host, so only the base rules decide; repeated rows
count and are returned as often as they occur; further columns are handed through,
whatever their names; an empty table gives an empty result.
With one host, or hosts of equal rates, the prior has no spread to fit, and
``PRIOR_WEIGHT`` pseudo-documents at the mean rate stand in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, let, materialize, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Rule limits. MAX_REPEAT and MIN_WORDS are the base rules, the others only tell a host's standing.
MIN_WORDS, MAX_REPEAT, MAX_SYMBOLS, MAX_DUP_LINES = 10, 20, 10, 30
HOST_LIMIT, PRIOR_WEIGHT = 0.6, 20.0
SMALL_HOSTS = 50_000  # of at most some tens of bytes each
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(hashes: Column, n: int = WINDOW) -> Column:
    """Words in windows whose hash occurs twice or more, given all windows' hashes in order. Only texts with a repeat are sorted."""
    m = F.size(hashes)
    sort = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(placed: Column) -> Column:
        # in the sorted array an element is of a repeated window if a neighbour is equal
        same = lambda k, j: F.coalesce(F.get(placed, k)["h"] == F.get(placed, j)["h"], F.lit(False))
        marked = F.filter(F.transform(placed, lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"])), lambda x: x.isNotNull())
        return F.aggregate(
            F.array_sort(marked),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
            lambda a, s: F.struct((s + n).alias("end"), (a["sum"] + s + n - F.greatest(a["end"], s)).alias("sum")),
            lambda a: a["sum"],
        )

    return F.when((m < 2) | (F.size(F.array_distinct(hashes)) == m), 0).otherwise(let(sort, covered))


def window_hashes(w: Column, n: int = WINDOW) -> Column:
    window = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), window)).otherwise(F.array().cast("array<bigint>"))


def rule_counts(docs: DataFrame, text: str = "text", name: str = "rules") -> DataFrame:
    """The input with one more column: a struct of the rule counts of whole texts, base_failed and any_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words(F.col(text)),
        lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), let(window_hashes(w), repeat_words).alias("again")),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    symbols = F.length(body) - F.length(F.translate(body, SYMBOLS, ""))
    w, x, all_ = free_name(docs, "w"), free_name(docs, "x"), docs.columns
    step = docs.withColumns({w: of_words, x: of_lines})
    n, again, dup, n_lines, chars = F.col(f"{w}.n"), F.col(f"{w}.again"), F.col(f"{x}.dup"), F.col(f"{x}.n"), F.col(f"{w}.chars")
    failed = (n < MIN_WORDS) | (100 * again > MAX_REPEAT * n)
    soft = (100 * symbols > MAX_SYMBOLS * chars) | (100 * dup > MAX_DUP_LINES * n_lines)
    counts = [c.cast("long").alias(k) for k, c in zip(COUNTS, (n, chars, symbols, dup, again), strict=True)]
    return step.select(*all_, F.struct(*counts, failed.alias("base_failed"), (failed | soft).alias("any_failed")).alias(name))


def host_verdicts(docs: DataFrame, host: str = "source", failed: str = "rules.any_failed", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: n, failures, shrunk rate, host_kept. The prior comes from two more sums over the hosts, never from rows."""
    hosts = docs.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("host_n"), F.count_if(failed).alias("host_failures"))
    rate = F.col("host_failures") / F.col("host_n")
    moments = hosts.agg(F.avg(rate).alias("mean"), F.var_samp(rate).alias("var"), F.avg(1 / F.col("host_n")).alias("noise"))
    m, v = F.col("mean"), F.col("var")
    spread = m * (1 - m)
    # the spread of rates holds the hosts' own sampling noise; what is left is the prior's
    own = v - spread * F.col("noise")
    weight = F.when((own > 0) & (spread > own), spread / own - 1).otherwise(F.lit(PRIOR_WEIGHT))
    prior = moments.select((m * weight).alias("alpha"), weight.alias("weight"))
    shrunk = (F.col("host_failures") + F.col("alpha")) / (F.col("host_n") + F.col("weight"))
    return hosts.join(F.broadcast(prior)).withColumn("host_rate", shrunk).withColumn("host_kept", shrunk <= limit).drop("alpha", "weight")  # prior: one row


def judged(docs: DataFrame, text: str = "text", host: str = "source", limit: float = HOST_LIMIT, drop_text: bool = False) -> tuple[DataFrame, str, Column]:
    """(the input with the struct of its counts, that struct's name, the verdict kept).

    The counts are written once; the host sums and the result read them.
    Verdicts are sent to all tasks if there are at most ``SMALL_HOSTS`` of them;
    beyond, hosts are joined by a shuffle that AQE may split.
    """
    name, own, verdict = free_name(docs, "rules"), free_name(docs, "rules_host"), free_name(docs, "host_kept")
    scored = rule_counts(docs, text, name)
    scored = materialize(scored.drop(text) if drop_text else scored, "rules")
    hosts = host_verdicts(scored, host, f"{name}.any_failed", limit)
    hosts = materialize(hosts.select(F.col(host).alias(own), F.col("host_kept").alias(verdict)), "hosts")
    if hosts.count() <= SMALL_HOSTS:
        hosts = F.broadcast(hosts)
    return scored.join(hosts, F.col(host) == F.col(own), "left"), name, ~F.col(f"{name}.base_failed") & F.coalesce(F.col(verdict), F.lit(True))


def apply_rules(docs: DataFrame, text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The input's columns with counts, base_failed and kept; columns of the input with these names give way."""
    scored, name, kept = judged(docs, text, host, limit)
    added = (*COUNTS, "base_failed", "kept")
    own = [c for c in docs.columns if c.lower() not in added]
    return scored.select(*own, *[F.col(f"{name}.{k}").alias(k) for k in added[:-1]], kept.alias("kept"))


def keep_rows(docs: DataFrame, text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows that are kept, with the input's columns as they were."""
    scored, _, kept = judged(docs, text, host, limit)
    return scored.where(kept).select(*docs.columns)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    scored, name, kept = judged(docs, drop_text=True)
    return scored.select("doc_id", *[f"{name}.{k}" for k in (*COUNTS, "base_failed")], kept.alias("kept"))


ORACLE_SQL = f"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i+{WINDOW - 1}], ' '))) AS g
  FROM w WHERE len(w) >= {WINDOW}
), many AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), again AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM many, range({WINDOW}) t(k) GROUP BY doc_id
), c AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(body) - length(translate(body, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN again USING (doc_id)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words OR 100 * n_symbols > {MAX_SYMBOLS} * word_chars OR 100 * n_dup_lines > {MAX_DUP_LINES} * n_lines AS any_failed
  FROM c
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (any_failed) AS f FROM b WHERE source IS NOT NULL GROUP BY source
), m AS (
  SELECT avg(f / n) AS mean, var_samp(f / n) - avg(f / n) * (1 - avg(f / n)) * avg(1 / n) AS own FROM h
), p AS (
  SELECT mean, CASE WHEN own > 0 AND mean * (1 - mean) > own THEN mean * (1 - mean) / own - 1 ELSE {PRIOR_WEIGHT} END AS weight FROM m
), v AS (
  SELECT source, (f + mean * weight) / (n + weight) <= {HOST_LIMIT} AS host_kept FROM h, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host_kept, true) AS kept
FROM b LEFT JOIN v USING (source)
"""
