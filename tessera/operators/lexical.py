"""BM25 as tables: postings, document frequencies, lengths; all questions are scored in one plan.

The corpus is read and cut into tokens once, when an index is built; the index is
a table in the shared folder, or in a folder of its own that later sessions load.
A row of it is a block of chunks with the postings of its terms, so a task scores
a block for all questions and answers with the best of each: no pair of question
and chunk is shuffled.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain, count, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import TOKEN, content_tokens, tokens
from ..sources.scratch import materialize, sent_if_few
from ..sources.shipping import ship_package
from .chunks import OVERLAP, SIZE

K1, B = 1.5, 0.75
SENT_TERMS, SENT_WEIGHTS = 100_000, 200_000
DIGITS = 9  # scores equal to so many digits are ties, whatever the order of their sums
BUCKETS, NONE = 256, -1  # of terms in a stored index; the bucket of the rows that have chunks
BLOCK, ASKED, PAIRS = 4096, 1024, 1 << 21  # chunks of a block; questions scored at once; sums made at once
PLACES = "source array<string>, i array<int>, chunk_id array<string>, len array<int>"
POSTINGS = "array<struct<term:string,at:array<int>,tf:array<int>>>"
_find = re.compile(TOKEN).findall


@dataclass(frozen=True)
class Index:
    """table: (block, source, i, chunk_id, len, postings), a row for each block of chunks; ``at`` of a posting is a chunk's place in those arrays. postings: (block, at, chunk_id, len, term, tf), one row for each chunk and token; terms: (term, df, idf); totals: one row (n_chunks, avg_len)."""

    table: DataFrame

    @property
    def postings(self) -> DataFrame:
        each = self.table.select("block", "chunk_id", "len", F.explode("postings").alias("p")).select("block", "chunk_id", "len", F.col("p.term").alias("term"), F.explode(F.arrays_zip("p.at", "p.tf")).alias("x"))
        return each.select("block", F.col("x.at").alias("at"), F.get("chunk_id", F.col("x.at")).alias("chunk_id"), F.get("len", F.col("x.at")).alias("len"), "term", F.col("x.tf").cast("long").alias("tf"))

    @property
    def totals(self) -> DataFrame:
        size = F.aggregate("len", F.lit(0).cast("long"), lambda a, x: a + x)
        return self.table.agg(F.coalesce(F.sum(F.size("len")), F.lit(0)).alias("n_chunks"), (F.sum(size) / F.sum(F.size("len"))).alias("avg_len"))

    @property
    def terms(self) -> DataFrame:
        df = self.table.select(F.explode(F.transform("postings", lambda p: F.struct(p["term"].alias("term"), F.size(p["at"]).alias("n")))).alias("x")).groupBy("x.term").agg(F.sum("x.n").alias("df"))
        idf = F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return df.crossJoin(F.broadcast(self.totals)).select("term", "df", idf.alias("idf"))  # totals: one row


def asked_terms(questions: DataFrame, strip: bool = True) -> DataFrame:
    """(qid, term) with repeats."""
    return questions.select("qid", F.explode(content_tokens(F.col("question")) if strip else tokens(F.col("question"))).alias("term"))


def _counted(texts: list[str], asked: dict[str, int] | None):
    """(tokens of each text; terms; postings of each term; for every posting, by term, the text's place and how often it has the term). With ``asked`` other terms are left out."""
    words = [_find(t.replace("\u0130", "i").lower()) for t in texts]  # as ``tokens`` has them
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = list(chain.from_iterable(words))
    names = {w: n for n, w in enumerate(dict.fromkeys(flat))} if asked is None else asked
    ids = np.fromiter(map(names.get, flat, repeat(-1)), np.int64, len(flat))
    key = ids * max(1, len(texts)) + np.repeat(np.arange(len(texts)), sizes)
    key = np.sort(key[ids >= 0])
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    tf, (term, at) = np.diff(np.r_[first, len(key)]), np.divmod(key[first], max(1, len(texts)))
    start = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    every = list(names)
    return sizes, [every[n] for n in term[start]], np.diff(np.r_[start, len(term)]), at.astype(np.int32), tf.astype(np.int32)


@dataclass(frozen=True)
class Windows:
    """The chunks that ``chunk_documents`` makes of ``docs`` (source, text), cut where they are read: what builds an index takes them in place of a table of chunks."""

    docs: DataFrame
    size: int = SIZE
    overlap: int = OVERLAP

    def __post_init__(self):
        if self.size <= 0 or not 0 <= self.overlap < self.size:
            raise ValueError(f"size must be positive and overlap from 0 to below size, not {self.size} and {self.overlap}")

    def parts(self):
        size, overlap, stride = self.size, self.overlap, self.size - self.overlap

        def run(batches):
            import pyarrow as pa

            def part():
                return pa.array(source, pa.string()), pa.array(place, pa.int32()), pa.array([f"{o}-{n}" for o, n in zip(source, place, strict=True)], pa.string()), texts

            source, place, texts = [], [], []
            for batch in batches:
                for n in range(len(batch)):
                    own, text = batch.column(0)[n].as_py(), batch.column(1)[n].as_py()
                    windows = -(-len(text) // stride)
                    if windows > 1 and len(text) - (windows - 1) * stride <= overlap:
                        windows -= 1
                    source += [own] * windows
                    place += range(windows)
                    texts += [text[at * stride : at * stride + size] for at in range(windows)]
                    if len(texts) >= BLOCK:
                        yield part()
                        source, place, texts = [], [], []
            if texts:
                yield part()

        return run


def _parts(batches):
    """Blocks of a table of chunks: (source, i, chunk_id, texts)."""
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            part = batch.slice(at, BLOCK)
            yield *(part.column(c) for c in range(3)), part.column(3).to_pylist()


def _lists(values, sizes):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)


def _block(part, asked):
    """(the four arrays of places, terms, lists of places, lists of counts) of a block."""
    import pyarrow as pa

    sizes, terms, df, at, tf = _counted(part[3], asked)
    places = [*part[:3], pa.array(sizes.astype(np.int32))]
    return places, pa.array(terms, pa.string()), _lists(pa.array(at), df), _lists(pa.array(tf), df)


def _numbers():
    """Numbers for blocks that no other task gives."""
    from pyspark import TaskContext

    return count(TaskContext.get().partitionId() << 33)


def _block_rows(parts, asked):
    def run(batches):
        import pyarrow as pa

        for no, part in zip(_numbers(), parts(batches), strict=False):
            places, terms, at, tf = _block(part, asked)
            postings = _lists(pa.StructArray.from_arrays([terms, at, tf], ["term", "at", "tf"]), [len(terms)])
            yield pa.RecordBatch.from_arrays([pa.array([no]), *(_lists(p, [len(p)]) for p in places), postings], names=["block", "source", "i", "chunk_id", "len", "postings"])

    return run


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def _bucket_rows(parts):
    """Blocks as a row for each bucket of terms, and one with the bucket ``NONE`` for the chunks."""

    def run(batches):
        import pyarrow as pa

        for no, part in zip(_numbers(), parts(batches), strict=False):
            places, terms, at, tf = _block(part, None)
            bucket = np.fromiter(map(_bucket, terms.to_pylist()), np.int32, len(terms))
            order = np.argsort(bucket, kind="stable")
            found, sizes = np.unique(bucket, return_counts=True)
            postings = _lists(pa.StructArray.from_arrays([terms, at, tf], ["term", "at", "tf"]).take(pa.array(order)), sizes)
            own = [_lists(p, [len(p)]) for p in places]
            columns = [pa.array([NONE], pa.int32()), pa.array([no]), pa.nulls(1, postings.type), *own], [pa.array(found), pa.array(np.full(len(found), no)), postings, *[pa.nulls(len(found), p.type) for p in own]]
            for one in columns:
                yield pa.RecordBatch.from_arrays(one, names=["bucket", "block", "postings", "source", "i", "chunk_id", "len"])

    return run


def _posting_rows(parts):
    def run(batches):
        import pyarrow as pa

        for part in parts(batches):
            _, terms, df, at, tf = _counted(part[3], None)
            yield pa.RecordBatch.from_arrays([part[2].take(pa.array(at)), pa.array(terms, pa.string()).take(pa.array(np.repeat(np.arange(len(df)), df))), pa.array(tf.astype(np.int64))], names=["chunk_id", "term", "tf"])

    return run


def _mapped(chunks: DataFrame | Windows, rows, schema: str) -> DataFrame:
    """Rows that ``rows`` makes of blocks of chunks."""
    table = chunks.docs if isinstance(chunks, Windows) else chunks
    columns = {"source": "string", "text": "string"} if isinstance(chunks, Windows) else {"source": "string", "i": "int", "chunk_id": "string", "text": "string"}
    ship_package(table.sparkSession)
    texts = table.where(F.col("text").isNotNull()).select(*[F.col(c).cast(t) for c, t in columns.items()])
    return texts.mapInArrow(rows(chunks.parts() if isinstance(chunks, Windows) else _parts), schema)


def postings(chunks: DataFrame | Windows) -> DataFrame:
    """(chunk_id, term, tf) of all terms, made as they are read: no index is written."""
    return _mapped(chunks, _posting_rows, "chunk_id string, term string, tf long")


def build(chunks: DataFrame | Windows, only: DataFrame | None = None) -> Index:
    """An index of all terms, or of those in ``only`` (term): for questions that are known beforehand. Up to ``SENT_TERMS`` terms are sent to all tasks; of more, all terms of the corpus are kept, which changes no score.

    Chunks without a token count in the number of chunks and the average length.
    """
    asked = None
    if only is not None:
        known = [r.term for r in only.select("term").distinct().limit(SENT_TERMS + 1).collect()]
        asked = {t: n for n, t in enumerate(known)} if len(known) <= SENT_TERMS else None
    return Index(materialize(_mapped(chunks, lambda parts: _block_rows(parts, asked), f"block long, {PLACES}, postings {POSTINGS}"), "index"))


def store(chunks: DataFrame | Windows, path: str) -> None:
    """Write the index of all terms to a folder, rows of a term together, so that a load of few terms reads few row groups. A row has the postings of one of ``BUCKETS`` buckets of terms in one block of chunks."""
    rows = _mapped(chunks, _bucket_rows, f"bucket int, block long, postings {POSTINGS}, {PLACES}")
    rows.repartitionByRange("bucket", "block").sortWithinPartitions("bucket", "block").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, questions: DataFrame | None = None) -> Index:
    """An index from its folder; with questions, only the postings of their terms, whose buckets parquet statistics find when the terms are few. The rows of a block are put together once."""
    table, columns = spark.read.parquet(path), ("source", "i", "chunk_id", "len")
    each = table.where(F.col("bucket") != NONE)
    if questions is None:
        lists = each.groupBy("block").agg(F.flatten(F.collect_list("postings")).alias("postings"))
    else:
        terms = asked_terms(questions, strip=False).select("term").distinct()
        known = [r.term for r in terms.limit(1001).collect()]
        if len(known) <= 1000:
            each = each.where(F.col("bucket").isin(*{_bucket(t) for t in known}))
        each = each.select("block", F.explode("postings").alias("p")).select("block", "p", F.col("p.term").alias("term"))
        lists = each.join(sent_if_few(materialize(terms, "terms"), SENT_TERMS)[0], "term", "left_semi").groupBy("block").agg(F.collect_list("p").alias("postings"))
    blocks = table.where(F.col("bucket") == NONE).select("block", *columns).join(lists, "block", "left")
    return Index(materialize(blocks.select("block", *columns, F.coalesce("postings", F.array().cast(POSTINGS)).alias("postings")), "index"))


def _sent(rows, qids: dict) -> list:
    """Weights (qid, term, w) as groups of up to ``ASKED`` questions: (first, how many, terms by number, where each starts, question of each, weight of each)."""
    groups: dict[int, dict[str, list]] = {}
    for r in rows:
        n = qids[r.qid]
        groups.setdefault(n // ASKED, {}).setdefault(r.term, []).append((n % ASKED, r.w))
    out = []
    for g, terms in sorted(groups.items()):
        flat = [x for t in terms for x in terms[t]]
        starts = np.r_[0, np.cumsum([len(v) for v in terms.values()])]
        out.append((g * ASKED, min(ASKED, len(qids) - g * ASKED), {t: n for n, t in enumerate(terms)}, starts, np.array([n for n, _ in flat], np.int64), np.array([w for _, w in flat])))
    return out


def _scored(names, starts, asked, weights, width, terms, df, at, tf, lengths, average):
    """Scores of a block's chunks (rows) for a group's questions (columns)."""
    row = np.fromiter(map(names.get, terms, repeat(-1)), np.int64, len(terms))
    row = np.repeat(row, df)
    at, tf, row = at[row >= 0], tf[row >= 0].astype(float), row[row >= 0]
    share = tf / (tf + K1 * (1 - B + B * lengths[at] / average))
    times = starts[row + 1] - starts[row]
    ends, out, a = np.cumsum(times), np.zeros(len(lengths) * width), 0
    while a < len(row):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        n = times[a:b]
        pos = np.arange(n.sum()) + np.repeat(starts[row[a:b]] - (np.cumsum(n) - n), n)
        out += np.bincount(np.repeat(at[a:b] * width, n) + asked[pos], np.repeat(share[a:b], n) * weights[pos], len(out))
        a = b
    return out.reshape(len(lengths), width)


class _Best:
    """The best rows of each question of a group: k of them by score and corpus position, or all that tie with the k-th where positions go by another order."""

    def __init__(self, width: int, k: int, tied: bool):
        self.rows, self.least, self.k, self.tied, self.most = [], np.zeros(width), k, tied, 4 * k * width + 10_000

    def add(self, scores, source, i, chunk_id):
        least = self.least - 2 * 10.0**-DIGITS
        found = (scores > 0) & (scores >= least)
        if len(scores) > self.k and np.count_nonzero(found) > 4 * self.k * scores.shape[1]:
            kth = np.ascontiguousarray(np.partition(scores, len(scores) - self.k, 0)[len(scores) - self.k])
            found &= scores >= kth - 2 * 10.0**-DIGITS
        at, asked = np.nonzero(found)
        exact = np.round(scores[at, asked], DIGITS)
        good = (exact > 0) & (exact >= self.least[asked])
        if not good.any():
            return
        import pyarrow as pa

        at, asked, exact = at[good], asked[good], exact[good]
        places = [c.take(pa.array(at)).to_pylist() for c in (source, i, chunk_id)]
        self.rows += [(q, -s, len(o or ""), o or "", n, c) for q, s, o, n, c in zip(asked.tolist(), exact.tolist(), *places, strict=True)]
        if len(self.rows) > self.most:
            self.cut()
            self.most = max(self.most, 2 * len(self.rows))

    def cut(self):
        self.rows.sort()
        kept, last, n, worst = [], -1, 0, 0.0
        for x in self.rows:
            n = n + 1 if x[0] == last else 1
            last = x[0]
            if n == self.k:
                worst = x[1]
                self.least[last] = -worst
            if n <= self.k or self.tied and x[1] == worst:
                kept.append(x)
        self.rows = kept


def _winners(groups, average: float, k: int, tied: bool):
    """Blocks to (q, score, source, i, chunk_id): what may be among the best k of a question, of this task's blocks."""

    def run(batches):
        import pyarrow as pa

        best = [_Best(g[1], k, tied) for g in groups]
        for batch in batches:
            for r in range(len(batch)):
                source, i, chunk_id, lengths, postings = (batch.column(c)[r].values for c in ("source", "i", "chunk_id", "len", "postings"))
                terms, at, tf = (postings.field(n) for n in range(3))
                terms, df = terms.to_pylist(), at.value_lengths().to_numpy(zero_copy_only=False)
                at, tf, lengths = at.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy(), lengths.to_numpy()
                for (_, width, *weights), own in zip(groups, best, strict=True):
                    own.add(_scored(*weights, width, terms, df, at, tf, lengths, average), source, i, chunk_id)
        for (first, *_), own in zip(groups, best, strict=True):
            own.cut()
            if own.rows:
                q, s, _, source, i, chunk_id = zip(*own.rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(q) + first, pa.int32()), pa.array(-np.array(s)), pa.array(source, pa.string()), pa.array(i, pa.int32()), pa.array(chunk_id, pa.string())], names=["q", "score", "source", "i", "chunk_id"])

    return run


def weighed(index: Index, questions: DataFrame, strip: bool = True) -> DataFrame:
    """(qid, term, w). A term asked twice counts twice; unknown terms don't count."""
    weights = asked_terms(questions, strip).groupBy("qid", "term").agg(F.count("*").alias("qtf")).join(index.terms, "term")
    return weights.select("qid", "term", (F.col("qtf") * F.col("idf") * (K1 + 1)).alias("w"))


def scores(index: Index, weights: DataFrame) -> DataFrame:
    """weights (qid, term, w) to (qid, source, i, chunk_id, score), every pair of question and chunk with a term in common: for more weights than are sent to all tasks."""
    weights, _ = sent_if_few(materialize(weights, "weights"), SENT_TERMS)
    share = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    shares = index.postings.crossJoin(F.broadcast(index.totals)).select("block", "at", "term", share.alias("share"))  # totals: one row
    return shares.join(weights, "term").groupBy("qid", "block", "at").agg(F.round(F.sum(F.col("w") * F.col("share")), DIGITS).alias("score")).where("score > 0")


def search_once(chunks: DataFrame | Windows, questions: DataFrame, k: int, strip: bool = True, position: list[str] | None = None) -> DataFrame:
    """``search`` over an index of the questions' terms only."""
    return search(build(chunks, asked_terms(questions, strip)), questions, k, strip, position)


def search(index: Index, questions: DataFrame, k: int, strip: bool = True, position: list[str] | None = None) -> DataFrame:
    """The k best chunks with a positive score of each question: rank from 1, ties by corpus position.

    Up to ``SENT_WEIGHTS`` weights of questions' terms are sent to all tasks, which
    answer with the best of their blocks; more meet the postings in a join.
    """
    spark, weights = questions.sparkSession, weighed(index, questions, strip)
    rows = weights.limit(SENT_WEIGHTS + 1).collect()
    if len(rows) <= SENT_WEIGHTS:
        qids = {q: n for n, q in enumerate(dict.fromkeys(r.qid for r in rows))}
        average = index.totals.first().avg_len or 0.0
        ship_package(spark)
        found = index.table.mapInArrow(_winners(_sent(rows, qids), average, k, position is not None), "q int, score double, source string, i int, chunk_id string")
        names = spark.createDataFrame([(n, q) for q, n in qids.items()], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("qid", questions.schema["qid"].dataType)]))
        found = found.join(F.broadcast(names), "q").drop("q")  # as many as weights at most
    else:
        best = F.rank().over(Window.partitionBy("qid").orderBy(F.desc("score")))
        found = scores(index, weights).withColumn("rank", best).where(F.col("rank") <= k).drop("rank")
        places = index.table.select("block", F.posexplode(F.arrays_zip("source", "i", "chunk_id")).alias("at", "x"))
        found = found.join(places.select("block", "at", "x.source", "x.i", "x.chunk_id"), ["block", "at"]).drop("block", "at")
    order = [F.desc("score"), *(position or [F.length("source"), F.col("source"), F.col("i")])]
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
