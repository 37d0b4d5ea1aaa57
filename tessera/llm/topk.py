"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

Vectors are quantised to floor(256 x) and stored in blocks. A block's postings
(vector, dimension, value) lie in segments by quantised impact, which is the bit
length of the value's magnitude; segments are processed from the highest impact down, for
all queries at once. After each, every score is known up to the query's norm times
the norm of what is left of the vector (Cauchy-Schwarz), so the k-th best of the
lower bounds, or of what earlier blocks gave exactly, proves most vectors out.
A query stops once few members stay possible; those are scored again from whole
vectors. A query that never gets there ends with all segments, exact by then. A segment is
multiplied in the dimensions that it holds and for members that some query may still want.

Queries lie in blocks of at most ``QUERY_BYTES``, too, as a table; each block of
queries meets each block of the index in one plan, and a task answers with at most k rows for a
query of the ``HELD`` blocks of queries that it saw last.

Defined cases: vectors that are null, or hold a null or a component that is not
finite, take no part, nor do rows with a null id; missing trailing dimensions count as zero
(an empty vector scores 0); a row is its query's own if it has its vec_id, and
of query rows with one id one (the smallest vector) asks; a score beyond 64 bits
is an error; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

K, EVERY, BLOCK = 5, 50, 4096
QUERY_BYTES, QUERY_ROWS, HELD = 2 << 20, 128, 64
QUERIES = "qids binary, qdims int, qvectors binary"
FEW = 64  # possible members at which a query stops and rescores
INDEX = "ids binary, dims int, vectors binary, impacts array<int>, members array<binary>, dimensions array<binary>, values array<binary>"


def quantised(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    good = rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & usable)
    return good.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * 256)).alias("q"))


def as_matrix(column, dims: int | None = None) -> np.ndarray:
    """An Arrow list column as int64 rows, filled with zeros on the right."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(int(lengths.max(initial=0)), dims or 0)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None] < lengths[:, None]] = column.flatten().to_numpy()
    return out


def segments(vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(impact, members, dimensions, values) of a block, by descending impact: values of magnitude 2^(impact-1) up to 2^impact."""
    who, dim = np.nonzero(vectors)
    value = vectors[who, dim]
    impact = np.frexp(np.abs(value).astype(np.float64))[1]
    for level in np.unique(impact)[::-1]:
        own = impact == level
        yield int(level), who[own].astype(np.int32), dim[own].astype(np.int32), value[own]


def _index(batches):
    import pyarrow as pa

    schema = pa.schema(
        [("ids", pa.binary()), ("dims", pa.int32()), ("vectors", pa.binary()), ("impacts", pa.list_(pa.int32()))] + [(k, pa.list_(pa.binary())) for k in ("members", "dimensions", "values")]
    )

    def block(ids: list, vectors: list):
        width = max(v.shape[1] for v in vectors)
        full = np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in vectors])
        found = list(segments(full))
        row = [np.concatenate(ids).tobytes(), width, full.tobytes(), [s[0] for s in found], *([s[i].tobytes() for s in found] for i in (1, 2, 3))]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    ids, vectors, n = [], [], 0
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            part = batch.slice(at, BLOCK)
            ids.append(part.column(0).to_numpy())
            vectors.append(as_matrix(part.column(1)))
            n += len(part)
            if n >= BLOCK:
                yield block(ids, vectors)
                ids, vectors, n = [], [], 0
    if n:
        yield block(ids, vectors)


def build_index(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The index as a table in the shared folder, one row per block of ``BLOCK`` to 2 x ``BLOCK`` vectors; every usable row is in it."""
    bounded_batches(rows.sparkSession)
    return materialize(quantised(rows, vec_id, vector).mapInArrow(_index, INDEX), "impact_index")


def dense_levels(n: int, parts: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Segments as (members, dimensions, matrix), of the members and dimensions that they hold."""
    out = []
    for _, who, dim, value in parts:
        rows, dims = np.zeros(n, bool), np.zeros(int(dim.max(initial=-1)) + 1, bool)
        rows[who], dims[dim] = True, True
        matrix = np.zeros((int(rows.sum()), int(dims.sum())))
        matrix[(np.cumsum(rows) - 1)[who], (np.cumsum(dims) - 1)[dim]] = value
        out.append((np.flatnonzero(rows), np.flatnonzero(dims), matrix))
    return out


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, levels: list, floor: np.ndarray, k: int, few: int = FEW) -> list[tuple[np.ndarray, np.ndarray]]:
    """``levels``: as from ``dense_levels``. For each query the (positions, exact scores) of all rows of the block that may be among its best k; floor: scores that k rows elsewhere are known to reach."""
    q, x = queries.astype(np.float64), vectors.astype(np.float64)
    norms, left = np.sqrt((q**2).sum(1)), (x**2).sum(1)
    out: list = [None] * len(q)
    # members that some active query may want, and their scores so far
    live = np.arange(len(x))
    row_of = np.arange(len(x))
    active = np.arange(len(q))
    score = np.zeros((len(q), len(x)))
    own = ids[None] == query_ids[:, None]
    for n, (rows, dims, segment) in enumerate(levels):
        if not len(active):
            break
        at = row_of[rows]
        here = at >= 0
        part = segment if here.all() else segment[here]
        at = at[here]
        gain = q[np.ix_(active, dims)] @ part.T
        if len(at) == len(live):
            score += gain
        else:
            score[:, at] += gain
        left[rows] -= (segment**2).sum(1)
        rest = np.maximum(left[live], 0) if n < len(levels) - 1 else np.zeros(len(live))
        slack = norms[active][:, None] * np.sqrt(rest)[None] * (1 + 1e-9)
        low = np.where(own, -np.inf, score - slack)
        need = floor[active] if len(live) < k else np.maximum(floor[active], np.partition(low, len(live) - k, 1)[:, len(live) - k])
        may = ~own & (score + slack >= need[:, None])
        done = (may.sum(1) <= few) | (n == len(levels) - 1)
        for i in np.flatnonzero(done):
            found = live[may[i]]
            out[active[i]] = found, x[found] @ q[active[i]]
        stay = may[~done].any(0)
        active, score, own = active[~done], score[~done], own[~done]
        if stay.sum() < 0.7 * len(live):
            # a member that no query wants is beaten by k others, which stay
            live, score, own = live[stay], score[:, stay], own[:, stay]
            row_of = np.full(len(x), -1)
            row_of[live] = np.arange(len(live))
    for i in active if not levels else ():
        at = np.flatnonzero(~own[i])
        out[i] = at, np.zeros(len(at))
    return out


def exact_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for numbers too large for doubles: Python's integers, one query at a time."""
    for i, q in zip(query_ids, queries.astype(object), strict=True):
        at = np.flatnonzero(ids != i)
        yield at, np.array([int(v) for v in vectors[at].astype(object) @ q], dtype=np.int64)


class Best:
    """The best k (id, score) of each query of a block so far. Scores are 64-bit integers; ``full`` tells the places that are taken."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.ids, self.scores, self.full = np.zeros((len(query_ids), k), np.int64), np.zeros((len(query_ids), k), np.int64), np.zeros((len(query_ids), k), bool)

    def add(self, i: int, names: np.ndarray, scores: np.ndarray) -> None:
        held = self.full[i]
        names, scores = np.concatenate([self.ids[i, held], names]), np.concatenate([self.scores[i, held], scores.astype(np.int64)])
        # from the highest score down, then from the smallest id up; ~x is -x - 1, which has no overflow
        order = np.lexsort((names, ~scores))[: self.k]
        self.ids[i, : len(order)], self.scores[i, : len(order)], self.full[i, : len(order)] = names[order], scores[order], True

    def floor(self, part: slice) -> np.ndarray:
        return np.where(self.full[part, -1], self.scores[part, -1], -np.inf)

    def rows(self):
        import pyarrow as pa

        at, j = np.nonzero(self.full)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (self.query_ids[at], self.ids[at, j], self.scores[at, j])], names=["query_id", "vec_id", "score"])


def searcher(k: int):
    """Tiles (a block of queries beside a block of the index) to (query_id, vec_id, score)."""

    def run(batches):
        held: OrderedDict[bytes, Best] = OrderedDict()
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                best = held.pop(row["qids"], None) or Best(np.frombuffer(row["qids"], np.int64), k)
                held[row["qids"]] = best
                tile(best, row)
                if len(held) > HELD:
                    yield held.popitem(last=False)[1].rows()
        for best in held.values():
            yield best.rows()

    def tile(best: Best, row: dict) -> None:
        ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.int64).reshape(-1, row["dims"])
        q = np.frombuffer(row["qvectors"], np.int64).reshape(-1, row["qdims"])
        width = max(x.shape[1], q.shape[1])
        x, q = np.pad(x, ((0, 0), (0, width - x.shape[1]))), np.pad(q, ((0, 0), (0, width - q.shape[1])))
        parts = ((i, np.frombuffer(m, np.int32), np.frombuffer(d, np.int32), np.frombuffer(v, np.int64)) for i, m, d, v in zip(row["impacts"], row["members"], row["dimensions"], row["values"], strict=True))
        levels = dense_levels(len(ids), parts)
        size = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(width, 1)
        for at in range(0, len(q), QUERY_ROWS):
            part = slice(at, at + QUERY_ROWS)
            if size < 2**52:
                found = search_block(best.query_ids[part], q[part], ids, x, levels, best.floor(part), best.k)
            else:
                found = exact_block(best.query_ids[part], q[part], ids, x)
            for i, (where, score) in enumerate(found, at):
                best.add(i, ids[where], score)

    return run


def _query_blocks(batches):
    """Rows (vec_id, q) to blocks of at most ``QUERY_BYTES``, or of one row."""
    import pyarrow as pa

    schema = pa.schema([("qids", pa.binary()), ("qdims", pa.int32()), ("qvectors", pa.binary())])
    for batch in batches:
        at = 0
        lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        while at < len(batch):
            widest = np.maximum.accumulate(lengths[at:])
            n = max(1, int((8 * np.maximum(widest, 1) * np.arange(1, len(widest) + 1) <= QUERY_BYTES).sum()))
            part = batch.slice(at, n)
            matrix = as_matrix(part.column(1))
            row = part.column(0).to_numpy().astype(np.int64).tobytes(), matrix.shape[1], matrix.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)
            at += n


def search(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """queries: (vec_id, q) as from ``quantised``. Result: query_id, rank, vec_id, score.

    All queries are asked of all rows, tile by tile: the cross join is one of blocks.
    """
    bounded_batches(index.sparkSession)
    asked = queries.groupBy("vec_id").agg(F.min("q").alias("q"))
    blocks = materialize(asked.mapInArrow(_query_blocks, QUERIES), "query_blocks")
    found = index.crossJoin(blocks).mapInArrow(searcher(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(build_index(rows), quantised(rows.where(F.col("vec_id") % EVERY == 0)))


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""
