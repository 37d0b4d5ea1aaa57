"""Exact nearest neighbours by vector: blocks of questions meet blocks of vectors in one plan.

Defined cases: a vector that is null, or holds a null or a component that is not
finite, takes no part on either side, nor does a row with a null id; missing
trailing dimensions count as zero; of several questions of one id one is asked (the
smallest vector); an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from ..sources.shipping import ship_package

DIGITS = 9
BLOCK_BYTES, BLOCK_ROWS, HELD, GROUPS, SLICE = 2 << 20, 4096, 64, 256, 256


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & fine


def _blocks(batches):
    """Rows (id, vector) to rows (ids, dims, vectors) of bounded size."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            lengths = part.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            width = int(lengths.max(initial=0))
            full = np.zeros((len(part), width))
            full[np.arange(width)[None] < lengths[:, None]] = part.column(1).flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (part.column(0).to_numpy().tobytes(), width, full.tobytes())], names=["ids", "dims", "vectors"])


def _gathered(batches):
    """Neighbouring blocks joined to larger ones, up to ``BLOCK_BYTES`` and ``BLOCK_ROWS``."""
    import pyarrow as pa

    def row(held):
        width = max(v.shape[1] for _, v in held)
        full = np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for _, v in held])
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (np.concatenate([i for i, _ in held]).tobytes(), width, full.tobytes())], names=["ids", "dims", "vectors"])

    held, rows, size = [], 0, 0
    for batch in _blocks(batches):
        ids, dims, vectors = (batch.column(c)[0].as_py() for c in range(3))
        if held and (size + len(vectors) > BLOCK_BYTES or rows + len(ids) // 8 > BLOCK_ROWS):
            yield row(held)
            held, rows, size = [], 0, 0
        ids = np.frombuffer(ids, np.int64)
        held.append((ids, np.frombuffer(vectors, np.float64).reshape(len(ids), dims)))
        rows, size = rows + len(ids), size + len(vectors)
    if held:
        yield row(held)


def blocks(rows: DataFrame, row_id: str, vector: str = "embedding") -> DataFrame:
    """(ids, dims, vectors): usable rows in blocks, a table in the shared folder."""
    ship_package(rows.sparkSession)
    good = rows.where(F.col(row_id).isNotNull() & usable(F.col(vector)))
    slim = good.select(F.col(row_id).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    return materialize(slim.mapInArrow(_gathered, "ids binary, dims long, vectors binary"), "blocks")


def nearest(asked: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, metric: str, least: np.ndarray):
    """(question's row, rounded distance, id) of what may be among the best k of the block's rows and of those held, whose k-th distances are ``least``.

    One matrix product gives distances up to its rounding. The k-th least of the least
    distances of ``GROUPS`` groups of rows is no less than the k-th of all, so nothing is
    sorted; rows within the rounding of that are measured again by differences, so
    equal rows tie exactly.
    """
    qq, xx = (asked**2).sum(1), (x**2).sum(1)
    if metric == "l2sq":
        rough, shift = asked @ (-2 * x.T), qq  # less the question's own square
        rough += xx
        slack = 1e-12 * (qq + xx.max(initial=0)) + 10.0**-DIGITS
    else:
        rough, shift = 1 - asked @ x.T / np.maximum(np.sqrt(xx)[None] * np.sqrt(qq)[:, None], 1e-300), 0.0
        slack = np.full(len(asked), 1e-9)
    bound, groups = least, max(k, GROUPS)
    if k < len(x):
        each = len(x) // groups
        few = rough[:, : each * groups].reshape(len(asked), each, groups).min(1) if each > 1 else rough
        bound = np.minimum(bound, np.partition(few, k - 1, 1)[:, k - 1] + shift)
    row, at = np.divmod(np.flatnonzero(rough <= (bound - shift + 2 * slack)[:, None]), max(1, len(x)))
    if metric == "l2sq":
        d = ((x[at] - asked[row]) ** 2).sum(1)
    else:
        d = 1 - (x[at] * asked[row]).sum(1) / np.maximum(np.sqrt(xx[at]) * np.sqrt(qq[row]), 1e-300)
    return row, np.round(d, DIGITS), ids[at]


def _merged(held, found, k: int):
    """The best k of each question among (row, distance, id) of both, and the k-th distances."""
    row, d, own = (np.concatenate(v) for v in zip(held[:3], found, strict=True))
    order = np.lexsort((own, d, row))
    row, d, own = row[order], d[order], own[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    least = held[3].copy()
    least[row[rank == k - 1]] = d[rank == k - 1]
    return row[rank < k], d[rank < k], own[rank < k], least


def _tiles(k: int, metric: str):
    """Tiles (a block of questions beside one of vectors) to (qid, vec_id, distance); the best k of each question of the ``HELD`` question blocks seen last are kept until the end."""

    def run(batches):
        import pyarrow as pa

        def rows(qids, best):
            columns = (np.concatenate(v) for v in zip(*((qids[at + part[0]], part[2], part[1]) for at, part in zip(range(0, len(qids), SLICE), best, strict=True)), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["qid", "vec_id", "distance"])

        held: OrderedDict = OrderedDict()
        for batch in batches:
            for n in range(len(batch)):
                name, qdims, qv, ids, dims, xv = (batch.column(c)[n].as_py() for c in ("qids", "qdims", "qvectors", "ids", "dims", "vectors"))
                qids, ids = np.frombuffer(name, np.int64), np.frombuffer(ids, np.int64)
                width = max(qdims, dims)
                asked = np.pad(np.frombuffer(qv, np.float64).reshape(len(qids), qdims), ((0, 0), (0, width - qdims)))
                x = np.pad(np.frombuffer(xv, np.float64).reshape(len(ids), dims), ((0, 0), (0, width - dims)))
                best = held.pop(name, None) or [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.full(len(qids[at : at + SLICE]), np.inf)) for at in range(0, len(qids), SLICE)]
                best = [_merged(part, nearest(asked[at : at + SLICE], x, ids, k, metric, part[3]), k) for at, part in zip(range(0, len(qids), SLICE), best, strict=True)]
                held[name] = best
                if len(held) > HELD:
                    old, best = held.popitem(last=False)
                    yield rows(np.frombuffer(old, np.int64), best)
        for name, best in held.items():
            yield rows(np.frombuffer(name, np.int64), best)

    return run


def embed(rows: DataFrame, row_id: str, text: str, model, batch: int = 256) -> DataFrame:
    """(vec_id, embedding) through ``model``, a function from a list of texts to rows of numbers: the hook for what makes vectors. Null texts are asked as empty ones."""

    def run(batches):
        import pyarrow as pa

        for one in batches:
            for at in range(0, len(one), batch):
                part = one.slice(at, batch)
                found = [[float(x) for x in row] for row in model([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.float32()))], names=["vec_id", "embedding"])

    ship_package(rows.sparkSession)
    return rows.select(F.col(row_id).cast("long").alias("vec_id"), text).mapInArrow(run, "vec_id long, embedding array<float>")


def search(vectors: DataFrame, questions: DataFrame, k: int, metric: str = "l2sq") -> DataFrame:
    """vectors (vec_id, embedding), questions (qid, embedding) to (qid, rank, vec_id, distance); ties by smaller vec_id.

    All questions are asked of all vectors; what is crossed is blocks of either, and
    a task answers with at most k rows a question. k below 1 gives nothing.
    """
    if metric not in ("l2sq", "cosine"):
        raise ValueError(f"metric must be l2sq or cosine, not {metric}")
    if k < 1:
        return vectors.sparkSession.createDataFrame([], "qid long, rank int, vec_id long, distance double")
    once = questions.where(usable(F.col("embedding"))).groupBy("qid").agg(F.min("embedding").alias("embedding"))
    asked = blocks(once, "qid").select(F.col("ids").alias("qids"), F.col("dims").alias("qdims"), F.col("vectors").alias("qvectors"))
    found = blocks(vectors, "vec_id").crossJoin(asked).mapInArrow(_tiles(k, metric), "qid long, vec_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "distance")
