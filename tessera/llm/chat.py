"""Chat formatting as a prefix tree.

A turn is written ``<s>role newline text</s>``. Conversations that begin with the
same turns share those turns' nodes: a node is named by the digest of its turns
from the first one on, is emitted once, and lies in one packed stream in
depth-first order. With it go its position (characters of its ancestors, so the
branches of a tree count on from the same place), its loss interval, and for
each conversation the intervals of the stream that it, and every node of its,
may attend to.

The order: every node belongs to the conversation of the smallest id that passes
through it; the nodes of one conversation form a chain, contiguous in the stream.
A conversation's path is then a few runs on chains, which is also its list of
attention intervals (by places in the stream and by depths on the chain), and sorting chains by their runs is depth-first order:
a chain first, then what leaves it, deepest first. Stream offsets come from a
range sort and sums per partition, so a first turn that very many conversations
share is not one task.

Backslashes, and ``<`` or ``[`` that begin a control string, are escaped inside
texts and roles, so that no control string is left in them.

Defined cases: null texts and roles are empty; rows of one conversation and turn
stand by role, then text; repeated rows are turns of their own; a null turn comes
first; rows with a null conv_id form one conversation without an id; a
conversation of any length is streamed, never held; further columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, running_total

#: The control strings.
OPEN, CLOSE = "<s>", "</s>"
_TO = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_FROM = {v[1]: k for k, v in _TO.items()}
_NO_ID = -(2**63)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return re.sub(r"\\|<(?=/?s>)|\[(?=/?INST\])", lambda m: _TO[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _FROM[m[1]], text)


def format_turn(role: str, text: str) -> str:
    """Line ends in a role are written as ``\\n``, since the first one ends the role."""
    return f"{OPEN}{escape(role).replace('\n', '\\n')}\n{escape(text)}{CLOSE}"


def parse_turn(piece: str) -> tuple[str, str]:
    if not (piece.startswith(OPEN) and piece.endswith(CLOSE)):
        raise ValueError("a piece does not begin and end as a turn does")
    role, _, text = piece[len(OPEN) : -len(CLOSE)].partition("\n")
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else _FROM[m[1]], role), unescape(text)


_TURNS = "conv long, depth int, node binary, parent binary, position long, length long, piece string, loss_from int, loss_to int, ids array<int>"


def _chains(model):
    """Rows sorted by conversation and turn, to turns named by the digest of all turns so far; with a model, lengths and places count tokens."""

    def run(batches):
        import pyarrow as pa

        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
        conv, parent, depth, position = None, b"", 0, 0
        for batch in batches:
            out = [[] for _ in types]
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "role", "text")), strict=True):
                if c != conv:
                    conv, parent, depth, position = c, b"", 0, 0
                piece, ids = format_turn(role, text), None
                head = piece.index("\n") + 1
                body, length = len(piece) - len(CLOSE), len(piece)
                node = hashlib.sha256(parent + piece.encode("utf-8", "surrogatepass")).digest()
                if model is not None:
                    parts = [model.encode(x) for x in (piece[:head], piece[head:body], CLOSE)]
                    ids, head, body, length = sum(parts, []), len(parts[0]), len(parts[0]) + len(parts[1]), sum(map(len, parts))
                depth += 1
                learn = role == LOSS_ROLE
                row = (c, depth, node, parent, position, length, piece, head if learn else 0, body if learn else 0, ids)
                for to, v in zip(out, row, strict=True):
                    to.append(v)
                parent, position = node, position + length
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=[f.split()[0] for f in _TURNS.split(", ")])

    return run


@dataclass(frozen=True)
class Packed:
    """``stream``: one row per node (chain, depth, start, end, position, loss_start, loss_end, parent, node, piece; with a model, ids); ``paths``: per conversation its intervals [(start, end, chain, depths)]."""

    stream: DataFrame
    paths: DataFrame


def pack_conversations(rows: DataFrame, model=None) -> Packed:
    """rows: conv_id, turn, role, text. Places count characters; with a model (``encode`` from text to token ids) tokens, and the stream has each node's ``ids``."""
    bounded_batches(rows.sparkSession)
    empty = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k)
    given = rows.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(_NO_ID)).alias("conv"), "turn", empty("role"), empty("text"))
    turns = materialize(given.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(_chains(model), _TURNS), "turns", compression="zstd")
    tokens = [] if model is None else ["ids"]
    same = [F.first(k).alias(k) for k in ("depth", "parent", "position", "length", "loss_from", "loss_to", "piece", *tokens)]
    nodes = materialize(turns.groupBy("node").agg(F.min("conv").alias("chain"), *same), "nodes", compression="zstd")

    runs = turns.select("conv", "depth", "node", F.col("position"), "length").join(nodes.select("node", "chain"), "node")
    runs = materialize(runs.groupBy("conv", "chain").agg(F.min("position").alias("from"), F.max(F.col("position") + F.col("length")).alias("to"), F.min("depth").alias("enters"), F.max("depth").alias("leaves")), "runs")
    # chain positions: a chain's own part of its conversation's path
    own = runs.where("conv = chain").select("chain", F.col("from").alias("base"), (F.col("to") - F.col("from")).alias("size"))
    step = F.struct(F.col("from"), F.col("chain"), F.when(F.col("conv") == F.col("chain"), F.lit(-(2**31))).otherwise(-F.col("leaves")).alias("leaves"))
    keys = runs.groupBy("conv").agg(F.array_sort(F.collect_list(step)).alias("steps")).select(F.col("conv").alias("chain"), F.transform("steps", lambda s: F.struct(s["chain"], s["leaves"])).alias("key"))
    placed = materialize(running_total(own.join(keys, "chain"), ["key"], "size", "offset").select("chain", "base", "offset"), "chains")

    start = F.col("offset") + F.col("position") - F.col("base")
    loss = lambda k: F.when(F.col("loss_to") > 0, start + F.col(k))
    stream = nodes.join(placed, "chain").select(
        "chain", "depth", start.alias("start"), (start + F.col("length")).alias("end"), "position", loss("loss_from").alias("loss_start"), loss("loss_to").alias("loss_end"), "parent", "node", "piece", *tokens
    )
    at = lambda k: F.col("offset") + F.col(k) - F.col("base")
    depths = F.struct(F.col("enters").alias("first"), F.col("leaves").alias("last")).alias("depths")
    paths = runs.join(placed, "chain").select("conv", "chain", at("from").alias("start"), at("to").alias("end"), depths)
    paths = paths.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("start", "end", "chain", "depths"))).alias("intervals"))
    return Packed(materialize(stream, "stream", compression="zstd"), materialize(paths.select(F.when(F.col("conv") != _NO_ID, F.col("conv")).alias("conv_id"), "intervals"), "paths"))


_DIGESTS = "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches):
    """Pieces sorted by conversation and position, to digests; one conversation's running hashes are all that is held."""
    import pyarrow as pa

    names = [f.split()[0] for f in _DIGESTS.split(", ")]
    conv, state = None, None

    def row():
        return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    def packed(out):
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    for batch in batches:
        out = []
        for c, piece, lo, hi in zip(*(batch.column(k).to_pylist() for k in ("conv", "piece", "loss_from", "loss_to")), strict=True):
            if state is None or c != conv:
                if state:
                    out.append(row())
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse_turn(piece)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if hi is not None:
                under = unescape(piece[lo:hi])
                state[2] += len(under)
                state[3].update(under.encode())
            state[4] += len(piece)
        yield packed(out)
    if state:
        yield packed([row()])


def path_nodes(packed: Packed) -> DataFrame:
    """(conv, chain, depth): one row for each node on a conversation's path. A chain has one node of each depth, so these name nodes."""
    part = packed.paths.select(F.coalesce("conv_id", F.lit(_NO_ID)).alias("conv"), F.explode("intervals").alias("i"))
    return part.select("conv", F.col("i.chain").alias("chain"), F.explode(F.sequence("i.depths.first", "i.depths.last")).alias("depth"))


def read_back(packed: Packed) -> DataFrame:
    """conv_id and digests of each conversation, from the stream (of characters) and the intervals alone."""
    bounded_batches(packed.paths.sparkSession)
    pieces = packed.stream.select("chain", "depth", "position", (F.col("loss_start") - F.col("start")).alias("loss_from"), (F.col("loss_end") - F.col("start")).alias("loss_to"), "piece")
    whole = path_nodes(packed).join(pieces, ["chain", "depth"]).select("conv", "position", "piece", "loss_from", "loss_to")
    read = whole.repartition("conv").sortWithinPartitions("conv", "position").mapInArrow(_read_back, _DIGESTS)
    return read.select(F.when(F.col("conv") != _NO_ID, F.col("conv")).alias("conv_id"), *[f.split()[0] for f in _DIGESTS.split(", ")[1:]])


#: Fixed value: the conversation that the contract adds.
EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(pack_conversations(rows.unionByName(spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string"))))


ORACLE_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM r
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(OPEN) + 1 + len(CLOSE)} + length(role) + length(text)
    + len(regexp_extract_all(text, '\\\\|</?s>|\\[/?INST\\]')) + len(regexp_extract_all(role, '\\\\|\\n|</?s>|\\[/?INST\\]')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
