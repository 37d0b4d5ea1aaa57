"""SentencePiece encoding and decoding by a weighted transducer.

A model compiles to three parts, from the model's own specification: a normaliser
(rewriting arcs such as space to mark, a prefix mark, extra spaces that go), a
lexicon of pieces as a trie read backwards, and byte fallback for characters that
are no piece. Composed with an input they give a lattice of positions with one arc
for each piece that ends there; encoding is the shortest path in the tropical
semiring: the cost of a position is the minimum over its arcs of the cost of where
the arc begins plus the arc's weight.

For a unigram model an arc weighs the negative score (sums are in doubles, the library's
in 32 bits, so costs that are closer than that may order otherwise there). For a BPE model
what counts is which neighbours can stand together: an arc weighs 0 after a piece with
which merging leaves exactly the two, and infinity after any other, so the result of
merging in the order of scores is a path of weight 0. Of equal costs the arc of the longer
piece wins; no weight of a BPE model is below 0, so its minimum is proved once an arc of
cost 0 is found. Runs of one character have several paths of weight 0; there the longer last piece is what merging
leaves, as far as comparison with the library shows.

Specifications with a character map, word or character models, white space as a
suffix, and user-defined or unused pieces are refused with an error.

The lattice falls apart between a character and a following mark where no piece
crosses, and at ASCII characters that no piece has; the parts repeat, so a worker
keeps the paths of the ``KEPT`` parts seen last, and new parts are composed in their
order, so that the costs of a common beginning are found once. The driver reads the model file;
tasks get the compiled transducer.

Defined cases: a null or empty text has no ids; texts are encoded whole; the mark
U+2581 in a text decodes to a space, as it does in SentencePiece (``round_trip`` is false
there); what the normaliser drops is not in the round trip; a character that is no piece, in a model without byte pieces, gets the
unknown id; repeated rows get equal ids; further columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches

#: Fixed value: the mark that stands for a space.
MARK = "▁"
KEPT, KEPT_PAIRS = 1_000_000, 1_000_000  # some 500 MB a worker at most
INFINITY = float("inf")
CHAR = 1 << 20  # symbols that are no piece are numbered from here by their character
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Transducer:
    """Compiled model. ``score``: of normal pieces; ``byte_id``: ids of the 256 byte pieces, if any."""

    kind: str
    pieces: list[str]
    ids: dict[str, int]
    score: list[float]
    byte_id: list[int]
    unknown: int
    prefix: bool = True
    escape: bool = True
    squeeze: bool = False
    halves: dict[str, tuple[str, str]] | None = None
    paths: dict = field(default_factory=dict)
    weights: dict = field(default_factory=dict)

    def __post_init__(self):
        self.longest = max(map(len, self.ids), default=1)
        # the normaliser: first the arcs that drop characters, then those that rewrite one, then what it writes at the start
        self.dropping = re.compile("^ +| +$| +(?= )") if self.squeeze else None
        self.rewriting = {" ": MARK} if self.escape else {}
        self.opening = (MARK if self.escape else " ") if self.prefix else ""
        if self.kind == "bpe" and self.halves is None:
            self.halves = self._halves()
        self.edges: tuple[dict, dict] = {}, {}
        # pieces that don't come after their halves in the order of merging, and what is made of such: their neighbours are found by merging, all others' by their edges
        worth = lambda p: float("inf") if len(p) == 1 else self.score[self.ids[p]]
        self.unordered: set[str] = set()
        for piece, (a, b) in sorted((self.halves or {}).items(), key=lambda x: len(x[0])):
            if min(worth(a), worth(b)) <= worth(piece) or a in self.unordered or b in self.unordered:
                self.unordered.add(piece)
        # pieces that merging makes as a trie read backwards: a node is (the id of the piece that ends the reading here or -1, nodes by the next character)
        self.trie: tuple[int, dict] = (-1, {})
        for piece in sorted(self.halves or (), key=len):
            node, above = self.trie, {}
            for char in reversed(piece):
                above = node[1]
                node = above.get(char) or above.setdefault(char, (-1, {}))
            above[piece[0]] = (self.ids[piece], node[1])
        # bytes that are no text of their own stand as lone surrogates until all are joined
        self.shown = list(self.pieces)
        for byte, i in enumerate(self.byte_id):
            self.shown[i] = chr(byte) if byte < 128 else chr(0xDC00 + byte)
        used = set("".join(self.ids))
        self.outside = "".join(chr(c) for c in range(128) if chr(c) not in used)
        crossing = any(MARK in p.lstrip(MARK) for p in self.ids)
        out = re.escape(self.outside)
        part = rf"[^{out}]+" if crossing else rf"{MARK}*[^{MARK}{out}]+|{MARK}+"
        self.parts = re.compile(rf"{part}|[{out}]" if out else part)
        self.floor = min((self.score[i] for i in self.ids.values()), default=0.0) - 10

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("kind", "pieces", "ids", "score", "byte_id", "unknown", "prefix", "escape", "squeeze", "halves")}

    def __setstate__(self, state):
        self.__init__(**state)

    # the three transducers
    def normalise(self, text: str) -> str:
        if self.dropping:
            text = self.dropping.sub("", text)
        if not text:
            return ""
        for old, new in self.rewriting.items():
            text = text.replace(old, new)
        return self.opening + text

    def fallback(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_id else [self.unknown]

    def arcs(self, part: str, end: int):
        """Pieces that end at a position, longest first."""
        ids = self.ids
        for begin in range(max(0, end - self.longest), end):
            i = ids.get(part[begin:end])
            if i is not None:
                yield begin, i

    # merging
    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Symbols after merging characters by score, leftmost first among equals; and the last two that were merged."""
        symbols, last = list(text), None
        ids, score = self.ids, self.score
        while len(symbols) > 1:
            found = [(-score[i], k) for k in range(len(symbols) - 1) if (i := ids.get(symbols[k] + symbols[k + 1])) is not None]
            if not found:
                break
            k = min(found)[1]
            last = symbols[k], symbols[k + 1]
            symbols[k : k + 2] = ["".join(last)]
        return symbols, last

    def _halves(self) -> dict[str, tuple[str, str]]:
        """The two symbols of which merging makes each longer piece; pieces that merging never makes are left out."""
        out = {}
        for piece in self.ids:
            if len(piece) > 1:
                symbols, last = self.merged(piece)
                if symbols == [piece]:
                    out[piece] = last
        return out

    def edge(self, symbol: str, side: int) -> list[tuple[str, float, float]]:
        """What stands at one edge (0: left, 1: right) of a symbol while it is merged: (part, score at which it appears, score at which it goes)."""
        known = self.edges[side].get(symbol)
        if known is None:
            known, part, until = [], symbol, float("-inf")
            while part in self.halves:
                worth = self.score[self.ids[part]]
                known.append((part, worth, until))
                part, until = self.halves[part][side], worth
            known.append((part, float("inf"), until))
            self.edges[side][symbol] = known
        return known

    def symbol(self, i: int) -> str:
        return self.pieces[i] if i < CHAR else chr(i - CHAR)

    def weight(self, before: int, i: int) -> float:
        """Of a piece's arc after another piece: 0 if merging both pieces' characters side by side leaves exactly the two (no merge across them comes while both of its parts stand there), else infinity."""
        if len(self.weights) >= KEPT_PAIRS:
            self.weights.clear()
        a, b = self.symbol(before), self.symbol(i)
        by_merging = a in self.unordered or b in self.unordered
        apart = self.merged(a + b)[0] == [a, b] if by_merging else self._together(a, b)
        found = self.weights[before << 21 | i] = 0.0 if apart else INFINITY
        return found

    def _together(self, a: str, b: str) -> bool:
        ids, score = self.ids, self.score
        for x, appears, goes in self.edge(a, 1):
            for y, also_appears, also_goes in self.edge(b, 0):
                i = ids.get(x + y)
                # of equal scores the left one merges first: x's own merge before this one, this one before y's
                if i is not None and appears > score[i] > goes and also_appears > score[i] >= also_goes:
                    return False
        return True

    # shortest path
    def path(self, part: str) -> list[int]:
        return self._bpe(part, "", [0.0], [-1]) if self.kind == "bpe" else self._unigram(part)

    def _bpe(self, part: str, before_it: str, cost: list[float], last: list[int]) -> list[int]:
        """``cost`` and ``last`` hold the costs and last pieces of the positions of ``before_it`` and are brought to those of ``part``: a position depends on what stands before it only, so a common beginning is kept.

        Arcs that end at a position come from the trie read backwards, as far as some piece ends so.
        """
        n, root, weights = len(part), self.trie[1].get, self.weights.get
        same, most = 0, min(n, len(before_it))
        while same < most and part[same] == before_it[same]:
            same += 1
        del cost[same + 1 :], last[same + 1 :]
        for end in range(same + 1, n + 1):
            i, begin = self.ids.get(part[end - 1], -1), end - 1
            arcs = [(begin, i if i >= 0 else CHAR + ord(part[begin]))]
            node = root(part[begin])
            while begin and node is not None:
                begin -= 1
                node = node[1].get(part[begin])
                if node is not None and node[0] >= 0:
                    arcs.append((begin, node[0]))
            best, piece = INFINITY, -1
            for begin, i in reversed(arcs):
                before = last[begin]
                if before < 0:
                    c = cost[begin]
                else:
                    w = weights(before << 21 | i)
                    c = cost[begin] + (self.weight(before, i) if w is None else w)
                if c < best:
                    best, piece = c, i
                    if c == 0.0:
                        break
            cost.append(best)
            last.append(piece)
        if cost[n] == INFINITY:
            raise ValueError(f"no path through {part[:80]!r}")
        out, end = [], n
        while end:
            i = last[end]
            if i < CHAR:
                out.append(i)
                end -= len(self.pieces[i])
            else:
                out += self.fallback(chr(i - CHAR))[::-1]
                end -= 1
        out.reverse()
        return out

    def _unigram(self, part: str) -> list[int]:
        n = len(part)
        cost, back = [0.0] + [float("inf")] * n, [None] * (n + 1)
        for end in range(1, n + 1):
            for begin, i in self.arcs(part, end):
                c = cost[begin] - self.score[i]
                if c < cost[end]:
                    cost[end], back[end] = c, (begin, [i])
            c = cost[end - 1] - self.floor
            if part[end - 1] not in self.ids and c < cost[end]:
                cost[end], back[end] = c, (end - 1, self.fallback(part[end - 1]))
        out, end = [], n
        while end:
            end, ids = back[end]
            out.append(ids)
        return [i for ids in out[::-1] for i in ids]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. Each part that is not kept is composed once, in the order of parts, so that neighbours share their beginnings."""
        split = [self.parts.findall(self.normalise(t)) for t in texts]
        paths, own = self.paths, {}
        known = [list(map(paths.get, parts)) for parts in split]
        gaps = [[k for k, ids in enumerate(got) if ids is None] for got in known]
        before_it, cost, last = "", [0.0], [-1]
        for part in sorted({parts[k] for parts, at in zip(split, gaps, strict=True) for k in at}):
            own[part] = self._bpe(part, before_it, cost, last) if self.kind == "bpe" else self._unigram(part)
            before_it = part
        for parts, got, at in zip(split, known, gaps, strict=True):
            for k in at:
                got[k] = own[parts[k]]
        paths.update((p, ids) for p, ids in own.items() if len(p) <= 64)
        if len(paths) > KEPT:
            for old in list(islice(paths, len(paths) - KEPT * 3 // 4)):
                del paths[old]
        return [list(chain.from_iterable(got)) for got in known]

    def decode(self, ids: list[int]) -> str:
        """Back through the transducer: runs of byte pieces are UTF-8, marks are spaces, the first mark is the prefix. Bad bytes give U+FFFD."""
        text = "".join(map(self.shown.__getitem__, ids))
        if self.byte_id:
            try:
                text.encode()
            except UnicodeEncodeError:
                text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        if self.opening and text.startswith(self.opening):
            text = text[1:]
        return text.replace(MARK, " ") if self.escape else text


def compile_spec(proto: bytes) -> Transducer:
    """The transducer of a serialised model; an error for what is not supported."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto.FromString(proto)
    trainer, norm, Piece = model.trainer_spec, model.normalizer_spec, pb.ModelProto.SentencePiece
    kind = {pb.TrainerSpec.UNIGRAM: "unigram", pb.TrainerSpec.BPE: "bpe"}.get(trainer.model_type)
    refused = [
        (kind is None, "word or character models"),
        (bool(norm.precompiled_charsmap), "a character map in the normaliser"),
        (trainer.treat_whitespace_as_suffix, "white space as a suffix"),
        (any(p.type in (Piece.USER_DEFINED, Piece.UNUSED) for p in model.pieces), "user-defined or unused pieces"),
    ]
    for bad, what in refused:
        if bad:
            raise ValueError(f"this model's specification has {what}, which is not supported")
    pieces, score = [p.piece for p in model.pieces], [p.score for p in model.pieces]
    byte_at = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == Piece.BYTE}
    if len(byte_at) not in (0, 256):
        raise ValueError("this model has some byte pieces, but not all")
    ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == Piece.NORMAL}
    unknown = next(i for i, p in enumerate(model.pieces) if p.type == Piece.UNKNOWN)
    bytes_ = [byte_at[b] for b in range(256)] if byte_at and trainer.byte_fallback else []
    return Transducer(kind, pieces, ids, score, bytes_, unknown, norm.add_dummy_prefix, norm.escape_whitespaces, norm.remove_extra_whitespaces)


def compile_model(path: str = MODEL) -> Transducer:
    """Reads the model's file; encoding and decoding are ours."""
    with open(path, "rb") as file:
        return compile_spec(file.read())


_WORKER: dict = {}


def _of_worker(model: Transducer) -> Transducer:
    """One transducer with its kept paths for all tasks of a worker process."""
    key = model.kind, model.opening, model.squeeze, model.escape, len(model.pieces), zlib.crc32("\n".join(model.pieces).encode())
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = model
    return _WORKER[key]


def encode_table(docs: DataFrame, model: Transducer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids: whole texts."""

    def run(batches):
        import pyarrow as pa

        fst = _of_worker(model)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                ids = fst.encode_all([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, ids array<int>")


def decode_table(encoded: DataFrame, model: Transducer) -> DataFrame:
    """doc_id, text."""

    def run(batches):
        import pyarrow as pa

        fst = _of_worker(model)
        for batch in batches:
            texts = [fst.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    bounded_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def summarise(docs: DataFrame, model: Transducer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers), round_trip; encoding and decoding in one pass, ids never leave the task."""

    def run(batches):
        import pyarrow as pa

        fst = _of_worker(model)
        low, high = (fst.byte_id[0], fst.byte_id[-1]) if fst.byte_id else (0, -1)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                out: list[list] = [[], [], [], []]
                texts = [t or "" for t in part.column(1).to_pylist()]
                for t, ids in zip(texts, fst.encode_all(texts), strict=True):
                    flat = np.array(ids, "<i4")
                    row = len(ids), int(((flat >= low) & (flat <= high)).sum()), zlib.crc32(flat.tobytes()), fst.decode(ids) == t
                    for to, v in zip(out, row, strict=True):
                        to.append(v)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, k) for v, k in zip(out, types, strict=True))], names=["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip"])

    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    return summarise(spark.read.parquet(f"{sf_dir}/documents.parquet"), compile_model(model_path))
