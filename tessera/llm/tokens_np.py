"""Words of whole texts and their 64-bit hashes, vectorised over an Arrow column in numpy.

A column is cut into parts of about ``PART_BYTES`` of text (one longer text makes
a part of its own), so the working memory does not depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PART_BYTES = 1 << 20
U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    with np.errstate(over="ignore"):
        x = x + U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def parts(column: pa.Array, part_bytes: int = PART_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) for consecutive rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + part_bytes, "right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of all words: runs of bytes outside x20 and x09 to x0D, within their row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~WHITE[data]
    first, last = np.zeros(len(data), bool), np.zeros(len(data), bool)
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = True
    last[np.concatenate([edges[edges > 0] - 1, [len(data) - 1]])] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:]
    closes[:-1] &= ~inside[1:] | last[:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: eight bytes at a time, so long words take more rounds and short ones one."""
    length = (ends - starts).astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    out = mix(length.astype(U))
    at, left, who = starts, length, None
    while len(at):
        x = eight[at] & _LOW[np.minimum(left, 8)]
        if who is None:
            out = mix(out ^ x)
        else:
            out[who] = mix(out[who] ^ x)
        more = np.flatnonzero(left > 8)
        who = more if who is None else who[more]
        at, left = at[more] + 8, left[more] - 8
    return out


_STEP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U)


def shingles(words: np.ndarray, row: np.ndarray, n_rows: int, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every window of n words within a row; a row of fewer words gives its whole sequence as one."""
    with np.errstate(over="ignore"):
        m = len(words) - n + 1
        if m > 0:
            whole = np.flatnonzero(row[:m] == row[n - 1 :])
            acc = np.zeros(len(whole), U)
            for k in range(n):
                acc += words[whole + k] * _STEP[k]
            long_h, long_r = mix(acc + U(n)), row[whole]
        else:
            long_h, long_r = np.zeros(0, U), np.zeros(0, np.int64)
        per_row = np.bincount(row, minlength=n_rows)
        short = np.flatnonzero((per_row > 0) & (per_row < n))
        if not len(short):
            return long_h, long_r
        first = np.searchsorted(row, short)
        acc = np.zeros(len(short), U)
        for k in range(n - 1):
            has = per_row[short] > k
            acc[has] += words[first[has] + k] * _STEP[k]
        short_h = mix(acc + per_row[short].astype(U) + U(1 << 32))
        order = np.argsort(np.concatenate([long_r, short]), kind="stable")
        return np.concatenate([long_h, short_h])[order], np.concatenate([long_r, short])[order]


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct shingle hashes) for every row with a word, texts lower-cased in A-Z."""
    for base, data, offsets in parts(column):
        data = LOWER[data]
        starts, ends, row = spans(data, offsets)
        h, r = shingles(hashes(data, starts, ends), row, len(offsets) - 1, n)
        cuts = np.flatnonzero(np.diff(r)) + 1
        begins = np.concatenate([[0], cuts]) if len(r) else cuts
        for b, e in zip(begins, [*cuts, len(r)], strict=True) if len(r) else ():
            own = np.sort(h[b:e])
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            yield base + int(r[b]), own[keep]
