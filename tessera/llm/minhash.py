"""Near-duplicate documents by HyperMinHash.

Every shingle hash chooses one of ``REGISTERS`` buckets by its low bits; a bucket
keeps the smallest of the remaining bits, compressed to the count of their
leading zeros and ``MANTISSA`` bits after the first one. The registers fold to
``FOLDED`` (the smaller value of each four), and ``BANDS`` bands of four folded
registers propose pairs; the share of equal registers, less the
collisions expected by chance, estimates their Jaccard similarity; pairs that can
still reach the threshold are compared on their full shingle sets.

Documents with the same set are one class (a 128-bit digest of the set), so exact
copies never meet in a band.

1. Within a band bucket a task compares sketches and writes a forest of possible
   pairs, at most one row a class. The forests' components are the clusters.
2. Each class of a cluster goes, with its text, to one cell: the cluster, or for a
   cluster of over ``BLOCK`` classes or ``CELL_SHINGLES`` shingles one of its
   parts by hash. A task compares all full sets of a cell that no link has joined yet.
3. Parts of a large cluster are joined by the leaders of their largest components;
   buckets that then still hold several components are dealt to cells of two parts,
   in which every pair of two components is compared on full sets. So ``BLOCK`` changes no result.
4. What bands and estimates miss follows. In one order of all shingles, frequent
   ones last, two sets that reach the threshold share one of their first
   n - ceil(t n) + 1. Where classes not compared yet (of two clusters, or of a large one
   without a common band) share one, and neither sizes, places nor sketches (``disproved``)
   exclude a link, they are compared on full sets. Only of these pairs a table is written.

Recall is 1 but for chances of 1e-15 a pair and collisions of 64-bit hashes. Bands alone miss 5 pairs in a million
at similarity 0.75, and some 20 in a million of three shingles against the same and a fourth.

Defined cases: texts that are null, empty or without words have no set, no link,
and stay; repeated rows are copies of each other; a null doc_id never names a
component that has another id; no column but the id and the text is read; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, sent_if_few
from .components import connected_components
from .tokens_np import U, mix, shingle_sets

REGISTERS, FOLDED, BANDS, MANTISSA = 512, 128, 32, 10
BITS = 9  # of a hash that choose the register; the other 55 are its value
SHINGLE, THRESHOLD = 5, 75
BLOCK, CELL_SHINGLES = 2048, 1 << 21  # classes and shingles of a part
TREES = 500_000  # classes whose trees a task remembers between buckets
SENT_CLASSES = 500_000  # of some 100 bytes, sent to all tasks at most
WHOLE = 2  # the side of rows that meet all rows of their cell
SAMPLED, SEEN, OFTEN = 8192, 3, 50_000  # classes looked at for frequent shingles, in how many of them one is frequent, how many are kept; they only set an order
SIGMAS, SLACK = 5.5, 0.015
CHANCE = 1e-15


def compress(v: np.ndarray) -> np.ndarray:
    """Leading zeros of 55-bit values and the mantissa bits that follow the first one; 0 is kept for an empty register."""
    m, e = np.frexp(v.astype(np.float64))
    mantissa = ((m - 0.5) * (2 << MANTISSA)).astype(np.int64)
    return (((64 - BITS - np.maximum(e, 0)) << MANTISSA) + np.clip(mantissa, 0, (1 << MANTISSA) - 1) + 1).astype(np.uint16)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of an ascending array of distinct hashes: the first that falls in a bucket has its smallest value."""
    low = U(REGISTERS - 1)
    out = np.zeros(REGISTERS, np.uint16)
    out[(hashes & low).astype(np.int64)[::-1]] = compress(hashes >> U(BITS))[::-1]
    return out


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits that depend on the set only."""
    with np.errstate(over="ignore"):
        n = U(len(hashes))
        pair = np.array([mix(hashes).sum(dtype=U) + n, mix(hashes ^ U(0x5851F42D4C957F2D)).sum(dtype=U) ^ n], dtype=U)
        return mix(pair).tobytes()


def fold(sketches: np.ndarray) -> np.ndarray:
    """(rows, FOLDED) registers as if the hash had chosen among FOLDED buckets. More leading zeros, then the smaller mantissa, is the smaller value."""
    low = (1 << MANTISSA) - 1
    rank = np.where(sketches == 0, 0, (sketches - 1) ^ low).astype(np.int32) + (sketches != 0)
    best = rank.reshape(-1, REGISTERS // FOLDED, FOLDED).max(1)
    return np.where(best == 0, 0, ((best - 1) ^ low) + 1).astype(np.uint16)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys; 0 where a band's registers are all empty."""
    words = np.ascontiguousarray(fold(sketches)).view(U).reshape(len(sketches), BANDS)
    keys = mix(words ^ mix(np.arange(BANDS, dtype=U) + U(1)))
    return np.where(words == 0, U(0), keys).view(np.int64)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers that are equal by chance for disjoint sets of n and m shingles.

    A register of a set with a shingles a register has its smallest value near x
    with density a exp(-a x); cells of one level are equally wide, so the sum over
    a level's cells is its cell width times the integral of both densities.
    """
    a, b = n / REGISTERS, m / REGISTERS
    level = np.arange(40)[:, None]
    hi, lo = 0.5**level, 0.5 ** (level + 1)
    mass = np.exp(-(a + b) * lo) - np.exp(-(a + b) * hi)
    return (lo / (1 << MANTISSA) * mass).sum(0) * a * b / np.maximum(a + b, 1e-12)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of pairs of sketches, and how many registers they rest on."""
    used = ((x | y) != 0).sum(1)
    same = ((x == y) & (x != 0)).sum(1)
    return np.clip((same - REGISTERS * chance(n, m)) / np.maximum(used, 1), 0, 1), used


def possible(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    """Pairs that the estimate and the sizes do not rule out.

    An estimate may fall ``SIGMAS`` standard deviations and ``SLACK`` below the
    threshold. The registers sample the union without replacement, so the
    deviation shrinks as they come to hold most of it; below 64 registers the
    plain binomial one is used, since few elements are not normal.
    """
    t = threshold / 100
    j, used = estimate(x, y, n, m)
    fits = 100 * np.minimum(n, m) >= threshold * np.maximum(n, m)
    unseen = np.where(used < 64, 1.0, np.maximum(1 - used * (1 + t) / (n + m), 0.02))
    return fits & (j >= t - SLACK - SIGMAS * np.sqrt(t * (1 - t) * unseen / np.maximum(used, 1)))


def disproved(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    """Pairs that cannot reach the threshold.

    A register that differs has a shingle of one set alone, and linked sets have at most (1 - t) / (1 + t) of
    n + m such. Of longer sets that says nothing; there a linked pair's share of equal registers, a sample of its union without
    replacement, stays above t - sqrt(ln(1 / ``CHANCE``) / 2 / registers) but for ``CHANCE`` (Hoeffding).
    """
    used, same = ((x | y) != 0).sum(1), ((x == y) & (x != 0)).sum(1)
    certain = (100 + threshold) * (x != y).sum(1) > (100 - threshold) * (n + m)
    return certain | (same < threshold / 100 * used - np.sqrt(-np.log(CHANCE) / 2 * used))


def first_shingles(own: np.ndarray, often: np.ndarray, threshold: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 of an ascending set: others by hash, then those of ``often`` (ascending hashes, their places). Sets that reach the threshold share one."""
    kept = len(own) + threshold * len(own) // -100 + 1
    if not often.size:
        return own[:kept]
    at = np.minimum(np.searchsorted(often[0], own), often.shape[1] - 1)
    return own[np.argsort(np.where(often[0][at] == own, often[1][at], 0), kind="stable")[:kept]]


def largest_partner(n: int, places: np.ndarray, threshold: int) -> np.ndarray:
    """The most shingles that a set linked to one of n shingles has, if their first common one stands at a place: no more than n - place are common."""
    return ((100 + threshold) * (n - places) - threshold * n) // threshold


def _sketches(batches):
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("regs", pa.binary())])
    for batch in batches:
        n, cls, regs = np.zeros(len(batch), np.int64), [None] * len(batch), [None] * len(batch)
        for i, own in shingle_sets(batch.column("text"), SHINGLE):
            n[i], cls[i], regs[i] = len(own), set_digest(own), sketch(own).tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n), pa.array(cls, pa.binary()), pa.array(regs, pa.binary())], schema=schema)


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _bands(batches):
    """The same rows with the list of their band keys."""
    import pyarrow as pa

    for batch in batches:
        if not len(batch):
            continue
        keys = band_keys(_registers(batch.column("regs")))
        full = keys != 0
        offsets = np.concatenate([[0], full.sum(1).cumsum()]).astype(np.int32)
        yield batch.append_column("keys", pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full])))


class Trees:
    """Disjoint sets of hashable names."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up[x]
        return top

    def join(self, x, y) -> bool:
        """Whether the two were apart."""
        x, y = self.find(x), self.find(y)
        self.up[x] = y
        return x != y


def forest(names: list, starts: np.ndarray, regs: np.ndarray, n: np.ndarray, threshold: int, trees: Trees) -> list[tuple]:
    """Pairs of names that tie together, in each run of rows from ``starts`` on, all that a chain of possible pairs connects; less what ``trees`` has tied already.

    First all rows are compared with the first of their run, for all runs at once.
    Runs that are still apart are compared between trees, short ones at once, too.
    """
    out = []

    def tie(i, j):
        if trees.join(names[i], names[j]):
            out.append((names[i], names[j]))

    def compare(i, j):
        for at in range(0, len(i), 8192):
            x, y = i[at : at + 8192], j[at : at + 8192]
            ok = possible(regs[x], regs[y], n[x], n[y], threshold)
            for p, q in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                tie(p, q)

    ends = np.concatenate([starts[1:], [len(names)]])
    first = np.repeat(starts, ends - starts)
    rows = np.arange(len(names))
    apart = [i for i in rows[rows != first].tolist() if trees.find(names[i]) != trees.find(names[first[i]])]
    compare(first[apart], np.array(apart, np.int64))
    left, right = [], []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        roots = [trees.find(x) for x in names[a:b]]
        if b - a < 3 or len(set(roots)) == 1:
            continue
        if b - a <= 32:
            # pairs with the first row are settled
            for i in range(a + 1, b):
                for j in range(i + 1, b):
                    if roots[i - a] != roots[j - a]:
                        left.append(i)
                        right.append(j)
            continue
        code = {r: k for k, r in enumerate(dict.fromkeys(roots))}
        label = np.array([code[r] for r in roots])
        outside = np.flatnonzero(label != np.bincount(label).argmax())
        rank = np.full(b - a, len(label))
        rank[outside] = np.arange(len(outside))
        for k, i in enumerate(outside.tolist()):
            other = np.flatnonzero((label != label[i]) & (rank > k))
            ok = other[possible(regs[a + i][None], regs[a + other], n[a + i][None], n[a + other], threshold)] if len(other) else other
            for was in np.unique(label[ok]).tolist():
                tie(a + i, a + int(ok[label[ok] == was][0]))
            label[np.isin(label, label[ok])] = label[i]
    compare(np.array(left, np.int64), np.array(right, np.int64))
    return out


def _pairs(out: list[tuple[bytes, bytes]]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _near(threshold: int):
    """Rows sorted by bucket and slice to a forest of possible pairs. Slices of one bucket are tied through a node of the bucket's own, its key."""

    def run(batches):
        trees = Trees()

        def tied(rows):
            key, cell = rows.column("key").to_numpy(), rows.column("cell").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1])
            names = rows.column("cls").to_pylist()
            if len(trees.up) > TREES:
                trees.up.clear()
            out = forest(names, starts, _registers(rows.column("regs")), rows.column("n").to_numpy(), threshold, trees)
            slices = rows.column("slices").to_numpy()
            out += [(names[i], int(key[i]).to_bytes(8, "big", signed=True)) for i in starts.tolist() if slices[i] > 1]
            return _pairs(out)

        for rows in whole_groups(batches, ("key", "cell")):
            yield tied(rows)

    return run


def whole_groups(batches, names, most: int = 4096):
    """Sorted batches joined to tables of whole groups, of at least ``most`` rows but for the last."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n >= most:
            rows = pa.Table.from_batches(held).combine_chunks()
            change = np.zeros(len(rows) - 1, bool)
            for k in names:
                column = rows.column(k).to_numpy()
                change |= column[1:] != column[:-1]
            at = np.flatnonzero(change)
            if len(at):
                yield rows.slice(0, int(at[-1]) + 1)
                held = rows.slice(int(at[-1]) + 1).to_batches()
                n = sum(map(len, held))
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def components_of_sets(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, threshold: int) -> np.ndarray:
    """Labels after joining every two sets that reach the threshold, are labelled apart and lie on two sides (or on side ``WHOLE``).

    Each set is counted against those after it that are labelled otherwise: its hashes are
    marked, and the marks of the others summed, so a pair costs its shorter part once and no pair is kept.
    """
    n, label = np.array([len(s) for s in sets]), label.copy()
    if len(sets) == 2:
        sets_apart = label[0] != label[1] and (side[0] != side[1] or side[0] == WHOLE)
        common = len(np.intersect1d(*sets, assume_unique=True)) if sets_apart else 0
        if sets_apart and 100 * common >= threshold * (n.sum() - common):
            label[1] = label[0]
        return label
    starts = np.concatenate([[0], np.cumsum(n)])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    mark = np.zeros(int(codes.max()) + 1, np.int32)
    for i in range(len(sets) - 1):
        after = label[i + 1 :] != label[i]
        after &= (side[i + 1 :] != side[i]) | (side[i] == WHOLE)
        after &= 100 * np.minimum(n[i + 1 :], n[i]) >= threshold * np.maximum(n[i + 1 :], n[i])
        other = i + 1 + np.flatnonzero(after)
        if not len(other):
            continue
        own = codes[starts[i] : starts[i + 1]]
        mark[own] = 1
        if 2 * len(other) > len(sets) - i:
            base = starts[i + 1]
            common = np.add.reduceat(mark[codes[base:]], starts[i + 1 : -1] - base)[other - i - 1]
        else:
            at = np.repeat(starts[other] - np.concatenate([[0], np.cumsum(n[other])[:-1]]), n[other]) + np.arange(n[other].sum())
            common = np.add.reduceat(mark[codes[at]], np.concatenate([[0], np.cumsum(n[other])[:-1]]))
        mark[own] = 0
        linked = other[100 * common >= threshold * (n[other] + n[i] - common)]
        if len(linked):
            label[np.isin(label, label[linked])] = label[i]
    return label


def _linked(threshold: int):
    """Rows with texts, sorted by group, cell and class, to (a, b): roots of one cell that links join, each tied to the smallest of them. One cell's sets are held at a time."""

    def run(batches):
        def joined(sets, root, side):
            code = {r: k for k, r in enumerate(dict.fromkeys(root))}
            was = np.array([code[r] for r in root])
            label = components_of_sets(sets, was, np.array(side), threshold)
            least: dict = {}
            for r, k in zip(root, label.tolist(), strict=True):
                least[k] = min(r, least.get(k, r))
            return {(r, least[k]) for r, k in zip(root, label.tolist(), strict=True) if r != least[k]}

        now, seen, sets, root, side = None, None, [], [], []
        out: list = []
        for batch in batches:
            own = dict(shingle_sets(batch.column("text"), SHINGLE))
            for i, (grp, cell, cls, r, s) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("grp", "cell", "cls", "root", "side")), strict=True)):
                if (grp, cell) != now:
                    if len(sets) > 1:
                        out += joined(sets, root, side)
                    now, seen, sets, root, side = (grp, cell), None, [], [], []
                # an id on several rows brings the same text again
                if cls != seen and i in own and set_digest(own[i]) == cls:
                    seen = cls
                    sets.append(own[i])
                    root.append(r)
                    side.append(s)
            if len(out) >= 4096:
                yield _pairs(out)
                out = []
        if len(sets) > 1:
            out += joined(sets, root, side)
        yield _pairs(out)

    return run


def _first_of_class(batches):
    """Rows without repeats of a class and cell, as far as a task remembers them, before their texts are sent."""
    import pyarrow as pa

    seen: set = set()
    for batch in batches:
        ok = []
        for place in zip(*(batch.column(c).to_pylist() for c in ("grp", "cell", "cls")), strict=True):
            ok.append(place not in seen)
            seen.add(place)
        if len(seen) > TREES:
            seen.clear()
        yield batch.filter(pa.array(ok, pa.bool_()))


def _all_shingles(batches):
    import pyarrow as pa

    for batch in batches:
        for _, own in shingle_sets(batch.column("text"), SHINGLE):
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["key"])


def _first(often: np.ndarray, threshold: int):
    """Rows (cls, grp, text) to one row for each first shingle: key, cls, grp, n, and the size of the largest set that it can link to."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, keys, n, most = [], [], [], []
            for i, own in shingle_sets(batch.column("text"), SHINGLE):
                first = first_shingles(own, often, threshold)
                rows.append(np.full(len(first), i))
                keys.append(first.view(np.int64))
                n.append(np.full(len(first), len(own)))
                most.append(largest_partner(len(own), np.arange(len(first)), threshold))
            if rows:
                of = pa.array(np.concatenate(rows))
                arrays = [pa.array(np.concatenate(keys)), batch.column("cls").take(of), batch.column("grp").take(of), pa.array(np.concatenate(n)), pa.array(np.concatenate(most))]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "cls", "grp", "n", "most"])

    return run


_FIRST = "key long, cls binary, grp long, n long, most long"


def _digits(batches):
    """Rows (cls, regs) to classes and their registers as half bytes; equal registers stay equal, and 0 is kept for an empty one."""
    import pyarrow as pa

    for batch in batches:
        if len(batch):
            regs = _registers(batch.column("regs"))
            digits = np.where(regs == 0, 0, regs % 15 + 1).astype(np.uint8)
            packed = digits[:, ::2] | digits[:, 1::2] << 4
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([d.tobytes() for d in packed], pa.binary())], names=["cls", "digits"])


def _allowed(rows):
    """Arrays (x, y) of places of rows of one key and cell, of two groups, that sizes and places allow to be linked; rows of each distance at once."""
    at = np.arange(len(rows))
    key, i, j, grp, n, most, side = (rows.column(c).to_numpy() for c in ("key", "i", "j", "grp", "n", "most", "side"))
    starts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1])
    size = np.diff([*starts, len(rows)])
    left = np.repeat(starts + size, size) - at
    for step in range(1, int(size.max())):
        x = at[left > step]
        y = x + step
        ok = (grp[y] != grp[x]) & (n[y] <= most[x]) & (n[x] <= most[y]) & ((side[y] != side[x]) | (side[x] == WHOLE))
        yield x[ok], y[ok]


def _with_partner(batches):
    """Of rows sorted by key and cell those that have an allowed partner."""
    import pyarrow as pa

    for rows in whole_groups(batches, ("key", "i", "j")):
        some = np.zeros(len(rows), bool)
        for x, y in _allowed(rows):
            some[x] = some[y] = True
        yield from rows.filter(pa.array(some)).combine_chunks().to_batches()


def _meetings(threshold: int):
    """Rows sorted by key and cell to allowed pairs of classes that the half bytes of registers leave open. Classes of one large cluster that share a band have been compared."""

    def run(batches):
        seen: set = set()
        for rows in whole_groups(batches, ("key", "i", "j")):
            n = rows.column("n").to_numpy()
            cls = rows.column("cls").to_pylist()
            packed = np.frombuffer(b"".join(rows.column("digits").to_pylist()), np.uint8).reshape(-1, REGISTERS // 2)
            digits = np.concatenate([packed & 15, packed >> 4], 1)
            cluster = rows.column("cluster").to_pylist() if "cluster" in rows.column_names else []
            bands = [k and frozenset(k) for k in rows.column("keys").to_pylist()] if cluster else []
            out: list = []
            for x, y in _allowed(rows):
                for k in range(0, len(x), 8192):
                    a, b = x[k : k + 8192], y[k : k + 8192]
                    ok = ~disproved(digits[a], digits[b], n[a], n[b], threshold)
                    for p, q in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                        pair = min(cls[p], cls[q]), max(cls[p], cls[q])
                        if pair in seen:
                            continue
                        if not cluster or cluster[p] is None or cluster[p] != cluster[q] or bands[p].isdisjoint(bands[q]):
                            seen.add(pair)
                            out.append(pair)
                if len(seen) > TREES:
                    seen.clear()
                if len(out) >= 4096:
                    yield _pairs(out)
                    out = []
            yield _pairs(out)

    return run


def _not_disproved(threshold: int):
    """Pairs with the sketches and sizes of both, to the pairs that those leave open."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
                open_ = ~disproved(_registers(batch.column("x")), _registers(batch.column("y")), n, m, threshold)
                yield batch.select(["a", "b", "m"]).filter(pa.array(open_))

    return run


_PAIR = "a binary, b binary"
_PLACED = "grp binary, cell string, side int, cls binary, root binary, text string"


def _links(slim: DataFrame, placed: DataFrame, threshold: int) -> DataFrame:
    """placed: a written table (grp, cell, side, cls, root, rep, h) of classes under their cells, to (a, b) of joined roots."""
    wanted, _ = sent_if_few(placed, SENT_CLASSES)
    same = slim["doc_id"].eqNullSafe(wanted["rep"]) & (slim["h"] == wanted["h"])
    texts = slim.join(wanted, same).select("grp", "cell", "side", "cls", "root", "text").mapInArrow(_first_of_class, _PLACED)
    return texts.repartition("grp", "cell").sortWithinPartitions("grp", "cell", "cls").mapInArrow(_linked(threshold), _PAIR)


def _parts(count: str, shingles: str) -> Column:
    """How many parts of ``BLOCK`` classes and ``CELL_SHINGLES`` shingles rows need."""
    return F.greatest(F.lit(1), F.ceil(F.col(count) / BLOCK), F.ceil(F.col(shingles) / CELL_SHINGLES)).cast("int")


def _part(parts: str) -> Column:
    return F.pmod(F.xxhash64("cls"), F.col(parts)).cast("int")


def _rooted(rows: DataFrame, roots: DataFrame, column: str = "root") -> DataFrame:
    """rows with ``column`` led to its root, where (node, root) has one."""
    found = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return rows.join(found, F.col(column) == F.col("__node"), "left").withColumn(column, F.coalesce("__root", column)).drop("__node", "__root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    whole = materialize(slim.mapInArrow(_sketches, "doc_id long, h long, n long, cls binary, regs binary"), "sketches")
    rows = materialize(whole.select("doc_id", "n", "cls"), "rows")
    of = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("of")
    classes = whole.where("cls is not null").groupBy("cls").agg(of, F.max("n").alias("n"), F.max("regs").alias("regs"))
    classes = materialize(classes.select("cls", F.col("of.doc_id").alias("rep"), "of.h", "n", "regs"), "classes")
    discard(whole)

    banded = classes.select("cls", "n", "regs").mapInArrow(_bands, "cls binary, n long, regs binary, keys array<long>")
    keyed = banded.select("cls", F.explode("keys").alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    shared, few = sent_if_few(shared)
    members = keyed.join(shared, "key")
    met = banded.select("cls", "n", "regs", F.explode("keys").alias("key")).join(shared, "key") if few else members.join(classes.select("cls", "n", "regs"), "cls")
    met = met.withColumn("slices", F.ceil(F.col("size") / BLOCK).cast("int")).select("key", _part("slices").alias("cell"), "slices", "cls", "n", "regs")
    near = met.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_near(threshold), _PAIR)
    clusters = connected_components(near).select(F.col("node").alias("cls"), F.col("root").alias("cluster"))

    own = classes.select("cls", "rep", "h", "n").join(clusters, "cls")
    sizes = own.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("s")).where("m > 1").select("cluster", _parts("m", "s").alias("parts"))
    placed = own.join(sizes, "cluster").withColumn("part", _part("parts"))
    placed = materialize(placed.select(F.col("cluster").alias("grp"), "parts", "part", F.col("part").cast("string").alias("cell"), F.lit(WHOLE).alias("side"), "cls", F.col("cls").alias("root"), "rep", "h", "n"), "placed")
    links = materialize(_links(slim, placed.drop("parts", "part", "n"), threshold), "links")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    large = placed.where("parts > 1")
    split = not large.isEmpty()
    if split:
        links = links.unionByName(_across_parts(slim, large, members, links, threshold))
        roots = connected_components(links)

    cluster_of = placed.select("cls", F.col("grp").alias("cluster"), (F.col("parts") > 1).alias("large"))
    named = _rooted(classes.select("cls", "rep", "h", "n", F.col("cls").alias("root")), roots).join(cluster_of, "cls", "left")
    # classes of one group have all been compared
    named = named.withColumn("grp", F.xxhash64(F.when(F.col("large"), F.col("root")).otherwise(F.coalesce("cluster", "cls"))))
    named = materialize(named.withColumn("cluster", F.when(F.col("large"), F.xxhash64("cluster"))).select("cls", "rep", "h", "n", "root", "grp", "cluster"), "named")
    missed = materialize(_links(slim, materialize(_missed(slim, named, classes, split, threshold), "stars"), threshold), "missed")
    if not missed.isEmpty():
        named = _rooted(named, connected_components(missed))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = materialize(named.join(smallest, "root").select("cls", "component_id"), "components")
    out = rows.select("doc_id", "n", "cls").join(final, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _texts_of(slim: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, a written table of classes with rep and h, with their texts."""
    wanted, _ = sent_if_few(wanted, SENT_CLASSES)
    return slim.join(wanted, slim["doc_id"].eqNullSafe(wanted["rep"]) & (slim["h"] == wanted["h"])).select(*(wanted[c] for c in wanted.columns), "text")


def _often(slim: DataFrame, classes: DataFrame) -> np.ndarray:
    """Ascending hashes of shingles that many of some ``SAMPLED`` classes have, and their places, from 1 for the rarest."""
    of = 1_000_000
    share = -(-SAMPLED * of // max(classes.count(), 1))
    drawn = materialize(classes.where(F.pmod(F.xxhash64("cls"), F.lit(of)) < share).select("cls", "rep", "h"), "drawn")
    seen = _texts_of(slim, drawn).select("text").mapInArrow(_all_shingles, "key long").groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") >= SEEN)
    most = seen.orderBy(F.desc("m"), "key").limit(OFTEN).collect()
    hashes = np.array([r.key for r in reversed(most)], np.int64).view(U)
    order = np.argsort(hashes)
    return np.stack([hashes[order], order.astype(U) + U(1)])


def _by_key(met: DataFrame) -> DataFrame:
    return met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _missed(slim: DataFrame, named: DataFrame, classes: DataFrame, split: bool, threshold: int) -> DataFrame:
    """Classes under the cells in which they meet those of other groups that they may be linked with and have not been compared with.

    named: a written table (cls, rep, h, n, root, grp, cluster); cluster is null but for large clusters, and ``split`` says whether there are any.
    """
    often = _often(slim, classes)
    first = _texts_of(slim, named.select("cls", "rep", "h", "grp")).select("cls", "grp", "text").mapInArrow(_first(often, threshold), _FIRST)
    spread = first.select("key", "grp").groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count("*").alias("m")).where("lo != hi")
    spread, _ = sent_if_few(materialize(spread.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts")), "spread"))
    dealt = first.join(spread, "key").withColumn("at", _part("parts"))
    at = F.col("at")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(at, k).alias("i"), F.greatest(at, k).alias("j"), F.when(k == at, WHOLE).when(at < k, 0).otherwise(1).alias("side")))
    met = dealt.withColumn("p", F.explode(cells)).select("key", "cls", "grp", "n", "most", "p.i", "p.j", "p.side")
    digits, _ = sent_if_few(materialize(classes.select("cls", "regs").mapInArrow(_digits, "cls binary, digits binary"), "digits"), SENT_CLASSES // 5)
    met = _by_key(met).mapInArrow(_with_partner, f"{_FIRST}, i int, j int, side int").join(digits, "cls")
    if split:
        bands = named.where("cluster is not null").select("cls", "cluster").join(classes.select("cls", "n", "regs"), "cls").mapInArrow(_bands, "cls binary, cluster long, n long, regs binary, keys array<long>")
        met = met.join(bands.select("cls", "cluster", "keys"), "cls", "left")
    pairs = _by_key(met).mapInArrow(_meetings(threshold), _PAIR).distinct()
    known = classes.select("cls", "regs", "n")
    both = pairs.join(known.toDF("a", "x", "n"), "a").join(known.toDF("b", "y", "m"), "b").select("a", "b", "x", "y", "n", "m")
    pairs = materialize(both.mapInArrow(_not_disproved(threshold), "a binary, b binary, m long"), "pairs")
    stars = pairs.groupBy("a").agg(F.count("*").alias("c"), F.sum("m").alias("s")).select("a", _parts("c", "s").alias("parts"))
    centres = stars.select(F.col("a").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("a").alias("cls"))
    others = pairs.join(stars, "a").select(F.col("a").alias("grp"), F.col("b").alias("cls"), "parts").select("grp", _part("parts").alias("part"), F.lit(1).alias("side"), "cls")
    cells = centres.unionByName(others).join(named.select("cls", "root", "rep", "h"), "cls")
    return cells.select("grp", F.col("part").cast("string").alias("cell"), "side", "cls", "root", "rep", "h")


def _across_parts(slim: DataFrame, large: DataFrame, members: DataFrame, links: DataFrame, threshold: int) -> DataFrame:
    """Further links, between the parts of large clusters (``large``, placed rows), which ``links`` has joined within."""
    columns = ("grp", "cell", "side", "cls", "root", "rep", "h")
    inside = materialize(_rooted(large, links.select(F.col("a").alias("node"), F.col("b").alias("root"))), "inside")
    # the leaders of the parts' largest components
    tops = inside.groupBy("grp", "part", "root").agg(F.count("*").alias("m")).groupBy("grp", "part").agg(F.max(F.struct("m", "root")).alias("top"))
    leaders = inside.join(tops.select(F.col("top.root").alias("cls")), "cls", "left_semi").withColumn("cell", F.floor(F.col("part") / BLOCK).cast("string"))
    ties = materialize(_links(slim, materialize(leaders.select(*columns), "leaders"), threshold), "ties")
    # buckets that still hold several components
    held = _rooted(inside.select("cls", "root", "rep", "h", "n"), connected_components(ties))
    held = materialize(members.select("key", "cls").join(held, "cls"), "held")
    open_ = held.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    cells = _cells(held.join(open_, "key")).select(F.col("key").cast("string").cast("binary").alias("grp"), F.to_json("cell").alias("cell"), *columns[2:])
    return ties.unionByName(materialize(_links(slim, materialize(cells, "cells"), threshold), "last"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of one document per near-duplicate group, with all their columns.

    Rows with a null id stay, since nothing tells them apart; an id on several rows
    goes if none of its rows is kept, and of its rows with equal text one stays.
    """
    verdicts = materialize(near_duplicates(docs, doc_id, text, threshold).groupBy("doc_id").agg(F.bool_or("kept").alias("any"), F.count("*").alias("rows")), "verdicts")
    gone = verdicts.where("not any").select(F.col("doc_id").alias("__gone"))
    gone, _ = sent_if_few(gone)
    stay = docs.join(gone, docs[doc_id] == gone["__gone"], "left_anti")
    if verdicts.where("rows > 1 and doc_id is not null").isEmpty():
        return stay
    named = stay.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id, text])
    return named.unionByName(stay.where(F.col(doc_id).isNull()))


def _cells(rows: DataFrame) -> DataFrame:
    """Rows (key, cls, root, rep, h, n) of buckets under every cell, a pair of parts, in which they meet others.

    Parts of the bucket's largest component (side 0) meet those of all other
    rows (side 1); the others' parts meet each other, and themselves (side WHOLE).
    The largest component's rows don't meet among themselves.
    """
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    main = sizes.groupBy("key").agg(F.max(F.struct("m", "root", "s")).alias("main"), F.sum("m").alias("all"), F.sum("s").alias("shingles"))
    main = main.select("key", F.col("main.root").alias("main"), F.col("main.m").alias("m"), F.col("main.s").alias("s"), (F.col("all") - F.col("main.m")).alias("om"), (F.col("shingles") - F.col("main.s")).alias("os"))
    counted = main.select("key", "main", _parts("m", "s").alias("nm"), _parts("om", "os").alias("no"))
    dealt = rows.join(counted, "key").withColumn("is_main", F.col("root") == F.col("main"))
    own = dealt.withColumn("at", F.when(F.col("is_main"), _part("nm")).otherwise(_part("no")))
    place = lambda rest, i, j, side: F.struct(F.struct(F.lit(rest).alias("rest"), i.alias("i"), j.alias("j")).alias("cell"), side.alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = F.col("at")
    of_main = F.transform(upto("no"), lambda j: place(False, at, j, F.lit(0)))
    with_main = F.transform(upto("nm"), lambda i: place(False, i, at, F.lit(1)))
    with_rest = F.transform(upto("no"), lambda k: place(True, F.least(at, k), F.greatest(at, k), F.when(k == at, WHOLE).when(at < k, 0).otherwise(1)))
    out = own.select("key", "cls", "root", "rep", "h", F.explode(F.when(F.col("is_main"), of_main).otherwise(F.concat(with_main, with_rest))).alias("p"))
    return out.select("key", "p.cell", "p.side", "cls", "root", "rep", "h")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
