"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats, empty tables and further columns."""

import hashlib
import random
import re
import zlib
from base64 import b32encode
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, cnn, components, minhash, packing, quality_rules, sharding, tokens_np, topk, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0, n=60):
    """Texts with copies, near copies, repeats inside, junk, very short, empty, null and long ones."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghéß") for _ in range(r.randint(1, 7))) for _ in range(300)]
    make = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    out = [make(r.choice([3, 12, 40, 90])) for _ in range(n)]
    base = make(80)
    for _ in range(12):
        w = base.split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append(" ".join(w))
    out += [base, base.upper(), base + "\n", "", "   \n\t ", None, "one", "one two three four", "one two three four", "a b c d e", "x\n" * 40, "spam ham eggs spam ham eggs " * 30, "### $$$ *** %%% &&& |||", make(6000), " wide space words are one"]
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(out)]


def table(spark, rows):
    """Documents with columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("size", F.lit("own")).withColumn("key", F.lit(1)).withColumn("cls", F.lit("x")).withColumn("n_words", F.lit(-1))


def plain(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


# tokens


def test_spans_and_shingles_agree_with_regex():
    texts = [t for _, t, *_ in corpus(3)]
    got = {i: set(s.tolist()) for i, s in tokens_np.shingle_sets(pa.array(texts, pa.string()))}
    want = [shingles(t) for t in texts]
    assert {i for i, s in enumerate(want) if s} == set(got)
    for i, s in got.items():
        assert len(s) == len(want[i])
    for i in got:
        for j in got:
            assert len(got[i] & got[j]) == len(want[i] & want[j])


@pytest.mark.parametrize("part", [1, 7, 64, 1 << 20])
def test_parts_do_not_change_words(part):
    texts = [t for _, t, *_ in corpus(4, 20)]
    found = []
    for base, data, offsets in tokens_np.parts(pa.array(texts, pa.string()), part):
        s, e, row = tokens_np.spans(data, offsets)
        found += [(base + int(r), data[a:b].tobytes().decode()) for a, b, r in zip(s, e, row, strict=True)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]


# 1


def test_warc(spark, tmp_path):
    rows = [(5, "u5", "<p>é</p>"), (2, "u2", "<p>é</p>"), (9, None, None), (3, "u3", ""), (7, "u\r\n7", "x" * 50_000), (2, "u2", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("own")).withColumn("digest", F.lit(1))
    archive = warc.write_archive(pages)
    records = warc.read_records(archive)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect()]
    digest = lambda t: b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    kinds = Counter((g[0], g[3], g[4]) for g in got)
    assert kinds == Counter([(5, "revisit", 2), (2, "response", None), (2, "revisit", 2), (9, "revisit", 3), (3, "response", None), (7, "response", None)])
    assert all(g[1:3] == (len((t or "").encode()), digest(t)) for g in got for p, _, t in rows if p == g[0])
    assert archive.payloads.count() == 3
    warc.export_warc(records, str(tmp_path / "w"))
    blocks = warc.import_warc(spark, str(tmp_path / "w" / "part-*")).collect()
    assert Counter(b.record_type for b in blocks) == Counter(g[3] for g in got)
    assert Counter(digest(b.payload.decode()) for b in blocks) == Counter(b.payload_digest.removeprefix("sha1:") for b in blocks)
    assert {digest(b.block.decode()) for b in blocks if b.record_type == "response"} == {b.payload_digest.removeprefix("sha1:") for b in blocks if b.record_type == "response"}
    assert warc.read_records(warc.write_archive(pages.limit(0))).count() == 0


def test_warc_without_ids(spark):
    """A null page_id sorts first, so such a row is the response; mandatory header lines are there."""
    rows = [(4, "u4", "same"), (None, None, "same"), (None, None, "other"), (1, "u1", None)]
    records = warc.read_records(warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to, bytes(r.payload)) for r in records) == Counter([(4, "revisit", None, b"same"), (None, "response", None, b"same"), (None, "response", None, b"other"), (1, "response", None, b"")])
    for r in records:
        names = [line.split(":")[0] for line in r.header.split("\r\n")[1:] if line]
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(names)
        assert ("Content-Type" in names) == (r.record_type == "response")


def test_warc_damage_is_found(spark):
    archive = warc.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"))
    broken = warc.Archive(archive.headers, archive.payloads.withColumn("payload", F.lit(b"abd")))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_records(broken).collect()
    # a header that fits the damaged payload does not hide it: the address is a stronger digest
    other = warc.write_archive(spark.createDataFrame([(1, "u", "abd")], "page_id long, url string, html string"))
    lying = warc.Archive(other.headers.withColumn("sha256", F.lit(hashlib.sha256(b"abc").digest())), other.payloads.withColumn("sha256", F.lit(hashlib.sha256(b"abc").digest())))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_records(lying).collect()


# 2


def components_by_force(rows, threshold=75):
    sets = {i: shingles(t) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= threshold * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("seed", [0, 1])
def test_near_duplicates(spark, seed):
    rows = corpus(seed)
    want, sizes = components_by_force(rows)
    got = minhash.near_duplicates(table(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """With a tiny block every cluster and bucket is dealt to parts; the components stay the same."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    rows = corpus(2)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(plain(spark, rows)).collect()} == components_by_force(rows)[0]


def test_cells_meet_every_pair_of_two_components_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 2)
    rows = [(7, str(i).encode(), b"0" if i < 5 else str(i % 9).encode(), i, i, 10) for i in range(16)]
    cells = minhash._cells(spark.createDataFrame(rows, "key long, cls binary, root binary, rep long, h long, n long")).collect()
    met, by = Counter(), defaultdict(list)
    for x in cells:
        by[x.cell].append(x)
    for own in by.values():
        for i, x in enumerate(own):
            met.update(frozenset((bytes(x.cls), bytes(y.cls))) for y in own[i + 1 :] if x.root != y.root and (x.side != y.side or x.side == minhash.WHOLE))
    roots = {r[1]: r[2] for r in rows}
    assert met == {frozenset((a, b)): 1 for a in roots for b in roots if roots[a] != roots[b]}


def dense_group(n, seed=0):
    """Texts of 200 words with four replaced in each: most pairs lie at about 0.66, some above 0.75."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    out = []
    for i in range(n):
        w = list(base)
        for k in r.sample(range(200), 4):
            w[k] = f"x{r.randrange(10**9)}"
        out.append((i, " ".join(w), "en", "s", 0))
    return out


def fast_components(rows):
    """Brute force over all pairs, as a matrix of common shingles."""
    codes, sets = {}, []
    for _, t, *_ in rows:
        sets.append([codes.setdefault(x, len(codes)) for x in shingles(t)])
    m = np.zeros((len(rows), len(codes)), np.float32)
    for i, s in enumerate(sets):
        m[i, s] = 1
    common, n = m @ m.T, m.sum(1)
    linked = 100 * common >= 75 * (n[:, None] + n[None] - common)
    label = np.arange(len(rows))
    while True:
        low = np.where(linked, label[None], len(rows)).min(1)
        if (low == label).all():
            return {rows[i][0]: rows[int(k)][0] for i, k in enumerate(label)}
        label = np.minimum(label, low)


@pytest.mark.parametrize("block", [2048, 40])
def test_dense_groups_write_rows_in_proportion(spark, monkeypatch, block):
    """Most pairs are possible and few are links: components as by brute force, and no table of pairs, with one cell and with many."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    real, written = minhash.materialize, Counter()

    def counted(df, name, **options):
        out = real(df, name, **options)
        written[name] += out.count()
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    totals = {}
    for n in (300, 600, 1200) if block > 40 else (300,):
        written.clear()
        rows = dense_group(n)
        want = fast_components(rows)
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(plain(spark, rows)).collect()} == want
        assert 1 < len(set(want.values())) < n
        totals[n] = written["links"], sum(written.values())
        assert written["links"] < n and written["placed"] <= n
    if block > 40:
        assert totals[1200][1] < 6 * totals[300][1]


def near_pairs(n, seed=3):
    """Pairs of texts at similarity 0.75 and above: eight words and the first seven, and longer ones with a word replaced or cut."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = [f"w{r.randrange(10**9)}" for _ in range(r.choice([8, 8, 8, 40, 120]))]
        other = w[:-1] if len(w) == 8 else [*w[: len(w) // 2], f"x{i}", *w[len(w) // 2 + 1 :]]
        out += [(2 * i, " ".join(w), "", "", 0), (2 * i + 1, " ".join(other), "", "", 0)]
    return out


@pytest.mark.parametrize(("block", "sampled"), [(2048, 8192), (3, 20)])
@pytest.mark.parametrize("missed", ["bands", "estimates"])
def test_links_that_bands_or_estimates_miss_are_found(spark, monkeypatch, missed, block, sampled):
    """No pair shares a band, or none passes the estimate: the components are still those of brute force."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SAMPLED", sampled, raising=False)
    rows = near_pairs(40) + [(100 + i, t, "", "", 0) for i, t, *_ in corpus(4)] + [(1000 + i, t, "", "", 0) for i, t, *_ in dense_group(40)]
    rows = [(i, t, *rest) for i, (_, t, *rest) in enumerate(rows)]
    if missed == "bands":
        monkeypatch.setattr(minhash, "_bands", _no_bands())
    else:
        real = minhash._near
        monkeypatch.setattr(minhash, "_near", lambda threshold: _none_possible(real(threshold)))
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(plain(spark, rows)).collect()} == components_by_force(rows)[0]


def _no_bands():
    def there(batches):
        import pyarrow

        for batch in batches:
            yield batch.append_column("keys", pyarrow.array([[]] * len(batch), pyarrow.list_(pyarrow.int64())))

    return there


def _none_possible(run):
    """run on a worker with estimates that rule out every pair."""

    def there(batches):
        from tessera.llm import minhash as module

        was, module.possible = module.possible, lambda x, *_: np.zeros(len(x), bool)
        try:
            yield from run(batches)
        finally:
            module.possible = was

    return there


def test_three_shingles_that_share_no_band(spark):
    """Eight words and the first seven, chosen so that the fourth shingle spoils the one band that the others share."""
    r, found = random.Random(0), None
    while found is None:
        texts = [" ".join(f"w{r.randrange(10**9)}" for _ in range(8)) for _ in range(4096)]
        texts += [t.rsplit(" ", 1)[0] for t in texts]
        sets = [s for _, s in tokens_np.shingle_sets(pa.array(texts), minhash.SHINGLE)]
        low = [((s & np.uint64(minhash.FOLDED - 1)).astype(int) // (minhash.FOLDED // minhash.BANDS)) for s in sets[:4096]]
        for k in (k for k, b in enumerate(low) if len(set(b.tolist())) == 1):
            keys = minhash.band_keys(np.stack([minhash.sketch(sets[k]), minhash.sketch(sets[k + 4096])]))
            if not ((keys[0] == keys[1]) & (keys[0] != 0)).any():
                found = [texts[k], texts[k + 4096]]
    rows = [(i, t, "", "", 0) for i, t in enumerate(found)]
    assert components_by_force(rows)[0] == {0: 0, 1: 0}
    assert [r.component_id for r in minhash.near_duplicates(plain(spark, rows)).collect()] == [0, 0]


@pytest.mark.parametrize("seed", range(4))
def test_first_shingles_and_disproof_lose_no_link(seed):
    """Linked sets share a first shingle whose places allow their sizes, in any order, and no sketch disproves them."""
    r = np.random.default_rng(seed)
    universe = np.unique(r.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2))
    known = np.sort(r.permutation(universe)[: 100 * seed])
    often = np.stack([known, r.permutation(len(known)).astype(np.uint64) + np.uint64(1)])
    linked = 0
    for _ in range(1500):
        a = r.permutation(universe)[: r.integers(1, 120)]
        b = np.concatenate([a[r.random(len(a)) < r.choice([0.8, 0.9, 1])], r.permutation(universe)[: r.integers(0, 2 + len(a) // 8)]])
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if not len(b) or 100 * common < 75 * (len(a) + len(b) - common):
            continue
        linked += 1
        x, y = minhash.first_shingles(a, often, 75), minhash.first_shingles(b, often, 75)
        meets = [(i, y.tolist().index(h)) for i, h in enumerate(x.tolist()) if h in y]
        assert any(len(b) <= minhash.largest_partner(len(a), i, 75) and len(a) <= minhash.largest_partner(len(b), j, 75) for i, j in meets)
        assert not minhash.disproved(minhash.sketch(a)[None], minhash.sketch(b)[None], np.array([len(a)]), np.array([len(b)]), 75)[0]
    assert linked > 100


def test_forest_ties_all_that_possible_pairs_connect():
    r = np.random.default_rng(5)
    base = [np.unique(r.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(6)]
    sets = []
    for i in range(90):
        b = base[i % 6]
        sets.append(np.sort(np.concatenate([b[r.random(len(b)) > r.choice([0.05, 0.15, 0.3])], r.integers(0, 2**63, 20).astype(np.uint64)])))
    regs, n = np.stack([minhash.sketch(s) for s in sets]), np.array([len(s) for s in sets])
    for starts in ([0], [0, 50], [0, 1, 4, 30, 31, 60], list(range(90))):
        trees, names = minhash.Trees(), [bytes([i]) for i in range(90)]
        out = minhash.forest(names, np.array(starts), regs, n, 75, trees)
        want, got = minhash.Trees(), minhash.Trees()
        for a, b in zip(starts, [*starts[1:], 90], strict=True):
            for i in range(a, b):
                for j in range(i + 1, b):
                    if minhash.possible(regs[i][None], regs[j][None], n[i][None], n[j][None], 75)[0]:
                        want.join(names[i], names[j])
        for a, b in out:
            assert got.join(a, b), "a forest has no circle"
        assert {(a, b) for a in names for b in names if got.find(a) == got.find(b)} == {(a, b) for a in names for b in names if want.find(a) == want.find(b)}


@pytest.mark.parametrize("seed", range(6))
def test_components_of_sets(seed):
    r = np.random.default_rng(seed)
    m = int(r.integers(2, 40))
    sets = [np.flatnonzero(r.random(30) < 0.8).astype(np.uint64) if r.random() < 0.8 else r.permutation(30)[:3].astype(np.uint64) for _ in range(m)]
    sets = [np.sort(s) if len(s) else np.array([1], np.uint64) for s in sets]
    label, side = r.integers(0, m, m), r.integers(0, 3, m) if seed % 2 else np.full(m, minhash.WHOLE)
    trees = minhash.Trees()
    for i in range(m):
        for j in range(i + 1, m):
            common = len(np.intersect1d(sets[i], sets[j]))
            if label[i] == label[j] or (100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common) and (side[i] != side[j] or side[i] == minhash.WHOLE)):
                trees.join(("l", int(label[i])), ("l", int(label[j])))
    got = minhash.components_of_sets(sets, label, side, 75)
    for i in range(m):
        for j in range(m):
            assert (got[i] == got[j]) == (trees.find(("l", int(label[i]))) == trees.find(("l", int(label[j]))))


def test_null_ids_do_not_multiply(spark):
    """Many rows without an id, of many texts and of one."""
    rows = [(None, t, "", "", 0) for _, t, *_ in dense_group(60)] + [(None, "one text of more than five words here", "", "", 0)] * 40 + [(3, "another one with the same number of words", "", "", 0)] * 5
    got = minhash.near_duplicates(plain(spark, rows)).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {None, 3}


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(plain(spark, [])).count() == 0
    text = "a b c d e f g"
    rows = [(None, text, "", "", 0), (4, text, "", "", 0), (4, text, "", "", 0), (6, None, "", "", 0), (None, "", "", "", 0)]
    got = sorted(((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(plain(spark, rows)).collect()))
    assert got == [(-1, -1, True), (-1, 4, False), (4, 4, True), (4, 4, True), (6, 6, True)]
    kept = minhash.keep_one(plain(spark, rows))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 4, 6]


def test_estimate_is_corrected_for_chance():
    r = np.random.default_rng(0)
    for n, m, common in [(400, 400, 320), (3000, 2500, 1000), (100, 90, 0), (20_000, 20_000, 0)]:
        out = []
        for _ in range(12):
            h = np.unique(r.integers(0, 2**63, n + m).astype(np.uint64) * np.uint64(2) + np.uint64(1))
            r.shuffle(h)
            x, y = np.sort(h[:n]), np.sort(h[n - common : n - common + m])
            out.append(minhash.estimate(minhash.sketch(x)[None], minhash.sketch(y)[None], np.array([n]), np.array([m]))[0][0])
        assert abs(np.mean(out) - common / (n + m - common)) < 0.02


def test_folded_registers_are_those_of_fewer_buckets():
    h = np.sort(np.unique(np.random.default_rng(1).integers(0, 2**63, 2000).astype(np.uint64) * np.uint64(2)))
    low = {}
    for x in h.tolist():
        low[x % minhash.FOLDED] = min(low.get(x % minhash.FOLDED, 2**64), x >> minhash.BITS)
    want = np.zeros(minhash.FOLDED, np.uint16)
    for k, v in low.items():
        want[k] = minhash.compress(np.array([v], np.uint64))[0]
    assert (minhash.fold(minhash.sketch(h)[None])[0] == want).all()


@pytest.mark.parametrize("hot", [False, True])
def test_components(spark, monkeypatch, hot):
    """Also with nodes counted as hot from three neighbours on."""
    if hot:
        monkeypatch.setattr(components, "HOT", 3)
        monkeypatch.setattr(components, "LOOKED_AT", 1)
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 201 + i) for i in range(50)] + [(7, 7)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in touched}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 3


def counts(text):
    w, text = WORD.findall(text or ""), text or ""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    base = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), base


def test_quality_rules(spark):
    rows = corpus(5)
    rows = [(i, t, lang, None if i % 11 == 0 else s, n) for i, t, lang, s, n in rows] + [(1000 + i, "%%% " * 30, "en", "junk", 0) for i in range(80)] + [(2000, "clean words " + " ".join(f"w{i}" for i in range(30)), "en", "junk", 0)]
    scored = quality_rules.apply_rules(plain(spark, rows))
    got = {r.doc_id: r for r in scored.collect()}
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(t), (i, t)
    assert not got[2000].base_failed and not got[2000].kept  # its host falls
    assert all(r.kept == (not r.base_failed) for r in got.values() if r.source != "junk")
    assert quality_rules.apply_rules(plain(spark, [])).count() == 0
    clash = table(spark, rows).withColumn("rules", F.lit("own")).withColumn("kept", F.lit("own")).withColumn("w", F.lit(1)).withColumn("host_kept", F.lit(2))
    out = quality_rules.keep_rows(clash)
    assert out.columns == clash.columns
    assert {r.doc_id for r in out.collect()} == {i for i, r in got.items() if r.kept} and {(r.rules, r.kept, r.n_words) for r in out.collect()} == {("own", "own", -1)}
    assert {(r.doc_id, r.kept, r.n_words) for r in quality_rules.apply_rules(clash).collect()} == {(r.doc_id, r.kept, r.n_words) for r in got.values()}


# 4


def test_sharding(spark):
    rows = [(i, t, lang, s, n) for i, t, lang, s, n in corpus(6)] + [(500 + i, "hot text", "", "", 0) for i in range(90)] + [(None, None, "", "", 0)] * 2
    got = sharding.shard_documents(table(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes[s] for s in range(16)) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    text = {i: t for i, t, *_ in rows}
    assert all((r["size"], r.text_crc32) == (len((text[r.doc_id] or "").encode()) + 1, zlib.crc32((text[r.doc_id] or "").encode())) for r in got)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert sharding.shard_documents(plain(spark, [])).count() == 0
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(table(spark, rows).repartition(7)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_every_row_lies_where_a_sequential_ring_puts_it(spark):
    """Row by row: each goes to the shard of the next point while there is room; what is left over walks on clockwise, arc after arc."""
    import bisect

    rows = [(i, t, lang, s, n) for i, t, lang, s, n in corpus(6, 200)] + [(500 + i, "hot text", "", "", 0) for i in range(150)] + [(None, None, "", "", 0)] * 2
    df = plain(spark, rows)
    body = F.coalesce("text", F.lit(""))
    keyed = df.select("doc_id", F.xxhash64(F.xxhash64(body)).alias("key"), F.xxhash64("doc_id").alias("h"), F.pmod(F.xxhash64("doc_id", F.lit("slice")), F.lit(16)).alias("slice")).collect()
    points = sharding.ring(16, 64)
    ends = [p for p, _ in points]
    limits = [len(rows) // 16 + (s < len(rows) % 16) for s in range(16)]
    arcs = defaultdict(list)
    for r in keyed:
        arcs[bisect.bisect_left(ends, r.key) % len(ends)].append(((r.slice, r.h), r.doc_id))
    filled, where, waiting = [0] * 16, Counter(), []

    def put(doc, shard):
        where[doc, shard, filled[shard]] += 1
        filled[shard] += 1

    for arc in range(len(points)):
        for _, doc in sorted(arcs[arc], key=lambda x: x[0]):
            shard = points[arc][1]
            if filled[shard] < limits[shard]:
                put(doc, shard)
            else:
                waiting.append((arc, doc))
    for arc, doc in waiting:
        step = next(k for k in range(1, len(points)) if filled[points[(arc + k) % len(points)][1]] < limits[points[(arc + k) % len(points)][1]])
        put(doc, points[(arc + step) % len(points)][1])
    assert Counter((r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(df).collect()) == where


def test_movement_at_the_registered_load(spark):
    """Of 4,000 different texts, what a seventeenth shard moves: its own share, and what the exact bounds push on."""
    df = plain(spark, [(i, f"text {i}", "", "", 0) for i in range(4000)])
    a, b = ({r.doc_id: r.shard for r in sharding.shard_documents(df, shards=n).collect()} for n in (16, 17))
    assert 1 / 17 <= sum(a[i] != b[i] for i in a) / 4000 < 0.2


def test_ring_walk_bounds_and_movement():
    r = random.Random(1)
    keys = [r.getrandbits(64) - 2**63 for _ in range(20_000)]

    def shard_of(shards, factor):
        points = sharding.ring(shards, 64)
        ends = [p for p, _ in points]
        import bisect

        arcs = defaultdict(list)
        for k in keys:
            arcs[bisect.bisect_left(ends, k) % len(ends)].append(k)
        limits = sharding.bounds(len(keys), shards, factor)
        where = {}
        for arc, lo, hi, s, _ in sharding.walk({a: len(v) for a, v in arcs.items()}, points, limits):
            where.update(dict.fromkeys(sorted(arcs[arc])[lo:hi], s))
        assert max(Counter(where.values()).values()) <= max(limits) and len(where) == len(set(keys))
        return where

    a, b = shard_of(16, 1.25), shard_of(17, 1.25)
    assert sum(a[k] != b[k] for k in keys) < 0.25 * len(keys)


# 6


@pytest.mark.parametrize("scale", [1.0, 40.0, 5e5])
def test_topk(spark, scale):
    r = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in r.normal(0, scale, 8)]) for i in range(230)]
    rows += [(300 + i, rows[100][1]) for i in range(6)] + [(400, None), (450, [1.0, None]), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (600, []), (650, [2.0 * scale]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("q", F.lit("own")).withColumn("score", F.lit(0))
    got = topk.search(topk.build_index(df), topk.quantised(df.where("vec_id % 50 = 0"))).collect()
    ok = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in ok:
        if q % 50 == 0:
            every = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=False)), i) for i, v in ok.items() if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(every)]
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == sorted(want)


def test_topk_stops_on_proof():
    r = np.random.default_rng(0)
    x = r.integers(-80, 80, (3000, 32))
    parts = list(topk.segments(x))
    assert [p[0] for p in parts] == sorted((p[0] for p in parts), reverse=True)
    found = topk.search_block(np.arange(40), x[:40], np.arange(3000), x, topk.dense_levels(3000, parts), np.full(40, -np.inf), 5)
    for i, (at, score) in enumerate(found):
        best = sorted((-int(x[j] @ x[i]), j) for j in range(3000) if j != i)[:5]
        assert [(int(-score[k]), int(at[k])) for k in np.lexsort((at, -score))[:5]] == best
    assert np.mean([len(at) for at, _ in found]) < 400  # most members are proven out before the last segment


def test_topk_blocks_and_repeats(spark, monkeypatch):
    """Several blocks of queries and of the index in a task, few of them remembered; rows with one vec_id, of which one asks and all can be found."""
    monkeypatch.setattr(topk, "QUERY_BYTES", 200)
    monkeypatch.setattr(topk, "HELD", 2)
    monkeypatch.setattr(topk, "BLOCK", 7)
    r = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in r.normal(0, 1, 5)]) for i in range(300)] + [(50, [9.0] * 5), (51, [9.0] * 5), (51, [9.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(2)
    got = topk.search(topk.build_index(df), topk.quantised(df.where("vec_id % 10 = 0"))).collect()
    ints = [(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows]
    for q in range(0, 300, 10):
        asked = min(v for i, v in ints if i == q)
        want = sorted((-sum(a * b for a, b in zip(asked, v, strict=True)), i) for i, v in ints if i != q)[:5]
        assert [(-x.score, x.vec_id) for x in sorted(got, key=lambda x: x["rank"]) if x.query_id == q] == want


def test_topk_memory_of_large_numbers():
    """What a task keeps of each query is k rows, whatever the blocks' number and the scores' size."""
    best = topk.Best(np.array([1, 2]), 3)
    r = np.random.default_rng(0)
    every = []
    for _ in range(20):
        names, scores = r.integers(0, 50, 9), r.integers(-(2**62), 2**62, 9)
        best.add(1, names, scores)
        every += [(-int(s), int(n)) for n, s in zip(names, scores, strict=True)]
    assert [(-int(s), int(n)) for n, s in zip(best.ids[1], best.scores[1], strict=True)] == sorted(every)[:3]
    assert not best.full[0].any() and best.rows().num_rows == 3


def test_topk_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(topk.build_index(df), topk.quantised(df)).count() == 0


# 7


def least_padding(lengths, k):
    lengths = sorted(lengths)
    values = sorted(set(lengths))
    from functools import cache

    @cache
    def best(i, left):
        if i == len(values):
            return 0
        if not left:
            return float("inf")
        return min(sum(values[j] - x for x in lengths if values[i] <= x <= values[j]) + best(j + 1, left - 1) for j in range(i, len(values)))

    return best(0, k)


def test_packing(spark):
    rows = [(i, t, a, b, c) for i, t, a, b, c in corpus(7, 40)] + [(None, None, "", "", 0)] * 2
    got = packing.pack(table(spark, rows), buckets=4, budget=300).collect()
    want = sorted(len(WORD.findall(t or "")) + 1 for _, t, *_ in rows)
    assert sorted(r.n_tokens for r in got) == want
    assert sum(r.padding for r in got) == least_padding(want, 4)
    batches = defaultdict(list)
    for r in got:
        batches[r.bucket, r.batch].append(r)
        assert r.padding == r.bucket_bound - r.n_tokens >= 0
    for own in batches.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) == 1 or len(own) * own[0].bucket_bound <= 300
    for b in {r.bucket for r in got}:
        assert sorted({r.batch for r in got if r.bucket == b}) == list(range(len({r.batch for r in got if r.bucket == b})))
    assert packing.pack(plain(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_bounds_are_optimal(seed):
    r = random.Random(seed)
    lengths = [r.choice([1, 2, 3, 5, 9, 17, 40, 41, 90]) for _ in range(60)]
    c = Counter(lengths)
    v = sorted(c)
    for k in (1, 2, 3, 12):
        bounds = packing.best_bounds(np.array(v), np.array([c[x] for x in v]), np.array([x * c[x] for x in v]), k)
        assert sum(min(b for b in bounds if b >= x) - x for x in lengths) == least_padding(lengths, k)


@pytest.mark.parametrize("seed", range(3))
def test_bounds_are_optimal_above_1024(spark, seed):
    """Long lengths count one by one: no cells merge them before the bounds are chosen."""
    r = random.Random(seed)
    lengths = [r.randrange(2040, 2200) for _ in range(40)] + [r.randrange(16_000, 16_040) for _ in range(20)] + [70_000, 70_001]
    bounds = packing.length_bounds(spark.createDataFrame([(x,) for x in lengths], "n_tokens long"), buckets=5)
    assert len(bounds) == 5 and sum(min(b for b in bounds if b >= x) - x for x in lengths) == least_padding(lengths, 5)


def test_packing_carries_columns(spark):
    rows = [(i, t, a, b, c) for i, t, a, b, c in corpus(7, 20)] + [(3, "again", "", "", 0)] * 3 + [(None, None, None, None, None)] * 2
    docs = plain(spark, rows).withColumn("slot", F.lit("own")).withColumn("Rank", F.lit(9)).withColumn("_slot", F.lit("also"))
    got = packing.pack(docs, carry=True)
    assert got.columns == [*packing.COLUMNS, "text", "lang", "source", "n_chars", "_slot", "_Rank", "__slot"]
    assert Counter((r.doc_id, r.text, r._slot, r._Rank) for r in got.collect()) == Counter((i, t, "own", 9) for i, t, *_ in rows)
    assert packing.pack(docs.limit(0), carry=True).count() == 0


def test_token_batches(spark):
    r = random.Random(2)
    rows = [(i, [r.randrange(10, 99) for _ in range(r.choice([0, 3, 7, 30, 31, 500]))]) for i in range(80)] + [(90, None), (None, [5, 6]), (None, None), (7, [11]), (7, [11]), (95, [20] * 3000)]
    got = packing.token_batches(spark.createDataFrame(rows, "doc_id long, ids array<int>"), buckets=3, budget=200).collect()
    back = Counter()
    for b in got:
        assert len(b.tokens) == 1 or len(b.tokens) * b.width <= 200
        for i, n, t in zip(b.doc_ids, b.lengths, b.tokens, strict=True):
            assert len(t) == b.width and t[n - 1] == 2 and not any(t[n:])
            back[i, tuple(t[: n - 1])] += 1
    assert back == Counter((i, tuple(t or ())) for i, t in rows)
    want = [len(t or ()) + 1 for _, t in rows]
    assert sum(b.width * len(b.lengths) - sum(b.lengths) for b in got) == least_padding(want, 3)
    assert packing.token_batches(spark.createDataFrame([], "doc_id long, ids array<int>")).count() == 0


# 8 and 9


def labelled(spark, kind):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(200)]
    docs, labels = [], []
    for i in range(600):
        w = [r.choice(vocabulary) for _ in range(r.randint(15, 120))]
        y = int(r.random() < 0.4)
        if kind == "toxic" and y:
            for bad in r.sample(["zzidiot", "zzscum", "zztrash"], 2):
                w.insert(r.randrange(len(w)), bad)
        text = " ".join(w)
        if kind == "quality" and not y:
            text = text.upper().replace(" ", "!! ") if i % 2 else " ".join(x + "***" for x in w)
        docs.append((i, text, "en", "s", len(text)))
        if i % 7:
            labels.append((i, y if kind == "quality" else 1, y if kind == "toxic" else 0))
    docs += [(900, "", "en", "s", 0), (901, None, "en", "s", 0), (None, "word", "en", "s", 0), (5, "w " * 40_000, "en", "s", 0)]
    labels += [(3, None, None), (3, 1, 0), (None, 1, 1)]
    return plain(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), len(docs)


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_classifiers_learn(spark, kind):
    docs, labels, n = labelled(spark, kind)
    got = (toxicity.score_toxicity if kind == "toxic" else cnn.score_quality)(docs, labels).toPandas()
    assert len(got) == n and got.score.between(0, 1).all()
    mod, rest, limit = (4, 2, 0.3) if kind == "toxic" else (3, 1, 0.5)
    own = got[got.doc_id.notna()]
    assert (own.held_out == [zlib.crc32(str(int(i)).encode()) % mod == rest for i in own.doc_id]).all()
    assert (got.predicted == (got.score >= limit)).all()
    y = {i: v for i, q, t in ((r.doc_id, r.quality, r.toxic) for r in labels.collect() if r.doc_id is not None) if (v := q if kind == "quality" else t) is not None}
    held = own[own.held_out & own.doc_id.isin(list(y)) & (own.doc_id > 6)]
    assert len(held) > 80 and (held.predicted == held.doc_id.map(y)).mean() > 0.9


@pytest.mark.parametrize("run", [toxicity.score_toxicity, cnn.score_quality])
def test_classifiers_without_labels(spark, run):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = plain(spark, corpus(1, 3))
    assert {round(r.score, 6) for r in run(docs, none).collect()} == {0.5}
    assert run(plain(spark, []), none).count() == 0


def test_cnn_scores_do_not_depend_on_batches():
    model = cnn.Model()
    texts = [t for _, t, *_ in corpus(8)]
    one = np.concatenate([model.scores(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(model.scores(pa.array(texts, pa.string())), one, atol=1e-5)


def test_cnn_against_a_plain_convolution():
    """Every filter at every byte of every chunk, summed and maximised one by one; the head by its definition."""
    model = cnn.Model(seed=3)
    p = model.p
    r = random.Random(0)
    texts = ["", "a", "abcdef" * 20, "".join(chr(r.randint(97, 122)) for _ in range(700)), "é" * 300, "x" * 512, "y" * 506, "".join(chr(r.randint(32, 126)) for _ in range(1290))]
    want = []
    for t in texts:
        data = t.encode()
        halves = max(2, -(-(len(data) + cnn.WIDTH) // cnn.HALF))
        padded = np.frombuffer(data.ljust(halves * cnn.HALF + cnn.WIDTH, b"\0"), np.uint8)
        chunks = []
        for c in range(halves - 1):
            at = c * cnn.HALF
            best = [max(sum(p["filters"][k, padded[i + k], f] for k in range(cnn.WIDTH)) for i in range(at, at + 2 * cnn.HALF)) for f in range(2)]
            chunks.append(best)
        want.append(chunks)
    tables = cnn.pair_tables(p["filters"])
    laid, first = cnn.layout(np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]))
    maxima = cnn.half_maxima(laid, first, tables)
    for i, chunks in enumerate(want):
        got = [np.maximum(maxima[h], maxima[h + 1])[:2] for h in range(first[i], first[i + 1] - 1)]
        assert np.allclose(got, chunks, atol=1e-4), texts[i][:20]
        pooled = np.stack([np.maximum(maxima[h], maxima[h + 1]) for h in range(first[i], first[i + 1] - 1)]).astype(float)
        a = np.maximum(np.maximum(pooled + p["bias"], 0) @ p["dense"] + p["dense_bias"], 0)
        logit = float(np.concatenate([a.mean(0), a.max(0)]) @ p["out"] + p["out_bias"][0])
        assert abs(model.scores(pa.array([texts[i]]))[0] - 1 / (1 + np.exp(-logit))) < 1e-5


def test_machine_adds_all_pairs():
    """Before the logistic: bias, weights of the distinct known terms, and the inner products of all pairs."""
    r = np.random.default_rng(2)
    model = toxicity.Model(0.3)
    model.weights, model.vectors = r.normal(0, 1, 40), r.normal(0, 0.5, (40, toxicity.RANK))
    sets = [np.sort(r.choice(40, k, replace=False)) for k in (0, 1, 2, 5, 17)]
    got = model.raw(np.concatenate(sets).astype(np.int64), np.repeat(np.arange(5), [len(s) for s in sets]), 5)[0]
    for s, x in zip(sets, got, strict=True):
        pairs = sum(model.vectors[a] @ model.vectors[b] for i, a in enumerate(s) for b in s[i + 1 :])
        assert abs(x - (0.3 + model.weights[s].sum() + pairs)) < 1e-9


def test_machine_learns_what_only_pairs_tell():
    """Two words that are each as common with either label: only together, or both absent, they mean label 1, so weights alone can't tell."""
    r = random.Random(4)
    filler = ["".join(r.choice("bcdfg") for _ in range(4)) for _ in range(12)]
    texts, y = [], []
    for i in range(4000):
        insult, group = i % 2, i // 2 % 2
        w = [r.choice(filler) for _ in range(3)] + ["zzinsult"] * insult + ["zzgroup"] * group
        r.shuffle(w)
        texts.append(" ".join(w))
        y.append(float(insult == group))
    model = toxicity.Model().fit(pa.array(texts[:3000]), np.array(y[:3000]), 0.0)
    right = ((model.scores(pa.array(texts[3000:])) >= 0.5) == np.array(y[3000:])).mean()
    model.vectors = model.vectors * 0
    linear = ((model.scores(pa.array(texts[3000:])) >= 0.5) == np.array(y[3000:])).mean()
    assert right > 0.95 and linear < 0.8, (right, linear)


@pytest.mark.parametrize("run", [toxicity.score_toxicity, cnn.score_quality])
def test_classifiers_with_clashing_columns(spark, run):
    docs, labels, _ = labelled(spark, "toxic")
    clash = docs.withColumn("score", F.lit("own")).withColumn("y", F.lit(5)).withColumn("held_out", F.lit("x")).withColumn("predicted", F.lit(None).cast("string"))
    more = labels.withColumn("text", F.lit("own")).withColumn("y", F.lit("z")).withColumn("count", F.lit(1))
    a, b = run(docs, labels), run(clash, more)
    assert a.columns == b.columns == ["doc_id", "held_out", "score", "predicted"]
    assert Counter(tuple(r) for r in a.collect()) == Counter(tuple(r) for r in b.collect())


def test_cnn_fits_on_every_chunk(monkeypatch):
    """All chunks of a long text reach the gradients, each as scoring sees it."""
    seen = defaultdict(set)
    monkeypatch.setattr(cnn, "EPOCHS", 1)

    def gradients(self, chunks, text, y):
        for c, t in zip(chunks, text, strict=True):
            seen[y[t]].add(c.tobytes())
        return {k: np.zeros_like(v) for k, v in self.p.items()}

    monkeypatch.setattr(cnn.Model, "_gradients", gradients)
    long, short = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(9_000)), "short"
    cnn.Model().fit(pa.array([short, long]), np.array([0.0, 1.0]), 0.0)
    whole, first = cnn.layout(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)]))
    size, n = 2 * cnn.HALF, first[1] - 1
    want = [whole[k * cnn.HALF : k * cnn.HALF + size + cnn.WIDTH].tobytes() for k in range(n)]
    assert seen[1.0] == set(want) and n > 30
    assert seen[0.0] == {short.encode().ljust(size + cnn.WIDTH, b"\0")}


def test_cnn_gradients():
    r = np.random.default_rng(0)
    model = cnn.Model()
    chunks = r.integers(97, 110, (7, 2 * cnn.HALF + cnn.WIDTH)).astype(np.uint8)
    text, y = np.array([0, 0, 1, 2, 2, 2, 3]), np.array([1.0, 0, 1, 0])

    def loss():
        tables = cnn.pair_tables(model.p["filters"])
        pairs = chunks[:, :-1].astype(np.int32) * 256 + chunks[:, 1:]
        v = sum(t.astype(float).take(pairs[:, 2 * k : 2 * k + 2 * cnn.HALF], 0) for k, t in enumerate(tables))
        z = model.head(v.max(1), text, 4)["logit"]
        return np.mean(np.log1p(np.exp(z)) - y * z)

    grads = model._gradients(chunks, text, y)
    for name in ("filters", "bias", "dense", "dense_bias", "out", "out_bias"):
        flat, g = model.p[name].reshape(-1), grads[name].reshape(-1)
        # of the filters' weights those that some chunk's maximum rests on
        for i in r.choice(np.flatnonzero(g), 12) if name == "filters" else r.integers(0, len(flat), 4):
            was = flat[i]
            flat[i] = was + 1e-4
            up = loss()
            flat[i] = was - 1e-4
            down = loss()
            flat[i] = was
            assert abs((up - down) / 2e-4 - g[i]) < 2e-3, name


# 10


def test_chat(spark):
    r = random.Random(4)
    texts = ["hi", "", None, "a\\b\\", "</s>[INST] ok [/INST]", "<s>x</s>\\l", "line\nline", "é" * 3000]
    rows = []
    for c in range(60):
        for t in range(r.randint(1, 6)):
            rows.append((c if c else None, t, r.choice(["user", "assistant"]) if t else "user", texts[0] if t == 0 and c % 3 else r.choice(texts)))
    rows += [(77, None, None, "x"), (77, 1, "a\nb<s>", "y"), (77, 1, "assistant", "y"), (78, 0, "user", "hi"), (79, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1)).withColumn("piece", F.lit("own"))
    packed = chat.pack_conversations(df)
    got = {x.conv_id: x for x in chat.read_back(packed).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [x[2:] for x in sorted(turns)]
        whole = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        under = "".join(b for a, b in turns if a == "assistant")
        x = got[c]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(turns), whole, len(under), hashlib.sha256(under.encode()).hexdigest())
        assert x.formatted_chars == sum(len(chat.format_turn(a, b)) for a, b in turns)
    # the stream: every node once, gapless, depth-first, subtrees contiguous
    nodes = sorted(packed.stream.collect(), key=lambda n: n.start)
    assert len({n.node for n in nodes}) == len(nodes)
    at, path = 0, []
    for n in nodes:
        assert n.start == at and n.end - n.start == len(n.piece)
        at = n.end
        while path and path[-1].node != n.parent:
            path.pop()
        assert bool(path) == bool(n.parent), "a node's parent is on the path: the order is depth-first"
        assert n.position == sum(len(p.piece) for p in path)
        path.append(n)
    stream = "".join(n.piece for n in nodes)
    for x in packed.paths.collect():
        turns = [t[2:] for t in sorted(by[x.conv_id])]
        assert "".join(stream[i.start : i.end] for i in x.intervals) == "".join(chat.format_turn(a, b) for a, b in turns)
    empty = chat.pack_conversations(df.limit(0))
    assert empty.stream.count() == 0 and chat.read_back(empty).count() == 0


def test_chat_long_conversation_with_many_sharers(spark):
    """One conversation of 2,000 turns whose first turn 1,999 others share: read-back candidates are the path's nodes, no more."""
    rows = [(0, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if t else "hi") for t in range(2000)] + [(c, 0, "user", "hi") for c in range(1, 2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packed = chat.pack_conversations(df)
    assert packed.stream.count() == 2000
    assert chat.path_nodes(packed).count() == 3999
    pairs = chat.path_nodes(packed).join(packed.stream, ["chain", "depth"])
    assert pairs.count() == 3999
    got = {x.conv_id: x for x in chat.read_back(packed).collect()}
    assert len(got) == 2000 and got[0].n_turns == 2000 and got[5].n_turns == 1
    assert got[0].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, _, a, b in rows[:2000]).encode()).hexdigest()


def test_chat_in_tokens(spark):
    """With a model, places count tokens: every conversation's intervals cut its own token ids from the stream, and loss intervals the assistants' texts."""

    class Letters:
        def encode(self, text):
            return [ord(c) for part in text.split(" ") for c in [*part, " "]][:-1] if text else []

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "same" if t < 2 else f"own {c}") for c in range(8) for t in range(2 + c % 3)]
    packed = chat.pack_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), Letters())
    nodes = sorted(packed.stream.collect(), key=lambda n: n.start)
    stream = [i for n in nodes for i in n.ids]
    assert all(n.end - n.start == len(n.ids) and stream[n.start : n.end] == n.ids for n in nodes)
    assert sum(len(n.ids) for n in nodes) < sum(len(chat.format_turn(r, t)) for _, _, r, t in rows)
    for n in nodes:
        if n.loss_start is not None:
            assert "".join(map(chr, stream[n.loss_start : n.loss_end])) == chat.parse_turn(n.piece)[1]
    for x in packed.paths.collect():
        whole = "".join(chr(v) for i in x.intervals for v in stream[i.start : i.end])
        assert whole == "".join(chat.format_turn(r, t) for c, _, r, t in rows if c == x.conv_id)


@pytest.mark.parametrize("text", ["", "\\", "\\l", "<s></s>", "[INST][/INST]", "\\\\<s>", "<<s>s>", "[[INST]", "a<b[c"])
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not re.search(r"</?s>|\[/?INST\]", chat.escape(text))
    assert chat.parse_turn(chat.format_turn("us\ner" + text, text)) == ("us\ner" + text, text)
