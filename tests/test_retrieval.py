import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunks, dense, fusion, lexical, metrics, security
from tessera.functions.text import STOPWORDS


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source string, text string")


def windows(text, size, overlap):
    out = [text[s : s + size] for s in range(0, len(text or ""), size - overlap)] if text else []
    return out[:-1] if len(out) > 1 and len(out[-1]) <= overlap else out


@pytest.mark.parametrize("size,overlap", [(10, 3), (5, 0), (7, 6)])
def test_chunks(spark, size, overlap):
    texts = ["", None, "a", "é" * 10, "0123456789" * 3, "x" * 17, "y" * 24, "😀" * 11]
    got = {}
    for r in chunks.chunk_documents(docs(spark, *texts), size, overlap).collect():
        got.setdefault(int(r.source), {})[r.i] = (r.chunk_id, r.text)
    for n, t in enumerate(texts):
        want = windows(t, size, overlap)
        assert got.get(n, {}) == {i: (f"{n}-{i}", w) for i, w in enumerate(want)}


@pytest.mark.parametrize("size,overlap", [(0, 0), (5, 5), (5, -1)])
def test_bad_windows(spark, size, overlap):
    with pytest.raises(ValueError):
        chunks.chunk_documents(docs(spark, "a"), size, overlap)


def test_validate(spark):
    d = docs(spark, "aaaa bbbb  cccc dddd", "zz")
    s = spark.createDataFrame([(1, "bbbb cccc"), (2, "aaaa bbbb cccc dddd"), (3, "nothing"), (4, "zz")], "span_id long, span string")
    got = {r.span_id: r.status for r in chunks.validate_contexts(s, d, chunks.chunk_documents(d, 16, 4)).collect()}
    assert got == {1: "OK", 2: "SPLIT", 3: "MISSING", 4: "OK"}


@pytest.mark.parametrize("sent", [1000, 1])
def test_occurrences(spark, monkeypatch, sent):
    monkeypatch.setattr(chunks, "SENT_SPANS", sent)
    r = random.Random(8)
    bodies = [" ".join(r.choice("ab abc b ca the x".split()) for _ in range(r.randint(0, 14))) for _ in range(30)]
    wanted = ["", "ab", "b c", "the x", "ab b ca", "abc the x b", "nowhere ab x", "x"] + [b[3:15].strip() for b in bodies if len(b) > 18]
    found = chunks.occurrences(spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "source string, body string"), spark.createDataFrame(list(enumerate(wanted)), "span_id long, span string"))
    assert {(x.span_id, int(x.source)) for x in found.collect()} == {(n, i) for n, w in enumerate(wanted) for i, b in enumerate(bodies) if w in b}


def bm25(corpus, question, strip):
    split = lambda t: re.findall(r"[a-z0-9]+(?:[-.][a-z0-9]+)*", t.lower())
    words = [split(t) for t in corpus]
    average = sum(map(len, words)) / len(words)
    out = []
    for i, w in enumerate(words):
        s = 0.0
        for t in split(question):
            if strip and t in STOPWORDS:
                continue
            df = sum(t in x for x in words)
            if df:
                tf = w.count(t)
                s += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / average))
        out.append((-round(s, 9), i))
    return [(i, -s) for s, i in sorted(out) if s < 0]


@pytest.mark.parametrize("strip", [True, False])
def test_bm25(spark, strip):
    r = random.Random(1)
    corpus = [" ".join(r.choice("alpha beta gamma delta the of risk".split()) for _ in range(r.randint(0, 12))) for _ in range(25)] + ["", "alpha beta", "alpha beta"]
    asked = ["the alpha alpha of risk", "unknown words", "", "gamma delta"]
    corpus_df = (chunks.chunk_documents(docs(spark, *[t or None for t in corpus])).unionByName(spark.createDataFrame([("25", 0, "25-0", ""), *[(str(i), 0, f"{i}-0", "") for i, t in enumerate(corpus[:25]) if not t]], "source string, i int, chunk_id string, text string")))
    index = lexical.build(corpus_df)
    q = spark.createDataFrame(list(enumerate(asked)), "qid long, question string")
    cols = ["qid", "rank", "chunk_id", "score"]
    assert sorted(lexical.search_once(corpus_df, q, 5, strip).select(cols).collect()) == sorted(lexical.search(index, q, 5, strip).select(cols).collect())
    got = {}
    for x in lexical.search(index, q, 5, strip).collect():
        got.setdefault(x.qid, []).append((x["rank"], int(x.source), x.score))
    for n, question in enumerate(asked):
        want = [(k + 1, i, pytest.approx(s, abs=1e-8)) for k, (i, s) in enumerate(bm25(corpus, question, strip)[:5])]
        assert sorted(got.get(n, [])) == want


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_dense(spark, metric):
    r = random.Random(2)
    v = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    v += [(60, v[3][1]), (61, v[3][1])]
    vectors = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = dense.search(vectors, vectors.where("vec_id < 9").withColumnRenamed("vec_id", "qid"), 4, metric).collect()
    for q in range(9):
        a = v[q][1]
        far = lambda b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) if metric == "l2sq" else 1 - sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)  # noqa: B023, E731
        want = sorted((round(far(b), 9) + 0.0, i) for i, b in v)[:4]
        mine = sorted((x["rank"], x.vec_id) for x in got if x.qid == q)
        assert [i for _, i in mine] == [i for _, i in want]
    assert dense.search(vectors, vectors.withColumnRenamed("vec_id", "qid"), 0).count() == 0
    with pytest.raises(ValueError):
        dense.search(vectors, vectors, 1, "dot")


def test_fusion(spark):
    cols = "qid long, rank int, text string, source string, distance double"
    a = spark.createDataFrame([(1, 1, "x", "s1", 0.1), (1, 2, "y", "s2", 0.2), (1, 3, "x", "s9", 0.3)], cols)
    b = spark.createDataFrame([(1, 1, "z", "s3", None), (1, 2, "x", "s4", None)], cols)
    got = fusion.fuse([a, b], 5).orderBy("rank").collect()
    assert [(r.text, r.source, r.distance, list(r.ranks)) for r in got] == [("x", "s1", 0.1, [1, 3, 2]), ("z", "s3", None, [1]), ("y", "s2", 0.2, [2])]
    assert got[0].rrf_score == pytest.approx(1 / 61 + 1 / 63 + 1 / 62, abs=1e-9)


def test_insert(spark):
    got = spark.createDataFrame([(1, i, f"t{i}", "s") for i in range(1, 6)], "qid long, rank int, text string, source string")
    out = fusion.insert_at(got, spark.createDataFrame([(1, "bad", "POISON")], "qid long, text string, source string"), 2)
    assert [r.text for r in out.orderBy("rank").collect()] == ["t1", "bad", "t2", "t3", "t4"]


def covered(gold, texts, least=5):
    """Word by word: the longest run from each word that a text holds between boundaries."""
    w = gold.split()
    n, run, got = len(w), min(least, len(w)), set()

    def holds(lo, hi):
        phrase = " ".join(w[lo:hi])
        for hay in (" ".join(t.split()) for t in texts):
            at = hay.find(phrase)
            while at >= 0:
                end = at + len(phrase)
                if (lo == 0 or at == 0 or hay[at - 1] == " ") and (hi == n or end == len(hay) or hay[end] == " "):
                    return True
                at = hay.find(phrase, at + 1)
        return False

    for lo in range(n):
        for hi in range(lo + run, n + 1):
            if holds(lo, hi):
                got |= set(range(lo, hi))
    return round(len(got) / n, 6) if n else 0.0


@pytest.mark.parametrize("seed", range(3))
def test_coverage(spark, seed):
    r = random.Random(seed)
    words = ["a", "b", "ab", "the", "thes", "c"]
    golds = [" ".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(12)] + ["", "the end of it all now"]
    texts = {q: ["x" * r.randint(0, 2) + "  ".join(r.choice([g, " ".join(g.split()[: r.randint(0, 9)]), "s" + g, " ".join(r.choice(words) for _ in range(9))]) for _ in range(2)) for _ in range(3)] for q, g in enumerate(golds)}
    spans = spark.createDataFrame([(q, 0, g) for q, g in enumerate(golds)], "qid long, ctx_no int, ctx string")
    retrieved = spark.createDataFrame([(q, k + 1, t) for q, ts in texts.items() for k, t in enumerate(ts)], "qid long, rank int, text string")
    got = {x.qid: x.coverage for x in metrics.span_coverage(retrieved, spans).collect()}
    assert got == {q: covered(g, texts[q]) for q, g in enumerate(golds)}


def test_summary(spark):
    rows = [(1, "g", 1, 1.0, 1.0), (2, "g", None, 0.5, 0.0), (3, "h", 2, 0.995, 0.2), (4, "h", None, 0.0, 0.0), (5, "h", None, 1.0, 1.0)]
    s = spark.createDataFrame(rows, "qid long, grp string, rank int, coverage double, worst double")
    m = metrics.summary(s).first()
    assert (m.n, m.hit, m.mrr, m.covered, m.complete) == (5, 0.4, 0.3, 0.6, 0.4)
    assert {r.grp: r.n for r in metrics.by_group(s).collect()} == {"all": 5, "g": 2, "h": 3}
    assert {r["rank"]: r.n for r in metrics.rank_histogram(s).collect()} == {0: 3, 1: 1, 2: 1}
    assert {r.cause: r.n for r in metrics.miss_diagnosis(s).collect()} == {"partial": 1, "missed": 1, "chunking": 1}
    none = metrics.summary(s.limit(0)).first()
    assert (none.n, none.hit, none.mrr, none.coverage) == (0, 0.0, 0.0, 0.0)


def test_poison_and_calibration(spark):
    got = spark.createDataFrame([(1, 1, "s"), (1, 2, "POISON"), (2, 1, "s")], "qid long, rank int, source string")
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    assert tuple(security.poison_served(got, q).first()) == (3, 1, 2)
    d = spark.createDataFrame([(True, 0.2), (True, 0.4), (False, 0.6)], "on_topic boolean, distance double")
    assert tuple(security.calibration_gap(d).first()) == (0.4, 0.6, 0.2, 0.5)
    assert security.calibration_gap(d.withColumn("distance", F.lit(1.0))).first().threshold is None


def test_dense_without_usable_vectors(spark):
    """Null and ragged vectors, and components that are null or no number, on either side; blocks of a few rows."""
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (8, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = dense.search(v, v.withColumnRenamed("vec_id", "qid"), 3).collect()
    ok = {i: (x + [0.0] * 3)[:3] for i, x in rows if i in (0, 5, 6, 7, 8)}
    for q in ok:
        want = sorted((sum((a - b) ** 2 for a, b in zip(ok[q], x, strict=True)), i) for i, x in ok.items())[:3]
        assert [(x.distance, x.vec_id) for x in sorted((x for x in got if x.qid == q), key=lambda x: x["rank"])] == want
    assert {x.qid for x in got} == set(ok)
    assert dense.search(v.limit(0), v.withColumnRenamed("vec_id", "qid"), 3).count() == 0


def test_dense_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_BYTES", 400)
    monkeypatch.setattr(dense, "HELD", 2)
    r = random.Random(4)
    v = [(i, [round(r.gauss(0, 1), 1) for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").coalesce(2)
    got = {}
    for x in dense.search(df, df.withColumnRenamed("vec_id", "qid"), 4).collect():
        got.setdefault(x.qid, []).append((x["rank"], x.distance, x.vec_id))
    for q, a in v:
        want = sorted((round(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)), 9), i) for i, b in v)[:4]
        assert [i for _, _, i in sorted(got[q])] == [i for _, i in want]


def test_embedding_hook(spark):
    rows = spark.createDataFrame([(i, "x" * i if i else None) for i in range(5)], "id long, text string")
    got = {r.vec_id: list(r.embedding) for r in dense.embed(rows, "id", "text", lambda texts: [[len(t), 1] for t in texts], batch=2).collect()}
    assert got == {i: [float(i), 1.0] for i in range(5)}


def test_stored_index(spark, tmp_path):
    d = chunks.chunk_documents(docs(spark, "alpha beta beta", "beta gamma", "", "delta alpha"))
    lexical.store(d, str(tmp_path / "ix"))
    q = spark.createDataFrame([(0, "alpha beta"), (1, "nothing")], "qid long, question string")
    cols = ["qid", "rank", "chunk_id", "score"]
    want = sorted(lexical.search(lexical.build(d), q, 5).select(cols).collect())
    assert want and sorted(lexical.search(lexical.load(spark, str(tmp_path / "ix"), q), q, 5).select(cols).collect()) == want
    assert sorted(lexical.search(lexical.load(spark, str(tmp_path / "ix")), q, 5).select(cols).collect()) == want


def test_search_function_feeds_the_metrics(spark):
    from tessera.operators import reports

    asked = spark.createDataFrame([(1, "g"), (2, "g")], "qid long, grp string")
    gold = spark.createDataFrame([(1, 0, "two words"), (2, 0, "never there")], "qid long, ctx_no int, ctx string")
    found = lambda q, k: spark.createDataFrame([(1, 1, "none"), (1, 2, "has two  words in it")], "qid long, rank int, text string").where(F.col("rank") <= k)
    got = {r.qid: (r["rank"], r.coverage) for r in reports.evaluate_retrieval(asked, gold, found).collect()}
    assert got == {1: (2, 1.0), 2: (None, 0.0)}


def test_counts_are_observed(spark):
    from pyspark.sql import Observation

    from tessera.operators import reports

    watch = Observation("flow")
    rows = spark.range(10).observe(watch, F.count("*").alias("rows"))
    assert reports.observe_counts(rows, "named", even=F.col("id") % 2 == 0).count() == 10 and watch.get["rows"] == 10


@pytest.mark.parametrize("changed", [{}, {"BLOCK": 7}, {"ASKED": 3, "PAIRS": 5}, {"SENT_WEIGHTS": 3}, {"SENT_TERMS": 2}])
def test_search_in_blocks(spark, monkeypatch, tmp_path, changed):
    """Blocks of any size, few questions or sums at once, and the join for many weights find the same; nearly all texts tie, and no more than k rows a question leave a task."""
    for name, value in changed.items():
        monkeypatch.setattr(lexical, name, value)
    r = random.Random(5)
    corpus = [" ".join(r.choice("alpha beta gamma of İstanbul x-y 3.5".split()) for _ in range(r.randint(0, 9))) for _ in range(40)] + ["alpha beta"] * 40
    asked = ["alpha beta", "gamma of alpha alpha", "istanbul", "3.5 x-y", "none such", "beta", "İSTANBUL beta"]
    d, q = docs(spark, *corpus), spark.createDataFrame(list(enumerate(asked)), "qid long, question string")
    cols = ["qid", "rank", "source", "score"]
    lexical.store(lexical.Windows(d), str(tmp_path / "ix"))
    built = lexical.build(lexical.Windows(d), lexical.asked_terms(q, False))
    full = [t for t in corpus if t]
    want = {n: [(i, s) for i, s in bm25([t.replace("İ", "i") for t in full], w.replace("İ", "i"), False)[:5]] for n, w in enumerate(asked)}
    at = [n for n, t in enumerate(corpus) if t]
    for index in (built, lexical.load(spark, str(tmp_path / "ix"), q), lexical.load(spark, str(tmp_path / "ix"))):
        got = {}
        for x in sorted(lexical.search(index, q, 5, False).select(cols).collect()):
            got.setdefault(x.qid, []).append((int(x.source), pytest.approx(x.score, abs=1e-8)))
        assert got == {n: [(at[i], s) for i, s in w] for n, w in want.items() if w}
    plan = lexical.search(built, q, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert ("MapInArrow" in plan) == ("SENT_WEIGHTS" not in changed)
    parts = built.table.rdd.getNumPartitions()
    if "SENT_WEIGHTS" not in changed:
        weights = lexical.weighed(built, q, False).collect()
        found = built.table.mapInArrow(lexical._winners(lexical._sent(weights, {n: n for n in range(len(asked))}), 3.0, 5, False), "q int, score double, source string, i int, chunk_id string")
        assert 0 < found.count() <= parts * 5 * len(asked)


def test_windows_are_the_chunks(spark):
    r = random.Random(6)
    d = docs(spark, *["".join(r.choice("ab é😀\n.") for _ in range(n)) for n in (0, 1, 3, 4, 5, 11, 12, 13, 14, 15, 40, 97)], None)
    for size, overlap in [(16, 4), (5, 4), (3, 0), (800, 160)]:
        index = lexical.build(lexical.Windows(d, size, overlap))
        want = chunks.chunk_documents(d, size, overlap)
        rows = index.table.selectExpr("inline(arrays_zip(source, i, chunk_id))")
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.select("source", "i", "chunk_id").collect()))
        assert sorted(map(tuple, lexical.postings(lexical.Windows(d, size, overlap)).collect())) == sorted(map(tuple, lexical.postings(want).collect())) == sorted(map(tuple, index.postings.select("chunk_id", "term", "tf").collect()))


@pytest.mark.parametrize("searched", [1, 60, 1 << 20])
def test_long_spans_in_many_texts(spark, monkeypatch, searched):
    """Spans of more and less than 16 bytes at edges of texts, with equal middles, in several texts and twice in one; white space of any kind; all spans are searched in one pass, without a join of texts and spans."""
    monkeypatch.setattr(chunks, "SEARCHED", searched)
    r = random.Random(9)
    bodies = ["".join(r.choice("abé😀 ") for _ in range(r.randint(0, 80))) for _ in range(40)]
    bodies += ["x" * 40, "y" * 16, "\u3000lead and\ttrail of it\n", "one two three four five", "one two three four five one two three four five", "NE two three four fivE", None]
    plain = [None if b is None else " ".join(b.split()) for b in bodies]
    wanted = [p[a : a + n].strip() for p in plain if p for a, n in ((0, 20), (len(p) - 18, 18), (3, 16), (2, 15)) if a >= 0] + ["x" * 16, "x" * 41, "lead and trail of it", "one two three four five", "NE two three four fivE", "", "no such text in any of these", None]
    given = spark.createDataFrame(list(enumerate(bodies)), "source string, body string"), spark.createDataFrame(list(enumerate(wanted)), "span_id long, span string")
    found = chunks.occurrences(*given)
    assert {(x.span_id, int(x.source)) for x in found.collect()} == {(n, i) for n, w in enumerate(wanted) if w is not None for i, b in enumerate(plain) if b is not None and w in b}
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
@pytest.mark.parametrize("groups", [1, 3, 128])
def test_nearest_without_sorting(monkeypatch, metric, groups):
    """With groups of any number, with what is held already, with many ties and zero vectors: the best are those of brute force, and few rows beside them are measured again."""
    import numpy as np

    monkeypatch.setattr(dense, "GROUPS", groups)
    r = np.random.default_rng(3)
    for n, k, high in [(900, 5, 1000), (40, 7, 2), (3, 5, 3), (300, 1, 2)]:
        q, x, ids = r.integers(-high, high, (20, 6)).astype(float), r.integers(-high, high, (n, 6)).astype(float), r.permutation(n)
        both = np.sqrt((x**2).sum(1))[None] * np.sqrt((q**2).sum(1))[:, None]
        d = ((q[:, None] - x[None]) ** 2).sum(2) if metric == "l2sq" else np.round(1 - (q @ x.T) / np.maximum(both, 1e-300), 9)
        held = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.full(20, np.inf)
        for half in (slice(0, n // 3), slice(n // 3, n)):
            found = dense.nearest(q, x[half], ids[half], k, metric, held[3])
            assert high < 1000 or groups < 128 or len(found[0]) < 20 * 12
            held = dense._merged(held, found, k)
        for i in range(20):
            want = sorted(zip(d[i].tolist(), ids.tolist(), strict=True))[:k]
            got = list(zip(held[1][held[0] == i].tolist(), held[2][held[0] == i].tolist(), strict=True))
            assert [n for _, n in got] == [n for _, n in want] and got == [(pytest.approx(a, abs=1e-9), n) for a, n in want]
