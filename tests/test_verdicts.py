import json
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.functions import text as T
from tessera.functions import verdicts as V
from tessera.operators import exercises, gates, security, splits, trace
from tessera.operators import verdicts as O

B = "boolean"


def test_first_object():
    assert V.first_object('x {"a": "} \\" {"} y') == '{"a": "} \\" {"}'
    assert V.first_object("{ open {\"a\": {}}") == '{"a": {}}'
    assert V.first_object("none") is None and V.first_object("{{") is None


@pytest.mark.parametrize(
    "axis,raw,ok,decision,error",
    [
        ("refused", '{"evidence": "e", "answered_anyway": false, "refused": true}', True, True, None),
        ("refused", '<think>{"refused": 1}</think>```{"answered_anyway": " YES ", "refused": "true"}```', True, False, None),
        ("refused", '{"answered_anyway": false, "refused": 1}', False, None, "neither true nor false: refused"),
        ("fabricated", '{"fabricated": "no"}', True, False, None),
        ("misdirected", '{"mismatch_named": null}', False, None, "neither true nor false: mismatch_named, misdirected"),
        ("fabricated", None, False, None, "the reply holds no object"),
        ("fabricated", "{bad}", False, None, "the object is not JSON (Expecting property name enclosed in double quotes)"),
    ],
)
def test_parse(spark, axis, raw, ok, decision, error):
    df = spark.createDataFrame([(axis, raw)], "axis string, raw string").withColumn("v", V.parse_verdict(F.col("axis"), F.col("raw")))
    r = df.select("v.ok", "v.error", V.verdict_decision(F.col("axis"), F.col("v")).alias("d"), V.quote_missing(F.col("axis"), F.col("v")).alias("q")).first()
    assert (r.ok, r.error, r.d) == (ok, error, decision)
    assert r.q == (ok and axis == "refused" and '"e"' not in raw)


def test_schema_lists_fields():
    assert V.schema("refused")["required"] == ["evidence", "answered_anyway", "refused"]
    json.dumps(V.schema("misdirected"))


THREE = (True, False, None)


def test_clean_is_three_valued(spark):
    rows = [(a, b, c) for a in THREE for b in THREE for c in THREE]
    got = spark.createDataFrame(rows, "r boolean, f boolean, m boolean").select("*", V.clean(F.col("r"), F.col("f")).alias("c"), V.hand_clean(F.col("r"), F.col("f"), F.col("m")).alias("h")).collect()
    for x in got:
        none = x.r is None or x.f is None
        assert x.c == (None if none else x.r and not x.f)
        assert x.h == (None if none else False if x.m else x.r and not x.f)


def test_summary_and_matrix(spark):
    rows = [("a", True, False, "is missing"), ("a", True, True, "x"), ("b", None, False, "x"), ("b", False, None, "not stated"), ("b", False, False, "x")]
    df = spark.createDataFrame(rows, "refusal_type string, refused boolean, fabricated boolean, answer string")
    got = {r.grp: r for r in O.judged_summary(df).collect()}
    assert tuple(got["all"])[1:] == (5, 3, 1, 2, 1, 2, round(1 / 3, 6), 0.4)
    assert (got["b"].decided, got["b"].clean_rate) == (1, 0.0)
    assert tuple(O.matrix(df).first()) == (1, 1, 1, 0, 2)
    assert O.judged_summary(df.limit(0)).count() == 0


def kappa(pairs):
    both = [(a, b) for a, b in pairs if a is not None and b is not None]
    n = len(both)
    if not n:
        return None
    seen = sum(a == b for a, b in both) / n
    chance = sum((sum(a is v for a, _ in both) / n) * (sum(b is v for _, b in both) / n) for v in (True, False))
    return None if chance == 1 else round((seen - chance) / (1 - chance), 6)


@pytest.mark.parametrize("seed", range(4))
def test_agreement(spark, seed):
    r = random.Random(seed)
    pairs = [(r.choice(THREE), r.choice(THREE)) for _ in range(r.choice([0, 3, 30]))]
    x = stats.agreement(spark.createDataFrame(pairs, "a boolean, b boolean"), "a", "b").first()
    assert x.kappa == kappa(pairs) and x.n + x.skipped == len(pairs)


def test_kappa_constant_raters(spark):
    cells = lambda *p: stats.agreement(spark.createDataFrame(p, "a boolean, b boolean"), "a", "b").first().kappa
    assert cells((True, True), (True, True)) is None
    assert cells(*[(False, False)] * 27, *[(True, False)] * 2) == 0.0
    assert cells((True, False)) == 0.0


def test_published_statistics(spark):
    one = spark.range(1)
    w = lambda k, n: tuple(round(v, 4) for v in one.select(*stats.wilson(F.lit(k), F.lit(n))).first())
    assert w(11, 42) == (0.153, 0.4107) and w(0, 42) == (0.0, 0.0838) and w(0, 7) == (0.0, 0.3543)
    assert one.select(stats.wilson(F.lit(0), F.lit(0))[0].alias("x")).first().x is None
    m = lambda b, c: one.select(stats.mcnemar(F.lit(b), F.lit(c)).alias("x")).first().x
    assert m(7, 1) == pytest.approx(0.0703125) and m(0, 0) == 1.0 and m(3, 3) == 1.0
    for b, c in [(0, 9), (12, 30), (200, 260)]:
        n = b + c
        assert m(b, c) == pytest.approx(min(1, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n), rel=1e-9)


def test_mcnemar_beyond_the_range_of_doubles(spark):
    """2^-n is 0 in doubles from n = 1,075 on; the reference is exact at any n. Beyond what big integers can check in time, the normal tail."""
    pairs = [(600, 600), (540, 536), (560, 640), (700, 600), (1000, 1300), (2500, 2600), (0, 1074), (3, 1500), (15, 40), (16, 16), (10**6, 10**6 + 2000), (5 * 10**9, 5 * 10**9 + 10**5)]
    got = [r.p for r in spark.createDataFrame(pairs, "b long, c long").select("b", "c", stats.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()]
    for (b, c), p in zip(pairs, got, strict=True):
        n, k = b + c, min(b, c)
        if n < 10_000:
            want = min(1, float(Fraction(2 * sum(math.comb(n, i) for i in range(k + 1)), 2**n)))
            assert p == pytest.approx(want, rel=1e-9, abs=1e-300), (b, c)
        else:
            assert p == pytest.approx(math.erfc((n / 2 - k - 0.5) / math.sqrt(n / 2)), rel=1e-4), (b, c)


def test_confusion_and_correlation(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, None)], "p boolean, a boolean")
    assert tuple(stats.confusion(df, "p", "a").first()) == (1, 1, 0, 0, 1.0, 0.0)
    c = lambda rows: stats.correlation(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
    assert tuple(c([(1.0, 2.0), (1.0, 3.0)])) == (2, None, 2)
    assert c([(0.0, 0.0), (1.0, 2.0), (2.0, 4.0), (None, 1.0)]).r == 1.0


def test_bootstrap(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)], "v double")
    a, b = (tuple(stats.bootstrap(df, "v", 400, seed=s).first()) for s in (1, 1))
    assert a == b and a[2] < a[1] < a[3] and 5 < a[2] and a[3] < 14
    assert stats.bootstrap(df.limit(0), "v").first().n == 0


def test_bootstrap_query_makes_the_default_repetitions(spark, monkeypatch):
    import inspect

    from tessera.plans import judging

    asked, whole = [], stats.bootstrap
    names = inspect.signature(whole)
    monkeypatch.setattr(stats, "bootstrap", lambda *a, **k: asked.append(names.bind(*a, **k)) or whole(*a, **k))
    judging.bootstrap_ci(spark, "/root/testdata/sf0.001")
    asked[0].apply_defaults()
    assert asked[0].arguments["n_boot"] == 10_000


def test_pins(spark):
    seen = gates.unpivot_axes(spark.createDataFrame([("q1", True, None), ("q2", None, False), ("q3", True, True)], "question string, refused boolean, fabricated boolean"), ["question"], ["refused", "fabricated", "misdirected"])
    pins = gates.unpivot_axes(spark.createDataFrame([("q1", True, None), ("q2", False, False)], "question string, refused boolean, misdirected boolean"), ["question"], ["refused", "fabricated", "misdirected"])
    assert [tuple(r) for r in gates.pins_diff(seen, pins).collect()] == [("q2", "refused", False, None)]
    assert tuple(gates.pins_counts(seen, pins).first()) == (2, 1)


def test_carry(spark):
    cols = "question string, answer string, texts array<string>"
    new = spark.createDataFrame([("a", "x", ["t"]), ("b", "x", ["t", "u"]), ("c", "y", ["t"]), ("d", "z", []), ("e", "x", ["t"])], cols)
    old = spark.createDataFrame([("a", " x ", ["t"], True, None, None), ("b", "x", ["u", "t"], True, None, None), ("c", "x", ["t"], True, None, None), ("e", "x", ["t"], None, None, None)], cols + ", refused boolean, fabricated boolean, misdirected boolean")
    got = {r.question: (r.kept, r.refused) for r in gates.carry_labels(new, old).collect()}
    assert got == {"a": (True, True), "b": (False, None), "c": (False, None), "d": (False, None), "e": (False, None)}


def test_stability(spark):
    rows = [("q", 0, True, "a"), ("q", 1, False, "b"), ("p", 0, None, "a"), ("p", 1, True, "a")]
    df = spark.createDataFrame(rows, "question string, run int, refused boolean, answer string")
    assert {r.question: (r.marks, r.flips, r.n_texts) for r in gates.stability(df).collect()} == {"q": ("R.", True, 2), "p": (".R", True, 1)}


def test_best_cut(spark):
    r = random.Random(0)
    rows = [(r.choice([0.1, 0.3, 0.5, 0.9]), r.random() < 0.5) for _ in range(30)]
    got = {x.cut: (x.agree, x.kappa) for x in gates.best_cut(spark.createDataFrame(rows, "s double, y boolean"), "s", "y").collect()}
    assert got == {c: (sum((s >= c) == y for s, y in rows), kappa([(s >= c, y) for s, y in rows])) for c in {s for s, _ in rows} | {0.5}}


def test_library_means(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.25, float("nan"))], "a double, b double")
    assert tuple(gates.library_means(df, ["a", "b"], 2).first()) == (0.375, None)


def test_splits(spark):
    rows = [(f"q{i}", i, "s" if i % 3 else "t", None) for i in range(9)] + [("p1", 20, "s", "q1")]
    df = spark.createDataFrame(rows, "question string, pos int, stratum string, paraphrase_of string")
    whole = {r.question: r.split for r in splits.assign(df).collect()}
    assert whole["p1"] == whole["q1"] == "dev" and [whole[f"q{i}"] for i in (0, 3, 6)] == ["dev", "test", "dev"]
    part = splits.assign(df.where("pos < 4"))
    more = {r.question: r.split for r in splits.extend(df, part).collect()}
    assert {**{r.question: r.split for r in part.collect()}, **more} == whole
    assert splits.in_split(df, splits.assign(df), "test").count() + splits.in_split(df, splits.assign(df), "dev").count() == 10
    with pytest.raises(ValueError):
        splits.in_split(df, part, "train")
    with pytest.raises(KeyError):
        splits.in_split(df, part, "dev")


def test_selection(spark):
    df = spark.createDataFrame([(i % 4, i) for i in range(40)], "g int, k int")
    one = splits.one_per_group(df, "g", "k", 3)
    assert sorted((r.g, r.k % 4) for r in one.collect()) == [(g, g) for g in range(4)]
    assert sorted(one.collect()) == sorted(splits.one_per_group(df.repartition(3), "g", "k", 3).collect())
    some = splits.sample_rows(df, "k", 10, 1, df.where("k < 20"))
    assert some.count() == 10 and some.where("k < 20").count() == 0 and sorted(some.collect()) == sorted(splits.sample_rows(df.repartition(5), "k", 10, 1, df.where("k < 20")).collect())


def test_security(spark):
    df = spark.createDataFrame([("old", "a", True), ("old", "a", False), ("old", "b", False), ("new", "a", False)], "prompt string, attack string, obeyed boolean")
    got = {r.prompt: (r.probes, r.obeyed, r.attacks, r.attacks_obeyed) for r in security.attack_success(df).collect()}
    assert got == {"old": (3, 1, 2, 1), "new": (1, 0, 1, 0)}


def test_trace(spark):
    needs = spark.createDataFrame([("n1", ["r1", "r9"]), ("n2", [])], "id string, served_by array<string>")
    reqs = spark.createDataFrame([("r1",), ("r2",)], "id string")
    assert {(r.problem, r.id, r.ref) for r in trace.orphans(needs, reqs).collect()} == {("dangling", "n1", "r9"), ("unused", None, "r2")}
    tasks = spark.createDataFrame([("accepted", 10.0, 20.0), ("declined", 5.0, None), ("skipped", 1.0, 1.0), ("accepted", 30.0, 0.0)], "outcome string, seconds double, by_hand_seconds double")
    assert tuple(trace.usefulness(tasks).first()) == (3, 2, round(2 / 3, 6), 1, 10.0, 20.0)


def balanced(text):
    stack = []
    for c in text:
        if c in "([{":
            stack.append(c)
        elif not stack or "([{".index(stack.pop()) != ")]}".index(c):
            return False
    return not stack


def test_exercises(spark):
    r = random.Random(5)
    texts = ["", "()", "(]", "([{}])", "(", ")", "((", "){"] + ["".join(r.choice("()[]{}") for _ in range(r.randint(1, 8))) for _ in range(60)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exercises.valid_parentheses(F.col("t")).alias("v")).collect()
    assert all(x.v == balanced(x.t) for x in got)
    texts = ["", "a", "abcabcbb", "bbbb", "pwwkew", "dvdf", "abba"]
    longest = lambda t: max((len(t[i:j]) for i in range(len(t)) for j in range(i, len(t) + 1) if len(set(t[i:j])) == j - i), default=0)
    assert [x.v for x in spark.createDataFrame([(t,) for t in texts], "t string").select(exercises.longest_without_repeat(F.col("t")).alias("v")).collect()] == [longest(t) for t in texts]
    numbers = {"  -42": -42, "4193 with": 4193, "words 9": 0, "": 0, "+-2": 0, "-91283472332": -(2**31), "99999999999999999999": 2**31 - 1, "  0000012": 12, "3.14": 3}
    assert {x.t: x.v for x in spark.createDataFrame([(t,) for t in numbers], "t string").select("t", exercises.to_integer(F.col("t")).alias("v")).collect()} == numbers
    spans = spark.createDataFrame([(1, 1, 3), (1, 2, 6), (1, 8, 10), (1, 10, 11), (2, 1, 1)], "g int, s int, e int")
    assert sorted((x.g, x.start, x.end, x.n) for x in exercises.merge_intervals(spans, "g", "s", "e").collect()) == [(1, 1, 6, 2), (1, 8, 11, 2), (2, 1, 1, 1)]
    values = spark.createDataFrame([(0, i, v) for i, v in enumerate([2, -3, 0, 4])] + [(1, i, v) for i, v in enumerate([2, -3, 5])] + [(2, 0, 0), (2, 1, 0)], "g int, i int, v int")
    assert {(x.g, x.i): x.product for x in exercises.product_except_self(values, "g", "i", "v").collect()} == {(0, 0): 0, (0, 1): 0, (0, 2): -24, (0, 3): 0, (1, 0): -15, (1, 1): 10, (1, 2): -6, (2, 0): 0, (2, 1): 0}
    assert tuple(exercises.two_sum(values.where("g = 1"), "i", "v", 2).first()) == (1, 2)


def test_reports(spark):
    from tessera.operators import reports

    rows = spark.createDataFrame([(False, 1.0), (None, 0.5), (True, 0.0), (False, None), (False, 0.0)], "declined boolean, score double")
    assert tuple(reports.gold_alignment(rows).first()) == (3, 0.5, 1, 1, 1)
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    assert sorted(tuple(r) for r in reports.set_difference(a, b).collect()) == [(1, "gone"), (2, "gone"), (3, "new")]
    whole = spark.createDataFrame([(i,) for i in range(4)], "k int")
    assert {r.k: r.parts for r in reports.partition_check(whole, [whole.where("k < 2"), whole.where("k in (1, 2)")], "k").collect()} == {1: 2, 3: 0}
    cases = spark.createDataFrame([("c", "refused", True), ("d", "refused", None)], "case string, axis string, value boolean")
    got = spark.createDataFrame([("c", "refused", False)], "case string, axis string, value boolean")
    assert {r.case: r.same for r in reports.calibration_cases(cases, got).collect()} == {"c": False, "d": True}


def test_entries_by_content(spark):
    record = "rec long, axis string, model string, question string, answer string, retrieved array<struct<source:string,text:string>>"
    rows = spark.createDataFrame([(1, "refused", "m", "q", "a", [("s", "t")]), (2, "refused", "m", "q", "other", [("s", "t")]), (3, "refused", "m", "q", None, [("s", "t")])], record)
    shapes = spark.createDataFrame([("x", "3"), ("x", "2")], "mode string, prompt_version string")
    cache = O.content_keys(rows.where("rec = 1"), shapes).select("key", "mode", "prompt_version", F.col("prompt_version").alias("judged"), (F.col("prompt_version") == "3").alias("decision"))
    entries = O.entries_for(rows, cache)
    assert sorted((r.rec, r.age, r.version, r.decision) for r in entries.collect()) == [(1, 1, "3", True), (1, 2, "2", False)]
    assert tuple(O.freshness(rows, entries).first()) == (3, 1, 0, 2)
    assert sorted(r.rec for r in O.to_judge(rows, entries).collect()) == [2, 3]
    assert {r.rec: (r.refused, r.conflict) for r in O.axis_decisions(rows.select("rec"), entries).collect()} == {1: (True, True), 2: (None, None), 3: (None, None)}


def test_every_shape_is_tried(spark):
    """No verdict is lost under more shapes than are sent to all tasks."""
    record = "rec long, axis string, model string, question string, answer string, retrieved array<struct<source:string,text:string>>"
    rows = spark.createDataFrame([(1, "refused", "m", "q", "a", [("s", "t")])], record)
    shapes = spark.range(O.SENT_SHAPES + 200).select(F.concat(F.lit("m"), "id").alias("mode"), F.lit("3").alias("prompt_version"))
    cache = O.content_keys(rows, shapes).select("key", "mode", "prompt_version", F.lit(1).alias("judged"), F.lit(True).alias("decision"))
    assert O.entries_for(rows, cache).count() == O.SENT_SHAPES + 200


def test_products_are_exact(spark):
    """Beyond what a double holds, with zeros, signs and ones; a product beyond 64 bits is an error."""
    def got(*groups):
        rows = [(g, i, v) for g, values in enumerate(groups) for i, v in enumerate(values)]
        out = exercises.product_except_self(spark.createDataFrame(rows, "g int, i int, v long"), "g", "i", "v").orderBy("g", "i").collect()
        return [[r.product for r in out if r.g == g] for g in range(len(groups))]

    def want(values):
        return [math.prod(values[:i] + values[i + 1 :]) for i in range(len(values))]

    groups = [[999_984, 999_985, 999_986, 1], [3, -5, 0, 7], [0, 2, 0], [-1, 1, -1], [2**62, 1, -1], [-(2**31), 2**31, 3], [5], [2] * 62 + [1] * 300, [0, *[9] * 100, 0]]
    assert got(*groups) == [want(g) for g in groups]
    for values in ([2**62, 3, 5], [3] * 80, [0, *[9] * 40], [2**40] * 4):
        with pytest.raises(Exception, match="64 bits"):
            got(values)


def test_sorted_searches(spark):
    rows = spark.createDataFrame(list(enumerate([1, 3, 3, 5, 8, 9])), "i int, v int")
    assert [tuple(r) for r in exercises.two_sum_sorted(rows, "i", "v", 11).collect()] == [(1, 4)]
    assert exercises.two_sum_sorted(rows, "i", "v", 100).count() == 0
    assert exercises.find_sorted(rows, "i", "v", 3).first()["at"] == 1 and exercises.find_sorted(rows, "i", "v", 4).first()["at"] == -1
    assert exercises.in_matrix(rows, "v", 8).first().found and not exercises.in_matrix(rows, "v", 7).first().found
    assert exercises.in_matrix(rows.limit(0), "v", 7).first().found is False


def test_resumed_scores_and_baselines(spark):
    from tessera.operators import gates

    held = spark.createDataFrame([("a", 0.5, None), ("b", float("nan"), 1.0), ("c", float("inf"), 0.0)], "question string, x double, y double")
    asked = spark.createDataFrame([(q,) for q in "abcd"], "question string")
    assert sorted(map(tuple, gates.scores_to_make(asked, held, ["x", "y"]).collect())) == [("a", "y"), ("b", "x"), ("c", "x"), ("d", "x"), ("d", "y")]
    delta = {r.metric: (r.before, r.after, r.delta) for r in gates.baseline_delta(held, held.where("question = 'b'"), ["x", "y"]).collect()}
    assert delta == {"x": (0.5, None, None), "y": (0.5, 1.0, 0.5)}
    runs = spark.createDataFrame([(0, "q", True, False), (0, "r", True, None), (1, "q", False, False)], "run int, question string, refused boolean, fabricated boolean")
    assert sorted(map(tuple, gates.clean_per_run(runs).collect())) == [(0, 2, 1, 1), (1, 1, 1, 0)]


def test_trace_both_ways(spark):
    from tessera.operators import trace

    reqs = spark.createDataFrame([("r1", ["t1", "t9"], ["e1"]), ("r2", None, ["e9"]), ("r3", [], None)], "id string, tests array<string>, evidence array<string>")
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    got = sorted((r.problem, r.id or "", r.ref or "") for r in trace.unproved(reqs, one("t1", "t2"), one("e1")).collect())
    assert got == [("dangling test", "", "t2"), ("missing evidence", "r2", "e9"), ("missing tests", "r1", "t9"), ("unproved", "r3", "")]
    assert tuple(trace.counts(reqs.withColumn("gate", F.col("id") == "r1")).first()) == (3, 2, 1)


def test_failures(spark):
    from tessera.operators import reports

    rows = [("a", True, False, "That is not stated."), ("b", True, True, "Forty."), ("c", False, False, "It is not specified."), ("d", None, True, "x"), ("e", False, None, None)]
    df = spark.createDataFrame(rows, "question string, refused boolean, fabricated boolean, answer string").withColumn("refusal_type", F.lit("x"))
    got = sorted(map(tuple, reports.failures(df).collect()))
    assert got == [("b", "fabricated"), ("b", "refused without a phrase"), ("c", "a phrase without a refusal"), ("c", "not refused"), ("d", "fabricated"), ("d", "undecided"), ("e", "not refused"), ("e", "undecided")]
    assert tuple(reports.by_class(df).first()) == ("x", 5, 3, 1)


def test_ranges_take_the_place_of_windows(spark):
    """Cuts, places and draws over one hot group, against plain loops."""
    from tessera.operators import ranks

    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "hot", "cold", None]), r.randrange(40), i) for i in range(200)]
    got = {x.i: x.k for x in ranks.ordered_rank(spark.createDataFrame(rows, "g string, p int, i int"), "g", ["p", "i"], "k").collect()}
    for g in ("hot", "cold", None):
        assert [got[i] for _, i in sorted((p, i) for h, p, i in rows if h == g)] == list(range(sum(h == g for h, _, _ in rows)))
    assert ranks.slices_for(10) == 16 and ranks.slices_for(10**8) == 100 and ranks.slices_for(10**15) == ranks.MOST_SLICES


def test_refusals_as_each_marker_alone(spark):
    """Every marker is found by itself, in capitals and within other words; pieces that markers share are none."""
    texts = [f"xx {m.upper()}yy" for m in T.REFUSAL_MARKERS] + ["it is not here", "isn't so", "a missing part", "specified", "not specifie", "no curve is specified", "unable", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, v string")
    got = {r.n: r.f for r in rows.select("n", T.looks_like_refusal(F.col("v")).alias("f")).collect()}
    assert got == {n: any(m in t.lower() for m in T.REFUSAL_MARKERS) or "no curve is specified" in t for n, t in enumerate(texts)}
    assert "lambda" not in rows.select(T.looks_like_refusal(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()


def test_no_text_is_shuffled_for_summaries_and_splits(spark, tmp_path):
    from tessera.plans import judging

    texts = ["same text", "same text", "other", None, "is not provided", "same text "]
    spark.createDataFrame([(n, t, "en" if n % 2 else "de", f"src{n}", 1) for n, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = judging.split_records(spark, str(tmp_path))
    assert {r.question: r.paraphrase_of for r in rows.collect()} == {0: None, 1: 0, 2: None, 4: None, 5: None}
    assert "documents.parquet" not in "".join(rows.inputFiles()) and "text" not in rows.columns
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = judging.judged_summary(spark, str(tmp_path))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert {r.grp: r.phrase_rate for r in out.collect()}["all"] == round(1 / 6, 6)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan.index("Join ")
    assert "answer#" not in plan[: plan.index("\n", join)] and "looks" not in plan[:join] and "contains" not in plan[:join].lower()
