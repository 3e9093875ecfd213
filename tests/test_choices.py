"""Ring samples against the law of a full shuffle, pools as classes against listed pools, and exact tests for any counts."""

import math
import random
from collections import Counter
from fractions import Fraction
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from plumbline.functions.binding import PARAMETERS, SHAPE, allowed, allowed_reason
from plumbline.functions.expressions import two_sided_binomial
from plumbline.operators import classes, pools, rings
from plumbline.operators import tasks as T

# rings


def test_ring_takes_successors_or_all(spark):
    members = spark.createDataFrame([(b, f"{b}{k}") for b, n in (("x", 40), ("y", 3), ("z", 1)) for k in range(n)], "bucket string, sym string")
    asked = spark.createDataFrame([(f"t{k}", b, need) for k, (b, need) in enumerate([("x", 5), ("x", 40), ("x", 99), ("y", 2), ("y", 9), ("z", 1), ("z", 0), ("none", 3)])], "task_id string, bucket string, need int")
    got = rings.successors(asked, members, ["bucket"], F.col("need"), "sym", 3).collect()
    per = Counter(r.task_id for r in got)
    assert per == {"t0": 5, "t1": 40, "t2": 40, "t3": 2, "t4": 3, "t5": 1}
    assert len({(r.task_id, r.sym) for r in got}) == len(got)  # without replacement
    order = {r.sym: r.place for r in rings.ring(members, ["bucket"], "sym", 3).where("bucket = 'x'").collect()}
    run = [order[r.sym] for r in sorted((r for r in got if r.task_id == "t0"), key=lambda r: r.step)]
    assert all((b - a) % 40 == 1 for a, b in zip(run, run[1:], strict=False))


def test_ring_law_is_that_of_a_full_shuffle(spark):
    """Over many buckets of six, each set of three is as likely as any other: by rings, and by ranking whole pools."""
    buckets, sets = 4000, list(combinations(range(6), 3))
    members = spark.range(buckets * 6).select((F.col("id") % buckets).alias("bucket"), F.floor(F.col("id") / buckets).cast("int").alias("k")).withColumn("sym", F.concat_ws(":", "bucket", "k"))
    asked = spark.range(buckets).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("task_id"), F.col("id").alias("bucket"))
    ring = rings.successors(asked, members, ["bucket"], F.lit(3), "sym", 0)
    full = T.choose(asked.join(members, "bucket").withColumn("is_target", F.lit(False)), 3, 0)
    for rows in (ring, full):
        seen = Counter(tuple(sorted(r.s)) for r in rows.groupBy("task_id").agg(F.collect_list("k").alias("s")).collect())
        want = buckets / len(sets)
        assert sum((seen[s] - want) ** 2 / want for s in sets) < 45  # chi square, 19 degrees: above 43.8 once in a thousand


def functions(spark, rows):
    """symbols from (namespace, path, name, ordinal, required, body)."""
    p = f"named_struct('positional_only', array(), 'positional_or_keyword', req, 'keyword_only', array(), 'required', req, 'has_vararg', false, 'has_kwarg', false)"  # noqa: F541
    df = spark.createDataFrame(rows, "namespace string, path string, name string, ordinal int, req array<string>, body string")
    return df.withColumns({"signature": F.concat_ws("", "name", F.lit("("), F.array_join("req", ", "), F.lit(")")), "shape": F.struct(F.size("req").alias("pos")), "params": F.expr(f"cast({p} as {PARAMETERS})")}).drop("req")


def listed(symbols, edges, most):
    """Each caller's eligible wrong candidates, by hand."""
    rows = [r.asDict() for r in symbols.collect()]
    out = {}
    for e in edges:
        own = [r for r in rows if (r["namespace"], r["path"], r["name"]) == (e[0], e[1], e[3])]
        t = max(own, key=lambda r: r["ordinal"])
        twin = lambda r: r in own and (r["signature"], r["body"]) == (t["signature"], t["body"])  # noqa: B023, E731
        out[e[:3]] = (t, [r for r in rows if r["namespace"] == e[0] and not twin(r)])
    return out


def test_call_decisions_by_rings(spark):
    """Twins of the target never show, local functions come first, small repositories are taken whole."""
    rows = [("n", "a.py", f"f{k}", k, ["x"], f"b{k}") for k in range(5)] + [("n", "a.py", "f0", 5, ["x"], "b0"), ("n", "a.py", "f0", 6, ["x"], "other")]
    rows += [("n", "b.py", f"g{k}", k, ["x"], "b") for k in range(30)] + [("m", "a.py", "f0", 0, ["x"], "b"), ("m", "a.py", "f1", 1, ["x"], "b")]
    rows += [("n", "b.py", "g3", 30, ["x"], "b"), ("n", "b.py", "g3", 31, ["x"], "b")]
    edges = [("n", "a.py", "f1", "f0"), ("n", "a.py", "f2", "f3"), ("m", "a.py", "f1", "f0"), ("n", "b.py", "g1", "g3")]
    s = functions(spark, rows)
    e = spark.createDataFrame(edges, "namespace string, path string, caller string, target string")
    want = listed(s, edges, 12)
    for most in (4, 12, 100):
        got = T.call_decisions(s, e, most).collect()
        for key, (t, others) in want.items():
            mine = [r for r in got if (r.namespace, r.path, r.caller) == key]
            hits = [r for r in mine if r.is_target]
            assert len(hits) == 1 and (hits[0].cpath, hits[0].name, hits[0].ordinal) == (t["path"], t["name"], t["ordinal"])
            assert {r.answer_index for r in mine} == {hits[0].cand_idx} and sorted(r.cand_idx for r in mine) == list(range(len(mine)))
            wrong = {(r.cpath, r.name, r.ordinal) for r in mine if not r.is_target}
            allowed_wrong = {(r["path"], r["name"], r["ordinal"]) for r in others}
            local = {x for x in allowed_wrong if x[0] == key[1]}
            assert len(mine) == min(most, 1 + len(allowed_wrong)) and wrong <= allowed_wrong
            assert wrong >= local if len(local) < most else wrong <= local


def test_no_row_for_each_task_and_function(spark):
    """What the joins of the choice make grows with the tasks, not with tasks times functions."""
    rows = [("n", f"{k // 10}.py", f"f{k}", k % 10, ["x"], "b") for k in range(2000)]
    edges = [("n", f"{k}.py", f"f{10 * k + 1}", f"f{10 * k}") for k in range(200)]
    s, e = functions(spark, rows), spark.createDataFrame(edges, "namespace string, path string, caller string, target string")
    made = rings.successors(T.with_task(e, "namespace", "path", "caller").drop("path", "caller", "target"), s.select("namespace", F.concat_ws(":", "path", "name").alias("sym")), ["namespace"], F.lit(15), "sym", 0)
    assert made.count() == 15 * 200  # of 400,000 pairs
    assert T.call_decisions(s, e).count() == 16 * 200


def test_cross_file_decisions_by_rings(spark):
    rows = [("n", f"{p}.py", f"f{k}", k, ["x"] * (1 + k % 2), "b") for p in "abc" for k in range(6)] + [("s", "a.py", "f0", 0, ["x"], "b"), ("s", "b.py", "g", 0, ["x"], "b")]
    s = functions(spark, rows)
    e = spark.createDataFrame([("n", "a.py", "f0", "y", "b.py", "f2"), ("n", "a.py", "f1", "y", "b.py", "f2"), ("s", "a.py", "f0", "y", "b.py", "g")], "namespace string, path string, caller string, alias string, target_path string, target string")
    for k in (4, 8, 9, 10):
        got = T.cross_file_decisions(s, e, k).collect()
        sizes = Counter((r.namespace, r.caller) for r in got)
        assert sizes == {("n", c): k for c, n in (("f0", 8), ("f1", 9)) if n >= k}  # the caller of the same shape is no candidate
        assert all(not (r.cpath == r.path and r.name == r.caller) and (r.is_target == (r.cpath == "b.py" and r.name == "f2")) for r in got)
        assert all((int(r.name[1:]) % 2 == 0) for r in got)


def test_unknown_level(spark):
    s = functions(spark, [("n", "a.py", f"f{k}", k, [], "b") for k in range(3)])
    t = spark.createDataFrame([("1", "n", "a.py", "f0")], "task_id string, namespace string, path string, caller string")
    none = spark.createDataFrame([], "namespace string, path string, alias string, target_path string, name string")
    assert [sorted(r.name for r in T.level_pool(level, t, s, none).collect()) for level in ("scope", "repository")] == [["f1", "f2"]] * 2
    with pytest.raises(ValueError, match="unknown pool level 'galaxy'"):
        T.level_pool("galaxy", t, s, none)


# classes


def made_repository(spark, seed):
    r = random.Random(seed)
    names = ["a", "b", "c"]
    rows = [(f"n{r.randrange(2)}", f"{r.randrange(4)}.py", f"f{r.randrange(8)}", k, r.sample(names, r.randrange(4)), f"body{r.randrange(3)}") for k in range(60)]
    s = functions(spark, rows).withColumn("rendering_hash", F.concat("signature", "body"))
    shapes = [None, [], [(1, [], False, False, False)], [(0, ["a"], False, False, False)], [(1, ["b"], False, False, False), (2, [], False, False, False)], [(0, [], True, False, False)]]
    known = [(x.namespace, x.path, x.name) for x in s.select("namespace", "path", "name").distinct().collect()]
    looks = [x.rendering_hash for x in s.select("rendering_hash").distinct().collect()]
    ts = [(f"t{k}", *r.choice([*known, ("n0", "9.py", "gone"), ("n7", "0.py", "f0")]), r.choice([*looks, "not there"]), r.choice(shapes)) for k in range(40)]
    return s, spark.createDataFrame(ts, f"task_id string, namespace string, path string, caller string, wanted string, shapes array<{SHAPE}>")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_class_counts_equal_listed_pools(spark, seed):
    s, t = made_repository(spark, seed)
    everything = t.join(s.select("namespace", F.col("path").alias("mpath"), "name", "params", "rendering_hash"), "namespace").where("NOT (mpath = path AND name = caller)").withColumn("bindable", allowed(F.col("params"), F.col("shapes")))
    want = {r.task_id: (r.n, r.b) for r in everything.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("bindable").alias("b")).collect()}
    got = {r.task_id: (r.repository, r.bindable) for r in classes.pool_counts(t, s).collect()}
    assert len(got) == 40 and got == {k: want.get(k, (0, 0)) for k in got}
    level = pools._level(everything.select("task_id", "rendering_hash", "bindable"), t.select("task_id", "wanted"), "repository")
    cols = sorted(c for c in level.columns if c != "task_id")
    want = {r.task_id: tuple(r[c] for c in cols) for r in level.select("task_id", *cols).na.fill(0).na.fill(False).collect()}
    got = {r.task_id: tuple(r[c] for c in cols) for r in classes.repository_counts(t, s).collect()}
    none = tuple(False if "target" in c else 0 for c in cols)
    assert len(got) == 40 and got == {k: want.get(k, none) for k in got}


def test_classes_are_judged_once(spark):
    """Ten thousand functions of three kinds and a thousand tasks of two: six verdicts."""
    s = functions(spark, [("n", "a.py", f"f{k}", k, ["a", "b", "c"][: k % 3], "b") for k in range(999)])
    t = spark.range(1000).select(F.col("id").cast("string").alias("task_id"), F.lit("n").alias("namespace"), F.lit("b.py").alias("path"), F.lit("g").alias("caller"), F.expr(f"cast(array(named_struct('positional', cast(id % 2 as int), 'keywords', array(), 'starred', false, 'double_starred', false, 'receiver', false)) as array<{SHAPE}>)").alias("shapes"))
    kinds = s.groupBy("namespace", "params").agg(F.count(F.lit(1)).alias("n"))
    assert kinds.count() == 3 and classes.bound_classes(kinds, t, ["namespace"]).count() == 2
    got = classes.pool_counts(t, s).groupBy((F.col("task_id").cast("int") % 2).alias("k"), "repository", "bindable").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {tuple(r) for r in got} == {(0, 999, 333, 500), (1, 999, 333, 500)}


def test_reason_of_a_constraint(spark):
    """No call site and an unreadable signature are allowed, and the reason says which case it is."""
    s, _t = made_repository(spark, 1)
    p = s.select("params").first().params
    site = [(5, [], False, False, False)]
    rows = spark.createDataFrame([(1, p, None), (2, None, site), (3, p, []), (4, p, site), (5, None, None)], f"k int, params {PARAMETERS}, shapes array<{SHAPE}>")
    ok, why = allowed_reason(F.col("params"), F.col("shapes"))
    got = {r.k: (r.ok, r.why) for r in rows.select("k", ok.alias("ok"), why.alias("why")).collect()}
    assert got == {1: (True, "no call site"), 2: (True, "unreadable signature"), 3: (True, "no call site"), 4: (False, "call site does not bind"), 5: (True, "no call site")}


# exact tests


def by_hand(a, b):
    n, m, term, total = a + b, min(a, b), 1, 1
    for k in range(1, m + 1):
        term = term * (n - k + 1) // k
        total += term
    return min(1.0, float(Fraction(2 * total, 2**n)))


def p_values(spark, pairs, **more):
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(pairs)], "k int, a long, b long")
    return [r.p for r in df.select("k", two_sided_binomial(F.col("a"), F.col("b"), **more).alias("p")).orderBy("k").collect()]


def test_golden_and_exact_p_values(spark):
    golden = {(125, 38): 4.96e-12, (56, 9): 2.05e-9, (71, 22): 3.48e-7, (23, 6): 0.00232, (21, 9): 0.0428, (7, 5): 0.774, (4, 1): 0.375}
    for got, want in zip(p_values(spark, golden), golden.values(), strict=True):
        assert got == pytest.approx(want, rel=2e-3)
    r = random.Random(2)
    pairs = [(0, 0), (0, 1), (1, 0), (0, 60), (900, 0), (500, 500), (15, 16), (800, 1200)] + [(r.randrange(2000), r.randrange(2000)) for _ in range(60)]
    for got, x in zip(p_values(spark, pairs), pairs, strict=True):
        assert got == pytest.approx(by_hand(*x), rel=1e-11, abs=1e-300)


def test_p_values_of_any_count(spark):
    """Both ways agree where they meet, billions take no time, and the normal law is the limit."""
    pairs = [(400_000, 402_000), (450_000, 449_000), (480_000, 500_000), (500_000, 499_999), (499_000, 499_000)]
    for x, y in zip(p_values(spark, pairs), p_values(spark, pairs, many=1000.0), strict=True):
        assert x == pytest.approx(y, rel=1e-11)
    large = [(1_500_000_000, 1_500_100_000), (30_000_000, 30_005_000), (2 * 10**12, 2 * 10**12 + 3_000_000), (3 * 10**9, 3 * 10**9), (10**9, 2 * 10**9)]
    got = p_values(spark, large)
    for p, (a, b) in zip(got[:3], large[:3], strict=True):
        assert p == pytest.approx(math.erfc((abs(a - b) - 1) / math.sqrt(2 * (a + b))), rel=1e-7)
    assert got[3:] == [1.0, 0.0]
