"""Parsing once, facts by kind, files dealt by size, stored caches, funnels, reports and turned tasks."""

import ast
import random

import pytest
from pyspark.sql import functions as F

from plumbline.catalog import extraction
from plumbline.functions import pysource
from plumbline.functions import texts as X
from plumbline.operators import attempts as A
from plumbline.operators import paired as P
from plumbline.operators import ranking as R
from plumbline.operators import splits as L
from plumbline.operators import tasks as T
from plumbline.plans import arguments as G
from plumbline.sources import files as S
from plumbline.sources import stored

SF = "/root/testdata/sf0.001"

# parsing


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_parsed_once(monkeypatch):
    text = "\n".join(f"def f{k}(a):\n    return g(a) + f{k + 1}(a)" for k in range(20)) + "\ndef f3(a):\n    return other(a)\n"
    seen, parse = [], ast.parse
    monkeypatch.setattr(pysource.ast, "parse", lambda *a, **b: seen.append(1) or parse(*a, **b))
    asked = [(f"f{k}", f"f{k + 1}") for k in range(20)] + [("f3", "g"), ("gone", "g"), ("f19", "f19")]
    said = pysource.masked_all(text, asked)
    assert len(seen) == 1
    assert said[:20] == [f"def f{k}(a):\n    return g(a) + __CALL_TARGET__(a)" for k in range(20)]
    assert said[20] == "def f3(a):\n    return __CALL_TARGET__(a) + f4(a)" and said[21:] == [None, None]  # the first of a name, and a name that stays


def test_a_file_travels_once(spark):
    files = spark.createDataFrame([("n", f"{k}.py", "\n".join(f"def f{j}(a):\n    return g{j}(a)" for j in range(10))) for k in range(6)], "namespace string, path string, content string")
    edges = files.select("namespace", "path", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("j")).select("namespace", "path", F.concat(F.lit("f"), "j").alias("caller"), F.concat(F.lit("g"), "j").alias("target"))
    assert S.asked_of_files(edges, files).count() == 6
    got = S.masked_callers(edges, files).collect()
    assert len(got) == 60 and {r.context for r in got} == {f"def f{j}(a):\n    return __CALL_TARGET__(a)" for j in range(10)}
    assert S.masked(edges.join(files, ["namespace", "path"])).count() == 60


def test_facts_are_read_by_kind_and_column(spark):
    x = S.fact_table(extraction.files(spark, SF))
    calls = plan_of(S.calls(x).select("namespace", "caller", "callee"))
    assert "PartitionFilters" in calls and "(kind" in calls.replace("isnotnull(kind", "") and "body" not in calls and "signature" not in calls
    assert "body" in plan_of(S.symbols(x))
    one = plan_of(S.imports(x))
    assert "= import)" in one and "params" not in one
    assert {r.kind for r in x.select("kind").distinct().collect()} >= {"symbol", "call", "import", "read", "method"}
    folder = S.symbols(x).inputFiles()[0].split("/kind=")[0]
    stored.remove(spark, x)
    assert not spark._jvm.java.io.File(folder.removeprefix("file:")).exists()


def test_fact_table_of_nothing(spark):
    none = spark.createDataFrame([], "namespace string, path string, content string")
    x = S.fact_table(none)
    assert S.symbols(x).count() == 0 and S.imports(x).count() == 0


def test_files_are_dealt_by_size(spark):
    """On a skewed tree no task has twice its share, but for files that are larger by themselves."""
    r = random.Random(6)
    sizes = [r.randrange(10, 300) for _ in range(2000)] + [int(10 ** r.uniform(1, 3.9)) for _ in range(200)] + [60_000, 45_000, 9000, 0]
    files = spark.createDataFrame([(f"n{k % 3}", f"{k}.py", "x" * n if n else None) for k, n in enumerate(sizes)], "namespace string, path string, content string")
    dealt = S.dealt_by_size(files, 10_000)
    tasks = dealt.groupBy(F.spark_partition_id().alias("t")).agg(F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    alone = sorted(t.bytes for t in tasks if t.n == 1 and t.bytes >= 10_000)
    rest = [t.bytes for t in tasks if not (t.n == 1 and t.bytes >= 10_000)]
    assert alone == sorted(n for n in sizes if n >= 10_000) and sum(t.n for t in tasks) == len(sizes)
    assert max(rest) <= 20_000 and sum(rest) / len(rest) > 8000
    assert dealt.exceptAll(files).count() == 0 and S.dealt_by_size(files.limit(0)).count() == 0


# stored caches


def test_only_touched_prefixes_are_read(spark, tmp_path):
    items = spark.range(4000).select(F.lit("context").alias("role"), F.col("id").cast("string").alias("text"))
    keyed = R.text_keys(items).select("role", "text_hash", F.array(F.lit(1.0)).alias("vec"))
    folder = str(tmp_path / "cache")
    R.write_cache(keyed, folder)
    new = items.where("text IN ('5', '77')").unionByName(spark.createDataFrame([("context", "not there"), ("question", "5"), ("context", "not there")], "role string, text string"))
    missing = R.missing_from_cache(new, folder)
    assert {(x.role, x.text) for x in missing.collect()} == {("context", "not there"), ("question", "5")}
    keys = R.text_keys(new).select("role", "text_hash").distinct()
    prefixes = {x.text_hash[:2] for x in keys.collect()}
    for few in (100_000, 1):  # keys sent along, and shuffled
        touched = R.touched_cache(keys, folder, few=few)
        plan = plan_of(touched)
        assert "PartitionFilters" in plan and "prefix" in plan and "vec" not in plan.split("ReadSchema")[1].split(">")[0]
        assert touched.where("text_hash IS NOT NULL").count() == (2 if few > 1 else keyed.where(F.substring("text_hash", 1, 2).isin(*prefixes)).count())
    read = [f for f in spark.read.parquet(folder).where(F.col("prefix").isin(*prefixes)).inputFiles()]
    assert {f.split("prefix=")[1][:2] for f in read} >= prefixes
    R.write_cache(R.encode_texts(missing, lambda: lambda ts, role: [[float(len(t))] for t in ts]), folder)
    assert R.missing_from_cache(new, folder).count() == 0
    assert R.missing_from_cache(new.limit(0), folder).count() == 0


# funnels, reports, plans


def test_funnel_is_one_pass(spark):
    rows = [(k, "ab"[k % 2], None if k % 5 == 0 else str(k % 3), k % 7 != 0, None if k % 11 == 0 else k % 3 != 0, k % 2 == 0) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, x string, y string, g1 boolean, g2 boolean, g3 boolean")
    got = {(r.level, r.value): (r.n, r.g1, r.g2, r.g3) for r in A.funnel(df, ["g1", "g2", "g3"], "x", "y").collect()}

    def plain(part):
        one = [r for r in part if r[3]]
        two = [r for r in one if r[4]]
        return len(part), len(one), len(two), sum(r[5] for r in two)

    want = {("total", ""): plain(rows)} | {("x", v): plain([r for r in rows if r[1] == v]) for v in "ab"} | {("y", v): plain([r for r in rows if r[2] == v]) for v in ("0", "1", "2", None)}
    assert got == want
    assert plan_of(A.funnel(df, ["g1", "g2"], "x", "y")).count("Expand") == 1
    assert [tuple(r) for r in A.funnel(df, ["g1"]).collect()] == [("total", "", 200, plain(rows)[1])]
    assert [tuple(r) for r in A.funnel(df.limit(0), ["g1"], "x").collect()] == [("total", "", 0, 0)]


def test_standard_report_of_the_pilot(spark):
    """Twelve tasks of the paired pilot, its numbers, and a key whose arms never solved the same task."""
    t, f = True, False
    pilot = [(t, 2, t, 1)] * 2 + [(t, 1, t, 1), (t, 2, t, 2)] + [(f, 2, t, 1)] * 4 + [(t, 1, f, 2)] + [(f, 2, f, 2)] * 3
    rows = [("pilot", b, bn, a, an, b and bn == 1, a and an == 1) for b, bn, a, an in pilot] + [("none", f, 2, t, 1, f, t)]
    pairs = spark.createDataFrame(rows, "key string, b_ok boolean, b_attempts long, a_ok boolean, a_attempts long, b_first boolean, a_first boolean")
    got = {(r.key, r.metric): (r.baseline, r.assisted) for r in X.standard_report(P.exact_tests(P.summarize(pairs, "key", means=True)), "key").collect()}
    want = {
        "first-pass success": ("2/12 (16.7%)", "7/12 (58.3%)"), "success within budget": ("5/12 (41.7%)", "8/12 (66.7%)"), "terminal failures": ("7/12", "4/12"), "mean attempts": ("1.83", "1.42"),
        "both succeed": ("4", None), "assisted only": ("4", None), "baseline only": ("1", None), "neither succeeds": ("3", None), "mean correction turns saved": ("0.50", None),
        "fewer, same, more": ("2, 2, 0 of 4", None), "McNemar": ("5 discordant: 4 to 1, p = 0.375", None), "sign test": ("2 unequal: 2 to 0, 2 ties, p = 0.500", None),
    }
    assert {m: v for (k, m), v in got.items() if k == "pilot"} == want
    assert got["none", "mean correction turns saved"] == ("not defined", None) and len(got) == 2 * len(want)
    tests = {r.metric: r.value for r in X.tests_report(P.exact_tests(P.summarize(pairs.where("key = 'pilot'")))).collect()}
    assert tests == pytest.approx({"success_rate_delta": 0.25, "mean_attempts_delta": 5 / 12, "mean_turn_delta": 0.5, "mcnemar_p": 0.375, "sign_p": 0.5})


def test_routing_elsewhere(spark):
    rows = [(0.2, True, False), (0.5, False, True), (0.9, False, True), (None, True, False)]
    df = spark.createDataFrame(rows, "confidence double, b_ok boolean, a_ok boolean")
    sweep = P.threshold_sweep(df.where("confidence IS NOT NULL"), [0.1, 0.3, 0.4, 0.7])
    assert sweep.where("best").first().threshold == 0.4  # 0.3 does as well: the higher one
    other = spark.createDataFrame([(0.39, True, False), (0.4, False, True), (None, True, False), (0.1, False, True)], "confidence double, b_ok boolean, a_ok boolean")
    r = P.routing_result(P.routed(other, sweep)).first()
    assert (r.n, r.took_assisted, r.assisted_successes, r.routed_successes, r.routed_only, r.assisted_only, r.delta) == (4, 1, 2, 3, 2, 1, 0.25) and r.p == pytest.approx(1.0)


def test_residual_ranks_before_and_after(spark):
    rows = [(1, 0, 0.9, False, False), (1, 1, 0.8, True, True), (1, 2, 0.1, False, True), (2, 0, 0.9, False, True), (2, 1, 0.5, True, False), (3, 0, 0.9, True, True), (4, 0, 0.9, False, False), (4, 1, 0.8, True, False)]
    got = {r.stage: r for r in R.residual_ranks(spark.createDataFrame(rows, "task_id int, cand_idx int, score double, is_target boolean, bindable boolean")).collect()}
    assert (got["before"].n, got["before"].first_wrong, got["before"].second_right, got["before"].two_turn_ceiling) == (4, 3, 3, 1.0)
    assert (got["after"].n, got["after"].first_wrong, got["after"].second_right, got["after"].two_turn_ceiling) == (4, 2, 0, 0.5)


def test_turned_tasks_verify_their_own_plan(spark):
    keep = "named_struct('cand', {}, 'op', array('keep'))"
    tasks = spark.range(3).selectExpr("id AS task_id", "3 AS n_candidates", "array('a', 'b', 'c') AS candidates", "cast(id AS int) AS answer_index", keep.format("cast(id AS int)") + " AS restoring")
    for r in G.reordered(tasks, 3).collect():
        assert r.candidates[r.answer_index] == "abc"[r.task_id] and r.restoring.cand == r.answer_index and sorted(r.candidates) == ["a", "b", "c"]
    shown = G.rotations(tasks, 2).select("task_id", "shift", F.posexplode("order").alias("cand_idx", "was"))
    back = G.map_plans(shown, tasks.select("task_id", "n_candidates")).collect()
    assert len(back) == 18 and all(r.cand_idx == r.was for r in back)


def test_recommended_baseline(spark):
    call = "named_struct('args', array(named_struct('text', 'x', 'starred', false)), 'keywords', cast(array() AS array<struct<name:string,value:string>>))"
    p = "named_struct('positional_only', cast(array() AS array<string>), 'positional_or_keyword', {0}, 'keyword_only', cast(array() AS array<string>), 'required', {0}, 'has_vararg', false, 'has_kwarg', false)"
    tasks = spark.sql(f"SELECT id AS task_id, 2 AS n_candidates, {call} AS call, array('a', 'b') AS vocabulary, false AS receiver, named_struct('cand', 0, 'op', array('keep')) AS restoring, cast(r AS int) AS recommendation FROM VALUES (1, 0), (2, 1), (3, NULL) t(id, r)")
    cands = spark.sql(f"SELECT id AS task_id, c AS cand_idx, CASE c WHEN 0 THEN {p.format(chr(97) + 'rray(' + chr(39) + 'a' + chr(39) + ')')} ELSE {p.format('array(' + chr(39) + 'q' + chr(39) + ')')} END AS params FROM VALUES (1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1) t(id, c)")
    got = {r.task_id: (r.recommended_feasible_uniform, r.position_prior) for r in G.recommended_baselines(tasks, cands).collect()}
    assert got == {1: (0.5, 1.0), 2: (0.0, 1.0), 3: (None, 1.0)}  # x as it is, or named a: two plans bind the first candidate


def test_duplicated_answer_names(spark):
    rows = [("s", ["f", "g", "f"], 0), ("s", ["f", "g", "f"], 1), ("t", ["f"], 0), ("t", [None, None], 0)]
    got = {r.k: (r.n, r.duplicated) for r in T.duplicated_answers(spark.createDataFrame(rows, "k string, symbols array<string>, answer_index int"), "k").collect()}
    assert got == {"s": (2, 1), "t": (2, 0)}


def test_splits_are_jointly_complete(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, None), (None, "b"), (4, "c")]
    x = spark.createDataFrame(rows, "id int, source string")
    assert L.unlike(x, x.repartition(3), "id", "source").collect() == []
    split = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (3, None), (4, "c"), (9, None)], "id int, source string")
    assert {tuple(r) for r in L.unlike(x, split, "id", "source").collect()} == {(2, "a", 2, 1), (3, None, 1, 2), (None, "b", 1, 0), (9, None, 0, 1)}
