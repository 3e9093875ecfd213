"""Steps that held a whole table in one task, on the driver or in rows that were wider than need be."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", ["arg2_applicable", "arg2_edited_calls", "arg6_plan_space", "arg7_binding_plans", "arg8_predicate_census", "arg10_chance_baselines", "arg10_recommended_baselines", "cen9_operation_census", "arg3_perturbations", "ver4_verify_repairs", "ver5_verify_calls", "txt12_prompts"])
def test_plans_of_one_file_are_worked_out_by_many_tasks_and_sent_to_none(spark, name):
    """The tables' files are small, their plans are not: the tasks are dealt before plans are made, and no side is broadcast."""
    plan = plan_of(entry.queries()[name](spark, DATA))
    assert "REPARTITION_BY_NUM" in plan and "BroadcastExchange" not in plan


def test_binding_plans_are_those_that_bind_one_by_one(spark):
    """Operations are looked at once for all candidates; a candidate that the task doesn't have, and unreadable parameters, as before."""
    from plumbline.catalog import plans as C
    from plumbline.functions import binding as B
    from plumbline.plans import arguments as G

    tasks = C.tasks(spark, DATA).where("task_id < 60")
    starred = F.transform("call.args", lambda a, k: F.struct(a["text"].alias("text"), (k == 1).alias("starred")))
    tasks = tasks.withColumn("call", F.when(F.col("task_id") % 3 == 0, F.struct(starred.alias("args"), F.col("call.keywords").alias("keywords"))).otherwise(F.col("call")))
    cands = C.candidates(spark, DATA).withColumn("params", F.when(F.col("task_id") % 7 != 0, F.col("params")))
    cands = cands.unionByName(cands.where("cand_idx = 0").withColumn("cand_idx", F.lit(3)))
    shape = G.call_shape(G.apply_op(F.col("call"), F.col("op")), F.col("receiver"))
    want = G.plan_space(tasks, "call", "receiver").join(cands, ["task_id", "cand_idx"]).where(B.allowed(F.col("params"), F.array(shape))).select("task_id", "plan_idx", "cand_idx", "op")
    got = G.binding_plans(tasks, cands)
    assert want.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pair_scores_are_the_cosines_to_the_last_bit_and_carry_no_vectors(spark):
    """Odd vectors and places as the view numbers them; the pairs hold ids and numbers alone."""
    from plumbline.catalog.bridges import RETRIEVAL, view
    from plumbline.catalog.ranking import order, retrieval
    from plumbline.functions.expressions import cosine
    from plumbline.operators.topk import pair_scores

    rows = [(i, [float((i * k) % 7 - 3) / 3 for k in range(1, 6)], i % 2) for i in range(400)]
    rows[3], rows[4], rows[5] = (3, None, 1), (4, [0.0] * 5, 0), (5, [1.0, None, 1.0, 1.0, 1.0], 1)
    rows[6], rows[7], rows[100] = (6, [1.0, 2.0], 0), (7, [float("nan")] * 5, 1), (100, rows[100][1], None)
    folder = __import__("tempfile").mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    want = view(spark, folder, RETRIEVAL).select("task_id", "cand_id", F.col("ord").cast("long"), cosine(F.col("qv"), F.col("cv")))
    small = pair_scores(*retrieval(spark, folder), ["namespace"], 2, 64)
    assert set(small.columns) == {"namespace", "task_id", "cand_id", "place", "score"}
    plain = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert want.count() and plain(small.select("task_id", "cand_id", order(), "score")) == plain(want)


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_printed_rounds_the_binary_value(spark, digits):
    from plumbline.functions.texts import printed

    values = [k / 10 ** (digits + 1) for k in range(-1205, 1206)] + [(2 * k + 1) / 16 for k in range(40)] + [2.015, 1.005, 0.0005, 0.00049999, 99.95, 1e-9, 123456.785, 1 / 3, 0.9999, 0.0]
    values = [v for v in values if v or str(v) == "0.0"]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "x double").select("x", printed(F.col("x"), digits).alias("t")).collect()
    assert [(x.x, x.t) for x in rows if x.t != (None if x.x is None else f"{x.x:.{digits}f}")] == []


def test_hashed_draws_of_many_sources_are_those_of_few(spark, monkeypatch):
    """The same replicates by blocks as by lists, and no limit on the sources."""
    from plumbline.operators import paired

    sources = spark.range(700).select((F.col("id") % 2).cast("string").alias("stratum"), F.col("id").cast("string").alias("source"), F.col("id").alias("n"), (F.col("id") / 7).alias("e"))
    sources = sources.where("stratum = '0' OR source < '4'")
    want = {(x.b, x.stratum): (x.n, x.e) for x in paired.replicates(sources, ["n", "e"], 60, 3, "draws").collect()}
    monkeypatch.setattr(paired, "FEW", 100)
    for size in (64, 1000):
        monkeypatch.setattr(paired, "CHUNK", size)
        got = {(x.b, x.stratum): (x.n, x.e) for x in paired.replicates(sources, ["n", "e"], 60, 3, "hashes").collect()}
        assert len(want) == 120 and set(got) == set(want) and all(got[k] == (want[k][0], pytest.approx(want[k][1])) for k in want)


def test_summary_of_a_repository_is_that_of_its_listed_pool(spark):
    """Doubled names, callers that come first or last, a repository of one function, one function twice alone."""
    from plumbline.operators import tasks as T

    symbols = spark.createDataFrame([("n", "a", "f"), ("n", "a", "f"), ("n", "b", "g"), ("n", "z", "h"), ("m", "a", "f"), ("k", "a", "f"), ("k", "a", "f"), ("k", "b", "f")], "namespace string, path string, name string").withColumn("params", F.lit(0))
    tasks = spark.createDataFrame([("1", "n", "a", "f"), ("2", "n", "z", "h"), ("3", "n", "b", "g"), ("4", "m", "a", "f"), ("5", "n", "a", "x"), ("6", "k", "b", "f"), ("7", "k", "a", "f")], "task_id string, namespace string, path string, caller string")
    sym = F.concat_ws("::", "mpath", "name")
    want = T.repository_pool(tasks, symbols).groupBy("task_id").agg(F.count(F.lit(1)).alias("members"), F.min(sym).alias("first"), F.max(sym).alias("last"))
    got = T.repository_summary(tasks, symbols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 6
