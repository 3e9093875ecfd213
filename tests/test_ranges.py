"""Shortlists by blocks against full rankings, exact quantiles against Spark's, seeded draws against rows of draws."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.expressions import cosine, draw
from plumbline.operators import paired, pools, quantiles, topk
from plumbline.operators import ranking as R


def vectors(spark, n, seed, start=0):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        v = [float(r.randint(-2, 2)) for _ in range(3)]  # few directions, so that scores tie
        rows.append((start + k, "ab"[k % 2], None if k % 29 == 3 else [0.0] * 3 if k % 23 == 5 else v))
    return spark.createDataFrame(rows, "id long, ns string, vec array<double>")


@pytest.mark.parametrize("k, query_rows, pool_rows, fan", [(4, 1000, 1000, 64), (4, 5, 7, 64), (3, 5, 4, 2), (500, 9, 11, 3)])
@pytest.mark.parametrize("itself", [True, False])
def test_blocked_shortlist_is_the_full_one(spark, k, query_rows, pool_rows, fan, itself):
    pool = vectors(spark, 120, 1)
    asked = pool.where("id % 7 = 0 OR id % 29 = 3")
    pairs = asked.select("ns", F.col("id").alias("task_id"), F.col("vec").alias("a")).join(pool.select("ns", F.col("id").alias("cand_idx"), F.col("vec").alias("b")), "ns")
    pairs = pairs if itself else pairs.where("task_id <> cand_idx")
    full = R.shortlist(pairs.withColumn("score", F.round(cosine(F.col("a"), F.col("b")), 9)), k)
    got = topk.blocked_shortlist(asked.withColumnRenamed("id", "task_id"), pool.withColumnRenamed("id", "cand_id"), k, ["ns"], itself, 9, query_rows, pool_rows, fan)
    assert {(r.ns, r.task_id, r["rank"], r.cand_id, r.score) for r in got.collect()} == {(r.ns, r.task_id, r["rank"], r.cand_idx, r.score) for r in full.select("ns", "task_id", "rank", "cand_idx", "score").collect()}


def test_few_rows_leave_a_block(spark):
    """At most k rows for each query and block of the pool, and blocks hold no more than about their share."""
    pool = spark.range(3000).select("id", F.lit("a").alias("ns"), F.array(F.cos("id"), F.sin("id")).alias("vec"))
    blocks = topk.dealt_blocks(pool, ["ns"], "id", 500).groupBy("block").count().collect()
    assert len(blocks) == 6 and max(r["count"] for r in blocks) < 700
    got = topk.blocked_shortlist(pool.where("id < 40").withColumnRenamed("id", "task_id"), pool.withColumnRenamed("id", "cand_id"), 5, ["ns"], pool_rows=500)
    assert got.count() == 200
    angles = np.arange(3000.0)
    for r in got.where("task_id = 17 AND rank = 2").collect():
        others = np.cos(angles - 17)
        others[17] = -2
        assert r.cand_id == others.argmax()


def test_no_pool_and_no_queries(spark):
    none = spark.createDataFrame([], "id long, ns string, vec array<double>")
    some = vectors(spark, 10, 1)
    for q, p in ((none, some), (some, none), (some, some.withColumn("ns", F.lit("elsewhere")))):
        assert topk.blocked_shortlist(q.withColumnRenamed("id", "task_id"), p.withColumnRenamed("id", "cand_id"), 3, ["ns"]).collect() == []


@pytest.mark.parametrize("most", [3, 40, 10_000])
def test_quantiles_are_spark_s(spark, most):
    r = random.Random(4)
    groups = {
        "even": [float(k) for k in range(500)], "ties": [float(r.randrange(5)) for _ in range(300)], "tail": [2.0 ** r.randrange(-900, 900) for _ in range(400)],
        "one": [7.5], "two": [-1.0, 4.0], "none": [None, None], None: [r.gauss(0, 1) for _ in range(300)], "with nulls": [None, 3.0, 1.0, None],
    }
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    at = [0.0, 0.025, 0.25, 0.5, 0.9, 0.975, 1.0]
    want = {x.g: list(x)[1:] for x in rows.groupBy("g").agg(*[F.percentile("v", F.lit(q)).alias(f"q{i}") for i, q in enumerate(at)]).collect()}
    got = {x.g: list(x)[1:] for x in quantiles.exact_quantiles(rows, "v", at, "g", most=most).collect()}
    assert set(got) == set(want) - {"none"}
    for g, values in got.items():
        assert values == pytest.approx(want[g], rel=1e-12), g


def test_quantiles_of_all_rows_and_whole_numbers(spark):
    rows = spark.range(10_001).select((F.col("id") * 7919 % 10_007).alias("v"))
    want = rows.agg(F.percentile("v", F.lit(0.5)).alias("a"), F.percentile("v", F.lit(0.333)).alias("b")).first()
    got = quantiles.exact_quantiles(rows, "v", [0.5, 0.333], most=200).first()
    assert list(got) == pytest.approx(list(want))
    assert quantiles.exact_quantiles(rows.limit(0), "v", [0.5]).collect() == []


def test_censuses_with_quantiles(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 9), (None, 4), (None, 5), ("b", None)], "ns string, size int")
    got = {r.ns: (r.tasks, r.median, r.most) for r in pools.distribution(rows, "size", "ns").collect()}
    assert got == {"a": (3, 2.0, 9), None: (2, 4.5, 5), "b": (1, None, None)}
    right = spark.createDataFrame([(True, 0.1), (True, 0.2), (None, 0.4), (False, None)], "ok boolean, confidence double")
    assert {r.correct: (r.n, r.q2) for r in paired.confidence_distribution(right, "ok").collect()} == {True: (2, pytest.approx(0.15)), None: (1, 0.4), False: (1, None)}


def test_draws_are_the_hashes_that_sql_repeats(spark):
    r = random.Random(3)
    rows = [(s, f"{s}::{k}", r.randrange(9), r.random()) for s, n in (("x", 7), ("y", 1), (None, 3)) for k in range(n)]
    sources = spark.createDataFrame(rows, "stratum string, source string, c long, e double")
    by = {s: sorted((x for x in rows if x[0] == s), key=lambda x: x[1]) for s in ("x", "y", None)}
    grid = spark.range(1, 41).withColumnRenamed("id", "b").join(sources.groupBy("stratum").agg(F.count(F.lit(1)).alias("size")))
    drawn = grid.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1))).select("b", "stratum", draw(F.col("size"), 5, F.col("b"), F.col("stratum"), F.col("j")).alias("i")).collect()
    want = {}
    for d in drawn:
        x = by[d.stratum][d.i]
        c, e = want.get((d.b, d.stratum), (0, 0.0))
        want[d.b, d.stratum] = (c + x[2], e + x[3])
    got = {(x.b, x.stratum): (x.c, x.e) for x in paired.replicates(sources, ["c", "e"], 40, 5, "draws").collect()}
    assert set(got) == set(want) and all(got[k] == (want[k][0], pytest.approx(want[k][1])) for k in want)


def test_draws_are_for_few_sources(spark):
    many = spark.range(paired.FEW + 1).select(F.lit("all").alias("stratum"), F.col("id").cast("string").alias("source"), F.lit(1).cast("long").alias("n"))
    with pytest.raises(ValueError, match="at most"):
        paired.replicates(many, ["n"], 10, 0, "draws")
