"""Queries and operators on rows that a cut would lose."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction
from itertools import permutations

from pyspark.sql import functions as F

from plumbline.catalog import evaluation, plans, splitting
from plumbline.functions.expressions import numbered, order_key
from plumbline.operators import ranking, splits
from plumbline.sources import files


def test_rank_plans_of_high_order_keys(spark, tmp_path):
    rows = [(k, n, 7, 5.0 * n, 3) for k in (1, 99_999_999, 100_000_000, 6_000_000_000) for n in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = plans.QUERIES["arg12_rank_plans"](spark, str(tmp_path)).collect()
    assert sorted((r.task_id, r.plan_idx) for r in got) == sorted((k, n) for k, n, *_ in rows)


def test_extract_long_file(spark):
    text = "def first(a):\n    return a\n\n\n" + "#" * 2_000_000 + "\n\n\ndef last(b):\n    return first(b)\n"
    facts = files.extract(spark.createDataFrame([("n", "long.py", text), ("n", "bad.py", "def"), ("n", "raw.py", None)], "namespace string, path string, content string")).cache()
    assert sorted(r.name for r in files.symbols(facts).collect()) == ["first", "last"]
    assert [(r.caller, r.callee) for r in files.calls(facts).collect()] == [("last", "first")]
    assert sorted((r.path, r.error) for r in files.quarantine(facts).collect()) == [("bad.py", "SyntaxError"), ("raw.py", "ValueError")]


def test_every_call_shape_is_judged(spark):
    data = "/root/testdata/sf0.001"
    shapes = [r.mask % 8 for r in splitting.pairs(spark, data).select("mask").distinct().collect()]
    got = splitting.QUERIES["flt2_all_sites_by_group"](spark, data).collect()
    whole = {r.p_partkey: r.bindable for r in splitting.QUERIES["flt2_all_sites"](spark, data).collect()}
    assert {r.site_group for r in got} == set(shapes) and len(set(shapes)) == 8
    assert whole == {k: all(r.bindable for r in got if r.p_partkey == k) for k in whole} and not all(r.bindable for r in got)


def required(ratio):
    for n in range(1, 10_001):
        few = min(k := round(n * ratio), n - k)
        if 2 * sum(math.comb(n, i) for i in range(few + 1)) / 2**n < 0.05:
            return n


def test_required_discordant_near_one_half(spark):
    got = {round(r.ratio, 2): r.required for r in evaluation.QUERIES["agg10_required_discordant_full"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {k / 100: required(0.5 + 4 * (k - 50) / 400) for k in range(54, 91, 4)}


def test_bootstraps_run_5000_replicates(spark):
    names = ["agg4_bootstrap_accuracy_full", "agg5_bootstrap_macro_full", "agg11_bootstrap_success_rate_delta_full"]
    got = [evaluation.QUERIES[k](spark, "/root/testdata/sf0.001").first() for k in names]
    assert all(r.samples == 5000 and r.lower <= r.estimate <= r.upper for r in got)


def one_by_one(groups, shares):
    """The balanced split a source at a time: the largest at the best start, each other where the cost is least."""
    total = sum(n for _, n, _ in groups)
    goal = [Fraction(total * s) for s in shares]
    scale = [max(t, Fraction(1)) for t in goal]
    on = [k for k in range(3) if goal[k] > 0]
    cost = lambda filled: sum(((filled[k] - goal[k]) / scale[k]) ** 2 for k in on)
    order = sorted(groups, key=lambda g: (-g[1], g[2], g[0]))
    starts = []
    for p in permutations(on):
        filled = [0, 0, 0]
        for k, g in zip(p, order, strict=False):
            filled[k] = g[1]
        starts.append((cost(filled), p, filled))
    _, p, filled = min(starts, key=lambda x: x[0])
    out = {g[0]: splits.SPLITS[k] for k, g in zip(p, order, strict=False)}
    for name, n, _ in order[len(on) :]:
        k = min(on, key=lambda k: cost([f + n * (i == k) for i, f in enumerate(filled)]))
        filled[k] += n
        out[name] = splits.SPLITS[k]
    return out


def test_balanced_split_is_that_of_one_source_at_a_time():
    rng = random.Random(4)
    for _ in range(150):
        groups = [(f"s{i}", rng.choice([1, 1, 1, 2, 3, rng.randint(1, 40)]), f"{rng.getrandbits(64):016x}") for i in range(rng.randint(3, 90))]
        shares = rng.choice([(0.7, 0.15, 0.15), (0.5, 0.25, 0.25), (0.8, 0.0, 0.2), (1 / 3, 1 / 3, 1 - 2 / 3)])
        total = sum(g[1] for g in groups)
        assert splits.assign_balanced(groups, {s: total * x for s, x in zip(splits.SPLITS, shares, strict=True)}) == one_by_one(groups, shares)


def test_balanced_split_of_rows(spark):
    rng = random.Random(5)
    rows = [(part, f"s{i}") for part, sources in (("a", 200), ("b", 40), (None, 30), ("c", 2)) for i in range(sources) for _ in range(rng.choice([1, 1, 1, 2, 5, 9]))]
    rows += [("a", None)] * 3  # a source like the others
    df = spark.createDataFrame(rows, "namespace string, source string").repartition(3)
    shares = (0.7, 0.15, 1 - 0.7 - 0.15)
    key = lambda s: hashlib.sha256(f"5:{s}".encode()).hexdigest()[:16] if s else "0" * 16
    for within in (None, "namespace"):
        got = splits.balanced_split(df, 5, within=within).collect()
        assert Counter((r.namespace, r.source) for r in got) == Counter(rows)
        found = {}
        for r in got:
            assert found.setdefault((r.namespace if within else "all", r.source), r.split) == r.split
        for part in {p for p, _ in found}:
            sizes = Counter(s for p, s in rows if not within or p == part)
            groups = [(s, n, key(s)) for s, n in sizes.items()]
            want = one_by_one(groups, shares) if len(groups) > 2 else dict.fromkeys(sizes, "train")
            assert {s: x for (p, s), x in found.items() if p == part} == want


def test_numbers_within_a_large_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 2).alias("k")).withColumn("h", order_key(3, F.col("id")))
    got = numbered(df, "at", ["k"], "h", "id", digits=1).collect()
    for k in (None, 0, 1):
        mine = sorted((r.h, r.at) for r in got if r.k == k)
        assert [at for _, at in mine] == list(range(len(mine)))
    assert len(got) == 3000
    sizes = Counter((r.k, r.batch) for r in ranking.batches(df.select("id", "k").withColumnRenamed("id", "task_id"), 32, 3).collect())
    assert all(n == 32 or b == max(x for j, x in sizes if j == k) for (k, b), n in sizes.items())


def test_stratified_sample_takes_repeated_rows(spark):
    df = spark.createDataFrame([(i % 4, "ab"[i % 2]) for i in range(40)], "task_id long, namespace string")
    assert splits.stratified_sample(df, 3, 17, "namespace").count() == 17 and splits.stratified_sample(df, 3, 90, "namespace").count() == 40
