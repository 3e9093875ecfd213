"""Queries of the argument-plan and text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.bridges import PAIRS, sql, view
from plumbline.catalog.evaluation import FAILS, FSUM, PR, SUMMARY, _outcomes, _recs
from plumbline.functions import texts as X
from plumbline.functions.selection import unfenced
from plumbline.operators import paired as P
from plumbline.plans import arguments as G

QUERIES, ORACLES = {}, {}


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


VOCABULARY = ["k0", "k1", "q0", "q1"]


def tasks(spark, d):
    """A call for each part: up to three positional arguments and two keywords."""
    n = F.col("p_size")
    args = F.transform(F.slice(F.array(*[F.lit(i) for i in range(3)]), 1, (n % 4).cast("int")), lambda i: F.struct(F.concat(F.lit("a"), i.cast("string")).alias("text"), F.lit(False).alias("starred")))
    kws = F.transform(F.slice(F.array(F.lit("k0"), F.lit("q1")), 1, (F.floor(n / 4) % 3).cast("int")), lambda k: F.struct(k.alias("name"), F.concat(F.lit("v"), k).alias("value")))
    call = F.struct(args.alias("args"), kws.alias("keywords"))
    restoring = F.struct(F.lit(1).alias("cand"), F.array(F.lit("keep")).alias("op"))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("task_id"), F.lit(3).alias("n_candidates"), call.alias("call"), F.array(*map(F.lit, VOCABULARY)).alias("vocabulary"), F.lit(False).alias("receiver"), restoring.alias("restoring"))


def candidates(spark, d):
    """Three candidates for each task: (a0), (a0, q0, q1) and (*, k0, k1 required) with arbitrary positionals."""
    made = lambda either, kw, req, va: F.struct(F.array().cast("array<string>").alias("positional_only"), either.alias("positional_or_keyword"), kw.alias("keyword_only"), req.alias("required"), F.lit(va).alias("has_vararg"), F.lit(False).alias("has_kwarg"))
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    p = F.array(made(a("a0"), a(), a("a0"), False), made(a("a0", "q0", "q1"), a(), a("a0"), False), made(a(), a("k0", "k1"), a("k1"), True))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("task_id"), F.posexplode(p).alias("cand_idx", "params"))


SIZES = "(SELECT p_partkey AS task_id, p_size % 4 AS p, (p_size // 4) % 3 AS k, 4 - (p_size // 4) % 3 AS u FROM part)"
SPACE = "3 * (1 + p * (p - 1) // 2 + k * (2 + u) + p * u)"


@register("arg1_parse_plan", """SELECT event_id, CASE event_type WHEN 'view' THEN 'keep' WHEN 'click' THEN CASE WHEN event_id % 3 = event_id % 4 THEN NULL ELSE 'swap,' || least(event_id % 3, event_id % 4) || ',' || greatest(event_id % 3, event_id % 4) END
  WHEN 'signup' THEN 'rename,k0,k1' WHEN 'error' THEN NULL ELSE 'name,2,k1' END AS op FROM events""")
def _(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    i, t = F.col("event_id"), F.col("event_type")
    said = F.when(t == "view", "Candidate 2; keep.").when(t == "click", F.format_string("candidate 1;  swap %d %d", i % 3, i % 4)).when(t == "signup", "```\ncandidate 3; RENAME k0 K1\n```").when(t == "error", "candidate 9; keep").otherwise("`candidate 1; name 2 k1`")
    return ev.select("event_id", F.array_join(G.parse_plan(said, F.lit(4))["op"], ",").alias("op"))


@register("arg6_plan_space", f"SELECT task_id, {SPACE} AS plans, {SPACE} AS distinct_plans FROM {SIZES} s")
def _(spark, d):
    x = G.plan_space(tasks(spark, d))
    return x.groupBy("task_id").agg(F.count(F.lit(1)).alias("plans"), F.countDistinct("cand_idx", "op").alias("distinct_plans"))


@register("arg2_applicable", f"SELECT task_id, {SPACE} AS applicable FROM {SIZES} s")
def _(spark, d):
    x = G.plan_space(tasks(spark, d), "call")
    return x.groupBy("task_id").agg(F.count_if(G.apply_op(F.col("call"), F.col("op")).isNotNull()).alias("applicable"))


@register("arg9_verify_plans", f"""SELECT task_id, CASE WHEN task_id % 3 = 0 THEN 'invalid_plan' WHEN task_id % 3 = 1 THEN CASE WHEN k = 0 THEN 'inapplicable_operation' WHEN p = 0 OR (k = 2 AND p = 3) THEN 'unbindable_call' ELSE 'wrong_operations' END
  WHEN p = 0 OR k > 0 THEN 'unbindable_call' ELSE 'ok' END AS reason FROM {SIZES} s""")
def _(spark, d):
    i = F.col("task_id")
    params = candidates(spark, d).groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cand_idx", "params"))), lambda x: x["params"]).alias("params"))
    x = tasks(spark, d).join(params, "task_id").withColumns({
        "output": F.when(i % 3 == 0, "candidate 2; drop nothing").when(i % 3 == 1, "candidate 2; drop k0").otherwise("candidate 2; keep"),
        "symbols": F.array(F.lit("f"), F.lit("g"), F.lit("h")), "answer_index": F.lit(1), "expected": F.col("call"),
    })
    return G.verify_plans(x).select("task_id", "reason")


@register("arg11_rotations", "SELECT task_id, shift, CAST((shift + 1) % 3 AS INT) AS second, CAST((3 + 1 - shift) % 3 AS INT) AS shown FROM (SELECT p_partkey AS task_id FROM part) p, (SELECT unnest(range(0, 3)) AS shift) s")
def _(spark, d):
    x = G.rotations(tasks(spark, d), 3)
    return x.select("task_id", F.col("shift").cast("long").alias("shift"), F.get("order", F.lit(1)).cast("int").alias("second"), G.shown_position(F.lit(1), F.col("shift"), F.lit(3)).alias("shown"))


SCORES = "SELECT l_orderkey AS task_id, l_linenumber AS plan_idx, l_linenumber % 3 AS cand_idx, CAST(l_suppkey % 4 AS BIGINT) AS shift, -(CAST(l_quantity AS BIGINT) % 5) / 1.0 AS log_probability, CAST(1 + l_partkey % 3 AS BIGINT) AS tokens FROM {lineitem}"
RANKED = f"(SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, plan_idx) AS rank FROM (SELECT task_id, plan_idx, cand_idx, round(avg(log_probability / tokens), 9) AS score FROM ({sql(SCORES)}) s GROUP BY 1, 2, 3) x)"


def ranked(spark, d):
    s = view(spark, d, SCORES).withColumn("log_probability", F.col("log_probability").cast("double"))
    return G.rank_plans(s, normalize=True)


@register("arg12_rank_plans", f"SELECT task_id, plan_idx, cand_idx, score FROM {RANKED} r")
def _(spark, d):
    return ranked(spark, d).select("task_id", "plan_idx", "cand_idx", F.round("score", 9).alias("score"))


@register("arg13_try_plans", "SELECT task_id, coalesce(min(CASE WHEN plan_idx % 4 = 0 AND rank <= 2 THEN rank END), 0) > 0 AS success, coalesce(min(CASE WHEN plan_idx % 4 = 0 AND rank <= 2 THEN rank END), least(2, count(*))) AS attempts FROM (SELECT task_id, plan_idx, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, plan_idx) AS rank FROM (SELECT l_orderkey AS task_id, l_linenumber AS plan_idx, -min(l_linenumber * 7 % 5) AS score FROM lineitem GROUP BY 1, 2) x) r GROUP BY task_id")
def _(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("plan_idx"), F.lit(0).alias("cand_idx"), (-(F.col("l_linenumber") * 7 % 5)).cast("double").alias("log_probability"), F.lit(1).alias("tokens"))
    return G.try_plans(G.rank_plans(li).withColumn("ok", F.col("plan_idx") % 4 == 0), 2)


TRIED = "(SELECT task_id, coalesce(min(CASE WHEN plan_idx % 4 = 0 AND rank <= 2 THEN rank END), 0) > 0 AS ok, coalesce(min(CASE WHEN plan_idx % 4 = 0 AND rank <= 2 THEN rank END), least(2, count(*))) AS attempts FROM (SELECT task_id, plan_idx, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, plan_idx) AS rank FROM (SELECT l_orderkey AS task_id, l_linenumber AS plan_idx, -min(l_linenumber * {turn} % 5) AS score FROM lineitem GROUP BY 1, 2) x) r GROUP BY task_id)"


@register("arg14_paired_plans", f"SELECT b.task_id, b.ok AS b_ok, b.attempts AS b_attempts, a.ok AS a_ok, a.attempts AS a_attempts FROM {TRIED.replace('{turn}', '7')} b JOIN {TRIED.replace('{turn}', '4')} a ON a.task_id = b.task_id")
def _(spark, d):
    def arm(turn):
        li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("plan_idx"), F.lit(0).alias("cand_idx"), (-(F.col("l_linenumber") * turn % 5)).cast("double").alias("log_probability"), F.lit(1).alias("tokens"))
        return G.rank_plans(li).withColumn("ok", F.col("plan_idx") % 4 == 0)

    return G.try_paired(arm(7), arm(4), 2)


@register("arg15_winner_histogram", "SELECT b.cand_idx, count(r.task_id) AS n FROM (SELECT unnest(range(0, 4)) AS cand_idx) b LEFT JOIN (SELECT task_id, plan_idx % 3 AS cand_idx, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, plan_idx) AS rank FROM (SELECT l_orderkey AS task_id, l_linenumber AS plan_idx, -min(l_linenumber * 7 % 5) AS score FROM lineitem GROUP BY 1, 2) x) r ON r.rank = 1 AND r.cand_idx = b.cand_idx GROUP BY b.cand_idx")
def _(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("plan_idx"), (F.col("l_linenumber") % 3).alias("cand_idx"), (-(F.col("l_linenumber") * 7 % 5)).cast("double").alias("log_probability"), F.lit(1).alias("tokens"))
    return G.winner_histogram(G.rank_plans(li), 4)


@register("arg16_tied_winners", "SELECT task_id FROM (SELECT task_id, cand_idx, score, max(score) OVER (PARTITION BY task_id) AS best FROM (SELECT l_orderkey AS task_id, l_linenumber AS plan_idx, l_linenumber % 3 AS cand_idx, -(min(l_linenumber) % 2) AS score FROM lineitem GROUP BY 1, 2, 3) x) y WHERE score = best GROUP BY task_id HAVING count(DISTINCT cand_idx) > 1")
def _(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("plan_idx"), (F.col("l_linenumber") % 3).alias("cand_idx"), (-(F.col("l_linenumber") % 2)).cast("double").alias("log_probability"), F.lit(1).alias("tokens"))
    return G.tied_winners(G.rank_plans(li))


# Texts.
def bench(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet")




@register("txt2_focused", """SELECT item_id, array_to_string(list_concat(list_concat(['def f(x):'], CASE WHEN lo > 0 THEN ['  # ... omitted before call site ...'] ELSE [] END), list_concat(list_transform(range(lo, hi + 1), lambda i: '  ' || CASE WHEN i = item_id % 20 OR i = 7 THEN '__CALL_TARGET__(' || i || ')' ELSE 'y' || i END),
  CASE WHEN hi < 19 THEN ['  # ... omitted after call site ...'] ELSE [] END)), chr(10)) AS text FROM (SELECT item_id, greatest(0, least(item_id % 20, 7) - 3) AS lo, least(19, greatest(item_id % 20, 7) + 3) AS hi FROM benchmark) b""")
def _(spark, d):
    line = lambda i: F.concat(F.lit("  "), F.when((i == F.col("item_id") % 20) | (i == 7), F.concat(F.lit("__CALL_TARGET__("), i.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("y"), i.cast("string"))))
    text = F.concat(F.lit("def f(x):\n"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), line), "\n"))
    return bench(spark, d).select("item_id", X.focused(text, 3).alias("text"))


@register("txt5_candidate_symbol", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN NULL ELSE 'f' || item_id END AS symbol FROM benchmark")
def _(spark, d):
    i = F.col("item_id")
    text = F.when(i % 3 == 0, F.col("text")).when(i % 3 == 1, F.concat(F.lit("pkg/a.py::f"), i.cast("string"), F.lit("(a, b)\nbody"))).otherwise(F.concat(F.lit("f"), i.cast("string"), F.lit("(a)")))
    return bench(spark, d).select("item_id", X.candidate_symbol(text).alias("symbol"))


@register("txt6_unfenced", "SELECT item_id, md5(trim(text, ' ' || chr(10))) AS digest FROM benchmark")
def _(spark, d):
    t = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("```python\n"), F.col("text"), F.lit("\n```\nrest"))).otherwise(F.concat(F.lit("  "), F.col("text"), F.lit(" ")))
    return bench(spark, d).select("item_id", F.md5(F.trim(unfenced(t))).alias("digest"))


@register("txt3_without_own_names", "SELECT item_id, 'def __CANDIDATE__(a)' || chr(10) || 'f' || item_id || 'x __CANDIDATE__' AS text FROM benchmark")
def _(spark, d):
    name = F.concat(F.lit("f"), F.col("item_id").cast("string"))
    one = F.concat(name, F.lit("(a)\n"), name, F.lit("x "), name)
    return bench(spark, d).select("item_id", F.concat(F.lit("def "), F.get(X.without_own_names(F.array(one)), F.lit(0))).alias("text"))


@register("txt8_edited", "SELECT item_id, 'x = g' || item_id % 2 || '(1)' AS text FROM benchmark")
def _(spark, d):
    return bench(spark, d).select("item_id", X.edited(F.lit("x = __CALL_TARGET__(1)"), F.array(F.lit("g0(a)"), F.lit("g1(b)")), (F.col("item_id") % 2).cast("int")).alias("text"))


@register("txt10_caller_name", "SELECT item_id, 'run' || item_id AS caller FROM benchmark")
def _(spark, d):
    return bench(spark, d).select("item_id", X.caller_name(F.concat(F.lit("# top\nasync def run"), F.col("item_id").cast("string"), F.lit("(x):\n  def inner(): pass"))).alias("caller"))


@register("txt11_selection_prompt", """SELECT item_id, 'ctx' || chr(10) || chr(10) || 'q?' || chr(10) || chr(10) || CASE WHEN item_id % 2 = 0 THEN '2. b' ELSE '1. a' END || chr(10) || '3. c' || chr(10) || chr(10) || 'Recommended: 3' || chr(10) || chr(10) || 'Answer with one number.' AS prompt FROM benchmark""")
def _(spark, d):
    p = X.selection_prompt(F.lit("ctx"), F.lit("q?"), F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array((F.col("item_id") % 2).cast("int")), F.lit(2))
    return bench(spark, d).select("item_id", p.alias("prompt"))


@register("snk2_paired_report", f"""SELECT namespace, metric, baseline, assisted FROM (SELECT namespace, unnest(['successes', 'first pass', 'only this arm', 'terminal failures', 'tasks', 'both', 'neither']) AS metric, unnest([baseline_successes, baseline_first_pass, baseline_only, tasks - baseline_successes, tasks, s.both, neither]) AS baseline,
  unnest([assisted_successes, assisted_first_pass, assisted_only, tasks - assisted_successes, tasks, s.both, neither]) AS assisted FROM (SELECT namespace, {SUMMARY} FROM {PR} p GROUP BY namespace) s) t""")
def _(spark, d):
    return X.paired_report(P.summarize(view(spark, d, PAIRS), "namespace"), "namespace")


@register("snk3_failure_report", f"""SELECT unnest(['tasks', 'assisted_failures', 'wrong_recommendations', 'correct_ignored', 'wrong_followed', 'recovery_failures', 'unparseable_first', 'terminal_unparseable']) AS metric, unnest([tasks, assisted_failures, wrong_recommendations, correct_ignored, wrong_followed, recovery_failures, unparseable_first, terminal_unparseable]) AS n FROM (SELECT {FSUM} FROM {FAILS} f) s""")
def _(spark, d):
    return X.failure_report(P.summarize_failures(P.failure_signatures(_outcomes(spark, d), _recs(spark, d))))
