"""Queries of answers that are code and of perturbed calls, over texts and calls that Spark derives from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.plans import SIZES, VOCABULARY, candidates, tasks
from plumbline.functions import texts as X
from plumbline.operators import repairs as R
from plumbline.plans import arguments as G

QUERIES, ORACLES = {}, {}


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


#: A caller, its candidates (the second is right; two share a name) and one answer for each case, by the part's key.
CONTEXT = "def run{K}(x):\n    y = __CALL_TARGET__(x, {N})\n    return y"
CANDIDATES = ["f{K}(a, b)\ndef f{K}(a, b):\n    return a", "g{K}(a, b)\ndef g{K}(a, b=1):\n    return b", "h{K}(a)\ndef h{K}(a):\n    return a", "d{K}(a)", "m.py::d{K}(a, b)"]
REPAIRS = {
    "ok": "def run{K}(x):\n    y = g{K}(x, {N})\n    return y",
    "ok ": "```python\ndef run{K}( x ):\n  y = g{K}(x,{N})   # done\n  return (y)\n```",
    "invalid_python": "def run{K}(x:\n    return g{K}(x, {N})",
    "wrong_function": "async def run{K}(x):\n    y = g{K}(x, {N})\n    return y",
    "placeholder_remaining": "def run{K}(x):\n    y = __CALL_TARGET__(x, {N})\n    return y",
    "wrong_target": "def run{K}(x):\n    y = f{K}(x, {N})\n    return y",
    "unrelated_change": "def run{K}(x):\n    y = g{K}(x, {N})\n    return y + 1",
    "unsupported_task": "def run{K}(x):\n    y = g{K}(x, {N})\n    return y",
}
CALLS = {
    "ok": "g{K}(x, {N})",
    "ok ": "```\n`g{K}(x,{N});`\n```",
    "invalid_call_expression": "g{K}(x, {N}) + 1",
    "unknown_target": "run{K}(x, {N})",
    "ambiguous_target": "d{K}(x, {N})",
    "unbindable_call": "h{K}(x, {N})",
    "wrong_target": "f{K}(x, {N})",
    "wrong_arguments": "g{K}({N}, x)",
    "unsupported_task": "g{K}(x, {N})",
}


def answers(spark, d, cases):
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{K}"), F.col("p_partkey").cast("string")), F.lit("{N}"), F.col("p_size").cast("string"))
    case = (F.col("p_partkey") % len(cases)).cast("int")
    params = lambda either, req: F.struct(F.array().cast("array<string>").alias("positional_only"), F.array(*map(F.lit, either)).alias("positional_or_keyword"), F.array().cast("array<string>").alias("keyword_only"), F.array(*map(F.lit, req)).alias("required"), F.lit(False).alias("has_vararg"), F.lit(False).alias("has_kwarg"))
    both, one = params("ab", "ab"), params("a", "a")
    # the file is small, its texts and their parsing are not: one task must not do them all
    parts = G.spread(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size"), "p_partkey")
    return parts.select(
        "p_partkey", "p_size", F.when(case == len(cases) - 1, "other").otherwise("python.hard_masked_direct_call").alias("task"), fill(CONTEXT).alias("context"),
        F.array(*map(fill, CANDIDATES)).alias("candidates"), F.array(both, params("ab", "a"), one, one, both).alias("params"), F.lit(1).alias("answer_index"), F.get(F.array(*map(fill, cases.values())), case).alias("output"),
    )


def verdicts(cases) -> str:
    return "CASE p_partkey % " + str(len(cases)) + "".join(f" WHEN {k} THEN '{c.strip()}'" for k, c in enumerate(cases)) + " END"


@register("ver4_verify_repairs", f"SELECT p_partkey, {verdicts(REPAIRS)} AS reason FROM part")
def _(spark, d):
    return R.verify_repairs(answers(spark, d, REPAIRS)).select("p_partkey", "reason")


@register("ver5_verify_calls", f"SELECT *, CASE reason WHEN 'ok' THEN 1 WHEN 'unbindable_call' THEN 2 WHEN 'wrong_target' THEN 0 WHEN 'wrong_arguments' THEN 1 END AS target_index FROM (SELECT p_partkey, {verdicts(CALLS)} AS reason FROM part) x")
def _(spark, d):
    return R.verify_calls(answers(spark, d, CALLS)).select("p_partkey", "reason", "target_index")


@register("join18_callee_matches", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '3,4' ELSE '' END AS matches FROM part")
def _(spark, d):
    name = F.concat(F.element_at(F.array(F.lit("g"), F.lit("d"), F.lit("run")), (F.col("p_partkey") % 3 + 1).cast("int")), F.col("p_partkey").cast("string"))
    return answers(spark, d, CALLS).select("p_partkey", F.array_join(R.matching(F.col("candidates"), name), ",").alias("matches"))


@register("txt12_prompts", f"""SELECT p_partkey, p_partkey % 2 = 0 AS recommends, NOT contains(why, 'g') AS feeds, true AS numbered, true AS names, true AS blind FROM (SELECT p_partkey, CASE WHEN {verdicts(CALLS)} = 'ok' THEN 'g' ELSE '' END AS why FROM part) x""")
def _(spark, d):
    x = R.verify_calls(answers(spark, d, CALLS))
    bad = F.col("reason") != "ok"
    rest = {"recommendation": F.when(F.col("p_partkey") % 2 == 0, F.lit(2)), "previous": F.when(bad, F.col("output")), "why": F.when(bad, F.col("reason"))}
    made = [f(F.col("context"), F.col("candidates"), **rest) for f in (X.repair_prompt, X.call_prompt)] + [X.plan_prompt(F.col("context"), F.col("candidates"), F.array(F.lit("a"), F.lit("b")), **rest)]
    every = lambda test: F.forall(F.array(*made), test)
    return x.select(
        "p_partkey", every(lambda t: t.contains("Recommended: 3")).alias("recommends"), every(lambda t: t.contains("Last answer:\n")).alias("feeds"), every(lambda t: t.contains("\n\n5. m.py::d")).alias("numbered"),
        made[2].contains("Names: a, b").alias("names"), every(lambda t: ~F.substring_index(t, "Last answer", -1).contains("answer is")).alias("blind"),
    )


# Perturbed calls of the plan tasks: the right candidate takes (a0, q0, q1).
KINDS = "list_filter(['bogus_keyword', 'keywordize', 'rename_keyword', 'swap'], lambda x: CASE x WHEN 'bogus_keyword' THEN p + k > 0 WHEN 'keywordize' THEN p > 0 AND NOT (p = 3 AND k = 2) WHEN 'rename_keyword' THEN k > 0 ELSE p > 1 END)"


def perturbable(spark, d):
    right = candidates(spark, d).where("cand_idx = 1").select("task_id", F.col("params").alias("target"))
    return G.spread(tasks(spark, d)).hint("merge").join(right, "task_id").withColumns({"seen": F.col("task_id").cast("string"), "answer_index": F.lit(1)})


@register("arg3_perturbations", f"SELECT task_id, unnest({KINDS}) AS kind, true AS restores, true AS differs FROM {SIZES} s")
def _(spark, d):
    x = perturbable(spark, d).withColumn("o", F.explode(G.perturbations(F.col("call"), F.col("vocabulary"), F.col("target"), F.col("receiver"), 0, F.col("seen"))))
    return x.select("task_id", "o.kind", G.apply_op(F.col("o.call"), F.col("o.op")).eqNullSafe(F.col("call")).alias("restores"), (~F.col("o.call").eqNullSafe(F.col("call"))).alias("differs"))


SEMANTIC = f"list_filter({KINDS}, lambda x: x <> 'keywordize')"
CHOSEN = f"(SELECT task_id, ks[1 + ('0x' || substr(md5(concat_ws(':', 'kind', 0, task_id)), 1, 8))::BIGINT % len(ks)] AS kind FROM (SELECT task_id, {SEMANTIC} AS ks FROM {SIZES} s) t WHERE len(ks) > 0)"


@register("arg5_perturbed_tasks", f"SELECT task_id, kind AS perturbation, 1 AS cand FROM {CHOSEN} c")
def _(spark, d):
    return G.perturbed(perturbable(spark, d)).select("task_id", "perturbation", "restoring.cand")


@register("arg4_label_dependent", f"SELECT task_id, 'keywordize' AS kind FROM {SIZES} s WHERE list_contains({KINDS}, 'keywordize')")
def _(spark, d):
    return G.label_dependent(perturbable(spark, d), candidates(spark, d), G.SEMANTIC + G.FORM)


# The plan space row by row: what is left of a call after each operation, and which candidates take it.
NAMES = f"(SELECT task_id, p, list_slice(['k0', 'q1'], 1, k) AS nm, list_filter({VOCABULARY}, lambda v: NOT list_contains(list_slice(['k0', 'q1'], 1, k), v)) AS un FROM {SIZES} s)"
EDITED = f"""(SELECT task_id, true AS keep, p, nm FROM {NAMES} n UNION ALL SELECT task_id, false, p, nm FROM (SELECT *, unnest(range(0, p * (p - 1) // 2)) AS i FROM {NAMES} n) a
  UNION ALL SELECT task_id, false, p + x, list_filter(nm, lambda y: y <> n) FROM (SELECT *, unnest(nm) AS n FROM {NAMES} n) b, (SELECT unnest([0, 1]) AS x) c
  UNION ALL SELECT task_id, false, p, list_append(list_filter(nm, lambda y: y <> n), v) FROM (SELECT *, unnest(un) AS v FROM (SELECT *, unnest(nm) AS n FROM {NAMES} n) b) c
  UNION ALL SELECT task_id, false, p - 1, list_append(nm, v) FROM (SELECT *, unnest(un) AS v FROM (SELECT *, unnest(range(0, p)) AS i FROM {NAMES} n) b) c)"""


def _takes(either: str, only: str, required: str, more: str) -> str:
    given = f"list_slice({either}, 1, p)"
    return f"((p <= len({either}) OR {more}) AND len(list_filter(nm, lambda n: list_contains({given}, n) OR NOT (list_contains({either}, n) OR list_contains({only}, n)))) = 0 AND (list_contains({given}, {required}) OR list_contains(nm, {required})))"


TAKES = f"(SELECT task_id, keep, unnest([{_takes(str(['a0']), '[]::VARCHAR[]', chr(39) + 'a0' + chr(39), 'false')}, {_takes(str(['a0', 'q0', 'q1']), '[]::VARCHAR[]', chr(39) + 'a0' + chr(39), 'false')}, {_takes('[]::VARCHAR[]', str(['k0', 'k1']), chr(39) + 'k1' + chr(39), 'true')}]) AS ok, unnest([0, 1, 2]) AS cand FROM {EDITED} e)"
PER_TASK = f"""(SELECT task_id, CAST(sum(n) AS BIGINT) AS space, CAST(sum(m) AS BIGINT) AS binding, count(*) FILTER (WHERE m > 0) AS surviving, max(m) AS most, bool_or(r) AS r FROM (
  SELECT task_id, cand, count(*) AS n, count(*) FILTER (WHERE ok) AS m, bool_or(ok AND keep AND cand = 1) AS r FROM {TAKES} t GROUP BY task_id, cand) c GROUP BY task_id)"""
CENSUS = f"SELECT task_id, space AS plan_space_size, binding AS binding_plans, surviving AS surviving_candidates, r AS restoring_plan_binds, binding = 1 AND r AS solved_by_predicate, surviving = 3 AND most = 1 AS pure_selection, surviving > 0 AND most = 1 AS at_most_one_per_survivor FROM {PER_TASK} p"


@register("arg7_binding_plans", f"SELECT task_id, binding FROM {PER_TASK} p WHERE binding > 0")
def _(spark, d):
    return G.binding_plans(tasks(spark, d), candidates(spark, d)).groupBy("task_id").agg(F.count(F.lit(1)).alias("binding"))


@register("arg8_predicate_census", CENSUS)
def _(spark, d):
    return G.predicate_census(tasks(spark, d), candidates(spark, d))


@register("arg10_chance_baselines", f"SELECT task_id, 1 / plan_space_size AS uniform, CASE WHEN restoring_plan_binds THEN 1 / binding_plans ELSE 0 END AS feasible_uniform FROM ({CENSUS}) c")
def _(spark, d):
    return G.chance_baselines(G.predicate_census(tasks(spark, d), candidates(spark, d)))


MEASURES = ("plan_space_size", "binding_plans", "surviving_candidates", "restoring_plan_binds", "solved_by_predicate", "pure_selection", "at_most_one_per_survivor")


@register("cen9_operation_census", f"""SELECT 'decisions' AS measure, '' AS kind, count(*) AS n, CAST(NULL AS DOUBLE) AS value FROM part UNION ALL SELECT 'applicable', kind, count(*), NULL FROM (SELECT unnest({KINDS}) AS kind FROM {SIZES} s) a GROUP BY kind
  UNION ALL SELECT 'chosen', kind, count(*), NULL FROM {CHOSEN} c GROUP BY kind""" + "".join(f" UNION ALL SELECT '{m}', '', count(*), round(avg(CAST({m} AS DOUBLE)), 9) FROM ({CENSUS}) c" for m in MEASURES))
def _(spark, d):
    x = perturbable(spark, d)
    return G.operation_census(x, G.perturbed(x), G.predicate_census(tasks(spark, d), candidates(spark, d))).withColumn("value", F.round("value", 9))
