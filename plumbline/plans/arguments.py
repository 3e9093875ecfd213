"""Closed-vocabulary argument plans: parse, apply, enumerate, prune, rank and try, as column expressions and joins.

A call is struct<args array<struct<text, starred>>, keywords array<struct<name, value>>> (a null name is `**`); a plan
is a candidate index and one operation, an array of strings whose positions count from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import binding as B
from plumbline.functions.expressions import draw, let
from plumbline.functions.selection import stripped, unfenced

CALL = "struct<args:array<struct<text:string,starred:boolean>>,keywords:array<struct<name:string,value:string>>>"

#: The plan language's operations and their operands (a position or a name).
OPERANDS = {"keep": "", "swap": "pp", "drop": "n", "rename": "nn", "name": "pn", "unname": "n"}


def parse_plan(text: Column, n_candidates: Column) -> Column:
    """struct<cand, op> of `candidate k; op`, or null; swaps are put in ascending order.

    The text is lower-cased first, so names with capitals are never in a vocabulary.
    """
    operand = {"p": r"\s+(\d+)", "n": r"\s+([a-z_]\w*)"}
    clean = F.regexp_replace(stripped(F.regexp_replace(unfenced(text), r"\A`+|`+\z", "")), r"\.+\z", "")
    parts = F.transform(F.split(F.lower(clean), ";"), lambda x: stripped(x))
    k = F.regexp_extract(F.get(parts, F.lit(0)), r"(?U)\Acandidate\s+(\d+)\z", 1).try_cast("int")
    said = F.get(parts, F.lit(1))
    op = F.lit(None).cast("array<string>")
    for name, kinds in OPERANDS.items():
        pattern = r"(?U)\A" + name + "".join(operand[x] for x in kinds) + r"\z"
        found = F.array(F.lit(name), *[F.regexp_extract(said, pattern, i + 1) for i in range(len(kinds))])
        if name == "swap":
            a, b = (F.get(found, F.lit(i)).try_cast("int") for i in (1, 2))
            found = F.when(a != b, F.array(F.lit(name), F.least(a, b).cast("string"), F.greatest(a, b).cast("string")))
        op = F.coalesce(op, F.when(said.rlike(pattern), found))
    return F.when((F.size(parts) == 2) & k.between(1, n_candidates) & op.isNotNull(), F.struct((k - 1).alias("cand"), op.alias("op")))


def operands_known(op: Column, vocabulary: Column) -> Column:
    """Whether all names of an operation are in the vocabulary."""
    kind = F.get(op, F.lit(0))
    names = F.when(kind.isin("drop", "unname"), F.slice(op, 2, 1)).when(kind == "rename", F.slice(op, 2, 2)).when(kind == "name", F.slice(op, 3, 1)).otherwise(F.array().cast("array<string>"))
    return F.forall(names, lambda n: F.array_contains(vocabulary, n))


def apply_op(call: Column, op: Column) -> Column:
    """The call after the operation, or null where it does not apply."""
    at = lambda i: F.get(op, F.lit(i))
    arg = lambda i: F.get(call["args"], i)
    kind = at(0)
    has = lambda n: F.coalesce(F.exists(call["keywords"], lambda k: k["name"] == n), F.lit(False))
    i, j = at(1).try_cast("int") - 1, at(2).try_cast("int") - 1
    free = lambda x: F.coalesce((x >= 0) & ~arg(x)["starred"], F.lit(False))
    made = lambda args, kws: F.struct(args.alias("args"), kws.alias("keywords"))
    without = lambda n: F.filter(call["keywords"], lambda k: ~k["name"].eqNullSafe(n))
    swapped = F.transform(call["args"], lambda a, k: F.when(k == i, arg(j)).when(k == j, arg(i)).otherwise(a))
    renamed = F.transform(call["keywords"], lambda k: F.struct(F.when(k["name"] == at(1), at(2)).otherwise(k["name"]).alias("name"), k["value"].alias("value")))
    named = F.concat(call["keywords"], F.array(F.struct(at(2).alias("name"), arg(i)["text"].alias("value"))))
    plain = F.size(F.filter(call["args"], lambda a: ~a["starred"]))
    value = F.get(F.filter(call["keywords"], lambda k: k["name"] == at(1)), F.lit(0))["value"]
    moved = F.concat(F.slice(call["args"], 1, plain), F.array(F.struct(value.alias("text"), F.lit(False).alias("starred"))), F.slice(call["args"], plain + 1, F.size(call["args"])))
    first = F.array_position(F.transform(call["keywords"], lambda k: k["name"]), at(1)).cast("int")
    but_first = F.filter(call["keywords"], lambda k, n: n != first - 1)
    rest = F.filter(call["args"], lambda a, k: k != i)
    return (
        F.when(kind == "keep", made(call["args"], call["keywords"]))
        .when((kind == "swap") & (i != j) & free(i) & free(j), made(swapped, call["keywords"]))
        .when((kind == "drop") & has(at(1)), made(call["args"], without(at(1))))
        .when((kind == "rename") & has(at(1)) & ~has(at(2)), made(call["args"], renamed))
        .when((kind == "name") & free(i) & ~has(at(2)), made(rest, named))
        .when((kind == "unname") & has(at(1)), made(moved, but_first))
    )


def call_shape(call: Column, receiver: Column) -> Column:
    names = F.transform(call["keywords"], lambda k: k["name"])
    return F.struct(
        F.size(F.filter(call["args"], lambda a: ~a["starred"])).alias("positional"), F.array_distinct(F.filter(names, lambda n: n.isNotNull())).alias("keywords"),
        F.exists(call["args"], lambda a: a["starred"]).alias("starred"), F.exists(names, lambda n: n.isNull()).alias("double_starred"), receiver.alias("receiver"),
    )


def operations(call: Column, vocabulary: Column) -> Column:
    """All operations that apply, in the plan space's order."""
    names = F.filter(F.transform(call["keywords"], lambda k: k["name"]), lambda n: n.isNotNull())
    unused = F.filter(F.array_sort(vocabulary), lambda v: ~F.array_contains(names, v))
    p = F.size(F.filter(call["args"], lambda a: ~a["starred"]))
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    s = lambda x: x.cast("string")
    one = F.lit(1)

    def all_of(x: Column) -> Column:
        names, unused = x["names"], x["unused"]
        swaps = F.flatten(F.transform(upto(one, p), lambda i: F.transform(upto(i + 1, p), lambda j: F.array(F.lit("swap"), s(i), s(j)))))
        keyed = F.flatten(F.transform(names, lambda n: F.concat(F.array(F.array(F.lit("drop"), n), F.array(F.lit("unname"), n)), F.transform(unused, lambda v: F.array(F.lit("rename"), n, v)))))
        named = F.flatten(F.transform(upto(one, p), lambda i: F.transform(unused, lambda v: F.array(F.lit("name"), s(i), v))))
        return F.concat(F.array(F.array(F.lit("keep"))), swaps, keyed, named)

    return let(F.struct(names.alias("names"), unused.alias("unused")), all_of)


def spread(tasks: DataFrame, key: str = "task_id") -> DataFrame:
    """tasks dealt by their key to as many parts as the session shuffles to.

    Tasks are short and their plans are many: a file of a few megabytes is read by one task, which must not work out all
    plans.  What is grouped or joined by the key later on needs no shuffle of the plans.
    """
    return tasks.repartition(int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def plan_space(tasks: DataFrame, *more: str) -> DataFrame:
    """(task_id, plan_idx, cand_idx, op): candidates times operations, ids and names only, and columns of tasks that are named."""
    ops = spread(tasks).select("task_id", *more, "n_candidates", operations(F.col("call"), F.col("vocabulary")).alias("ops"))
    cand = ops.withColumn("cand_idx", F.explode(F.sequence(F.lit(0), F.col("n_candidates") - 1)))
    plans = cand.select("task_id", *more, "cand_idx", F.size("ops").alias("n"), F.posexplode("ops").alias("k", "op"))
    return plans.select("task_id", (F.col("cand_idx") * F.col("n") + F.col("k")).alias("plan_idx"), "cand_idx", "op", *more)


def _bound(tasks: DataFrame, candidates: DataFrame, *more: str) -> DataFrame:
    """(task_id, cand_idx, n, bound, more): how many operations there are, and array<struct<k, op>> of those that bind the candidate.

    What an operation makes of a call is looked at once for all candidates.  Tasks and candidates meet by a shuffle: their
    size is not told by that of the file, so neither may be sent whole.
    """
    made = lambda op: let(apply_op(F.col("call"), op), lambda c: call_shape(c, F.col("receiver")))
    ops = spread(tasks).withColumn("_ops", operations(F.col("call"), F.col("vocabulary")))
    ops = ops.withColumn("_made", F.transform("_ops", lambda op, k: F.struct(k.alias("k"), op.alias("op"), made(op).alias("shape"))))
    met = ops.select("task_id", "n_candidates", "_made", *more).hint("merge").join(candidates.select("task_id", "cand_idx", "params"), "task_id").where("cand_idx >= 0 AND cand_idx < n_candidates")
    fits = F.filter("_made", lambda m: B.allowed(F.col("params"), F.array(m["shape"])))
    return met.select("task_id", "cand_idx", F.size("_made").alias("n"), F.transform(fits, lambda m: F.struct(m["k"].alias("k"), m["op"].alias("op"))).alias("bound"), *more)


def binding_plans(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Plans of the space that bind their candidate (task_id, cand_idx, params)."""
    plans = _bound(tasks, candidates).select("task_id", "cand_idx", "n", F.inline("bound"))
    return plans.select("task_id", (F.col("cand_idx") * F.col("n") + F.col("k")).alias("plan_idx"), "cand_idx", "op")


def _binding_counts(tasks: DataFrame, candidates: DataFrame, *more: str) -> DataFrame:
    """(task_id, cand_idx, n, r, more): how many plans bind each candidate, and whether the restoring one is among them; none without any."""
    hit = F.exists("bound", lambda m: (F.col("cand_idx") == F.col("restoring.cand")) & (m["op"] == F.col("restoring.op")))
    per = _bound(tasks, candidates, "restoring", *more).where(F.size("bound") > 0)
    return per.groupBy("task_id", "cand_idx", *more).agg(F.sum(F.size("bound")).alias("n"), F.bool_or(hit).alias("r"))


def predicate_census(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """What bindability leaves of each task's plans; restoring: tasks' struct<cand, op>."""
    g = _binding_counts(tasks, candidates).groupBy("task_id").agg(F.sum("n").alias("binding_plans"), F.count(F.lit(1)).alias("surviving"), F.max("n").alias("most"), F.bool_or("r").alias("r"))
    size = F.col("n_candidates") * F.size(operations(F.col("call"), F.col("vocabulary")))
    x = spread(tasks.select("task_id", "n_candidates", "call", "vocabulary")).select("task_id", "n_candidates", size.cast("long").alias("plan_space_size")).hint("merge").join(g, "task_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return x.select(
        "task_id", "plan_space_size", z("binding_plans").alias("binding_plans"), z("surviving").alias("surviving_candidates"), F.coalesce("r", F.lit(False)).alias("restoring_plan_binds"),
        ((z("binding_plans") == 1) & F.coalesce("r", F.lit(False))).alias("solved_by_predicate"), ((z("surviving") == F.col("n_candidates")) & (z("most") == 1)).alias("pure_selection"),
        ((z("surviving") > 0) & (z("most") == 1)).alias("at_most_one_per_survivor"),
    )


def chance_baselines(census: DataFrame) -> DataFrame:
    """Expected success of choosing uniformly from the space, and from the plans that bind."""
    return census.select("task_id", (1 / F.col("plan_space_size")).alias("uniform"), F.when(F.col("restoring_plan_binds"), 1 / F.col("binding_plans")).otherwise(F.lit(0.0)).alias("feasible_uniform"))


def recommended_baselines(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """(task_id, recommended_feasible_uniform, position_prior): chance among the recommended candidate's binding plans, and of the first plan.

    tasks: as plan_space has them, with restoring and recommendation (an index, or null: then the chance is null).  The
    first plan is the first candidate with nothing changed.
    """
    x = spread(tasks)
    wanted = candidates.select("task_id", "cand_idx", "params").join(x.select("task_id", "recommendation").hint("merge"), "task_id").where("cand_idx = recommendation").drop("recommendation")
    g = _binding_counts(tasks, wanted).select("task_id", "n", F.col("r").alias("hit"))
    first = (F.col("restoring.cand") == 0) & (F.col("restoring.op") == F.array(F.lit("keep")))
    chance = F.when(F.col("recommendation").isNotNull(), F.when(F.col("hit"), 1 / F.col("n")).otherwise(F.lit(0.0)))
    return x.select("task_id", "recommendation", "restoring").hint("merge").join(g, "task_id", "left").select("task_id", chance.alias("recommended_feasible_uniform"), first.cast("double").alias("position_prior"))


#: Gates of a plan, in the order in which a reader's answer meets them.
GATES = ["syntax", "in_vocabulary", "applicable", "bindable", "candidate", "operation", "exact"]


def plan_gates(answers: DataFrame) -> DataFrame:
    """answers with a flag for each of GATES: what parses, knows its operands, applies, binds, names the target, restores the call, and all of it.

    answers: output, n_candidates, vocabulary, call, receiver, params array, symbols array, answer_index, expected call.
    A candidate of the target's name is the target, whatever its index; a flag that cannot be told is null.
    """
    x = answers.withColumn("_plan", parse_plan(F.col("output"), F.col("n_candidates")))
    x = x.withColumn("_call", F.when(F.col("_plan").isNotNull(), apply_op(F.col("call"), F.col("_plan.op"))))
    cand, made = F.col("_plan.cand"), F.col("_call")
    fits = B.allowed(F.get("params", cand), F.array(call_shape(made, F.col("receiver"))))
    flags = {
        "syntax": F.col("_plan").isNotNull(), "in_vocabulary": operands_known(F.col("_plan.op"), F.col("vocabulary")), "applicable": made.isNotNull(), "bindable": F.when(made.isNotNull(), fits),
        "candidate": F.get("symbols", cand) == F.get("symbols", F.col("answer_index")), "operation": F.when(made.isNotNull(), made.eqNullSafe(F.col("expected"))),
    }
    out = x.withColumns(flags | {"_cand": cand}).drop("_plan", "_call")
    every = F.lit(True)
    for g in GATES[:-1]:
        every = every & F.coalesce(F.col(g), F.lit(False))
    return out.withColumn("exact", every)


def verify_plans(answers: DataFrame) -> DataFrame:
    """answers (as plan_gates has them) with reason.

    Gates in order: invalid plan, inapplicable, unbindable, ok, wrong target, wrong operations.  Equality of the call
    and of the symbol's name is looked at before the index, so a like-named candidate is right.
    """
    x = plan_gates(answers)
    reason = (
        F.when(~F.col("syntax") | ~F.col("in_vocabulary"), "invalid_plan").when(~F.col("applicable"), "inapplicable_operation").when(~F.col("bindable"), "unbindable_call")
        .when(F.col("candidate") & F.col("operation"), "ok").when(F.col("_cand") != F.col("answer_index"), "wrong_target").otherwise("wrong_operations")
    )
    return x.withColumn("reason", reason).drop("_cand", *GATES)


#: Perturbations by name; those that depend on nothing but what a reader sees, and the one that uses the target.
SEMANTIC, FORM = ("bogus_keyword", "rename_keyword", "swap"), ("keywordize",)


def perturbations(call: Column, vocabulary: Column, target: Column, receiver: Column, seed: int, *seen: Column) -> Column:
    """All wrong calls that one operation restores: array<struct<kind, call, op>>, kinds in order; none for calls with stars.

    target holds the parameters of the right candidate (null if unreadable), which only keywordize looks at.  Names are
    drawn by a hash of the seed and of what a reader sees.
    """
    n, given = F.size(call["args"]), F.transform(call["keywords"], lambda k: k["name"])
    plain = ~F.exists(call["args"], lambda a: a["starred"]) & ~F.exists(given, lambda g: g.isNull())
    text = lambda c: c.cast("string")

    def with_names(x: Column) -> Column:
        spare, names = x["spare"], x["names"]
        pick = lambda kind: F.get(spare, draw(F.size(spare), kind, seed, *seen).cast("int"))
        last, first = F.element_at(names, -1), F.coalesce(F.get(call["args"], F.lit(0))["text"], F.get(call["keywords"], F.lit(0))["value"])
        bound = F.concat(target["positional_only"], target["positional_or_keyword"])
        key = F.get(bound, n - 1 + receiver.cast("int"))

        def option(when: Column, kind: str, made: Column, op: Column) -> Column:
            return F.when(when, F.struct(F.lit(kind).alias("kind"), made.alias("call"), op.alias("op")))

        bogus = F.struct(call["args"].alias("args"), F.concat(call["keywords"], F.array(F.struct(x["extra"].alias("name"), first.alias("value")))).alias("keywords"))
        swap = F.array(F.lit("swap"), text(n - 1), text(n))
        swapped = apply_op(call, swap)
        nameable = (n > 0) & F.array_contains(target["positional_or_keyword"], key) & ~F.array_contains(names, key)
        return F.filter(
            F.array(
                option((F.size(spare) > 0) & (n + F.size(names) > 0), "bogus_keyword", bogus, F.array(F.lit("drop"), x["extra"])),
                option(F.coalesce(nameable, F.lit(False)), "keywordize", apply_op(call, F.array(F.lit("name"), text(n), key)), F.array(F.lit("unname"), key)),
                option((F.size(spare) > 0) & (F.size(names) > 0), "rename_keyword", apply_op(call, F.array(F.lit("rename"), last, pick("rename"))), F.array(F.lit("rename"), pick("rename"), last)),
                option((n > 1) & ~swapped.eqNullSafe(call), "swap", swapped, swap),
            ),
            lambda o: o.isNotNull(),
        )

    spare = F.filter(vocabulary, lambda v: ~F.array_contains(given, v))
    extra = F.get(spare, draw(F.greatest(F.size(spare), F.lit(1)), "bogus", seed, *seen).cast("int"))
    empty = F.array().cast(f"array<struct<kind:string,call:{CALL},op:array<string>>>")
    return F.when(plain, let(F.struct(spare.alias("spare"), given.alias("names"), extra.alias("extra")), with_names)).otherwise(empty)


def perturbed(tasks: DataFrame, seed: int = 0, form_too: bool = False) -> DataFrame:
    """tasks (task_id, call, vocabulary, target, receiver, seen, answer_index) with perturbation, perturbed call and restoring plan; tasks without one go.

    The kind is drawn, like the names, from what a reader sees, never from the answer.
    """
    kinds = SEMANTIC + FORM if form_too else SEMANTIC
    found = perturbations(F.col("call"), F.col("vocabulary"), F.col("target"), F.col("receiver"), seed, F.col("seen"))
    x = tasks.withColumn("_o", F.filter(found, lambda o: o["kind"].isin(*kinds))).where(F.size("_o") > 0)
    x = x.withColumn("_c", F.get("_o", draw(F.size("_o"), "kind", seed, F.col("seen")).cast("int")))
    plan = F.struct(F.col("answer_index").alias("cand"), F.col("_c.op").alias("op"))
    kept = [c for c in tasks.columns if c not in ("perturbation", "perturbed", "restoring")]
    return x.select(*kept, F.col("_c.kind").alias("perturbation"), F.col("_c.call").alias("perturbed"), plan.alias("restoring"))


def label_dependent(tasks: DataFrame, params: DataFrame, kinds: tuple = SEMANTIC, seed: int = 0) -> DataFrame:
    """(task_id, kind) whose visible wrong call, or its absence, would be another one if another candidate were the answer.

    params: (task_id, cand_idx, params); every candidate is taken for the answer in turn.
    """
    turns = tasks.drop("target").join(params.select("task_id", F.col("params").alias("target")), "task_id")
    found = perturbations(F.col("call"), F.col("vocabulary"), F.col("target"), F.col("receiver"), seed, F.col("seen"))
    seen = lambda k: F.to_json(F.struct(F.get(F.filter(F.col("_o"), lambda o: o["kind"] == k), F.lit(0))["call"].alias("c")))
    each = turns.withColumn("_o", found).select("task_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), seen(k).alias("shown")) for k in kinds])).alias("x")).select("task_id", "x.*")
    return each.groupBy("task_id", "kind").agg(F.countDistinct("shown").alias("n")).where("n > 1").select("task_id", "kind")


def operation_census(tasks: DataFrame, chosen: DataFrame, census: DataFrame, seed: int = 0) -> DataFrame:
    """Long rows (measure, kind, n, value): decisions, applicable and chosen perturbations, and what bindability leaves, in shares and means."""
    found = perturbations(F.col("call"), F.col("vocabulary"), F.col("target"), F.col("receiver"), seed, F.col("seen"))
    count, none = F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("value")
    kinds = tasks.select(F.explode(found).alias("o")).groupBy(F.col("o.kind").alias("kind")).agg(count).select(F.lit("applicable").alias("measure"), "kind", "n", none)
    took = chosen.groupBy(F.col("perturbation").alias("kind")).agg(count).select(F.lit("chosen").alias("measure"), "kind", "n", none)
    totals = tasks.agg(count).select(F.lit("decisions").alias("measure"), F.lit("").alias("kind"), "n", none)
    means, flags = ("plan_space_size", "binding_plans", "surviving_candidates"), ("restoring_plan_binds", "solved_by_predicate", "pure_selection", "at_most_one_per_survivor")
    shares = census.agg(count, *[F.avg(F.col(c).cast("double")).alias(c) for c in (*means, *flags)])
    parts = ", ".join(f"'{c}', {c}" for c in (*means, *flags))
    per = shares.selectExpr("n", f"stack({len(means) + len(flags)}, {parts}) AS (measure, value)").select("measure", F.lit("").alias("kind"), "n", "value")
    return totals.unionByName(kinds).unionByName(took).unionByName(per)


def shown_position(original: Column, shift: Column, count: Column) -> Column:
    """Where a candidate appears when the order is turned by shift."""
    return F.pmod(original - shift, count)


def rotations(tasks: DataFrame, shifts: int) -> DataFrame:
    """(task_id, shift, order): the first `shifts` cyclic orders of each task's candidates."""
    s = tasks.withColumn("shift", F.explode(F.sequence(F.lit(0), F.least(F.lit(shifts), F.col("n_candidates")) - 1)))
    return s.select("task_id", "shift", F.transform(F.sequence(F.lit(0), F.col("n_candidates") - 1), lambda i: (i + F.col("shift")) % F.col("n_candidates")).alias("order"))


def reordered(tasks: DataFrame, shifts: int) -> DataFrame:
    """tasks (n_candidates, answer_index, restoring, candidates, more) shown in each of their first `shifts` cyclic orders.

    Candidates are turned, and the answer's and the restoring plan's index go with them, so that a turned task still
    verifies its own restoring plan.
    """
    turned = rotations(tasks, shifts).join(tasks, "task_id")
    at = lambda i: shown_position(i, F.col("shift"), F.col("n_candidates"))
    plan = F.struct(at(F.col("restoring.cand")).alias("cand"), F.col("restoring.op").alias("op"))
    return turned.withColumns({"candidates": F.transform("order", lambda i: F.get("candidates", i)), "answer_index": at(F.col("answer_index")), "restoring": plan})


def map_plans(scores: DataFrame, counts: DataFrame) -> DataFrame:
    """scores (task_id, shift, cand_idx as shown, more) with cand_idx as it was before the turn; counts: task_id, n_candidates."""
    return scores.join(counts, "task_id").withColumn("cand_idx", F.pmod(F.col("cand_idx") + F.col("shift"), F.col("n_candidates")).cast("int")).drop("n_candidates")


def rank_plans(scores: DataFrame, normalize: bool = False) -> DataFrame:
    """(task_id, plan_idx, cand_idx, score, rank): mean over shifts, per token if normalised; ties go by plan order."""
    v = F.col("log_probability") / F.greatest(F.col("tokens"), F.lit(1)) if normalize else F.col("log_probability")
    mean = scores.groupBy("task_id", "plan_idx", "cand_idx").agg(F.avg(v).alias("score"))
    return mean.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("score"), "plan_idx")))


def try_plans(ranked: DataFrame, max_attempts: int) -> DataFrame:
    """(task_id, success, attempts): plans in rank order (with ok) until one is right or the budget is gone."""
    g = ranked.where(F.col("rank") <= max_attempts).groupBy("task_id").agg(F.min(F.when(F.col("ok"), F.col("rank"))).alias("hit"), F.count(F.lit(1)).alias("n"))
    return g.select("task_id", F.col("hit").isNotNull().alias("success"), F.coalesce(F.col("hit").cast("long"), F.col("n")).alias("attempts"))


def try_paired(baseline: DataFrame, assisted: DataFrame, max_attempts: int) -> DataFrame:
    """(task_id, b_ok, b_attempts, a_ok, a_attempts): try_plans() of both arms' rankings of the same tasks, side by side."""
    arm = lambda ranked, p: try_plans(ranked, max_attempts).select("task_id", F.col("success").alias(f"{p}_ok"), F.col("attempts").alias(f"{p}_attempts"))
    return arm(baseline, "b").join(arm(assisted, "a"), "task_id")


def winner_histogram(ranked: DataFrame, count: int) -> DataFrame:
    """How often each candidate holds the first plan; empty bins are 0."""
    bins = ranked.sparkSession.range(count).select(F.col("id").alias("cand_idx"))
    won = ranked.where("rank = 1").groupBy(F.col("cand_idx").cast("long").alias("cand_idx")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(won, "cand_idx", "left").select("cand_idx", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def tied_winners(ranked: DataFrame, rel: float = 1e-9, least: float = 1e-12) -> DataFrame:
    """Tasks whose best score plans of two or more candidates share within tolerance."""
    best = F.max("score").over(Window.partitionBy("task_id"))
    near = F.abs(F.col("score") - best) <= F.greatest(F.lit(rel) * F.greatest(F.abs("score"), F.abs(best)), F.lit(least))
    return ranked.withColumn("_near", near).where("_near").groupBy("task_id").agg(F.countDistinct("cand_idx").alias("winners")).where("winners > 1").select("task_id")
