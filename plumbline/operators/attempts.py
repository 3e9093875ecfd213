"""Verifying recorded attempts, replaying bounded loops over them, rolling them up and pairing arms.

attempts: task_id, arm, attempt_no, output, and the decision's task, n_candidates, answer_index (join them first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import selection as S


def verify(attempts: DataFrame) -> DataFrame:
    """attempts with selected_index, reason, valid; each row by itself."""
    out = attempts.withColumn("selected_index", S.candidate_index(F.col("output"), F.col("n_candidates")))
    return out.withColumn("reason", S.selection_reason(F.col("task"), F.col("selected_index"), F.col("answer_index"))).withColumn("valid", F.col("reason") == S.OK)


def verify_with_memory(attempts: DataFrame, rejected: str = "rejected") -> DataFrame:
    """As verify(), with an array column of candidates that are out."""
    out = attempts.withColumn("selected_index", S.candidate_index(F.col("output"), F.col("n_candidates")))
    reason = S.memory_reason(F.col("task"), F.col("selected_index"), F.col("answer_index"), F.col(rejected))
    return out.withColumn("reason", reason).withColumn("valid", F.col("reason") == S.OK)


def ranked_recommendation(ranking: Column, allowed: Column, rejected: Column) -> Column:
    """The best-ranked candidate that is allowed and not rejected, or null."""
    return F.get(F.filter(ranking, lambda i: F.get(allowed, i) & ~F.array_contains(rejected, i)), F.lit(0))


def replay(attempts: DataFrame, max_attempts: int = 3, memory: bool = True, ranking: str | None = None, allowed: str | None = None) -> DataFrame:
    """The attempts that a bounded loop would have made, with verdicts and what was rejected before each.

    A loop ends with its first success or its budget.  With memory, wrong selections are rejected for the rest of the
    loop; with a ranking, each turn's recommendation is derived anew.  One window over (task, arm) does it all: a
    rejected candidate is a distinct earlier wrong selection, so nothing is iterated.
    """
    before = Window.partitionBy("task_id", "arm").orderBy("attempt_no").rowsBetween(Window.unboundedPreceding, -1)
    base = verify(attempts)
    wrong = F.when(F.col("reason") == S.WRONG, F.col("selected_index"))
    out = base.withColumns({"rejected": F.array_sort(F.collect_set(wrong).over(before)), "_done": F.coalesce(F.max(F.col("valid").cast("int")).over(before), F.lit(0))})
    out = out.where((F.col("attempt_no") <= max_attempts) & (F.col("_done") == 0)).drop("_done")
    if memory:
        reason = S.memory_reason(F.col("task"), F.col("selected_index"), F.col("answer_index"), F.col("rejected"))
        out = out.withColumn("reason", reason).withColumn("valid", F.col("reason") == S.OK)
    if ranking:
        out = out.withColumn("recommendation", ranked_recommendation(F.col(ranking), F.col(allowed), F.col("rejected")))
    return out


def gated_at_first_turn(replayed: DataFrame, ranking: str) -> DataFrame:
    """(task_id, arm, gated): whether a hard constraint changed the first recommendation."""
    first = replayed.where("attempt_no = 1")
    return first.select("task_id", "arm", (~F.col("recommendation").eqNullSafe(F.get(ranking, F.lit(0)))).alias("gated"))


def outcomes(verified: DataFrame, *carry: str) -> DataFrame:
    """One row for each (task, arm): success, attempts_used, correction_turns, first_pass_success."""
    return verified.groupBy("task_id", "arm").agg(
        F.bool_or("valid").alias("success"), F.count(F.lit(1)).alias("attempts_used"), F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("correction_turns"),
        F.min_by("valid", "attempt_no").alias("first_pass_success"), F.min_by("reason", "attempt_no").alias("first_reason"), F.max_by("reason", "attempt_no").alias("terminal_reason"),
        F.min_by("selected_index", "attempt_no").alias("first_selected"), *[F.first(c).alias(c) for c in carry],
    )


def pair(outs: DataFrame, *carry: str, baseline: str = "baseline", assisted: str = "assisted") -> DataFrame:
    """One row for each task that both arms tried: b_* and a_* columns and the deltas."""
    of = lambda arm, name, c: F.max(F.when(F.col("arm") == arm, F.col(c))).alias(name)
    cols = [("ok", "success"), ("attempts", "attempts_used"), ("turns", "correction_turns"), ("first", "first_pass_success")]
    wide = outs.where(F.col("arm").isin(baseline, assisted)).groupBy("task_id").agg(
        *[of(arm, f"{k}_{n}", c) for k, arm in (("b", baseline), ("a", assisted)) for n, c in cols], *[F.first(c).alias(c) for c in carry]
    )
    both = wide.where("b_ok IS NOT NULL AND a_ok IS NOT NULL")
    return both.withColumns({"success_delta": F.col("a_ok").cast("int") - F.col("b_ok").cast("int"), "turn_delta": F.when(F.col("a_ok") & F.col("b_ok"), F.col("b_turns") - F.col("a_turns"))})


def funnel(attempts: DataFrame, gates: list[str], *keys: str) -> DataFrame:
    """(level, value, n, gates): how many rows pass each gate and all before it, by each key alone and in total.

    A row's depth is the number of gates that it passes before the first that stops it.  Rows are counted once by keys
    and depth; grouping sets over those counts give every level, so the table is read once however many keys there are.
    """
    depth = F.lit(len(gates))
    for i, g in reversed(list(enumerate(gates))):
        depth = F.when(F.coalesce(F.col(g), F.lit(False)), depth).otherwise(F.lit(i))
    names = [f"_k{i}" for i in range(len(keys))]
    rows = attempts.select(*[F.col(k).cast("string").alias(n) for k, n in zip(keys, names, strict=True)], depth.alias("_depth"))
    rows = rows.groupBy(*names, "_depth").agg(F.count(F.lit(1)).alias("_n"))
    sums = [F.sum("_n").alias("n"), *[F.coalesce(F.sum(F.when(F.col("_depth") > i, F.col("_n"))), F.lit(0)).alias(g) for i, g in enumerate(gates)]]
    total = rows.agg(*sums).select(F.lit("total").alias("level"), F.lit("").alias("value"), F.coalesce("n", F.lit(0)).alias("n"), *gates)
    if not keys:
        return total
    # an empty table has a total, too
    nothing = attempts.sparkSession.range(1).select(*[F.lit(None).cast("string").alias(n) for n in names], F.lit(0).alias("_depth"), F.lit(0).cast("long").alias("_n"))
    parts = rows.unionByName(nothing).groupingSets([[], *[[n] for n in names]], *names).agg(F.grouping_id(*names).alias("_id"), *sums)
    level, value = F.lit("total"), F.lit("")
    for i, (k, n) in enumerate(zip(keys, names, strict=True)):
        mine = F.col("_id") == (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i))
        level, value = F.when(mine, k).otherwise(level), F.when(mine, F.col(n)).otherwise(value)
    return parts.select(level.alias("level"), value.alias("value"), "n", *gates).where((F.col("level") == "total") | (F.col("n") > 0))


def conditional_entry(verified: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Tasks whose wrong recommendation was followed on the first turn: (task_id, arm)."""
    first = verified.where("attempt_no = 1")
    return first.join(recommendations, "task_id").where("recommendation <> answer_index AND selected_index = recommendation").select("task_id", "arm")


def transitions(verified: DataFrame) -> DataFrame:
    """Second turns after a wrong first one, by class."""
    w = Window.partitionBy("task_id", "arm").orderBy("attempt_no")
    x = verified.withColumns({"_last": F.lag("selected_index").over(w), "_was": F.lag("reason").over(w)})
    kind = F.when(F.col("valid"), "correct").when(F.col("selected_index").isNull(), "unparseable").when(F.col("selected_index") == F.col("_last"), "repeated_rejected").otherwise("different_wrong")
    return x.where((F.col("attempt_no") == 2) & (F.col("_was") == S.WRONG)).groupBy("arm", kind.alias("transition")).agg(F.count(F.lit(1)).alias("n"))
