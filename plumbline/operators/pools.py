"""Censuses over candidate pools.

members: corpus or namespace, task_id, bindable, is_target; one row for each candidate of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.quantiles import exact_quantiles


def predicate_census(members: DataFrame) -> DataFrame:
    """For each corpus: tasks with a veto, mean survivors, expected uniform successes before and after, vetoed truths (should be 0)."""
    return census_of_counts(
        members.groupBy("corpus", "task_id").agg(F.count(F.lit(1)).alias("pool"), F.count_if("bindable").alias("survivors"), F.count_if(F.col("is_target") & ~F.col("bindable")).alias("vetoed"))
    )


def census_of_counts(task: DataFrame) -> DataFrame:
    """predicate_census from a row for each task: corpus, task_id, pool, survivors, vetoed."""
    after = F.when(F.col("survivors") > 0, 1 / F.col("survivors")).otherwise(F.lit(0.0))
    return task.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("survivors") < F.col("pool")).alias("any_veto"), F.avg("survivors").alias("mean_survivors"),
        F.sum(1 / F.col("pool")).alias("uniform"), F.sum(after).alias("predicate_uniform"), F.sum("vetoed").alias("vetoed_truths"),
    )


def pool_census(members: DataFrame) -> DataFrame:
    """For each task and level: members, distinct renderings, those that bind, whether the target is among them and unique.

    members: task_id, level, rendering_hash, bindable, is_target.  Renderings are deduplicated by grouping first.
    """
    per = members.groupBy("task_id", "level", "rendering_hash").agg(F.count(F.lit(1)).alias("n"), F.bool_or("bindable").alias("bindable"), F.bool_or("is_target").alias("target"))
    g = per.groupBy("task_id", "level").agg(
        F.sum("n").alias("members"), F.count(F.lit(1)).alias("distinct"), F.count_if("bindable").alias("bindable"), F.coalesce(F.bool_or(F.col("target") & F.col("bindable")), F.lit(False)).alias("target_binds"),
        F.coalesce(F.max(F.when(F.col("target"), F.col("n"))), F.lit(0)).alias("like_target"),
    )
    return g.withColumn("unique", F.col("like_target") == 1).withColumn("uniform", F.when(F.col("bindable") > 0, 1 / F.col("bindable")).otherwise(F.lit(0.0)))


def _level(pool: DataFrame, wanted: DataFrame, prefix: str) -> DataFrame:
    """Counts of one pool by distinct rendering: size, bindable, and whether the wanted one is in, binds, binds once."""
    per = pool.groupBy("task_id", "rendering_hash").agg(F.count_if("bindable").alias("n")).join(wanted, "task_id")
    mine = F.col("rendering_hash") == F.col("wanted")
    g = per.groupBy("task_id").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("n") > 0).alias("bindable"), F.bool_or(mine).alias("target"), F.max(F.when(mine, F.col("n"))).alias("_like"))
    like = F.coalesce("_like", F.lit(0))
    return g.select("task_id", *[F.col(c).alias(f"{prefix}_{c}") for c in ("size", "bindable", "target")], (like >= 1).alias(f"{prefix}_target_binds"), (like == 1).alias(f"{prefix}_target_unique"))


def task_census(protocol: DataFrame, scope: DataFrame, repository: DataFrame, counted: bool = False) -> DataFrame:
    """A row for each task: what it shows, and what its scope and its repository hold, by distinct rendering.

    protocol: task_id, rendering_hash, is_target, the candidates shown; scope: task_id, ord, rendering_hash, shape,
    bindable, source ('local' or 'imported') and elsewhere, true for local members and for imported ones whose alias is
    read outside the caller; repository: task_id, rendering_hash, bindable; or, counted, what
    classes.repository_counts gives, which lists no member.  A task without members counts 0 and false.
    shape is any orderable value that is equal for equal call shapes.  scope_solved: bindability leaves the target alone;
    filter_resolves: no wrong candidate shown is in scope, but the target; independently: without its own import line.
    """
    wanted = protocol.where("is_target").select("task_id", F.col("rendering_hash").alias("wanted")).distinct()
    shown = protocol.groupBy("task_id").agg(F.count(F.lit(1)).alias("protocol_candidates"))
    inside = scope.select("task_id", "rendering_hash").distinct()
    negatives = protocol.where("NOT is_target").join(inside, ["task_id", "rendering_hash"], "left_semi").groupBy("task_id").agg(F.count(F.lit(1)).alias("protocol_negatives_in_scope"))
    kinds = scope.groupBy("task_id").agg(F.count_if(F.col("source") == "local").alias("scope_local"), F.count_if(F.col("source") == "imported").alias("scope_imported"))
    # a rendering's shape is that of its first member
    per = scope.groupBy("task_id", "rendering_hash").agg(F.min_by("shape", "ord").alias("shape"), F.bool_or("elsewhere").alias("elsewhere")).join(wanted, "task_id")
    mine = F.col("rendering_hash") == F.col("wanted")
    per = per.withColumn("_shape", F.max(F.when(mine, F.col("shape"))).over(Window.partitionBy("task_id")))
    shapes = per.groupBy("task_id").agg(F.count_if(F.col("shape") == F.col("_shape")).alias("scope_shape_matched"), F.coalesce(F.bool_or(mine & F.col("elsewhere")), F.lit(False)).alias("target_independent"))
    out = shown.join(wanted, "task_id")
    for part in (negatives, kinds, shapes, _level(scope, wanted, "scope"), repository if counted else _level(repository, wanted, "repository")):
        out = out.join(part, "task_id", "left")
    flags = ["target_independent", *[f"{level}_{c}" for level in ("scope", "repository") for c in ("target", "target_binds", "target_unique")]]
    numbers = ["protocol_negatives_in_scope", "scope_local", "scope_imported", "scope_shape_matched", *[f"{level}_{c}" for level in ("scope", "repository") for c in ("size", "bindable")]]
    out = out.select("task_id", "protocol_candidates", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], *[F.coalesce(c, F.lit(False)).alias(c) for c in flags])
    solved: Column = F.col("scope_target_binds") & (F.col("scope_bindable") == 1)
    resolves = F.col("scope_target") & (F.col("protocol_negatives_in_scope") == 0)
    return out.withColumns({"scope_solved": solved, "filter_resolves": resolves, "filter_resolves_independently": resolves & F.col("target_independent")})


def repose(members: DataFrame, k: int | None = None, seed: int = 0) -> DataFrame:
    """Tasks posed anew over their complete bindable pool, or the target and k - 1 others, in seeded order.

    Tasks whose target does not bind, shares its rendering, or whose pool is smaller than k have no rows.
    """
    from plumbline.operators.tasks import choose

    census = pool_census(members).where("target_binds AND unique").select("task_id", "level", F.col("bindable").alias("size"))
    kept = census.where(F.col("size") >= k) if k else census
    one = members.where("bindable").groupBy("task_id", "level", "rendering_hash").agg(F.bool_or("is_target").alias("is_target"))
    pool = one.join(kept, ["task_id", "level"]).withColumn("sym", F.col("rendering_hash"))
    return choose(pool, k or 2**31 - 1, seed)


def distribution(census: DataFrame, column: str, *keys: str) -> DataFrame:
    """Mean, exact median and largest value of a census column, and the share of tasks with none."""
    out = census.groupBy(*keys).agg(F.count(F.lit(1)).alias("tasks"), F.avg(column).alias("mean"), F.max(column).alias("most"), F.avg((F.col(column) == 0).cast("int")).alias("none"))
    median = exact_quantiles(census, column, [0.5], *keys).withColumnRenamed("q1", "median")
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"o.{k}").eqNullSafe(F.col(f"m.{k}"))
    return out.alias("o").join(median.alias("m"), same, "left").select(*[f"o.{k}" for k in keys], "tasks", "mean", "median", "most", "none")


def neighbourhood_report(census: DataFrame, budget: int = 32) -> DataFrame:
    """Recall, its chance and pools within the budget, by namespace and variant and by variant alone (namespace null)."""
    parts = census.groupingSets([["namespace", "variant"], ["variant"]], "namespace", "variant")
    return parts.agg(F.count(F.lit(1)).alias("tasks"), F.count_if("recalled").alias("recalled"), F.sum("uniform").alias("uniform"), F.count_if(F.col("size") <= budget).alias("within"))
