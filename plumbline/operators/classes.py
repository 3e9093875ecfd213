"""Pools as classes with counts: what binds in a whole repository, without a row for each task and function.

Functions whose parameters read alike bind the same calls.  So a repository is a short table of distinct parameter
structs, each with the number of functions (or renderings) that have it; tasks fall into classes by the shapes of their
calls.  Bindability is decided once for each class of functions and class of calls that meet, sums over the classes
answer every task of the class, and a task is put right for the few functions that are its own caller's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.binding import allowed


def bound_classes(classes: DataFrame, sites: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shapes, members, bindable): for each distinct (keys, shapes) of sites the classes' counts, all and those that bind.

    classes: keys, params, n; sites: keys, shapes.  No key: every class of functions meets every class of calls.
    """
    known = classes.groupBy(*keys, "params").agg(F.sum("n").alias("n"))
    calls = sites.select(*keys, "shapes").distinct()
    met = known.join(calls, keys) if keys else known.crossJoin(calls)  # classes, not rows
    verdict = met.select("params", "shapes").distinct().withColumn("binds", allowed(F.col("params"), F.col("shapes")))
    same = F.col("m.params").eqNullSafe(F.col("v.params")) & F.col("m.shapes").eqNullSafe(F.col("v.shapes"))
    judged = met.alias("m").join(verdict.alias("v"), same).select(*[F.col(f"m.{k}") for k in keys], "m.shapes", "n", "binds")
    return judged.groupBy(*keys, "shapes").agg(F.sum("n").alias("members"), F.coalesce(F.sum(F.when(F.col("binds"), F.col("n"))), F.lit(0)).alias("bindable"))


def with_bound(tasks: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """tasks (keys, shapes, more) with members and bindable, from classes (keys, params, n)."""
    bound = bound_classes(classes, tasks, keys)
    same = F.col("t.shapes").eqNullSafe(F.col("b.shapes"))
    for k in keys:
        same &= F.col(f"t.{k}") == F.col(f"b.{k}")
    z = lambda c: F.coalesce(F.col(f"b.{c}"), F.lit(0)).alias(c)
    return tasks.alias("t").join(bound.alias("b"), same, "left").select("t.*", z("members"), z("bindable"))


def pool_counts(tasks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task_id, repository, bindable): functions of the repository but the caller, and those that bind the task's calls.

    tasks: task_id, namespace, path, caller, shapes (null: everything binds); symbols: namespace, path, name, params.
    """
    classes = symbols.groupBy("namespace", "params").agg(F.count(F.lit(1)).alias("n"))
    own = tasks.join(symbols.select("namespace", "path", F.col("name").alias("caller"), "params"), ["namespace", "path", "caller"])
    less = own.groupBy("task_id").agg(F.count(F.lit(1)).alias("_own"), F.count_if(allowed(F.col("params"), F.col("shapes"))).alias("_binding"))
    out = with_bound(tasks.select("task_id", "namespace", "shapes"), classes, ["namespace"]).join(less, "task_id", "left")
    return out.select("task_id", (F.col("members") - F.coalesce("_own", F.lit(0))).alias("repository"), (F.col("bindable") - F.coalesce("_binding", F.lit(0))).alias("bindable"))


def repository_counts(tasks: DataFrame, members: DataFrame) -> DataFrame:
    """The repository's part of pools.task_census, by distinct rendering: repository_size, _bindable, _target, _target_binds, _target_unique.

    tasks: task_id, namespace, path, caller, wanted (rendering of the target), shapes; members: namespace, path, name,
    params, rendering_hash.  A rendering binds if one of its functions does; the caller's definitions are in no pool, so
    renderings that they have are counted again for the task without them.
    """
    every = F.array_sort(F.collect_set("params"))
    looks = members.groupBy("namespace", "rendering_hash").agg(every.alias("kinds"))
    classes = looks.groupBy("namespace", "kinds").agg(F.count(F.lit(1)).alias("n"))
    sites = tasks.select("namespace", "shapes").distinct()
    some = F.exists("kinds", lambda p: allowed(p, F.col("shapes")))
    judged = classes.join(sites, "namespace").withColumn("binds", some)
    sums = judged.groupBy("namespace", "shapes").agg(F.sum("n").alias("size"), F.coalesce(F.sum(F.when(F.col("binds"), F.col("n"))), F.lit(0)).alias("bindable"))

    mine = tasks.join(members.select("namespace", "path", F.col("name").alias("caller"), "rendering_hash"), ["namespace", "path", "caller"]).select("task_id", "rendering_hash").distinct()
    theirs = tasks.select("task_id", "namespace", "path", "caller", "shapes", F.col("wanted").alias("_w"))
    named = lambda rows: rows.join(theirs, "task_id").join(
        members.select("namespace", "rendering_hash", F.col("path").alias("_path"), F.col("name").alias("_name"), "params"), ["namespace", "rendering_hash"]
    ).withColumns({"_self": F.expr("_path = path AND _name = caller"), "_binds": allowed(F.col("params"), F.col("shapes"))})
    # what the caller's renderings added to the sums, and what is left of them without it
    again = named(mine).groupBy("task_id", "rendering_hash").agg(F.bool_or("_binds").alias("was"), F.bool_or(~F.col("_self")).alias("stays"), F.bool_or(~F.col("_self") & F.col("_binds")).alias("still"))
    change = again.groupBy("task_id").agg((F.count_if("stays") - F.count(F.lit(1))).alias("_d_size"), (F.count_if("still") - F.count_if("was")).alias("_d_bindable"))
    target = named(tasks.select("task_id", F.col("wanted").alias("rendering_hash"))).where("NOT _self").groupBy("task_id").agg(F.count_if("_binds").alias("_like"))

    same = (F.col("t.namespace") == F.col("s.namespace")) & F.col("t.shapes").eqNullSafe(F.col("s.shapes"))
    out = tasks.select("task_id", "namespace", "shapes").alias("t").join(sums.alias("s"), same, "left").select("t.task_id", "s.size", "s.bindable")
    out = out.join(change, "task_id", "left").join(target, "task_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "task_id", (z("size") + z("_d_size")).alias("repository_size"), (z("bindable") + z("_d_bindable")).alias("repository_bindable"), F.col("_like").isNotNull().alias("repository_target"),
        (z("_like") >= 1).alias("repository_target_binds"), (z("_like") == 1).alias("repository_target_unique"),
    )
