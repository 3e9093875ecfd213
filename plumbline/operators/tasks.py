"""Building decisions: joins of callers, targets, imports and candidate pools.

symbols, calls, imports, name_reads and methods as plumbline.sources.files gives them.  Everything stays within a
namespace (repository); candidates travel as ids until the few that are chosen get their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.expressions import order_key
from plumbline.operators.rings import bucket_sizes, successors

FILE = ["namespace", "path"]


def by_name(symbols: DataFrame) -> DataFrame:
    """One symbol for each name of a file: the last definition."""
    # columns by themselves, so that those nobody reads are pruned
    return symbols.groupBy(*FILE, "name").agg(*[F.max_by(c, "ordinal").alias(c) for c in ("ordinal", "signature", "body", "shape", "params")])


def single_target_callers(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(namespace, path, caller, target): callers that call exactly one other function of their file."""
    names = symbols.select(*FILE, F.col("name").alias("callee")).distinct()
    edges = calls.where("caller <> callee").join(names, [*FILE, "callee"], "left_semi")
    one = edges.groupBy(*FILE, "caller", "caller_ordinal").agg(F.collect_set("callee").alias("c")).where("size(c) = 1")
    return one.groupBy(*FILE, "caller").agg(F.max_by(F.get("c", F.lit(0)), "caller_ordinal").alias("target"))


def with_task(edges: DataFrame, *keys: str) -> DataFrame:
    return edges.withColumn("task_id", order_key(*[F.col(k) for k in keys]))


def choose(pool: DataFrame, k: int, seed: int, *first) -> DataFrame:
    """At most k candidates of each task in seeded order, the target always, then shuffled: cand_idx, answer_index.

    The law is that of a seeded shuffle, by hash order, so it does not depend on partitioning.
    """
    h = order_key(seed, "choice", F.col("task_id"), F.col("sym"))
    w = Window.partitionBy("task_id")
    kept = pool.withColumn("_r", F.row_number().over(w.orderBy(F.col("is_target").desc(), *first, h))).where(F.col("_r") <= k)
    shown = kept.withColumn("cand_idx", F.row_number().over(w.orderBy(order_key(seed, "display", F.col("task_id"), F.col("sym")))) - 1)
    return shown.withColumn("answer_index", F.max(F.when(F.col("is_target"), F.col("cand_idx"))).over(w)).drop("_r")


def render(signature, body, chars: int | None, path=None):
    """Candidate text: signature alone, with a body excerpt, with the path before it."""
    head = signature if path is None else F.concat(path, F.lit("::"), signature)
    return head if chars is None else F.concat(head, F.lit("\n"), F.substring(body, 1, chars))


def symbol_id(*prefix: str):
    return F.concat_ws("::", *[F.col(p) for p in prefix], "name", F.col("ordinal").cast("string"))


def call_decisions(symbols: DataFrame, edges: DataFrame, most: int = 16, seed: int = 0) -> DataFrame:
    """Candidates of direct-call decisions: the target, local functions first, then others of the repository, up to `most`.

    Both kinds come from rings (plumbline.operators.rings): the file's, and the repository's only where a file is too
    small, so no task meets all functions of its repository.
    """
    tasks = with_task(edges, "namespace", "path", "caller", "target")
    target = by_name(symbols).select(*FILE, F.col("name").alias("target"), F.col("ordinal").alias("tord"))
    # another definition that is the target's twin is no wrong candidate
    alike = Window.partitionBy(*FILE, "name", F.xxhash64("signature", "body"))
    known = symbols.select(*FILE, "name", "ordinal", F.max("ordinal").over(alike).alias("_twin"), F.count(F.lit(1)).over(alike).alias("_twins"))
    local = known.select(*FILE, F.col("path").alias("cpath"), "name", "ordinal", "_twin").withColumn("sym", symbol_id("cpath"))
    everywhere = local.drop("path")
    twins = known.select(*FILE, F.col("name").alias("target"), F.col("ordinal").alias("tord"), "_twins")
    size = symbols.groupBy(*FILE).agg(F.count(F.lit(1)).alias("_file"))
    tasks = tasks.join(target, [*FILE, "target"]).join(twins, [*FILE, "target", "tord"]).join(size, FILE)
    wrong = F.lit(most - 1)
    own = tasks.select("*", F.col("path").alias("cpath"), F.col("target").alias("name"), F.col("tord").alias("ordinal"), F.lit(True).alias("is_target"), F.lit(0).cast("long").alias("step")).withColumn("sym", symbol_id("cpath"))
    near = successors(tasks, local, FILE, wrong + F.col("_twins"), "sym", seed).where("NOT (name = target AND _twin = tord)")
    few = tasks.where(F.col("_file") - F.col("_twins") < wrong)
    far = successors(few, everywhere, ["namespace"], wrong + F.col("_file"), "sym", seed).where("cpath <> path")
    pool = own.unionByName(near.unionByName(far).drop("_twin").withColumn("is_target", F.lit(False))).drop("_twins", "_file")
    return with_text(choose(pool, most, seed, (F.col("cpath") == F.col("path")).desc(), "step"), symbols).drop("step")


def with_text(chosen: DataFrame, symbols: DataFrame, path: str = "cpath", *more: str) -> DataFrame:
    """The chosen candidates (namespace, path, more keys, name, ordinal) with signature and body, which no pool carries."""
    keys = ["namespace", path, *more, "name", "ordinal"]
    return chosen.join(symbols.withColumn(path, F.col("path")).select(*keys, "signature", "body"), keys)


def masked_call_decisions(symbols: DataFrame, edges: DataFrame, contexts: DataFrame, most: int = 16, chars: int = 768, seed: int = 0) -> DataFrame:
    """Direct-call decisions of callers whose masked text does not give the target away, candidates with path and body excerpt."""
    known = edges.join(contexts.select(*FILE, "caller", "target").distinct(), [*FILE, "caller", "target"], "left_semi")
    return call_decisions(symbols, known, most, seed).withColumn("candidate", render(F.col("signature"), F.col("body"), chars, F.col("cpath")))


def target_in_pool(wanted: DataFrame, pool: DataFrame) -> DataFrame:
    """(task_id, sym_id): the first pool member whose rendering is the labelled candidate's.

    wanted: task_id, text of the labelled candidate; pool: task_id, ord, sym_id, text.  Texts meet by hash, then by
    themselves; a task without such a member has no row.
    """
    left = wanted.select("task_id", F.col("text").alias("_t"), F.xxhash64("text").alias("_h"))
    hit = pool.withColumn("_h", F.xxhash64("text")).join(left, ["task_id", "_h"]).where(F.col("text") == F.col("_t"))
    return hit.groupBy("task_id").agg(F.min_by("sym_id", "ord").alias("sym_id"))


def target_aliases(wanted: DataFrame, imported: DataFrame, rendered: DataFrame) -> DataFrame:
    """(task_id, alias): names in the caller's file that stand for the labelled rendering.

    wanted: task_id, namespace, path, text; rendered: namespace, path, name, text of every function.
    """
    texts = rendered.select("namespace", F.col("path").alias("target_path"), "name", F.xxhash64("text").alias("_h"), F.col("text").alias("_t"))
    named = imported.join(texts, ["namespace", "target_path", "name"]).select(*FILE, "alias", "_h", "_t")
    at = wanted.withColumn("_h", F.xxhash64("text")).join(named, [*FILE, "_h"]).where(F.col("text") == F.col("_t"))
    return at.select("task_id", "alias").distinct()


def negatives_in_scope(wrong: DataFrame, scope: DataFrame) -> DataFrame:
    """(task_id, n): how many of each task's own wrong candidates are in its scope; wrong, scope: task_id, text."""
    inside = scope.select("task_id", F.xxhash64("text").alias("_h"), F.col("text").alias("_t")).distinct()
    mine = wrong.withColumns({"_h": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    hit = mine.join(inside, ["task_id", "_h"]).where(F.col("text") == F.col("_t")).select("task_id", "_row").distinct()
    return wrong.select("task_id").distinct().join(hit.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")), "task_id", "left").select("task_id", F.coalesce("n", F.lit(0)).alias("n"))


def beyond(strict: DataFrame, primary: DataFrame) -> DataFrame:
    """Members of the strict neighbourhood that the primary one lacks; must be empty.  Both: task_id, npath."""
    return strict.select("task_id", "npath").exceptAll(primary.select("task_id", "npath"))


def stacked(candidates: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, size, task_ids, values): each batch's tasks in order, each with its candidates' values in order.

    candidates: batch, task_id, cand_idx, value.  A batch whose tasks differ in their number of candidates is an error.
    """
    task = candidates.groupBy(batch, "task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cand_idx", "value"))), lambda x: x["value"]).alias("values"))
    all_of = task.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("task_id", "values"))).alias("x"), F.min(F.size("values")).alias("size"), F.max(F.size("values")).alias("_most"))
    size = F.when(F.col("size") == F.col("_most"), F.col("size")).otherwise(F.raise_error(F.concat(F.lit("mixed sizes in batch "), F.col(batch).cast("string"))).cast("int"))
    return all_of.select(batch, size.alias("size"), F.col("x.task_id").alias("task_ids"), F.col("x.values").alias("values"))


def hard_decisions(symbols: DataFrame, edges: DataFrame, k: int = 4, seed: int = 0) -> DataFrame:
    """Candidates of hard decisions: same file, same call shape, not the caller; tasks with fewer than k of them go."""
    last = by_name(symbols)
    tasks = with_task(edges, "namespace", "path", "caller", "target")
    tasks = tasks.join(last.select(*FILE, F.col("name").alias("target"), "shape", F.col("ordinal").alias("tord")), [*FILE, "target"])
    tasks = tasks.join(last.select(*FILE, F.col("name").alias("caller"), F.col("ordinal").alias("cord")), [*FILE, "caller"])
    pool = tasks.join(symbols.select(*FILE, "shape", "name", "ordinal"), [*FILE, "shape"]).where("ordinal <> cord")
    pool = pool.withColumns({"is_target": F.expr("ordinal = tord"), "sym": symbol_id(), "_n": F.count(F.lit(1)).over(Window.partitionBy("task_id"))})
    return with_text(choose(pool.where(F.col("_n") >= k).drop("_n"), k, seed), symbols, "path")


def method_decisions(methods: DataFrame, method_calls: DataFrame, k: int = 4, seed: int = 0) -> DataFrame:
    """Candidates of same-class decisions: same binding kind and shape; classes need more than k usable methods."""
    cls = [*FILE, "class_name"]
    big = methods.groupBy(*cls).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > k).drop("m")
    usable = methods.join(big, cls, "left_semi")
    names = usable.select(*cls, F.col("name").alias("callee"))
    one = method_calls.where("caller <> callee").join(names, [*cls, "callee"], "left_semi").groupBy(*cls, "caller").agg(F.collect_set("callee").alias("c")).where("size(c) = 1")
    tasks = with_task(one.select(*cls, "caller", F.get("c", F.lit(0)).alias("target")), *cls, "caller")
    tasks = tasks.join(usable.select(*cls, F.col("name").alias("target"), "binding", "shape"), [*cls, "target"])
    pool = tasks.join(usable.select(*cls, "binding", "shape", "name", "ordinal"), [*cls, "binding", "shape"]).where("name <> caller")
    pool = pool.withColumns({"is_target": F.col("name") == F.col("target"), "sym": symbol_id(), "_n": F.count(F.lit(1)).over(Window.partitionBy("task_id"))})
    return with_text(choose(pool.where(F.col("_n") >= k).drop("_n"), k, seed), methods, "path", "class_name")


def resolve_modules(imports: DataFrame, files: DataFrame, roots: tuple = ("", "src")) -> DataFrame:
    """imports with target_path where module and level name exactly one known file (m.py or m/__init__.py below a root)."""
    up = F.col("level") - 1
    folder = F.split(F.col("path"), "/")
    base = F.array_join(F.slice(folder, 1, F.greatest(F.size(folder) - 1 - up, F.lit(0))), "/")
    module = F.replace(F.col("module"), F.lit("."), F.lit("/"))
    join = lambda *p: F.array_join(F.filter(F.array(*p), lambda x: x != ""), "/")
    stems = F.when(F.col("level") > 0, F.array(join(base, module))).otherwise(F.array(*[join(F.lit(r), module) for r in roots]))
    tries = imports.withColumn("_stem", F.explode(F.array_distinct(stems))).where(F.col("_stem") != "").withColumn("target_path", F.explode(F.array(F.concat("_stem", F.lit(".py")), F.concat("_stem", F.lit("/__init__.py")))))
    hits = tries.join(files.select("namespace", F.col("path").alias("target_path")).distinct(), ["namespace", "target_path"], "left_semi").where("target_path <> path")
    keys = [*FILE, "stmt_no", "alias_pos"]
    found = hits.groupBy(*keys).agg(F.collect_set("target_path").alias("t")).where("size(t) = 1").select(*keys, F.get("t", F.lit(0)).alias("target_path"))
    return imports.join(found, keys)


def imported_symbols(imports: DataFrame, symbols: DataFrame, roots: tuple = ("", "src")) -> DataFrame:
    """(namespace, path, alias, target_path, name): aliases that name one top-level function of one file; later statements win."""
    # files without a function are not known to the resolver
    found = resolve_modules(imports.where("NOT whole AND member <> '*'"), symbols.select(*FILE).distinct(), roots)
    once = symbols.groupBy("namespace", F.col("path").alias("target_path"), F.col("name").alias("member")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    good = found.join(once, ["namespace", "target_path", "member"])
    last = F.row_number().over(Window.partitionBy(*FILE, "alias").orderBy(F.desc("stmt_no"), F.desc("alias_pos")))
    return good.withColumn("_r", last).where("_r = 1").select(*FILE, "alias", "target_path", F.col("member").alias("name"))


def unshadowed(imported: DataFrame, symbols: DataFrame) -> DataFrame:
    """Imported aliases that no function of the file hides."""
    return imported.join(symbols.select(*FILE, F.col("name").alias("alias")).distinct(), [*FILE, "alias"], "left_anti")


def cross_file_edges(calls: DataFrame, imported: DataFrame, symbols: DataFrame) -> DataFrame:
    """(namespace, path, caller, alias, target_path, target): callers that call exactly one imported function."""
    hits = calls.select(*FILE, "caller", F.col("callee").alias("alias")).distinct().join(unshadowed(imported, symbols), [*FILE, "alias"])
    g = hits.groupBy(*FILE, "caller").agg(F.collect_set(F.struct("alias", "target_path", "name")).alias("s")).where("size(s) = 1").select(*FILE, "caller", F.get("s", F.lit(0)).alias("s"))
    return g.select(*FILE, "caller", "s.alias", "s.target_path", F.col("s.name").alias("target"))


def cross_file_decisions(symbols: DataFrame, edges: DataFrame, k: int = 4, seed: int = 0) -> DataFrame:
    """Candidates of cross-file decisions: the repository's functions of the target's shape, without the caller.

    They come from the shape's ring; tasks with fewer than k candidates, which counts tell, have no rows.
    """
    tasks = with_task(edges, "namespace", "path", "caller", "alias")
    last = by_name(symbols)
    tasks = tasks.join(last.select("namespace", F.col("path").alias("target_path"), F.col("name").alias("target"), "shape", F.col("ordinal").alias("tord")), ["namespace", "target_path", "target"])
    bucket = ["namespace", "shape"]
    members = symbols.select(*bucket, F.col("path").alias("cpath"), "name", "ordinal").withColumn("sym", symbol_id("cpath"))
    callers = symbols.groupBy("namespace", "shape", "path", F.col("name").alias("caller")).agg(F.count(F.lit(1)).alias("_self"))
    tasks = tasks.join(callers, [*bucket, "path", "caller"], "left").join(bucket_sizes(members, bucket).withColumnRenamed("bucket_size", "_size"), bucket)
    tasks = tasks.withColumn("_self", F.coalesce("_self", F.lit(0))).where(F.col("_size") - F.col("_self") >= k)
    found = successors(tasks, members, bucket, F.col("_self") + k, "sym", seed).where("NOT (cpath = path AND name = caller) AND NOT (cpath = target_path AND name = target AND ordinal = tord)")
    own = tasks.select("*", F.col("target_path").alias("cpath"), F.col("target").alias("name"), F.col("tord").alias("ordinal"), F.lit(True).alias("is_target"), F.lit(0).cast("long").alias("step")).withColumn("sym", symbol_id("cpath"))
    own = own.where("NOT (cpath = path AND name = caller)")
    pool = own.unionByName(found.withColumn("is_target", F.lit(False))).drop("_self", "_size")
    return with_text(choose(pool, k, seed, "step"), symbols).drop("step")


def read_outside(imported: DataFrame, name_reads: DataFrame, callers: DataFrame) -> DataFrame:
    """(namespace, path, caller, alias): aliases that the file reads outside the caller."""
    reads = name_reads.select(*FILE, F.col("name").alias("alias"), "owner")
    rows = callers.select(*FILE, "caller").distinct().join(imported.select(*FILE, "alias"), FILE)
    return rows.join(reads, [*FILE, "alias"]).where("owner IS NULL OR owner <> caller").select(*FILE, "caller", "alias").distinct()


def scope_pool(tasks: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """(task_id, mpath, name, source): local functions but the caller, and imported ones that nothing hides, once each."""
    t = tasks.select("task_id", *FILE, "caller")
    local = t.join(symbols.select(*FILE, "name").distinct(), FILE).where("name <> caller").select("task_id", F.col("path").alias("mpath"), "name", F.lit("local").alias("source"))
    other = t.join(unshadowed(imported, symbols), FILE).select("task_id", F.col("target_path").alias("mpath"), "name", F.lit("imported").alias("source"))
    return local.unionByName(other).dropDuplicates(["task_id", "mpath", "name"])


def repository_pool_sizes(tasks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task_id, repository): how many functions the repository pool holds, from counts: the pool is never written out."""
    n = symbols.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))
    return tasks.join(n, "namespace").select("task_id", (F.col("n") - 1).alias("repository"))


def repository_pool(tasks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task_id, mpath, name, params): all functions of the repository but the caller, ids and parameters only."""
    pool = tasks.select("task_id", *FILE, "caller").join(symbols.select("namespace", F.col("path").alias("mpath"), "name", "params"), "namespace")
    return pool.where("NOT (mpath = path AND name = caller)").select("task_id", "mpath", "name", "params")


def repository_summary(tasks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task_id, members, first, last): size of each task's repository pool and its first and last `path::name`, without a row for each member.

    A repository is counted once, with its two first and two last functions; a task is put right for its caller's own
    definitions, which may be several.  Tasks with an empty pool have no row, as in a count over repository_pool.
    """
    key = F.struct(F.concat_ws("::", "path", "name").alias("sym"), "path", "name")
    all_of = symbols.select("namespace", key.alias("k"))
    ends = all_of.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    second = all_of.distinct().join(ends, "namespace").groupBy("namespace").agg(F.min(F.when(F.col("k") > F.col("lo"), F.col("k"))).alias("lo2"), F.max(F.when(F.col("k") < F.col("hi"), F.col("k"))).alias("hi2"))
    own = symbols.groupBy(*FILE, F.col("name").alias("caller")).agg(F.count(F.lit(1)).alias("own"))
    x = tasks.select("task_id", *FILE, "caller").join(ends, "namespace").join(second, "namespace").join(own, [*FILE, "caller"], "left")
    mine = lambda c: F.expr(f"{c}.path = path AND {c}.name = caller")
    pick = lambda a, b: F.when(mine(a), F.col(f"{b}.sym")).otherwise(F.col(f"{a}.sym"))
    out = x.select("task_id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("members"), pick("lo", "lo2").alias("first"), pick("hi", "hi2").alias("last"))
    return out.where("members > 0")


def level_pool(level: str, tasks: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """(task_id, mpath, name): the pool at a named level, `scope` or `repository`; any other level is an error."""
    if level == "scope":
        return scope_pool(tasks, symbols, imported).select("task_id", "mpath", "name")
    if level == "repository":
        return repository_pool(tasks, symbols).select("task_id", "mpath", "name")
    raise ValueError(f"unknown pool level {level!r}")


def neighbourhood_files(tasks: DataFrame, imports: DataFrame, symbols: DataFrame, imported: DataFrame, name_reads: DataFrame, variant: str = "alias", roots: tuple = ("", "src"), hide_target: bool = True) -> DataFrame:
    """(task_id, npath): files that the caller's file imports, without what names the target.

    alias: every import but the target's aliases, star imports too.  independent: only imports whose alias is read
    outside the caller, no stars.  Without hide_target nothing of the label is used.
    """
    if variant not in ("alias", "independent"):
        raise ValueError(f"unknown variant {variant!r}")
    t = tasks.select("task_id", *FILE, "caller", "target_path", "target")
    as_module = F.when(F.col("whole") | (F.col("member") == "*"), F.col("module")).otherwise(F.concat_ws(".", F.when(F.col("module") != "", F.col("module")), "member"))
    files = symbols.select(*FILE).distinct()
    keys = [*FILE, "stmt_no", "alias_pos"]
    reached = resolve_modules(imports, files, roots).select(*keys, "alias", "member", "target_path").unionByName(resolve_modules(imports.withColumn("module", as_module), files, roots).select(*keys, "alias", "member", "target_path")).distinct()
    rows = t.join(reached.withColumnRenamed("target_path", "npath"), FILE).where("npath <> path")
    if hide_target:
        own = imported.select(*FILE, "alias", F.col("target_path").alias("_tp"), F.col("name").alias("_tn"))
        hidden = t.join(own, FILE).where("_tp = target_path AND _tn = target").select("task_id", "alias").distinct()
        rows = rows.join(hidden, ["task_id", "alias"], "left_anti")
    if variant == "independent":
        used = read_outside(imports.select(*FILE, "alias").distinct(), name_reads, tasks)
        rows = rows.where("member <> '*'").join(used, [*FILE, "caller", "alias"], "left_semi")
    return rows.select("task_id", "npath").distinct()


def neighbourhood_pool(files: DataFrame, tasks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task_id, mpath, name): all functions of those files."""
    at = files.join(tasks.select("task_id", "namespace"), "task_id")
    return at.join(symbols.select("namespace", F.col("path").alias("npath"), "name"), ["namespace", "npath"]).select("task_id", F.col("npath").alias("mpath"), "name")


def neighbourhood_census(tasks: DataFrame, pools: DataFrame, sizes: DataFrame) -> DataFrame:
    """(task_id, variant, size, recalled, uniform): the pool's size, whether it holds the target, and a random pool's chance."""
    hit = pools.join(tasks.select("task_id", "target_path", "target"), "task_id").groupBy("task_id", "variant").agg(F.count(F.lit(1)).alias("size"), F.bool_or(F.expr("mpath = target_path AND name = target")).alias("recalled"))
    grid = tasks.select("task_id").withColumn("variant", F.explode(F.array(F.lit("alias"), F.lit("independent"))))
    out = grid.join(hit, ["task_id", "variant"], "left").join(sizes, "task_id")
    size = F.coalesce("size", F.lit(0))
    return out.select("task_id", "variant", size.alias("size"), F.coalesce("recalled", F.lit(False)).alias("recalled"), F.coalesce(F.try_divide(F.least(size, "repository"), F.col("repository")), F.lit(0.0)).alias("uniform"))


def ordered_join(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Full join of two runs whose keys repeat: the n-th of one meets the n-th of the other; drift shows as nulls."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    a = left.withColumn("nth", n).withColumnsRenamed({c: f"l_{c}" for c in left.columns if c not in keys})
    b = right.withColumn("nth", n).withColumnsRenamed({c: f"r_{c}" for c in right.columns if c not in keys})
    return a.join(b, [*keys, "nth"], "full_outer")


def definition_decisions(symbols: DataFrame) -> DataFrame:
    """One decision for each function of a file with two or more: all the file's signatures, and which is its own."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*FILE))
    rows = symbols.withColumn("_n", n).where("_n > 1").drop("_n")
    files = rows.groupBy(*FILE).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "signature"))), lambda x: x["signature"]).alias("candidates"))
    return rows.select(*FILE, "ordinal", "name").join(files, FILE).withColumn("answer_index", F.col("ordinal"))


def single_site(contexts: DataFrame, sites: DataFrame, tasks: tuple) -> DataFrame:
    """Decisions of supported families with exactly one masked call, and its number of arguments."""
    x = contexts.withColumn("context_hash", F.sha2("context", 256)).join(sites, "context_hash").where((F.size("shapes") == 1) & F.col("task").isin(*tasks))
    s = F.get("shapes", F.lit(0))
    return x.withColumn("n_args", s["positional"] + F.size(s["keywords"]))


def duplicated_answers(decisions: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, duplicated): decisions, and those of which another candidate has the answer's name, so that no name can win them.

    decisions: symbols (the candidates' names), answer_index.
    """
    mine = F.get("symbols", F.col("answer_index"))
    twice = F.size(F.filter("symbols", lambda s: s == mine)) > 1
    return decisions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(twice).alias("duplicated"))


def counts(decisions: DataFrame, *keys: str) -> DataFrame:
    """Decisions of each key, largest first."""
    return decisions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)
