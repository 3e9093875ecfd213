"""Queries of the source operators over repositories that Spark derives from the supplier table.

Each supplier is a file of four functions and a class; it imports a function of the supplier ten keys on, so five
repositories of linked files grow with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.binding import allowed
from plumbline.operators import pools as N
from plumbline.operators import tasks as T
from plumbline.operators.classes import repository_counts
from plumbline.operators.ranking import structural_baseline
from plumbline.sources import files as S
from plumbline.sources.stored import stored

QUERIES, ORACLES = {}, {}


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


CODE = """from pkg.m{N} import f{N} as other
import pkg.m{N}
TOP = other(1)

def f{K}(a, b=1):
    return a

def g{K}(a, b=2):
    return f{K}(a, b=3)

def h{K}(x, y=4):
    if x:
        return [y for y in x]
    return y

def u{K}(x, /, *, k):
    return other(x, b=k)

class C{K}:
    def one(self, a):
        return self.two(a)
    def two(self, a):
        return a
    def three(self, a):
        return a
    @property
    def four(self):
        return 4
    @staticmethod
    def five(a):
        return a
"""


def files(spark, d):
    k = F.col("s_suppkey").cast("string")
    text = F.replace(F.replace(F.lit(CODE), F.lit("{K}"), k), F.lit("{N}"), (F.col("s_suppkey") + 10).cast("string"))
    broken = F.when(F.col("s_suppkey") % 50 == 7, F.lit("def f(:\n")).otherwise(text)
    sup = spark.read.parquet(f"{d}/supplier.parquet")
    return sup.select(F.concat(F.lit("ns"), (F.col("s_suppkey") % 5).cast("string")).alias("namespace"), F.concat(F.lit("pkg/m"), k, F.lit(".py")).alias("path"), broken.alias("content"))


def facts(spark, d):
    """All facts, written once: each file is parsed once for a query, however much is derived from it."""
    return S.fact_table(files(spark, d))


# The oracles' suppliers: readable files, and whether the import's file exists and is readable.
GOOD = """(SELECT s_suppkey AS k, 'ns' || s_suppkey % 5 AS namespace, 'pkg/m' || s_suppkey || '.py' AS path, s_suppkey + 10 AS n, s_suppkey + 10 IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 50 <> 7) AS linked FROM supplier WHERE s_suppkey % 50 <> 7)"""
FUNCS = f"(SELECT *, unnest(['f', 'g', 'h', 'u']) AS fn FROM {GOOD} g0)"


@register("src2_quarantine", "SELECT 'ns' || s_suppkey % 5 AS namespace, 'pkg/m' || s_suppkey || '.py' AS path, 'SyntaxError' AS error FROM supplier WHERE s_suppkey % 50 = 7")
def _(spark, d):
    return S.quarantine(S.extract(files(spark, d)))


@register("ext1_symbols", f"""SELECT namespace, path, fn || k AS name, CASE fn WHEN 'f' THEN 'f' || k || '(a, b)' WHEN 'g' THEN 'g' || k || '(a, b)' WHEN 'h' THEN 'h' || k || '(x, y)' ELSE 'u' || k || '(x, /, *, k)' END AS signature,
  CASE fn WHEN 'f' THEN 0 WHEN 'g' THEN 1 WHEN 'h' THEN 2 ELSE 3 END AS ordinal FROM {FUNCS} f""")
def _(spark, d):
    return S.symbols(facts(spark, d)).select("namespace", "path", "name", "signature", "ordinal")


@register("ext2_call_shape", f"SELECT namespace, path, fn || k AS name, CASE WHEN fn = 'u' THEN 1 ELSE 2 END AS pos, 1 AS req_pos, CASE WHEN fn = 'u' THEN 1 ELSE 0 END AS kwonly, CASE WHEN fn = 'u' THEN 1 ELSE 0 END AS req_kwonly FROM {FUNCS} f")
def _(spark, d):
    return S.symbols(facts(spark, d)).select("namespace", "path", "name", "shape.pos", "shape.req_pos", "shape.kwonly", "shape.req_kwonly")


@register("ext3_direct_calls", f"SELECT namespace, path, 'g' || k AS caller, 'f' || k AS callee FROM {GOOD} g UNION ALL SELECT namespace, path, 'u' || k, 'other' FROM {GOOD} g")
def _(spark, d):
    return S.calls(facts(spark, d)).select("namespace", "path", "caller", "callee")


@register("ext4_single_target_callers", f"SELECT namespace, path, 'g' || k AS caller, 'f' || k AS target FROM {GOOD} g")
def _(spark, d):
    x = facts(spark, d)
    return T.single_target_callers(S.symbols(x), S.calls(x))


@register("ext5_methods", f"SELECT namespace, path, 'C' || k AS class_name, name, CASE WHEN name = 'five' THEN 'static' ELSE 'instance' END AS binding FROM {GOOD} g, (SELECT unnest(['one', 'two', 'three', 'five']) AS name) m")
def _(spark, d):
    return S.methods(facts(spark, d)).select("namespace", "path", "class_name", "name", "binding")


@register("ext6_method_calls", f"SELECT namespace, path, 'C' || k AS class_name, 'one' AS caller, 'two' AS callee FROM {GOOD} g")
def _(spark, d):
    return S.method_calls(facts(spark, d)).select("namespace", "path", "class_name", "caller", "callee")


@register("ext7_imports", f"SELECT namespace, path, 'pkg.m' || n AS module, 'f' || n AS member, 'other' AS alias, false AS whole FROM {GOOD} g UNION ALL SELECT namespace, path, 'pkg.m' || n, 'pkg.m' || n, 'pkg.m' || n, true FROM {GOOD} g")
def _(spark, d):
    return S.imports(facts(spark, d)).select("namespace", "path", "module", "member", "alias", "whole")


@register("ext7_name_reads", f"SELECT namespace, path, coalesce(owner, '') AS owner, count(*) AS n FROM (SELECT namespace, path, unnest([NULL, 'f' || k, 'g' || k, 'g' || k, 'h' || k, 'h' || k, 'u' || k, 'u' || k, 'u' || k, 'C' || k, 'C' || k, 'C' || k, 'C' || k]) AS owner FROM {GOOD} g) x WHERE owner IS NULL OR owner NOT LIKE 'C%' GROUP BY 1, 2, 3")
def _(spark, d):
    reads = S.name_reads(facts(spark, d)).where("NOT (owner IS NULL AND name IN ('a', 'self', 'property', 'staticmethod'))")
    return reads.groupBy("namespace", "path", F.coalesce("owner", F.lit("")).alias("owner")).agg(F.count(F.lit(1)).alias("n"))


@register("ext8_call_sites", f"SELECT namespace, path, 'g' || k AS caller, 1 AS positional, ['b'] AS keywords, false AS receiver FROM {GOOD} g")
def _(spark, d):
    x = facts(spark, d)
    edges = T.single_target_callers(S.symbols(x), S.calls(x))
    m = S.masked_callers(edges, files(spark, d)).withColumn("context_hash", F.sha2("context", 256))
    sites = S.call_sites(m.select("context"))
    return m.join(sites, "context_hash").select("namespace", "path", "caller", F.explode("shapes").alias("s")).select("namespace", "path", "caller", "s.positional", "s.keywords", "s.receiver")


@register("ext9_candidate_parameters", f"SELECT namespace, path, fn || k AS name, CASE fn WHEN 'f' THEN ['a'] WHEN 'g' THEN ['a'] WHEN 'h' THEN ['x'] ELSE ['x', 'k'] END AS required FROM {FUNCS} f")
def _(spark, d):
    rows = S.symbols(facts(spark, d)).select("namespace", "path", "name", T.render(F.col("signature"), F.col("body"), 768, F.col("path")).alias("text"))
    params = S.candidate_parameters(rows.select("text"))
    return rows.withColumn("text_hash", F.sha2("text", 256)).join(params, "text_hash").select("namespace", "path", "name", "params.required")


@register("txt1_masked", f"SELECT namespace, path, 'g' || k AS caller, 'def g' || k || '(a, b=2):' || chr(10) || '    return __CALL_TARGET__(a, b=3)' AS context FROM {GOOD} g")
def _(spark, d):
    x = facts(spark, d)
    edges = T.single_target_callers(S.symbols(x), S.calls(x))
    return S.masked_callers(edges, files(spark, d)).select("namespace", "path", "caller", "context")


def edges(spark, d):
    x = facts(spark, d)
    return T.single_target_callers(S.symbols(x), S.calls(x)), S.symbols(x), x


# A task's pool: all functions but itself; at most sixteen, the three others of its file among them.
SIZES = f"(SELECT namespace, count(*) AS files FROM {GOOD} g GROUP BY namespace)"


@register("join1_call_decisions", f"SELECT g.namespace, path, 'g' || k AS caller, least(16, 4 * files) AS candidates, 4 AS local, 1 AS targets FROM {GOOD} g JOIN {SIZES} s ON g.namespace = s.namespace")
def _(spark, d):
    e, s, _x = edges(spark, d)
    x = T.call_decisions(s, e)
    return x.groupBy("namespace", "path", "caller").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.expr("cpath = path")).alias("local"), F.count_if("is_target").alias("targets"))


def texts(symbols):
    """Every function with its rendering as candidate text."""
    return symbols.withColumn("text", T.render(F.col("signature"), F.col("body"), 768, F.col("path")))


def rendering(path: str, name: str, signature: str, code: str) -> str:
    """SQL of a candidate text: name and path are SQL, the others say what follows the name."""
    return f"{path} || '::' || {name} || '{signature}' || chr(10) || 'def ' || {name} || '{code.split('|')[0]}' || chr(10) || '    {code.split('|')[1]}'"


TARGET = rendering("'pkg/m' || n || '.py'", "'f' || n", "(a, b)", "(a, b=1):|return a")


@register("join2_masked_decisions", f"SELECT g.namespace, path, 'g' || k AS caller, least(16, 4 * files) AS candidates, 1 AS targets, {rendering('path', "'f' || k", '(a, b)', '(a, b=1):|return a')} AS target FROM {GOOD} g JOIN {SIZES} s ON g.namespace = s.namespace")
def _(spark, d):
    e, s, _x = edges(spark, d)
    shown = S.masked_callers(e, files(spark, d))
    out = T.masked_call_decisions(s, e, shown)
    return out.groupBy("namespace", "path", "caller").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("is_target").alias("targets"), F.max(F.when(F.col("cand_idx") == F.col("answer_index"), F.col("candidate"))).alias("target"))


# A call's own file holds four functions of two parameters each: file and arity leave a choice of four.
@register("rnk17_structural_baseline", f"SELECT namespace, count(*) AS n, count(*) / 4 AS hits, 0.25 AS accuracy FROM {GOOD} g GROUP BY namespace")
def _(spark, d):
    e, s, _x = edges(spark, d)
    shown = T.call_decisions(s, e).join(s.select("namespace", F.col("path").alias("cpath"), "ordinal", (F.col("shape.pos") + F.col("shape.kwonly")).alias("arity")), ["namespace", "cpath", "ordinal"])
    return structural_baseline(shown.withColumns({"same_file": F.expr("cpath = path"), "same_arity": F.col("arity") == 2}), "namespace")


@register("join3_hard_decisions", f"SELECT namespace, path, 'g' || k AS caller, 2 AS candidates, 1 AS targets, 'f' || k AS target FROM {GOOD} g")
def _(spark, d):
    e, s, _x = edges(spark, d)
    x = T.hard_decisions(s, e, 2)
    return x.groupBy("namespace", "path", "caller").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("is_target").alias("targets"), F.max(F.when(F.col("cand_idx") == F.col("answer_index"), F.col("name"))).alias("target"))


@register("join4_method_decisions", f"SELECT namespace, path, 'C' || k AS class_name, 'one' AS caller, 2 AS candidates FROM {GOOD} g")
def _(spark, d):
    x = facts(spark, d)
    out = T.method_decisions(S.methods(x), S.method_calls(x), 2)
    return out.groupBy("namespace", "path", "class_name", "caller").agg(F.count(F.lit(1)).alias("candidates"))


def imported(spark, d):
    x = facts(spark, d)
    return T.imported_symbols(S.imports(x), S.symbols(x)), x


@register("join6_resolved_modules", f"SELECT namespace, path, 'pkg/m' || n || '.py' AS target_path, count(*) AS n FROM {GOOD} g, (SELECT unnest([1, 2])) u WHERE linked GROUP BY 1, 2, 3")
def _(spark, d):
    x = facts(spark, d)
    return T.resolve_modules(S.imports(x), S.symbols(x)).groupBy("namespace", "path", "target_path").agg(F.count(F.lit(1)).alias("n"))


@register("join7_imported_symbols", f"SELECT namespace, path, 'other' AS alias, 'pkg/m' || n || '.py' AS target_path, 'f' || n AS name FROM {GOOD} g WHERE linked")
def _(spark, d):
    return imported(spark, d)[0]


def cross(spark, d):
    i, x = imported(spark, d)
    return T.cross_file_edges(S.calls(x), i, S.symbols(x)), i, x


@register("join5_cross_file_edges", f"SELECT namespace, path, 'u' || k AS caller, 'other' AS alias, 'pkg/m' || n || '.py' AS target_path, 'f' || n AS target FROM {GOOD} g WHERE linked")
def _(spark, d):
    return cross(spark, d)[0]


@register("join5_cross_file_decisions", f"SELECT namespace, path, 'u' || k AS caller, 4 AS candidates, 1 AS targets FROM {GOOD} g WHERE linked")
def _(spark, d):
    e, _i, x = cross(spark, d)
    return T.cross_file_decisions(S.symbols(x), e).groupBy("namespace", "path", "caller").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("is_target").alias("targets"))


def tasks(spark, d):
    e, i, x = cross(spark, d)
    return T.with_task(e, "namespace", "path", "caller"), i, x


@register("join8_scope_pool", f"SELECT namespace, path, 4 AS scope, 3 AS local FROM {GOOD} g WHERE linked")
def _(spark, d):
    t, i, x = tasks(spark, d)
    pool = T.scope_pool(t, S.symbols(x), i)
    return pool.join(t.select("task_id", "namespace", "path"), "task_id").groupBy("namespace", "path").agg(F.count(F.lit(1)).alias("scope"), F.count_if(F.col("source") == "local").alias("local"))


def scoped(spark, d):
    """Tasks of the imported call, all functions' texts, and each task's scope with texts, local members first."""
    t, i, x = tasks(spark, d)
    t, i, s = stored(t), stored(i), texts(S.symbols(x))  # read several times below
    pool = T.scope_pool(t, s, i).join(t.select("task_id", "namespace"), "task_id")
    said = pool.join(s.select("namespace", F.col("path").alias("mpath"), "name", "text", "shape", "params"), ["namespace", "mpath", "name"])
    return t, i, x, s, said.withColumns({"ord": F.struct(F.col("source") == "imported", "mpath", "name"), "sym_id": F.concat_ws("::", "mpath", "name")})


def wanted(t, s):
    """Each task's target as text."""
    return t.join(s.select("namespace", F.col("path").alias("target_path"), F.col("name").alias("target"), "text"), ["namespace", "target_path", "target"]).select("task_id", "namespace", "path", "text")


@register("join12_target_aliases", f"SELECT namespace, path, 'other' AS alias FROM {GOOD} g WHERE linked")
def _(spark, d):
    t, i, _x, s, _pool = scoped(spark, d)
    return T.target_aliases(wanted(t, s), i, s).join(t.select("task_id", "namespace", "path"), "task_id").select("namespace", "path", "alias")


@register("join16_target_in_pool", f"SELECT namespace, path, 'pkg/m' || n || '.py::f' || n AS sym_id, {TARGET} AS text FROM {GOOD} g WHERE linked")
def _(spark, d):
    t, _i, _x, s, pool = scoped(spark, d)
    w = wanted(t, s)
    return T.target_in_pool(w, pool).join(w, "task_id").select("namespace", "path", "sym_id", "text")


# Of all functions of the caller's and the target's file, the caller and three beside the target are out of scope.
@register("join17_negatives_in_scope", f"SELECT namespace, path, 3 AS n FROM {GOOD} g WHERE linked")
def _(spark, d):
    t, _i, _x, s, pool = scoped(spark, d)
    wrong = protocol(t, s).where("NOT is_target").select("task_id", "text")
    return T.negatives_in_scope(wrong, pool).join(t.select("task_id", "namespace", "path"), "task_id").select("namespace", "path", "n")


def protocol(t, s):
    """Candidates shown: all functions of the caller's and the target's file."""
    both = t.withColumn("cpath", F.explode(F.array("path", "target_path")))
    shown = both.join(s.select("namespace", F.col("path").alias("cpath"), "name", "text"), ["namespace", "cpath"])
    return shown.select("task_id", "text", F.expr("cpath = target_path AND name = target").alias("is_target"))


# The import is read at module level too, so the target is in scope without the caller.  A call with b by name binds f
# and g of any file: in scope two local ones and the target, in the repository two of each file.
@register("cen2_task_census", f"""SELECT g.namespace, path, 8 AS protocol_candidates, 3 AS protocol_negatives_in_scope, 3 AS scope_local, 1 AS scope_imported, 4 AS scope_shape_matched, 4 AS scope_size, 3 AS scope_bindable, 4 * files - 1 AS repository_size, 2 * files AS repository_bindable,
  true AS target_independent, true AS scope_target, true AS scope_target_binds, true AS scope_target_unique, true AS repository_target, true AS repository_target_binds, true AS repository_target_unique, false AS scope_solved, false AS filter_resolves, false AS filter_resolves_independently
  FROM {GOOD} g JOIN {SIZES} s ON g.namespace = s.namespace WHERE linked""")
def _(spark, d):
    t, i, x, s, pool = scoped(spark, d)
    keyed = lambda df: df.withColumn("rendering_hash", F.sha2("text", 256))
    masked = S.masked_callers(t.withColumn("target", F.col("alias")), files(spark, d)).withColumn("context_hash", F.sha2("context", 256))
    sites = masked.join(S.call_sites(masked.select("context")), "context_hash").join(t.select("task_id", "namespace", "path", "caller"), ["namespace", "path", "caller"]).select("task_id", "shapes")
    read = T.read_outside(i, S.name_reads(x), t).join(t.select("task_id", "namespace", "path", "caller", F.col("alias").alias("_a")), ["namespace", "path", "caller"])
    read = read.join(i, ["namespace", "path", "alias"]).select("task_id", F.col("target_path").alias("mpath"), "name", F.lit(True).alias("_read")).distinct()
    scope = keyed(pool).join(sites, "task_id", "left").join(read, ["task_id", "mpath", "name"], "left")
    scope = scope.withColumns({"bindable": allowed(F.col("params"), F.col("shapes")), "elsewhere": (F.col("source") == "local") | F.coalesce("_read", F.lit(False)), "shape": F.xxhash64("shape")})
    shown = keyed(protocol(t, s))
    asked = t.join(shown.where("is_target").select("task_id", F.col("rendering_hash").alias("wanted")), "task_id").join(sites, "task_id", "left")
    out = N.task_census(shown, scope, repository_counts(asked.select("task_id", "namespace", "path", "caller", "wanted", "shapes"), keyed(s)), counted=True)
    return t.select("task_id", "namespace", "path").join(out, "task_id").drop("task_id")


# What is reached by names read elsewhere is never more than what all imports reach.
@register("set7_strict_within_primary", f"SELECT count(*) AS tasks, 0 AS beyond FROM {GOOD} g WHERE linked")
def _(spark, d):
    t, i, x = tasks(spark, d)
    strict, primary = [T.neighbourhood_files(t, S.imports(x), S.symbols(x), i, S.name_reads(x), v) for v in ("independent", "alias")]
    over = T.beyond(strict, primary).groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    return t.select("task_id").join(over, "task_id", "left").agg(F.count(F.lit(1)).alias("tasks"), F.coalesce(F.sum("n"), F.lit(0)).alias("beyond"))


@register("join9_repository_pool", f"SELECT g.namespace, path, 4 * files - 1 AS repository, 4 * files - 1 AS listed FROM {GOOD} g JOIN {SIZES} s ON g.namespace = s.namespace WHERE linked")
def _(spark, d):
    t, _i, x = tasks(spark, d)
    listed = T.repository_summary(t, S.symbols(x)).select("task_id", F.col("members").alias("listed"))
    return t.join(T.repository_pool_sizes(t, S.symbols(x)), "task_id").join(listed, "task_id").select("namespace", "path", "repository", "listed")


@register("join11_read_outside", f"SELECT namespace, path, 'u' || k AS caller, 'other' AS alias FROM {GOOD} g WHERE linked")
def _(spark, d):
    t, i, x = tasks(spark, d)
    return T.read_outside(i, S.name_reads(x), t)


# The target's alias is hidden; `import pkg.m` still reaches its file, but is read nowhere.
@register("join13_neighbourhood_files", f"SELECT namespace, path, 'pkg/m' || n || '.py' AS npath FROM {GOOD} g WHERE linked")
def _(spark, d):
    t, i, x = tasks(spark, d)
    n = T.neighbourhood_files(t, S.imports(x), S.symbols(x), i, S.name_reads(x))
    return n.join(t.select("task_id", "namespace", "path"), "task_id").select("namespace", "path", "npath")


@register("join14_label_free_neighbourhood", f"SELECT namespace, path, 'pkg/m' || n || '.py' AS npath FROM {GOOD} g WHERE linked")
def _(spark, d):
    t, i, x = tasks(spark, d)
    n = T.neighbourhood_files(t, S.imports(x), S.symbols(x), i, S.name_reads(x), "independent", hide_target=False)
    return n.join(t.select("task_id", "namespace", "path"), "task_id").select("namespace", "path", "npath")


@register("cen3_neighbourhood_census", f"SELECT g.namespace, path, variant, CASE WHEN variant = 'alias' THEN 4 ELSE 0 END AS size, variant = 'alias' AS recalled, round(CASE WHEN variant = 'alias' THEN least(4, 4 * files - 1) / (4 * files - 1) ELSE 0 END, 9) AS uniform FROM {GOOD} g JOIN {SIZES} s ON g.namespace = s.namespace, (SELECT unnest(['alias', 'independent']) AS variant) v WHERE linked")
def _(spark, d):
    t, i, x = tasks(spark, d)
    s, im, nr = S.symbols(x), S.imports(x), S.name_reads(x)
    pools = None
    for v in ("alias", "independent"):
        p = T.neighbourhood_pool(T.neighbourhood_files(t, im, s, i, nr, v), t, s).withColumn("variant", F.lit(v))
        pools = p if pools is None else pools.unionByName(p)
    c = T.neighbourhood_census(t, pools, T.repository_pool_sizes(t, s))
    return c.join(t.select("task_id", "namespace", "path"), "task_id").select("namespace", "path", "variant", "size", "recalled", F.round("uniform", 9).alias("uniform"))


@register("join19_ordered_join", """SELECT source, nth, l_doc_id, r_doc_id FROM (SELECT coalesce(a.source, b.source) AS source, coalesce(a.nth, b.nth) AS nth, a.doc_id AS l_doc_id, b.doc_id AS r_doc_id
  FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents WHERE doc_id % 2 = 0) a FULL JOIN (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents WHERE doc_id % 3 <> 0) b ON a.source = b.source AND a.nth = b.nth) x""")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("source", "doc_id")
    return T.ordered_join(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 <> 0"), ["source"], "doc_id")


@register("ext10_definition_decisions", f"SELECT namespace, path, fn || k AS name, CASE fn WHEN 'f' THEN 0 WHEN 'g' THEN 1 WHEN 'h' THEN 2 ELSE 3 END AS answer_index, 4 AS candidates FROM {FUNCS} f")
def _(spark, d):
    return T.definition_decisions(S.symbols(facts(spark, d))).select("namespace", "path", "name", "answer_index", F.size("candidates").alias("candidates"))


@register("ext11_nested_calls", f"SELECT namespace, path, 'g' || k AS caller, 'f' || k AS target FROM {GOOD} g")
def _(spark, d):
    x = facts(spark, d)
    return T.single_target_callers(S.symbols(x), S.calls(x, nested=True))


def contexts(spark, d):
    x = facts(spark, d)
    e = T.single_target_callers(S.symbols(x), S.calls(x))
    return S.masked_callers(e, files(spark, d)).withColumn("task", F.when(F.length("path") % 2 == 0, "python.hard_masked_direct_call").otherwise("other"))


@register("ext12_single_site", f"SELECT namespace, path, 2 AS n_args FROM {GOOD} g WHERE length(path) % 2 = 0")
def _(spark, d):
    c = contexts(spark, d)
    return T.single_site(c, S.call_sites(c.select("context")), ("python.hard_masked_direct_call",)).select("namespace", "path", "n_args")


@register("cen6_argument_counts", f"SELECT 2 AS n_args, count(*) AS n FROM {GOOD} g WHERE length(path) % 2 = 0 HAVING count(*) > 0")
def _(spark, d):
    c = contexts(spark, d)
    return T.counts(T.single_site(c, S.call_sites(c.select("context")), ("python.hard_masked_direct_call",)), "n_args")


@register("cen5_decisions_per_file", f"SELECT namespace, path, 1 AS n FROM {GOOD} g")
def _(spark, d):
    return T.counts(edges(spark, d)[0], "namespace", "path")


# Members of pools from the documents: a task for each source, renderings are texts, every third document doesn't bind.
POOL = "(SELECT source AS task_id, sha256(text) AS h, doc_id % 3 <> 1 AS binds, doc_id = min(doc_id) OVER (PARTITION BY source) AS target FROM documents)"
PER = f"(SELECT task_id, h, count(*) AS n, bool_or(binds) AS binds, bool_or(target) AS target FROM {POOL} p GROUP BY 1, 2)"
CENSUS = f"(SELECT task_id, CAST(sum(n) AS BIGINT) AS members, count(*) AS distinct_n, count(*) FILTER (WHERE binds) AS bindable, coalesce(bool_or(target AND binds), false) AS target_binds, coalesce(max(n) FILTER (WHERE target), 0) = 1 AS uniq FROM {PER} x GROUP BY task_id)"


def members(spark, d):
    x = spark.read.parquet(f"{d}/documents.parquet")
    first = x.groupBy("source").agg(F.min("doc_id").alias("first"))
    return x.join(first, "source").select(F.col("source").alias("task_id"), F.lit("repository").alias("level"), F.sha2("text", 256).alias("rendering_hash"), (F.col("doc_id") % 3 != 1).alias("bindable"), (F.col("doc_id") == F.col("first")).alias("is_target"))


@register("cen2_pool_census", f"SELECT task_id, members, distinct_n, bindable, target_binds, uniq FROM {CENSUS} c")
def _(spark, d):
    return N.pool_census(members(spark, d)).select("task_id", "members", F.col("distinct").alias("distinct_n"), "bindable", "target_binds", F.col("unique").alias("uniq"))


@register("cen1_reposed", f"SELECT task_id, 5 AS candidates, 1 AS targets FROM {CENSUS} c WHERE target_binds AND uniq AND bindable >= 5")
def _(spark, d):
    return N.repose(members(spark, d), 5).groupBy("task_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("is_target").alias("targets"))


@register("cen7_distribution", f"SELECT count(*) AS tasks, round(avg(bindable), 9) AS mean, quantile_cont(bindable, 0.5) AS median, max(bindable) AS most, avg(CAST(bindable = 0 AS INT)) AS none FROM {CENSUS} c")
def _(spark, d):
    return N.distribution(N.pool_census(members(spark, d)), "bindable").withColumn("mean", F.round("mean", 9))


@register("cen8_neighbourhood_report", """SELECT lang AS namespace, source AS variant, count(*) AS tasks, count(*) FILTER (WHERE doc_id % 3 = 0) AS recalled, sum(doc_id % 4) / 4 AS uniform, count(*) FILTER (WHERE n_chars <= 1500) AS within FROM documents GROUP BY GROUPING SETS ((lang, source), (source))""")
def _(spark, d):
    x = spark.read.parquet(f"{d}/documents.parquet").select(F.col("lang").alias("namespace"), F.col("source").alias("variant"), (F.col("doc_id") % 3 == 0).alias("recalled"), (F.col("doc_id") % 4 / 4).alias("uniform"), F.col("n_chars").alias("size"))
    return N.neighbourhood_report(x, 1500)
