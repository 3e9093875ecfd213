"""Queries of imports and scopes over files that hide, star, double and nest names.

Each supplier has the file of `extraction` and one beside it that reaches it by relative imports only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import extraction
from plumbline.operators import tasks as T
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


CODE = """from .m{K} import *
from .m{K} import f{K} as near
from .m{K} import g{K} as hidden
from . import m{K}
SEEN = near(0)

def hidden(a):
    return a

def twice{K}(a):
    return a

def twice{K}(b):
    return b

def v{K}(a):
    def inner():
        return twice{K}(a)
    return inner()

def w{K}(a):
    return hidden(near(a, b=a))

def x{K}(a):
    return near(a)
"""


def facts(spark, d):
    """Facts of both files of each supplier, written once."""
    k = F.col("s_suppkey").cast("string")
    sup = spark.read.parquet(f"{d}/supplier.parquet")
    beside = sup.select(F.concat(F.lit("ns"), (F.col("s_suppkey") % 5).cast("string")).alias("namespace"), F.concat(F.lit("pkg/n"), k, F.lit(".py")).alias("path"), F.replace(F.lit(CODE), F.lit("{K}"), k).alias("content"))
    return S.fact_table(extraction.files(spark, d).unionByName(beside))


# The files beside; linked if the supplier's own file is readable.
BESIDE = "(SELECT s_suppkey AS k, 'ns' || s_suppkey % 5 AS namespace, 'pkg/n' || s_suppkey || '.py' AS path, 'pkg/m' || s_suppkey || '.py' AS own, s_suppkey % 50 <> 7 AS linked FROM supplier)"
OURS = "path LIKE 'pkg/n%'"


@register("ext1_doubled_names", f"SELECT namespace, path, unnest(['hidden', 'twice' || k, 'v' || k, 'w' || k, 'x' || k]) AS name, unnest([0, 2, 3, 4, 5]) AS ordinal, unnest(['hidden(a)', 'twice' || k || '(b)', 'v' || k || '(a)', 'w' || k || '(a)', 'x' || k || '(a)']) AS signature FROM {BESIDE} b")
def _(spark, d):
    return T.by_name(S.symbols(facts(spark, d)).where(OURS)).select("namespace", "path", "name", "ordinal", "signature")


@register("ext4_direct_scope_callers", f"SELECT namespace, path, 'w' || k AS caller, 'hidden' AS target FROM {BESIDE} b")
def _(spark, d):
    x = facts(spark, d).where(OURS)
    return T.single_target_callers(S.symbols(x), S.calls(x))


@register("ext11_inner_scope_callers", f"SELECT namespace, path, unnest(['v' || k, 'w' || k]) AS caller, unnest(['twice' || k, 'hidden']) AS target FROM {BESIDE} b")
def _(spark, d):
    x = facts(spark, d).where(OURS)
    return T.single_target_callers(S.symbols(x), S.calls(x, nested=True))


# `from . import m` names the folder, which is no file.
@register("join6_relative_modules", f"SELECT namespace, path, own AS target_path, unnest(['*', 'f' || k, 'g' || k]) AS member FROM {BESIDE} b WHERE linked")
def _(spark, d):
    x = facts(spark, d)
    return T.resolve_modules(S.imports(x), S.symbols(x)).where(OURS).select("namespace", "path", "target_path", "member")


def imported(spark, d):
    x = facts(spark, d)
    return T.imported_symbols(S.imports(x), S.symbols(x)), x


@register("join7_relative_symbols", f"SELECT namespace, path, own AS target_path, unnest(['near', 'hidden']) AS alias, unnest(['f' || k, 'g' || k]) AS name FROM {BESIDE} b WHERE linked")
def _(spark, d):
    return imported(spark, d)[0].where(OURS)


@register("join10_unshadowed", f"SELECT namespace, path, own AS target_path, 'near' AS alias, 'f' || k AS name FROM {BESIDE} b WHERE linked")
def _(spark, d):
    i, x = imported(spark, d)
    return T.unshadowed(i, S.symbols(x)).where(OURS)


def tasks(spark, d):
    i, x = imported(spark, d)
    t = T.with_task(T.cross_file_edges(S.calls(x), i, S.symbols(x)).where(OURS), "namespace", "path", "caller")
    return stored(t), i, x


@register("join5_calls_past_hidden_names", f"SELECT namespace, path, unnest(['w' || k, 'x' || k]) AS caller, 'near' AS alias, own AS target_path, 'f' || k AS target FROM {BESIDE} b WHERE linked")
def _(spark, d):
    return tasks(spark, d)[0].drop("task_id")


# The own file's functions but the caller, once for a doubled name, and the one import that nothing hides.
@register("join8_scope_with_hidden_names", f"SELECT namespace, path, caller, unnest(list_filter(['hidden', 'twice' || k, 'v' || k, 'w' || k, 'x' || k], lambda f: f <> caller) || ['f' || k]) AS name FROM (SELECT *, unnest(['w' || k, 'x' || k]) AS caller FROM {BESIDE} b WHERE linked) t")
def _(spark, d):
    t, i, x = tasks(spark, d)
    return T.scope_pool(t, S.symbols(x), i).join(t.select("task_id", "namespace", "path", "caller"), "task_id").select("namespace", "path", "caller", "name")


# `near` is read at module level, `hidden` by w alone.
@register("join11_read_by_others", f"SELECT namespace, path, unnest(['w' || k, 'x' || k, 'x' || k]) AS caller, unnest(['near', 'near', 'hidden']) AS alias FROM {BESIDE} b WHERE linked")
def _(spark, d):
    t, i, x = tasks(spark, d)
    return T.read_outside(i, S.name_reads(x), t)


# Without the target's alias, the star, `hidden` and the module reach its file; read by others is only `hidden`, for x.
@register("join13_neighbourhoods_of_stars", f"SELECT namespace, path, own AS npath, unnest(['w' || k, 'x' || k, 'x' || k]) AS caller, unnest(['alias', 'alias', 'independent']) AS variant FROM {BESIDE} b WHERE linked")
def _(spark, d):
    t, i, x = tasks(spark, d)
    found = [T.neighbourhood_files(t, S.imports(x), S.symbols(x), i, S.name_reads(x), v).withColumn("variant", F.lit(v)) for v in ("alias", "independent")]
    return found[0].unionByName(found[1]).join(t.select("task_id", "namespace", "path", "caller"), "task_id").select("namespace", "path", "npath", "caller", "variant")
