"""Queries of the split, sample and guard operators, and of bindability."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.bridges import EXAMPLES, sql, view
from plumbline.functions import binding as B
from plumbline.operators import splits as S

QUERIES, ORACLES = {}, {}


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


#: Examples with finer sources than a table has: one for each hundred documents of a language.
FINE = "SELECT doc_id AS task_id, lang AS namespace, lang || '::' || source || '/' || CAST(doc_id % 3 AS VARCHAR(9)) AS source FROM {documents}"
EX = f"({sql(FINE)})"
HASH = "substr(sha256('5:' || source), 1, 16)"
T1, T2, T3 = S.hex_threshold(0.7), S.hex_threshold(0.7 + 0.15), S.hex_threshold(1 - 0.2)
SPLIT = f"(SELECT *, CASE WHEN {HASH} < '{T1}' THEN 'train' WHEN {HASH} < '{T2}' THEN 'validation' ELSE 'test' END AS split FROM {EX} e)"
HELD = f"(SELECT *, CASE WHEN namespace IN ('de') THEN 'test' WHEN {HASH} < '{T3}' THEN 'train' ELSE 'validation' END AS split FROM {EX} e)"


def ex(spark, d):
    return view(spark, d, FINE)


@register("spl1_hash_split", f"SELECT task_id, split FROM {SPLIT} s")
def _(spark, d):
    return S.hash_split(ex(spark, d), 5).select("task_id", "split")


@register("spl2_balanced_split")
def _(spark, d):
    return S.balanced_split(ex(spark, d), 5).select("task_id", "source", "split")


@register("spl3_balanced_by_namespace")
def _(spark, d):
    return S.balanced_split(ex(spark, d), 5, within="namespace").select("task_id", "source", "split")


@register("spl4_holdout", f"SELECT task_id, split FROM {HELD} s")
def _(spark, d):
    return S.holdout(ex(spark, d), ["de"], 5, 0.2).select("task_id", "split")


@register("spl5_leave_one_out", f"SELECT f.namespace AS fold, CASE WHEN f.namespace = e.namespace THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM (SELECT DISTINCT namespace FROM {EX} x) f, {EX} e GROUP BY 1, 2")
def _(spark, d):
    return S.leave_one_out(ex(spark, d))


@register("spl6_stratified_sample", f"""WITH r AS (SELECT *, sha256(concat_ws(chr(31), '5', 'sample', task_id)) AS h FROM {EX} e), n AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY h, task_id) AS rn FROM r)
  SELECT task_id, namespace FROM n WHERE rn <= 20 UNION ALL SELECT task_id, namespace FROM (SELECT *, row_number() OVER (ORDER BY h, task_id) AS g FROM n WHERE rn > 20) q WHERE g <= 120 - (SELECT count(*) FROM n WHERE rn <= 20)""")
def _(spark, d):
    return S.stratified_sample(ex(spark, d), 20, 120, "namespace", seed=5).select("task_id", "namespace")


@register("spl7_eligible", f"SELECT namespace, count(*) AS n, count(DISTINCT source) AS files FROM {EX} e GROUP BY namespace HAVING count(*) >= 110 AND count(DISTINCT source) >= 5 ORDER BY namespace LIMIT 2")
def _(spark, d):
    return S.eligible_namespaces(ex(spark, d), 110, 5, 2)


@register("spl8_split_sizes", f"SELECT s.split, count(task_id) AS n FROM (SELECT unnest(['train', 'validation', 'test']) AS split) s LEFT JOIN (SELECT * FROM {SPLIT} t WHERE split <> 'validation') x ON s.split = x.split GROUP BY s.split")
def _(spark, d):
    return S.split_sizes(S.hash_split(ex(spark, d), 5).where("split <> 'validation'"))


@register("set3_pooled", "SELECT 'a' AS namespace, 'a::' || source AS source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source UNION ALL SELECT 'b', 'b::' || source, count(*) FROM documents WHERE lang = 'de' GROUP BY source")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "lang")
    return S.pool_namespaces({"a": docs.where("lang = 'en'"), "b": docs.where("lang = 'de'")}).groupBy("namespace", "source").agg(F.count(F.lit(1)).alias("n"))


@register("set4_leaked_namespaces", f"SELECT DISTINCT namespace FROM {SPLIT} s WHERE split = 'test' AND namespace IN (SELECT namespace FROM {SPLIT} t WHERE split <> 'test')")
def _(spark, d):
    return S.leaked_namespaces(S.hash_split(ex(spark, d), 5))


@register("set5_shared_sources", f"SELECT source FROM (SELECT source, CASE WHEN task_id % 50 = 0 THEN 'test' ELSE split END AS split FROM {SPLIT} s) x GROUP BY source HAVING count(DISTINCT split) > 1")
def _(spark, d):
    return S.shared_sources(S.hash_split(ex(spark, d), 5).withColumn("split", F.when(F.col("task_id") % 50 == 0, "test").otherwise(F.col("split"))))


@register("set6_drift", "SELECT lang AS namespace, count(*) AS n, 'now' AS side FROM documents WHERE lang IN ('en', 'de') GROUP BY lang UNION ALL SELECT lang, count(*) - 1, 'frozen' FROM documents WHERE lang IN ('en', 'de') GROUP BY lang")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    now = docs.groupBy(F.col("lang").alias("namespace")).agg(F.count(F.lit(1)).alias("n"))
    return S.drift(now, now.withColumn("n", F.when(F.col("namespace").isin("en", "de"), F.col("n") - 1).otherwise(F.col("n"))))


@register("txt9_namespace", f"SELECT task_id, split_part(source, '::', 1) AS namespace FROM ({sql(EXAMPLES)}) e")
def _(spark, d):
    return view(spark, d, EXAMPLES).select("task_id", S.namespace_of("source").alias("namespace"))


# Bindability: parameters from part, call shapes from lineitem, two hundred shapes at most by construction.
def parameters():
    n = F.col("p_size")
    names = lambda prefix, k: F.transform(F.slice(F.array(*[F.lit(i) for i in range(5)]), 1, k), lambda i: F.concat(F.lit(prefix), i.cast("string")))
    only, either, kw = names("p", (n % 3).cast("int")), names("q", (F.floor(n / 3) % 4).cast("int")), names("k", (F.floor(n / 12) % 3).cast("int"))
    required = F.filter(F.concat(only, either, kw), lambda x: F.length("p_name") % (F.substring(x, 2, 1).cast("int") + 2) == 0)
    return F.struct(only.alias("positional_only"), either.alias("positional_or_keyword"), kw.alias("keyword_only"), required.alias("required"), (n % 5 == 0).alias("has_vararg"), (n % 7 == 0).alias("has_kwarg"))


def shape():
    names = F.array(*map(F.lit, ["p0", "q0", "q1", "q2", "k0", "k1", "z"]))
    mask = F.col("mask")
    keywords = F.filter(names, lambda x: F.getbit(mask, F.array_position(names, x).cast("int")) != 0)
    return F.struct((mask % 4).cast("int").alias("positional"), keywords.alias("keywords"), (mask % 11 == 0).alias("starred"), (mask % 13 == 0).alias("double_starred"), (mask % 3 == 0).alias("receiver"))


PARAMS = """(SELECT p_partkey, po, pk, ko, list_filter(list_concat(list_concat(po, pk), ko), lambda x: length(p_name) % (CAST(x[2] AS INT) + 2) = 0) AS req, p_size % 5 = 0 AS va, p_size % 7 = 0 AS ka FROM (SELECT *,
  list_transform(range(0, p_size % 3), lambda i: 'p' || i) AS po, list_transform(range(0, (p_size // 3) % 4), lambda i: 'q' || i) AS pk, list_transform(range(0, (p_size // 12) % 3), lambda i: 'k' || i) AS ko FROM part) x)"""
SHAPES = """(SELECT mask, CAST(mask % 4 AS INT) AS np, list_filter(['p0', 'q0', 'q1', 'q2', 'k0', 'k1', 'z'], lambda x: (mask >> 1) & (1 << (list_position(['p0', 'q0', 'q1', 'q2', 'k0', 'k1', 'z'], x) - 1)) <> 0) AS kws, mask % 11 = 0 AS st, mask % 13 = 0 AS ds, mask % 3 = 0 AS rc
  FROM (SELECT DISTINCT CAST(l_quantity AS INT) * 7 % 256 AS mask FROM lineitem) m)"""


def _binds(only: str, either: str) -> str:
    """One reading of the call, over names that DuckDB has beside each other."""
    fill = f"CASE WHEN st THEN [] ELSE list_slice(list_concat({only}, {either}), 1, np) END"
    return f"""((np <= len({only}) + len({either}) OR va)
      AND len(list_filter(kws, lambda k: list_contains({only}, k) OR list_contains({fill}, k) OR NOT (list_contains({either}, k) OR list_contains(ko, k) OR ka))) = 0
      AND len(list_filter(req, lambda r: NOT (list_contains({fill}, r) OR list_contains(kws, r) OR CASE WHEN list_contains({only}, r) THEN st WHEN list_contains({either}, r) THEN st OR ds WHEN list_contains(ko, r) THEN ds ELSE true END))) = 0)"""


BINDS = f"(SELECT p_partkey, mask, {_binds('po', 'pk')} OR (rc AND {_binds('CASE WHEN len(po) > 0 THEN po[2:] ELSE po END', 'CASE WHEN len(po) > 0 THEN pk ELSE pk[2:] END')}) AS binds FROM {PARAMS} p, {SHAPES} s)"


def call_shapes(spark, d):
    """The declared call shapes: at most 256 by their masks, which is looked at again before they are broadcast."""
    masks = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_quantity").cast("int") * 7 % 256).alias("mask")).distinct().select("mask", shape().alias("s"))
    if masks.limit(257).count() > 256:
        raise ValueError("more call shapes than declared")
    return masks


def part_classes(spark, d):
    """Parts with their parameters, which repeat: what they bind is decided for each distinct struct."""
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_brand").alias("corpus"), parameters().alias("p"))


def class_pairs(spark, d):
    """Every distinct parameter struct against every call shape."""
    return part_classes(spark, d).select("p").distinct().join(F.broadcast(call_shapes(spark, d)), F.lit(True))


def pairs(spark, d):
    """Every part against every call shape, a row each; the queries work on class_pairs()."""
    return part_classes(spark, d).select("p_partkey", "p").join(F.broadcast(call_shapes(spark, d)), F.lit(True))


def with_class(rows, judged):
    """Rows (p, more) with what was decided for their class."""
    return rows.alias("r").join(judged.alias("j"), F.col("r.p").eqNullSafe(F.col("j.p"))).drop(F.col("j.p"))


@register("flt1_bindable", f"SELECT p_partkey, count(*) FILTER (WHERE binds) AS bindable, count(*) AS shapes FROM {BINDS} b GROUP BY p_partkey")
def _(spark, d):
    ok = B.bindable(F.col("p"), F.array("s"))
    counts = class_pairs(spark, d).groupBy("p").agg(F.count_if(ok).alias("bindable"), F.count(F.lit(1)).alias("shapes"))
    return with_class(part_classes(spark, d).select("p_partkey", "p"), counts).select("p_partkey", "bindable", "shapes")


@register("flt2_all_sites", f"SELECT p_partkey, bool_and(binds) AS bindable FROM {BINDS} b GROUP BY p_partkey")
def _(spark, d):
    sites = class_pairs(spark, d).groupBy("p").agg(F.collect_list("s").alias("sites")).select("p", B.allowed(F.col("p"), F.col("sites")).alias("bindable"))
    return with_class(part_classes(spark, d).select("p_partkey", "p"), sites).select("p_partkey", "bindable")


@register("flt2_all_sites_by_group", f"SELECT p_partkey, CAST(mask % 8 AS INT) AS site_group, bool_and(binds) AS bindable FROM {BINDS} b GROUP BY 1, 2")
def _(spark, d):
    groups = class_pairs(spark, d).groupBy("p", (F.col("mask") % 8).cast("int").alias("site_group")).agg(F.collect_list("s").alias("sites"))
    judged = groups.select("p", "site_group", B.allowed(F.col("p"), F.col("sites")).alias("bindable"))
    return with_class(part_classes(spark, d).select("p_partkey", "p"), judged).select("p_partkey", "site_group", "bindable")


@register("flt4_literals", "SELECT item_id, contains(lower(text), 'the an') AS has, NOT contains(text, 'Then') AS hasnot FROM benchmark")
def _(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", B.requires(F.col("text"), "The An", True).alias("has"), B.rejects(F.col("text"), "Then").alias("hasnot"))


@register("flt5_conjunction", "SELECT item_id, contains(text, 'th') AND length(text) < 300 AND contains(text, 'er') AS allowed, CASE WHEN NOT contains(text, 'th') THEN 'th' WHEN length(text) >= 300 THEN 'short' WHEN NOT contains(text, 'er') THEN 'er' ELSE '' END AS reason FROM benchmark")
def _(spark, d):
    t = F.col("text")
    ok, why = B.conjunction(("th", B.requires(t, "th")), ("short", F.length(t) < 300), ("er", B.requires(t, "er")))
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", ok.alias("allowed"), why.alias("reason"))


CORPUS = f"(SELECT p_brand AS corpus, mask AS task, p_partkey, binds, p_partkey = min(p_partkey) OVER (PARTITION BY p_brand, mask) AS truth FROM {BINDS} b JOIN part USING (p_partkey))"


@register("cen4_predicate_census", f"""SELECT corpus, count(*) AS tasks, count(*) FILTER (WHERE survivors < pool) AS any_veto, round(avg(survivors), 9) AS mean_survivors, round(sum(1.0 / pool), 6) AS uniform, round(sum(CASE WHEN survivors > 0 THEN 1.0 / survivors ELSE 0 END), 6) AS predicate_uniform, CAST(sum(vetoed) AS BIGINT) AS vetoed_truths
  FROM (SELECT corpus, task, count(*) AS pool, count(*) FILTER (WHERE binds) AS survivors, count(*) FILTER (WHERE truth AND NOT binds) AS vetoed FROM {CORPUS} c GROUP BY corpus, task) t GROUP BY corpus""")
def _(spark, d):
    from plumbline.operators.pools import census_of_counts

    parts = part_classes(spark, d)
    truth = parts.groupBy("corpus").agg(F.min("p_partkey").alias("t"))
    classes = parts.join(truth, "corpus").groupBy("corpus", "p").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_partkey") == F.col("t")).alias("targets"))
    judged = class_pairs(spark, d).select("p", F.col("mask").alias("task_id"), B.bindable(F.col("p"), F.array("s")).alias("binds"))
    task = with_class(classes, judged).groupBy("corpus", "task_id").agg(
        F.sum("n").alias("pool"), F.coalesce(F.sum(F.when(F.col("binds"), F.col("n"))), F.lit(0)).alias("survivors"), F.coalesce(F.sum(F.when(~F.col("binds"), F.col("targets"))), F.lit(0)).alias("vetoed")
    )
    out = census_of_counts(task)
    return out.withColumns({"mean_survivors": F.round("mean_survivors", 9), "uniform": F.round("uniform", 6), "predicate_uniform": F.round("predicate_uniform", 6)})
