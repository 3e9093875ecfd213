"""Queries of reports, funnels, routing, baselines and reasons that stand beside the summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.catalog import extraction, splitting
from plumbline.catalog.bridges import PAIRS, view
from plumbline.catalog.evaluation import FAILS, FSUM, GRID, PR, SUMMARY, _outcomes, _recs, tail
from plumbline.catalog.plans import SIZES, candidates, tasks
from plumbline.catalog.ranking import SCORED, scored
from plumbline.catalog.repairs import EDITED, TAKES
from plumbline.functions import binding as B
from plumbline.functions import texts as X
from plumbline.operators import attempts as A
from plumbline.operators import pools as N
from plumbline.operators import paired as P
from plumbline.operators import ranking as R
from plumbline.operators import splits as L
from plumbline.operators import tasks as T
from plumbline.plans import arguments as G
from plumbline.sources import files as S
from plumbline.sources.stored import shared_folder

QUERIES, ORACLES = {}, {}


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# Seven gates of a plan.  By the part's number: no plan; an unknown operand; a keyword dropped (where there is one); the
# call kept, for the third or the second candidate.  One task in five wants the first candidate.
GATED = """(SELECT p_partkey AS id, p_brand AS repository, 'size ' || p_size % 2 AS family, ['no plan', 'unknown', 'drop', 'keep'][p_partkey % 4 + 1] AS perturbation,
  p_partkey % 4 <> 0 AS syntax, p_partkey % 4 >= 2 AS in_vocabulary, p_partkey % 4 = 3 OR k > 0 AS applicable,
  CASE WHEN p_partkey % 4 = 2 THEN p > 0 AND NOT (k = 2 AND p = 3) ELSE (p_partkey // 4) % 2 = 1 AND k = 0 AND p > 0 END AS bindable, p_partkey % 5 <> 0 AS candidate, p_partkey % 4 = 3 AS operation
  FROM (SELECT *, p_size % 4 AS p, (p_size // 4) % 3 AS k FROM part) x)"""
PASSES = ", ".join(f"count(*) FILTER (WHERE {' AND '.join(G.GATES[: i + 1])}) AS {g}" for i, g in enumerate(G.GATES[:-1]))
PASSES = f"count(*) AS n, {PASSES}, count(*) FILTER (WHERE {' AND '.join(G.GATES[:-1])}) AS exact"


@register("ver10_plan_funnel", f"SELECT 'total' AS level, '' AS value, {PASSES} FROM {GATED} g" + "".join(f" UNION ALL SELECT '{k}', {k}, {PASSES} FROM {GATED} g GROUP BY {k}" for k in ("repository", "family", "perturbation")))
def _(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("task_id"), F.col("p_brand").alias("repository"), F.concat(F.lit("size "), (F.col("p_size") % 2).cast("string")).alias("family"))
    params = candidates(spark, d).groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cand_idx", "params"))), lambda x: x["params"]).alias("params"))
    kind = F.col("task_id") % 4
    kept = F.when(F.floor(F.col("task_id") / 4) % 2 == 0, "candidate 3; keep").otherwise("candidate 2; keep")
    x = tasks(spark, d).join(params, "task_id").join(part, "task_id").withColumns({
        "output": F.when(kind == 0, "I would keep it").when(kind == 1, "candidate 2; drop nothing").when(kind == 2, "candidate 2; drop k0").otherwise(kept),
        "perturbation": F.when(kind == 0, "no plan").when(kind == 1, "unknown").when(kind == 2, "drop").otherwise("keep"),
        # the third candidate is the right one where the third is named, so that the candidate's gate does not depend on the answer's text
        "symbols": F.array(F.lit("f"), F.lit("g"), F.lit("g")), "answer_index": F.when(F.col("task_id") % 5 == 0, 0).otherwise(1), "expected": F.col("call"),
    })
    return A.funnel(G.plan_gates(x), G.GATES, "repository", "family", "perturbation")


CHANCE = f"(SELECT task_id, cand, count(*) FILTER (WHERE ok) AS m, bool_or(ok AND keep AND cand = 1) AS r FROM {TAKES} t GROUP BY task_id, cand)"


@register("arg10_recommended_baselines", f"SELECT task_id, CASE WHEN task_id % 7 <> 0 THEN CASE WHEN r THEN 1.0 / m ELSE 0.0 END END AS recommended_feasible_uniform, 0.0 AS position_prior FROM {CHANCE} c WHERE cand = task_id % 3")
def _(spark, d):
    x = tasks(spark, d).withColumn("recommendation", F.when(F.col("task_id") % 7 != 0, (F.col("task_id") % 3).cast("int")))
    return G.recommended_baselines(x, candidates(spark, d))


SHIFTS = f"(SELECT task_id, unnest([0, 1, 2]) AS shift FROM {SIZES} s)"


@register("arg11_reordered", f"SELECT task_id, shift, (3 + task_id % 3 - shift) % 3 AS answer_index, (3 + 1 - shift) % 3 AS restoring, array_to_string(list_transform([0, 1, 2], lambda i: 'c' || (i + shift) % 3), ',') AS shown FROM {SHIFTS} s")
def _(spark, d):
    x = tasks(spark, d).withColumns({"candidates": F.array(*map(F.lit, ("c0", "c1", "c2"))), "answer_index": (F.col("task_id") % 3).cast("int")})
    return G.reordered(x, 3).select("task_id", "shift", F.col("answer_index").cast("long").alias("answer_index"), F.col("restoring.cand").cast("long").alias("restoring"), F.array_join("candidates", ",").alias("shown"))


@register("arg11_mapped_plans", f"SELECT task_id, shift, shown, (shown + shift) % 3 AS cand_idx FROM {SHIFTS} s, (SELECT unnest([0, 1, 2]) AS shown) x")
def _(spark, d):
    counts = tasks(spark, d).select("task_id", "n_candidates")
    scores = G.rotations(tasks(spark, d), 3).select("task_id", "shift", F.explode(F.sequence(F.lit(0), F.size("order") - 1)).alias("cand_idx")).withColumn("shown", F.col("cand_idx"))
    return G.map_plans(scores, counts).select("task_id", "shift", "shown", "cand_idx")


# The threshold is chosen on one family and applied to the other.
BEST = f"(SELECT threshold FROM (SELECT CAST(threshold AS DOUBLE) AS threshold, sum(CAST(CASE WHEN confidence >= threshold THEN a_ok ELSE b_ok END AS INT)) AS s FROM {PR} p, (SELECT unnest({GRID}) AS threshold) g WHERE family = 'f0' GROUP BY 1) x ORDER BY s DESC, threshold DESC LIMIT 1)"


@register("agg21_routed_elsewhere", f"""SELECT namespace, n, took_assisted, assisted_successes, routed_successes, routed_only, assisted_only, threshold, (routed_successes - assisted_successes) / n AS delta, round({tail('routed_only', 'assisted_only')}, 9) AS p FROM (
  SELECT namespace, count(*) AS n, count(*) FILTER (WHERE confidence >= threshold) AS took_assisted, count(*) FILTER (WHERE a_ok) AS assisted_successes, count(*) FILTER (WHERE CASE WHEN confidence >= threshold THEN a_ok ELSE b_ok END) AS routed_successes,
    count(*) FILTER (WHERE confidence < threshold AND b_ok AND NOT a_ok) AS routed_only, count(*) FILTER (WHERE confidence < threshold AND a_ok AND NOT b_ok) AS assisted_only, max(threshold) AS threshold FROM {PR} p, {BEST} b WHERE family = 'f1' GROUP BY namespace) g""")
def _(spark, d):
    pairs = view(spark, d, PAIRS)
    sweep = P.threshold_sweep(pairs.where("family = 'f0'"), GRID)
    return P.routing_result(P.routed(pairs.where("family = 'f1'"), sweep), "namespace").withColumn("p", F.round("p", 9))


def _residual(where: str) -> str:
    ranks = f"SELECT task_id, is_target, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, cand_idx) AS rank FROM {SCORED} s WHERE {where}"
    return f"(SELECT t.task_id, coalesce(rank, 1000000) AS rank FROM (SELECT DISTINCT task_id FROM {SCORED} s) t LEFT JOIN (SELECT * FROM ({ranks}) x WHERE is_target) r ON r.task_id = t.task_id)"


RESIDUAL = "count(*) AS n, count(*) FILTER (WHERE rank > 1) AS first_wrong, count(*) FILTER (WHERE rank = 2) AS second_right, count(*) FILTER (WHERE rank = 2) / nullif(count(*) FILTER (WHERE rank > 1), 0) AS residual, avg(CAST(rank <= 2 AS INT)) AS two_turn_ceiling"


@register("agg24_residual_ranks", f"SELECT 'before' AS stage, {RESIDUAL} FROM {_residual('true')} r UNION ALL SELECT 'after', {RESIDUAL} FROM {_residual('allowed')} r")
def _(spark, d):
    return R.residual_ranks(scored(spark, d).withColumnRenamed("allowed", "bindable"))


# Names of candidates from the documents' first words; the answer is the second.
@register("cen6_duplicated_answers", """SELECT lang, count(*) AS n, count(*) FILTER (WHERE len(list_filter(w, lambda x: x = w[2])) > 1) AS duplicated FROM (SELECT lang, list_slice(string_split(coalesce(text, ''), ' '), 1, 6) AS w FROM documents) x GROUP BY lang""")
def _(spark, d):
    words = F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 6)
    return T.duplicated_answers(spark.read.parquet(f"{d}/documents.parquet").select("lang", words.alias("symbols"), F.lit(1).alias("answer_index")), "lang")


def _pairs(text: str) -> tuple[str, str]:
    return text, "CAST(NULL AS VARCHAR)"


def _rate(n: str) -> str:
    return f"printf('%d/%d (%.1f%%)', CAST({n} AS BIGINT), tasks, 100 * {n} / tasks)"


REPORT = [
    ("arms", "first-pass success", _rate("baseline_first_pass"), _rate("assisted_first_pass")), ("arms", "success within budget", _rate("baseline_successes"), _rate("assisted_successes")),
    ("arms", "terminal failures", "(tasks - baseline_successes) || '/' || tasks", "(tasks - assisted_successes) || '/' || tasks"), ("arms", "mean attempts", "printf('%.2f', bm)", "printf('%.2f', am)"),
    *[("pairs", n, *_pairs(f"CAST({c} AS VARCHAR)")) for n, c in (("both succeed", "\"both\""), ("assisted only", "assisted_only"), ("baseline only", "baseline_only"), ("neither succeeds", "neither"))],
    ("turns", "mean correction turns saved", *_pairs("coalesce(printf('%.2f', mean_turn_delta), 'not defined')")),
    ("turns", "fewer, same, more", *_pairs("fewer_turns || ', ' || (\"both\" - fewer_turns - more_turns) || ', ' || more_turns || ' of ' || \"both\"")),
    ("tests", "McNemar", *_pairs(f"printf('%d discordant: %d to %d, p = %.3f', assisted_only + baseline_only, assisted_only, baseline_only, {tail('assisted_only', 'baseline_only')})")),
    ("tests", "sign test", *_pairs(f"printf('%d unequal: %d to %d, %d ties, p = %.3f', fewer_turns + more_turns, fewer_turns, more_turns, \"both\" - fewer_turns - more_turns, {tail('fewer_turns', 'more_turns')})")),
]
SUMMED = f"(SELECT namespace, {SUMMARY}, avg(b_attempts) AS bm, avg(a_attempts) AS am FROM {PR} p GROUP BY namespace)"


@register("snk2_standard_report", " UNION ALL ".join(f"SELECT namespace, '{part}' AS part, '{metric}' AS metric, {b} AS baseline, {a} AS assisted FROM {SUMMED} s" for part, metric, b, a in REPORT))
def _(spark, d):
    return X.standard_report(P.exact_tests(P.summarize(view(spark, d, PAIRS), "namespace", means=True)), "namespace")


@register("snk2_tests_report", " UNION ALL ".join(f"SELECT namespace, '{n}' AS metric, round(CAST({x} AS DOUBLE), 9) AS value FROM {SUMMED} s" for n, x in (
    ("success_rate_delta", "(assisted_successes - baseline_successes) / tasks"), ("mean_attempts_delta", "bm - am"), ("mean_turn_delta", "mean_turn_delta"), ("mcnemar_p", tail("assisted_only", "baseline_only")), ("sign_p", tail("fewer_turns", "more_turns")))))
def _(spark, d):
    return X.tests_report(P.exact_tests(P.summarize(view(spark, d, PAIRS), "namespace")), "namespace").withColumn("value", F.round("value", 9))


@register("snk3_failure_rates", f"SELECT namespace, metric, round(rate, 9) AS rate FROM (SELECT namespace, unnest(['failure_rate', 'wrong_recommendation_rate', 'ignored_share_of_failures', 'followed_share_of_failures']) AS metric, unnest([assisted_failures / tasks, wrong_recommendations / tasks, correct_ignored / nullif(assisted_failures, 0), wrong_followed / nullif(assisted_failures, 0)]) AS rate FROM (SELECT namespace, {FSUM} FROM {FAILS} f GROUP BY namespace) s) x")
def _(spark, d):
    signs = P.failure_signatures(_outcomes(spark, d), _recs(spark, d))
    return X.failure_rates(P.summarize_failures(signs, "namespace"), "namespace").withColumn("rate", F.round("rate", 9))


# Parts whose parameters cannot be read, and site groups without a site, are allowed, and say so.
@register("flt3_reasons", f"""SELECT p_partkey, g AS site_group, g = 8 OR p_partkey % 9 = 0 OR binds AS allowed, CASE WHEN g = 8 THEN 'no call site' WHEN p_partkey % 9 = 0 THEN 'unreadable signature' WHEN binds THEN '' ELSE 'call site does not bind' END AS reason FROM (
  SELECT p_partkey, CAST(mask % 8 AS INT) AS g, bool_and(binds) AS binds FROM {splitting.BINDS} b GROUP BY 1, 2 UNION ALL SELECT p_partkey, 8, true FROM part) x""")
def _(spark, d):
    groups = splitting.call_shapes(spark, d).groupBy((F.col("mask") % 8).cast("int").alias("site_group")).agg(F.collect_list("s").alias("sites"))
    none = spark.range(1).select(F.lit(8).alias("site_group"), F.lit(None).cast(groups.schema["sites"].dataType).alias("sites"))
    parts = splitting.part_classes(spark, d).select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p")).alias("p"))
    ok, why = B.allowed_reason(F.col("p"), F.col("sites"))
    judged = parts.select("p").distinct().join(F.broadcast(groups.unionByName(none)), F.lit(True)).select("p", "site_group", ok.alias("allowed"), why.alias("reason"))
    return splitting.with_class(parts, judged).select("p_partkey", "site_group", "allowed", "reason")


# Whole tables where other queries of the operator take a part.
LANGUAGES = ("de", "en", "es", "fr")


@register("set3_all_languages", "SELECT lang AS namespace, lang || '::' || source AS source, count(*) AS n FROM documents WHERE lang IN ('de', 'en', 'es', 'fr') GROUP BY lang, source")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "lang")
    return L.pool_namespaces({k: docs.where(F.col("lang") == k) for k in LANGUAGES}).groupBy("namespace", "source").agg(F.count(F.lit(1)).alias("n"))


@register("set6_all_namespaces", "WITH c AS (SELECT lang || '/' || source AS namespace, count(*) AS n, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS m FROM documents GROUP BY 1) SELECT namespace, n, 'now' AS side FROM c WHERE n <> m UNION ALL SELECT namespace, m, 'frozen' FROM c WHERE n <> m AND m > 0")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat_ws("/", "lang", "source").alias("namespace"))
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id").distinct()
    count = lambda x: x.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))
    return L.drift(count(docs), count(docs.join(labels, "doc_id", "left_semi")))


@register("spl8_all_splits", f"SELECT s.split, count(task_id) AS n FROM (SELECT unnest(['train', 'validation', 'test']) AS split) s LEFT JOIN {splitting.SPLIT} x ON s.split = x.split GROUP BY s.split")
def _(spark, d):
    return L.split_sizes(L.hash_split(splitting.ex(spark, d), 5))


NTH = "row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth"


@register("join19_documents_and_labels", f"SELECT coalesce(a.source, b.source) AS source, coalesce(a.nth, b.nth) AS nth, a.doc_id AS l_doc_id, b.doc_id AS r_doc_id FROM (SELECT source, doc_id, {NTH} FROM documents) a FULL JOIN (SELECT source, doc_id, {NTH} FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) b ON a.source = b.source AND a.nth = b.nth")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("source", "doc_id")
    labelled = docs.join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id").distinct(), "doc_id", "left_semi")
    return T.ordered_join(docs, labelled, ["source"], "doc_id")


# A call's arguments: two where a function calls its neighbour, two where one calls what it imports.
@register("cen6_arguments_by_family", f"SELECT task, n_args, count(*) AS n FROM (SELECT 'python.hard_masked_direct_call' AS task, 2 AS n_args FROM {extraction.GOOD} g UNION ALL SELECT 'python.hard_masked_cross_file_call', 2 FROM {extraction.GOOD} g WHERE linked) x GROUP BY ALL")
def _(spark, d):
    e, _s, _x = extraction.edges(spark, d)
    t, _i, _y = extraction.tasks(spark, d)
    near = S.masked_callers(e, extraction.files(spark, d)).withColumn("task", F.lit("python.hard_masked_direct_call"))
    far = S.masked_callers(t.withColumn("target", F.col("alias")), extraction.files(spark, d)).withColumn("task", F.lit("python.hard_masked_cross_file_call"))
    c = near.unionByName(far)
    return T.counts(T.single_site(c, S.call_sites(c.select("context")), ("python.hard_masked_direct_call", "python.hard_masked_cross_file_call")), "task", "n_args")


# The census of the import neighbourhood, reported: every pool has four functions or none.
@register("cen8_of_census", f"""WITH c AS (SELECT g.namespace, variant, variant = 'alias' AS recalled, CASE WHEN variant = 'alias' THEN least(4, 4 * files - 1) / (4 * files - 1) ELSE 0 END AS uniform FROM {extraction.GOOD} g JOIN {extraction.SIZES} s ON g.namespace = s.namespace, (SELECT unnest(['alias', 'independent']) AS variant) v WHERE linked)
SELECT namespace, variant, count(*) AS tasks, count(*) FILTER (WHERE recalled) AS recalled, round(sum(uniform), 6) AS uniform, count(*) AS within FROM c GROUP BY GROUPING SETS ((namespace, variant), (variant))""")
def _(spark, d):
    return N.neighbourhood_report(extraction.QUERIES["cen3_neighbourhood_census"](spark, d)).withColumn("uniform", F.round("uniform", 6))


# What each operation leaves of its call: positional arguments and keyword names.
@register("arg2_edited_calls", f"SELECT task_id, p AS positional, array_to_string(list_sort(nm), ',') AS keywords, 3 * count(*) AS plans FROM {EDITED} e GROUP BY ALL")
def _(spark, d):
    x = G.plan_space(tasks(spark, d), "call").withColumn("made", G.apply_op(F.col("call"), F.col("op")))
    names = F.array_join(F.array_sort(F.transform("made.keywords", lambda k: k["name"])), ",")
    return x.where("made IS NOT NULL").groupBy("task_id", F.size("made.args").alias("positional"), names.alias("keywords")).agg(F.count(F.lit(1)).alias("plans"))


# Texts of documents: each is a caller, names come from its columns.
@register("txt8_edited_documents", "SELECT doc_id, md5('x = ' || CASE WHEN n_chars % 2 = 0 THEN lang ELSE source END || '(1)' || chr(10) || coalesce(text, '')) AS digest FROM documents")
def _(spark, d):
    context = F.concat(F.lit("x = __CALL_TARGET__(1)\n"), F.coalesce("text", F.lit("")))
    made = X.edited(context, F.array(F.concat("lang", F.lit("(a)")), F.concat("source", F.lit("(b)\nbody"))), (F.col("n_chars") % 2).cast("int"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(made).alias("digest"))


@register("txt10_caller_of_documents", "SELECT doc_id, lang || '_' || source AS caller FROM documents")
def _(spark, d):
    text = F.concat(F.lit("@wrapped\ndef "), "lang", F.lit("_"), "source", F.lit("(a, *, b=1):\n    "), F.coalesce("text", F.lit("")))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.caller_name(text).alias("caller"))


# A split that loses some rows and repeats others.
@register("set5_rows_unlike", f"SELECT task_id, source, 1 AS n, CASE WHEN task_id % 10 = 3 THEN 0 ELSE 2 END AS split_n FROM {splitting.EX} e WHERE task_id % 10 IN (3, 4)")
def _(spark, d):
    x = splitting.ex(spark, d)
    split = L.hash_split(x, 5)
    return L.unlike(x, split.where("task_id % 10 <> 3").unionByName(split.where("task_id % 10 = 4")), "task_id", "source")


@register("snk1_written_decisions", f"SELECT task_id, namespace, source, split FROM {splitting.SPLIT} s")
def _(spark, d):
    folder = f"{shared_folder(spark)}/decisions-{uuid.uuid4().hex}"
    split = L.hash_split(splitting.ex(spark, d), 5).select("task_id", "namespace", "source", "split")
    S.write_decisions(split, folder)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in split.schema)
    return S.read_decisions(spark, folder, kinds).select(*split.columns)
