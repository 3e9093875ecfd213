"""Queries of the embedding, ranking, shortlist and retrieval operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from plumbline.catalog.bridges import RETRIEVAL, sql
from plumbline.functions.expressions import order_key
from plumbline.operators import ranking as R
from plumbline.operators.tasks import stacked
from plumbline.operators.topk import blocked_shortlist, met_blocks, pair_scores
from plumbline.sources.stored import shared_folder

QUERIES, ORACLES = {}, {}


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# Scores are rounded before they are ranked, so that both engines see the same ties.
SCORED = f"""(SELECT task_id, namespace, cand_id, ord AS cand_idx, score, ord = min(ord) OVER (PARTITION BY task_id) AS is_target, cand_id % 4 <> 0 AS allowed
  FROM (SELECT *, round(list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i] * c[i])) / sqrt(list_sum(list_transform(q, lambda x: x * x)) * list_sum(list_transform(c, lambda x: x * x))), 6) AS score
    FROM (SELECT *, qv::DOUBLE[] AS q, cv::DOUBLE[] AS c FROM ({sql(RETRIEVAL)}) r) d) s)"""
RANKED = f"(SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, cand_idx) AS rank, count(*) OVER (PARTITION BY task_id) AS pool FROM {SCORED} s)"


def retrieval(spark, d):
    """(queries, pool) of RETRIEVAL: namespace, task_id or cand_id, vec; a candidate's place is that of its id in its label."""
    x = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("namespace"), "vec_id", F.col("embedding").alias("vec")).where("namespace IS NOT NULL AND vec_id IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("namespace").orderBy("vec_id")) - 1
    return x.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "task_id"), x.withColumn("place", place.cast("long")).withColumnRenamed("vec_id", "cand_id")


def order() -> Column:
    """A candidate's order in its task: its place in the label, where the task's own id has none."""
    return F.col("place") - (F.col("cand_id") > F.col("task_id")).cast("long")


def scored(spark, d):
    rows = pair_scores(*retrieval(spark, d), ["namespace"]).select("task_id", "namespace", "cand_id", order().alias("cand_idx"), F.round("score", 6).alias("score"))
    return rows.select("*", (F.col("cand_idx") == 0).alias("is_target"), (F.col("cand_id") % 4 != 0).alias("allowed"))


@register("rnk4_cosine", f"SELECT task_id, cand_id, score FROM {SCORED} s")
def _(spark, d):
    return scored(spark, d).select("task_id", "cand_id", "score")


@register("rnk5_cosine_mix", f"SELECT task_id, cand_id, round((1 / (1 + exp(-0.4)) * score + (1 - 1 / (1 + exp(-0.4))) * score * score) * exp(1.5), 4) AS score FROM {SCORED} s")
def _(spark, d):
    return scored(spark, d).select("task_id", "cand_id", F.round(R.cosine_mix(F.col("score"), F.col("score") * F.col("score"), 0.4, 1.5), 4).alias("score"))


@register("rnk7_softmax", f"SELECT task_id, cand_id, round(exp(score - mx) / sum(exp(score - mx)) OVER (PARTITION BY task_id), 7) AS prob, rank = 1 AS top FROM (SELECT *, max(score) OVER (PARTITION BY task_id) AS mx FROM {RANKED} r) x")
def _(spark, d):
    return R.probabilities(scored(spark, d)).select("task_id", "cand_id", F.round("prob", 7).alias("prob"), "top")


@register("rnk8_constrained", f"""SELECT task_id, cand_id, round(CASE WHEN allowed THEN exp(score - mx) ELSE 0 END / sum(CASE WHEN allowed THEN exp(score - mx) ELSE 0 END) OVER (PARTITION BY task_id), 7) AS prob, NOT bool_or(allowed) OVER (PARTITION BY task_id) AS escalate,
  first_value(cand_idx) OVER (PARTITION BY task_id ORDER BY allowed DESC, score DESC, cand_idx) AS chosen_index FROM (SELECT *, max(score) FILTER (WHERE allowed) OVER (PARTITION BY task_id) AS mx FROM {SCORED} s) x""")
def _(spark, d):
    return R.constrained(scored(spark, d)).select("task_id", "cand_id", F.round("prob", 7).alias("prob"), "escalate", "chosen_index")


@register("rnk9_ranking", f"SELECT task_id, cand_id, rank FROM {RANKED} r")
def _(spark, d):
    return R.ranked(scored(spark, d)).select("task_id", "cand_id", "rank")


@register("rnk9_not_permutations", f"SELECT task_id FROM (SELECT task_id, count(*) AS n, max(rank) AS hi FROM {RANKED} r WHERE cand_id % 7 <> 0 GROUP BY task_id) x WHERE hi <> n")
def _(spark, d):
    return R.check_permutation(R.ranked(scored(spark, d)).withColumn("rank", F.col("rank") - 1).where("cand_id % 7 <> 0"))


@register("rnk10_recommend", f"SELECT task_id, arg_min(cand_idx, rank) FILTER (WHERE allowed AND cand_idx % 3 <> 0) AS recommendation FROM {RANKED} r GROUP BY task_id")
def _(spark, d):
    return R.recommend(R.ranked(scored(spark, d)).withColumn("rejected", F.col("cand_idx") % 3 == 0))


@register("rnk11_shortlist", f"SELECT task_id, cand_id, rank FROM {RANKED} r WHERE rank <= 16")
def _(spark, d):
    return R.shortlist(scored(spark, d), 16).select("task_id", "cand_id", "rank")


# The same shortlist by matrix products of blocks; a candidate's order is that of its id.
@register("rnk11_blocked_shortlist", f"SELECT task_id, cand_id, score, rank FROM {RANKED} r WHERE rank <= 16")
def _(spark, d):
    x = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("namespace"), "vec_id", F.col("embedding").alias("vec")).where("namespace IS NOT NULL")
    asked = x.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "task_id")
    return blocked_shortlist(asked, x.withColumnRenamed("vec_id", "cand_id"), 16, ["namespace"], itself=False, digits=6).select("task_id", "cand_id", "score", "rank")


@register("rnk12_hybrid_order", f"SELECT task_id, cand_id, row_number() OVER (PARTITION BY task_id ORDER BY cand_id % 5 = 0 DESC, score DESC, cand_idx) AS rank FROM {SCORED} s")
def _(spark, d):
    near = F.col("cand_id") % 5 == 0
    return R.ranked(scored(spark, d), near.desc(), F.desc("score"), F.col("cand_idx")).select("task_id", "cand_id", "rank")


@register("rnk13_rerank", f"""SELECT t.task_id, coalesce(hit, false) AS hit FROM (SELECT DISTINCT task_id FROM {SCORED} s) t LEFT JOIN (SELECT task_id, is_target AS hit FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY -score DESC, cand_idx) AS again FROM {RANKED} r WHERE rank <= 32) x WHERE again = 1) h ON t.task_id = h.task_id""")
def _(spark, d):
    s = scored(spark, d)
    return R.rerank(R.shortlist(s, 32), s.withColumn("score", -F.col("score")))


@register("rnk14_cross_entropy", f"SELECT task_id, round(ln(sum(exp(score))) - max(score) FILTER (WHERE is_target), 6) AS loss FROM {SCORED} s GROUP BY task_id")
def _(spark, d):
    return R.cross_entropy(scored(spark, d)).select("task_id", F.round("loss", 6).alias("loss"))


@register("rnk15_batches", """SELECT task_id, k, CAST(floor((row_number() OVER (PARTITION BY k ORDER BY sha256(concat_ws(chr(31), '7', '1', task_id)), task_id) - 1) / 32) AS BIGINT) AS batch FROM (SELECT doc_id AS task_id, n_chars % 3 + 2 AS k FROM documents) t""")
def _(spark, d):
    return R.batches(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("task_id"), (F.col("n_chars") % 3 + 2).alias("k")), 32, 7, 1)


# Each batch's tasks in order, with each task's candidates in order: 1, 4, 9, ...
@register("rnk16_stacked", """SELECT k, batch, CAST(k AS INT) AS size, string_agg(task_id, ',' ORDER BY task_id) AS ids, string_agg(vs, ';' ORDER BY task_id) AS said FROM (
  SELECT task_id, k, batch, string_agg((i + 1) * (i + 1), ',' ORDER BY i) AS vs FROM (SELECT *, unnest(range(0, k)) AS i FROM (
    SELECT task_id, k, CAST(floor((row_number() OVER (PARTITION BY k ORDER BY sha256(concat_ws(chr(31), '7', '1', task_id)), task_id) - 1) / 32) AS BIGINT) AS batch FROM (SELECT doc_id AS task_id, n_chars % 3 + 2 AS k FROM documents) t) b) c GROUP BY task_id, k, batch) v GROUP BY k, batch""")
def _(spark, d):
    tasks = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("task_id"), (F.col("n_chars") % 3 + 2).alias("k"))
    rows = R.batches(tasks, 32, 7, 1).withColumn("cand_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k").cast("long") - 1)))
    rows = rows.withColumns({"key": F.struct("k", "batch"), "value": (F.col("cand_idx") + 1) * (F.col("cand_idx") + 1)})
    out = stacked(rows, "key")
    strings = lambda x: F.array_join(x.cast("array<string>"), ",")
    return out.select("key.k", "key.batch", "size", strings(F.col("task_ids")).alias("ids"), F.array_join(F.transform("values", strings), ";").alias("said"))


@register("agg17_rank_histogram", f"SELECT namespace, CAST((rank > 1)::INT + (rank > 8)::INT + (rank > 16)::INT + (rank > 32)::INT AS INT) AS bin, count(*) AS n FROM {RANKED} r WHERE is_target GROUP BY 1, 2")
def _(spark, d):
    return R.rank_histogram(R.target_ranks(scored(spark, d)), [1, 8, 16, 32], "namespace")


@register("agg17_retrieval_quality", f"SELECT namespace, count(*) AS n, round(avg(CAST(rank <= 8 AS INT)), 9) AS recall_8, round(avg(CAST(rank <= 32 AS INT)), 9) AS recall_32, round(avg(1.0 / rank), 9) AS mrr FROM {RANKED} r WHERE is_target GROUP BY namespace")
def _(spark, d):
    q = R.retrieval_quality(R.target_ranks(scored(spark, d)), [8, 32], "namespace")
    return q.select("namespace", "n", *[F.round(c, 9).alias(c) for c in ("recall_8", "recall_32", "mrr")])


@register("agg19_pool_bins", f"SELECT CAST(CASE WHEN pool > 55 THEN 2 WHEN pool > 48 THEN 1 ELSE 0 END AS INT) AS bin, count(*) AS n, count(*) FILTER (WHERE rank = 1) AS hits, round(sum(1.0 / pool), 6) AS expected FROM {RANKED} r WHERE is_target GROUP BY 1")
def _(spark, d):
    return R.pool_bins(R.target_ranks(scored(spark, d)), [48, 55]).withColumn("expected", F.round("expected", 6))


@register("agg22_coverage_curve", f"""SELECT CAST(share AS DOUBLE) AS share, min(upto) AS answered, round(arg_min(hits / upto, upto), 9) AS accuracy FROM (SELECT share, total, count(*) OVER (PARTITION BY share ORDER BY margin DESC RANGE UNBOUNDED PRECEDING) AS upto,
  sum(CAST(hit AS INT)) OVER (PARTITION BY share ORDER BY margin DESC RANGE UNBOUNDED PRECEDING) AS hits FROM (SELECT *, count(*) OVER (PARTITION BY share) AS total FROM (
  SELECT task_id, round(max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2), 6) AS margin, bool_or(is_target AND rank = 1) AS hit FROM {RANKED} r GROUP BY task_id) m, (SELECT unnest([0.2, 0.5, 1.0]) AS share) g) t) x
  WHERE upto >= ceil(share * total) GROUP BY share""")
def _(spark, d):
    m = R.margins(scored(spark, d)).withColumn("margin", F.round("margin", 6))
    return R.coverage_curve(m, [0.2, 0.5, 1.0]).withColumn("accuracy", F.round("accuracy", 9))


@register("agg24_residual_rank", f"SELECT count(*) AS n, count(*) FILTER (WHERE rank > 1) AS first_wrong, count(*) FILTER (WHERE rank = 2) AS second_right, round(count(*) FILTER (WHERE rank = 2) / nullif(count(*) FILTER (WHERE rank > 1), 0), 9) AS residual, round(avg(CAST(rank <= 2 AS INT)), 9) AS two_turn_ceiling FROM {RANKED} r WHERE is_target")
def _(spark, d):
    x = R.residual_rank(R.target_ranks(scored(spark, d)))
    return x.withColumns({c: F.round(c, 9) for c in ("residual", "two_turn_ceiling")})


MEMBERS = "(SELECT lang AS task_id, doc_id AS sym_id, doc_id AS ord, sha256(text) AS rendering_hash, doc_id % 40 = 0 AS is_target FROM documents)"


def members(spark, d):
    x = spark.read.parquet(f"{d}/documents.parquet")
    return x.select(F.col("lang").alias("task_id"), F.col("doc_id").alias("sym_id"), F.col("doc_id").alias("ord"), F.sha2("text", 256).alias("rendering_hash"), (F.col("doc_id") % 40 == 0).alias("is_target"))


@register("set1_distinct_renderings", f"SELECT task_id, rendering_hash, min(sym_id) AS sym_id, min(ord) AS ord, count(*) AS members FROM {MEMBERS} m GROUP BY task_id, rendering_hash")
def _(spark, d):
    return R.distinct_by_rendering(members(spark, d))


@register("set2_ambiguous_targets", f"SELECT task_id FROM {MEMBERS} m WHERE rendering_hash IN (SELECT rendering_hash FROM {MEMBERS} t WHERE is_target AND t.task_id = m.task_id) GROUP BY task_id HAVING count(*) > 1")
def _(spark, d):
    return R.ambiguous(members(spark, d))


ITEMS = "(SELECT CASE WHEN doc_id % 2 = 0 THEN 'context' ELSE 'candidate' END AS role, text, sha256(text) AS text_hash FROM documents)"


def items(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.when(F.col("doc_id") % 2 == 0, "context").otherwise("candidate").alias("role"), "text", "doc_id")


def cached(spark, d):
    return R.text_keys(items(spark, d).where("doc_id % 3 = 0")).select("role", "text_hash").distinct()


@register("rnk2_missing_texts", f"SELECT DISTINCT role, text_hash FROM {ITEMS} i EXCEPT SELECT CASE WHEN doc_id % 2 = 0 THEN 'context' ELSE 'candidate' END, sha256(text) FROM documents WHERE doc_id % 3 = 0")
def _(spark, d):
    return R.missing_texts(items(spark, d), cached(spark, d)).select("role", "text_hash")


# The same against a cache that is stored by prefixes of the hash.
@register("rnk2_missing_from_stored", ORACLES["rnk2_missing_texts"])
def _(spark, d):
    folder = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    R.write_cache(cached(spark, d).select("role", "text_hash", F.array(F.lit(0.0)).alias("vec")).distinct(), folder)
    return R.missing_from_cache(items(spark, d), folder).select("role", "text_hash")


def length_encoder():
    return lambda texts, role: [[float(len(t)), float(t.count(" ")), float(role == "context")] for t in texts]


@register("rnk1_encode_once", "SELECT role, text_hash, CAST(length(text) AS DOUBLE) AS v0, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS v1, CAST(role = 'context' AS DOUBLE) AS v2 FROM (SELECT role, text_hash, min(text) AS text FROM " + ITEMS + " i GROUP BY role, text_hash) x")
def _(spark, d):
    empty = spark.createDataFrame([], "role string, text_hash string, vec array<double>")
    return R.refresh_embeddings(items(spark, d), empty, length_encoder).select("role", "text_hash", *[F.get("vec", F.lit(k)).alias(f"v{k}") for k in range(3)])


@register("txt14_role_input", "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN 'query: ' || text ELSE text END) AS digest FROM documents")
def _(spark, d):
    return items(spark, d).select("doc_id", F.md5(R.role_input(F.col("text"), F.col("role"), "query: ")).alias("digest"))


TOKENS = "regexp_extract_all(text, '([A-Za-z_][A-Za-z_0-9]*|[0-9]+|[^\\sA-Za-z_0-9])')"


@register("txt7_token_buckets", f"SELECT item_id, ('0x' || substr(sha256(t), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM (SELECT item_id, unnest({TOKENS}) AS t FROM benchmark) x GROUP BY 1, 2")
def _(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    return b.select("item_id", F.explode(R.token_buckets(F.col("text"), 64)).alias("bucket")).groupBy("item_id", "bucket").agg(F.count(F.lit(1)).alias("n"))


@register("rnk3_hashed_embedding", f"""SELECT key, dim, round(sum(w) / count(*), 9) AS value FROM (SELECT item_id AS key, dim, ((('0x' || substr(sha256(t), 1, 8))::BIGINT % 64) * 7 + dim * 13) % 11 / 11.0 AS w
  FROM (SELECT item_id, unnest({TOKENS}) AS t FROM benchmark) x, (SELECT unnest(range(0, 4)) AS dim) g) y GROUP BY key, dim""")
def _(spark, d):
    grid = spark.range(64).select(F.col("id").alias("bucket"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("dim"))
    table = grid.withColumn("weight", (F.col("bucket") * 7 + F.col("dim") * 13) % 11 / 11.0)
    texts = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("key"), "text")
    return R.hashed_embedding(texts, table, 64).withColumn("value", F.round("value", 9))


@register("rnk17_lexical_overlap", f"""SELECT a.item_id AS item_id, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 9) AS overlap FROM (SELECT item_id, list_distinct({TOKENS.replace('text', 'lower(text)')}) AS s FROM benchmark) a
  JOIN (SELECT item_id, list_distinct({TOKENS.replace('text', 'lower(text)')}) AS s FROM benchmark) b ON b.item_id = a.item_id + 1""")
def _(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(other, "item_id").select("item_id", F.round(R.lexical_overlap(F.col("text"), F.col("other")), 9).alias("overlap"))


@register("rnk6_mlp_scores")
def _(spark, d):
    q, p = met_blocks(*retrieval(spark, d), ["namespace"], 256, 4096)
    both = q.withColumnRenamed("vec", "qv").join(p.withColumnRenamed("vec", "cv"), ["namespace", "qb", "pb"]).where("task_id <> cand_id")
    rows = both.select("task_id", order().alias("cand_idx"), F.col("qv").alias("context"), F.reverse("qv").alias("question"), F.col("cv").alias("candidate"))
    f = 7 * 64
    weights = {"gamma": [1.0] * f, "beta": [0.0] * f, "w1": [[((i * 31 + j * 17) % 13 - 6) / 60 for j in range(f)] for i in range(8)], "b1": [0.01 * i for i in range(8)], "w2": [0.1 * (i - 3) for i in range(8)], "b2": 0.0}
    return R.mlp_scores(rows, weights).withColumn("score", F.round("score", 9))


@register("join20_seeded_choice", """SELECT task_id, doc_id, rn FROM (SELECT lang AS task_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat_ws(chr(31), '0', 'negatives', lang, doc_id)), doc_id) AS rn FROM documents) x WHERE rn <= 15""")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("lang").alias("task_id"), "doc_id")
    w = R.of_task(order_key(0, "negatives", F.col("task_id"), F.col("doc_id")), "doc_id")
    return docs.withColumn("rn", F.row_number().over(w)).where("rn <= 15")
