"""Embedding once per text, scoring, ranking, shortlists and retrieval measures.

scores: task_id, cand_idx, score.  Ties go to the lowest index everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.stored import stored


def of_task(*order: Column | str) -> Window:
    w = Window.partitionBy("task_id")
    return w.orderBy(*order) if order else w


def text_keys(items: DataFrame) -> DataFrame:
    """items (role, text) with text_hash: joins go by the hash, not the text."""
    return items.withColumn("text_hash", F.sha2("text", 256))


def missing_texts(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct (role, text_hash, text) that no cached embedding covers; one shuffle by hash serves both steps."""
    distinct = text_keys(items).dropDuplicates(["role", "text_hash"])
    return distinct.join(cache.select("role", "text_hash"), ["role", "text_hash"], "left_anti").select("role", "text_hash", "text")


def write_cache(rows: DataFrame, folder: str, digits: int = 2) -> None:
    """Add embeddings (role, text_hash, vec) to a stored cache: a folder for each prefix of the hash, so many hex digits long.

    Within a file rows are in order of the hash, so that a reader's row groups know their range.  A row is added once:
    give what missing_from_cache found missing.
    """
    rows = rows.withColumn("prefix", F.substring("text_hash", 1, digits))
    rows.repartition("prefix").sortWithinPartitions("prefix", "text_hash", "role").write.mode("append").partitionBy("prefix").parquet(folder)


def touched_cache(keys: DataFrame, folder: str, digits: int = 2, few: int = 100_000) -> DataFrame:
    """(role, text_hash) of a stored cache that may meet the keys (role, text_hash): the prefixes that they touch, nothing else is read.

    At most 16 ** digits prefixes are looked up.  Up to `few` keys, which are counted, are sent along, and only rows of the cache
    that they name leave the scan.
    """
    prefixes = sorted(r.p for r in keys.select(F.substring("text_hash", 1, digits).alias("p")).distinct().collect())
    cache = keys.sparkSession.read.schema("role string, text_hash string, vec array<double>, prefix string").parquet(folder).where(F.col("prefix").isin(prefixes))
    cache = cache.select("role", "text_hash")
    if keys.limit(few + 1).count() <= few:
        cache = cache.join(F.broadcast(keys.select("role", "text_hash")), ["role", "text_hash"], "left_semi")
    return cache


def missing_from_cache(items: DataFrame, folder: str, digits: int = 2) -> DataFrame:
    """missing_texts() against a stored cache, of which only what the texts may meet is read."""
    distinct = stored(text_keys(items).dropDuplicates(["role", "text_hash"]).select("role", "text_hash", "text"))
    return distinct.join(touched_cache(distinct.select("role", "text_hash"), folder, digits), ["role", "text_hash"], "left_anti")


def encode_texts(texts: DataFrame, encoder: Callable[[], Callable[[list[str], str], list]], batch: int = 64) -> DataFrame:
    """(role, text_hash, vec): the encoder factory runs once in a worker; batches hold texts of one role."""

    def of(frames):
        import pandas as pd

        encode = encoder()
        for frame in frames:
            for role, rows in frame.groupby("role"):
                for k in range(0, len(rows), batch):
                    part = rows.iloc[k : k + batch]
                    yield pd.DataFrame({"role": role, "text_hash": part["text_hash"], "vec": list(encode(part["text"].tolist(), role))})

    return texts.mapInPandas(of, "role string, text_hash string, vec array<double>")


def refresh_embeddings(items: DataFrame, cache: DataFrame, encoder, batch: int = 64) -> DataFrame:
    """The cache with what was missing."""
    return cache.unionByName(encode_texts(missing_texts(items, cache), encoder, batch))


def role_input(text: Column, role: Column, prefix: str) -> Column:
    """Encoder input: contexts and questions carry the query prefix, candidates none."""
    return F.when(role.isin("context", "question"), F.concat(F.lit(prefix), text)).otherwise(text)


def tokens(text: Column) -> Column:
    """Identifiers, numbers and single marks; `<empty>` without any."""
    found = F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z_0-9]*|[0-9]+|[^\\sA-Za-z_0-9])"), F.lit(1))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("<empty>")))


def token_buckets(text: Column, buckets: int) -> Column:
    """Stable bucket of each token."""
    return F.transform(tokens(text), lambda t: F.pmod(F.conv(F.substring(F.sha2(t, 256), 1, 8), 16, 10).cast("long"), F.lit(buckets)))


def hashed_embedding(texts: DataFrame, table: DataFrame, buckets: int) -> DataFrame:
    """(key, dim, value): mean of the token buckets' vectors; table: bucket, dim, weight."""
    exploded = texts.select("key", F.explode(token_buckets(F.col("text"), buckets)).alias("bucket"))
    counts = exploded.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n"))  # a token costs one row however often it occurs
    sizes = counts.groupBy("key").agg(F.sum("n").alias("size"))
    return counts.join(table, "bucket").groupBy("key", "dim").agg(F.sum(F.col("n") * F.col("weight")).alias("s")).join(sizes, "key").select("key", "dim", (F.col("s") / F.col("size")).alias("value"))


def cosine_mix(context_cos: Column, question_cos: Column, mix: float, log_scale: float, low: float = 0.0, high: float = 4.6) -> Column:
    """Sigmoid-weighted mixture of two cosines times a clamped exponential scale."""
    w = 1 / (1 + F.exp(F.lit(-mix)))
    return (w * context_cos + (1 - w) * question_cos) * F.exp(F.least(F.lit(high), F.greatest(F.lit(low), F.lit(log_scale))))


def mlp_scores(pairs: DataFrame, weights: dict) -> DataFrame:
    """Scores of (context, question, candidate) vectors by given weights: pairwise features, norm, linear, exact GELU, linear.

    weights: gamma, beta (7d), w1 (h x 7d), b1 (h), w2 (h), b2.
    """

    def of(batches):
        import math

        import numpy as np
        import pandas as pd

        w = {k: np.asarray(v, float) for k, v in weights.items()}
        erf = np.vectorize(math.erf)
        for rows in batches:
            c, q, k = (np.stack(rows[x].to_list()).astype(float) if len(rows) else np.zeros((0, 1)) for x in ("context", "question", "candidate"))
            if not len(rows):
                continue
            x = np.hstack([c, q, k, c * k, q * k, np.abs(c - k), np.abs(q - k)])
            x = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5) * w["gamma"] + w["beta"]
            h = x @ w["w1"].T + w["b1"]
            h = 0.5 * h * (1 + erf(h / math.sqrt(2)))
            yield pd.DataFrame({"task_id": rows["task_id"], "cand_idx": rows["cand_idx"], "score": h @ w["w2"] + w["b2"]})

    return pairs.mapInPandas(of, "task_id long, cand_idx long, score double")


def probabilities(scores: DataFrame) -> DataFrame:
    """scores with softmax prob within the task and top, the first best candidate."""
    e = F.exp(F.col("score") - F.max("score").over(of_task()))
    best = F.row_number().over(of_task(F.desc("score"), "cand_idx")) == 1
    return scores.withColumns({"prob": e / F.sum(e).over(of_task()), "top": best})


def constrained(scores: DataFrame) -> DataFrame:
    """Softmax over allowed candidates: prob (0 where not allowed), chosen_index, escalate when none is allowed."""
    w = of_task()
    score = F.when(F.col("allowed"), F.col("score"))
    e = F.when(F.col("allowed"), F.exp(score - F.max(score).over(w))).otherwise(F.lit(0.0))
    total = F.sum(e).over(w)
    any_allowed = F.max(F.col("allowed").cast("int")).over(w) == 1
    out = scores.withColumns({"prob": F.when(total > 0, e / total).otherwise(F.lit(0.0)), "escalate": ~any_allowed, "_best": F.max(score).over(w)})
    chosen = F.min(F.when(F.col("allowed") & (F.col("score") == F.col("_best")), F.col("cand_idx"))).over(w)
    return out.withColumn("chosen_index", chosen).drop("_best")


def ranked(scores: DataFrame, *order: Column) -> DataFrame:
    """scores with rank from 1, best score first unless another order is given."""
    return scores.withColumn("rank", F.row_number().over(of_task(*(order or (F.desc("score"), F.col("cand_idx"))))))


def check_permutation(rankings: DataFrame) -> DataFrame:
    """Tasks whose ranks (from 0) are no permutation."""
    g = rankings.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    return g.where("NOT (n = d AND lo = 0 AND hi = n - 1)").select("task_id")


def recommend(rankings: DataFrame) -> DataFrame:
    """(task_id, recommendation): best rank that is allowed and not rejected, null where there is none."""
    ok = F.col("allowed") & ~F.col("rejected")
    return rankings.groupBy("task_id").agg(F.min_by("cand_idx", F.when(ok, F.col("rank"))).alias("recommendation"))


def shortlist(scores: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k best of each task, all of a smaller pool; Spark cuts each task's rows before it shuffles them."""
    return ranked(scores, *order).where(F.col("rank") <= k)


def rerank(short: DataFrame, second: DataFrame) -> DataFrame:
    """(task_id, hit): whether the target comes first after reranking the shortlist; a target that is not in it is missed."""
    best = second.join(short.select("task_id", "cand_idx"), ["task_id", "cand_idx"], "left_semi")
    top = ranked(best).where("rank = 1").select("task_id", F.col("is_target").alias("hit"))
    return second.select("task_id").distinct().join(top, "task_id", "left").select("task_id", F.coalesce("hit", F.lit(False)).alias("hit"))


def cross_entropy(scores: DataFrame) -> DataFrame:
    """(task_id, loss) of the labelled candidate."""
    m = scores.groupBy("task_id").agg(F.max("score").alias("m"))
    g = scores.join(m, "task_id").groupBy("task_id").agg(F.max(F.when(F.col("is_target"), F.col("score"))).alias("t"), F.first("m").alias("m"), F.sum(F.exp(F.col("score") - F.col("m"))).alias("z"))
    return g.select("task_id", (F.col("m") + F.log("z") - F.col("t")).alias("loss"))


def batches(tasks: DataFrame, batch: int, *seed) -> DataFrame:
    """tasks (task_id, k) with batch numbers: tasks of equal candidate count only, in seeded order."""
    from plumbline.functions.expressions import numbered, order_key

    at = numbered(tasks.withColumn("_h", order_key(*seed, F.col("task_id"))), "_at", ["k"], "_h", "task_id")
    return at.withColumn("batch", F.floor(F.col("_at") / batch).cast("long")).drop("_h", "_at")


def target_ranks(scores: DataFrame, *order: Column) -> DataFrame:
    """(task_id, namespace, rank, pool) of each task's target."""
    r = ranked(scores, *order).withColumn("pool", F.count(F.lit(1)).over(of_task()))
    return r.where("is_target").select("task_id", "namespace", "rank", "pool")


def retrieval_quality(ranks: DataFrame, cuts: list[int], *keys: str) -> DataFrame:
    """n, recall at each cut and mean reciprocal rank; a target outside the pool has a null rank."""
    return ranks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")).alias(f"recall_{k}") for k in cuts], F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def rank_histogram(ranks: DataFrame, edges: list[int], *keys: str) -> DataFrame:
    """How many targets have a rank above each number of edges (bin 0: at most the first); null bin: not in the pool."""
    b = sum(((F.col("rank") > e).cast("int") for e in sorted(edges)), F.lit(0))
    return ranks.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pool_bins(ranks: DataFrame, edges: list[int]) -> DataFrame:
    """Hits and their expectation in bins of pool size fixed beforehand."""
    b = sum(((F.col("pool") > e).cast("int") for e in edges), F.lit(0))
    return ranks.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") == 1).alias("hits"), F.sum(1 / F.col("pool")).alias("expected"))


def coverage_curve(tasks: DataFrame, shares: list[float]) -> DataFrame:
    """Selective accuracy when only the share of tasks with the largest margins is answered.

    Tasks are counted per margin first.  The counts are dealt by range of margins, added up within each range, and the
    sums of the ranges before (a row for each) come on top, so no task sees all margins.
    """
    by = tasks.groupBy("margin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("long")).alias("h"))
    by = stored(by.repartitionByRange(F.desc("margin")).withColumn("part", F.spark_partition_id()))
    sums = by.groupBy("part").agg(F.sum("n").alias("pn"), F.sum("h").alias("ph"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("ph").over(before), F.lit(0)).alias("h0"))
    total = by.agg(F.sum("n").alias("total"))
    w = Window.partitionBy("part").orderBy(F.desc("margin")).rowsBetween(Window.unboundedPreceding, 0)
    run = by.withColumns({"upto": F.sum("n").over(w), "hits": F.sum("h").over(w)}).join(F.broadcast(starts), "part").join(F.broadcast(total), F.lit(True))
    run = run.withColumns({"upto": F.col("upto") + F.col("n0"), "hits": F.col("hits") + F.col("h0")})
    out = run.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).where(F.col("upto") >= F.ceil(F.col("share") * F.col("total")))
    return out.groupBy("share").agg(F.min("upto").alias("answered"), F.min_by(F.col("hits") / F.col("upto"), "upto").alias("accuracy"))


def margins(scores: DataFrame) -> DataFrame:
    """(task_id, margin, hit): distance of the two best scores, and whether the best is the target."""
    g = ranked(scores).where("rank <= 2").groupBy("task_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"), F.bool_or(F.col("is_target") & (F.col("rank") == 1)).alias("hit"))
    return g.select("task_id", (F.col("a") - F.coalesce("b", F.col("a"))).alias("margin"), "hit")


def residual_rank(ranks: DataFrame) -> DataFrame:
    """Where the first pick is wrong, how often the second is right, and what two turns could reach."""
    wrong, second = F.count_if(F.col("rank") > 1), F.count_if(F.col("rank") == 2)
    return ranks.agg(F.count(F.lit(1)).alias("n"), wrong.alias("first_wrong"), second.alias("second_right"), F.try_divide(second, wrong).alias("residual"), F.avg((F.col("rank") <= 2).cast("int")).alias("two_turn_ceiling"))


def residual_ranks(scores: DataFrame) -> DataFrame:
    """residual_rank before and after the predicate, a row each (stage): all candidates, and those that bind.

    scores: task_id, cand_idx, score, is_target, bindable.  A task whose target does not bind, or that nothing binds, has
    no rank after the predicate: its first pick is wrong.
    """
    out = None
    tasks = scores.select("task_id").distinct()
    for stage, rows in (("before", scores), ("after", scores.where("bindable"))):
        rank = ranked(rows).where("is_target").select("task_id", "rank")
        part = residual_rank(tasks.join(rank, "task_id", "left").select(F.coalesce("rank", F.lit(2**31 - 1)).alias("rank"))).withColumn("stage", F.lit(stage))
        out = part if out is None else out.unionByName(part)
    return out


def distinct_by_rendering(members: DataFrame) -> DataFrame:
    """The first member of each rendering in a task and how many share it."""
    return members.groupBy("task_id", "rendering_hash").agg(F.min_by("sym_id", "ord").alias("sym_id"), F.min("ord").alias("ord"), F.count(F.lit(1)).alias("members"))


def ambiguous(members: DataFrame) -> DataFrame:
    """Tasks whose target's rendering is not unique in the pool."""
    target = members.where("is_target").select("task_id", "rendering_hash").distinct()
    return members.join(target, ["task_id", "rendering_hash"], "left_semi").groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("task_id")


def lexical_overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of two texts' token sets."""
    x, y = F.array_distinct(tokens(F.lower(a))), F.array_distinct(tokens(F.lower(b)))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def structural_baseline(candidates: DataFrame, *keys: str) -> DataFrame:
    """Expected hits of choosing by file and arity alone: (n, hits, accuracy) for each key or in total.

    candidates: task_id, is_target, same_file, same_arity.  Those that agree in most of the two are the choice; where
    they are several, each is as likely, so a tie counts its share and no order of candidates matters.
    """
    score = F.col("same_file").cast("int") + F.col("same_arity").cast("int")
    x = candidates.select(*keys, "task_id", "is_target", score.alias("score"))
    per = x.groupBy(*keys, "task_id", "score").agg(F.count(F.lit(1)).alias("n"), F.bool_or("is_target").alias("hit"))
    best = per.groupBy(*keys, "task_id").agg(F.max_by(F.when(F.col("hit"), 1 / F.col("n")).otherwise(F.lit(0.0)), "score").alias("hit"))
    return best.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.avg("hit").alias("accuracy"))
