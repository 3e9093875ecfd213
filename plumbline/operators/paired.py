"""Paired summaries, exact tests, cluster bootstraps and accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.expressions import draw, let, two_sided_binomial
from plumbline.operators.quantiles import exact_quantiles
from plumbline.sources.stored import stored


def summarize(pairs: DataFrame, *keys: str, means: bool = False) -> DataFrame:
    """Four-way contingency, arm totals and deltas of paired rows, for each key or in total; means: both arms' mean attempts, too.

    A rate delta is assisted minus baseline, an attempts delta baseline minus assisted; the turn delta counts only
    tasks that both arms solved.
    """
    b, a = F.col("b_ok"), F.col("a_ok")
    n = lambda c: F.count_if(c)
    sums = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tasks"), n(b).alias("baseline_successes"), n(a).alias("assisted_successes"), n("b_first").alias("baseline_first_pass"), n("a_first").alias("assisted_first_pass"),
        n(a & b).alias("both"), n(a & ~b).alias("assisted_only"), n(b & ~a).alias("baseline_only"), n(~a & ~b).alias("neither"),
        *([F.avg("b_attempts").alias("b_mean_attempts"), F.avg("a_attempts").alias("a_mean_attempts")] if means else []),
        (F.avg("b_attempts") - F.avg("a_attempts")).alias("mean_attempts_delta"), F.avg(F.when(a & b, F.col("b_attempts") - F.col("a_attempts"))).alias("mean_turn_delta"),
        n(a & b & (F.col("b_attempts") > F.col("a_attempts"))).alias("fewer_turns"), n(a & b & (F.col("b_attempts") < F.col("a_attempts"))).alias("more_turns"),
    )
    return sums.withColumn("success_rate_delta", (F.col("assisted_successes") - F.col("baseline_successes")) / F.nullif("tasks", F.lit(0)))


def turn_deltas(pairs: DataFrame, *keys: str) -> DataFrame:
    """How often each difference of attempts (baseline minus assisted) occurs among tasks that both arms solved."""
    both = pairs.where("a_ok AND b_ok").withColumn("turn_delta", F.col("b_attempts") - F.col("a_attempts"))
    return both.groupBy(*keys, "turn_delta").agg(F.count(F.lit(1)).alias("n"))


def exact_tests(summary: DataFrame) -> DataFrame:
    """summary with the exact McNemar and sign test p-values."""
    return summary.withColumns({"mcnemar_p": two_sided_binomial(F.col("assisted_only"), F.col("baseline_only")), "sign_p": two_sided_binomial(F.col("fewer_turns"), F.col("more_turns"))})


def required_discordant(ratios: DataFrame, alpha: float = 0.05, limit: int = 10_000) -> DataFrame:
    """For each favourable ratio the least number of discordant pairs that is significant (round half to even).

    Each ratio is one row, whose search stops computing at the first significant number.  A ratio that is not above one
    half and at most one, and one that no number up to the limit is significant for, is an error.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")

    def step(found: Column, n: Column) -> Column:
        wins = F.bround(n * F.col("ratio"), 0).cast("int")
        return F.when(found.isNotNull(), found).when(two_sided_binomial(wins, n - wins) < alpha, n)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(limit)), F.lit(None).cast("int"), step)
    fail = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), F.col("ratio").cast("string"))).cast("int")
    sound = F.coalesce((F.col("ratio") > 0.5) & (F.col("ratio") <= 1), F.lit(False))
    return ratios.select("ratio").distinct().select("ratio", F.when(sound, F.coalesce(found, fail(f"not significant up to {limit} pairs"))).otherwise(fail("ratio not in (0.5, 1]")).alias("required"))


def accuracy(examples: DataFrame, *keys: str) -> DataFrame:
    """n and micro accuracy of prediction against answer, for each key or in total."""
    return examples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("answer")).cast("int")).alias("accuracy"))


def macro_accuracy(examples: DataFrame, key: str = "namespace") -> DataFrame:
    """Mean of the keys' accuracies."""
    return accuracy(examples, key).agg(F.avg("accuracy").alias("macro_accuracy"), F.count(F.lit(1)).alias("groups"))


FEW = 50_000  # sources for which every draw may be a hash

BLOCK = 1024  # sources whose draws are counted in one matrix product


def numbered(sources: DataFrame) -> DataFrame:
    """sources with i, from 0 within each stratum, and the stratum's size; no task sees a whole stratum.

    Numbers go by a range of hashes, then by source within it; only counts of the ranges (4,096 a stratum) are added up.
    """
    x = sources.withColumn("_h", F.pmod(F.xxhash64("source"), F.lit(4096)))
    per = x.groupBy("stratum", "_h").agg(F.count(F.lit(1)).alias("_n"))
    of = Window.partitionBy("stratum").orderBy("_h")
    per = per.withColumns({"_before": F.sum("_n").over(of) - F.col("_n"), "size": F.sum("_n").over(Window.partitionBy("stratum"))}).drop("_n")
    own = F.row_number().over(Window.partitionBy("stratum", "_h").orderBy("source")) - 1
    at = F.col("p.stratum").eqNullSafe(F.col("x.stratum")) & (F.col("p._h") == F.col("x._h"))
    out = x.withColumn("_own", own).alias("x").join(per.alias("p"), at)
    return out.select("x.*", "p.size", (F.col("_before") + F.col("_own")).alias("i")).drop("_h", "_own")


def block_replicates(sources: DataFrame, sums: list[str], samples: int, seed: int) -> DataFrame:
    """Sums of `samples` resamples of the sources within each stratum: (b, stratum, sums), by multinomial counts.

    A stratum's sources lie in blocks.  How many draws of each replicate fall into a block is found by halving the
    stratum again and again, a binomial number at each half; all blocks below a half draw the same number, as it comes
    from the half's own seed.  Within a block the counts are multinomial, and one product with the block's sums gives
    its part of every replicate.  So a replicate costs a row for each block, not for each draw.
    """
    kind = sources.schema["stratum"].dataType.simpleString()
    kinds = {s: "double" if sources.schema[s].dataType.typeName() == "double" else "long" for s in sums}

    def draw_block(rows):
        import zlib

        import numpy as np
        import pandas as pd

        rows = rows.sort_values("i")
        n, block, stratum = int(rows["size"].iloc[0]), int(rows["block"].iloc[0]), rows["stratum"].iloc[0]
        name = zlib.crc32(str(stratum).encode())
        low, high, drawn = 0, -(-n // BLOCK), np.full(samples, n, np.int64)
        while high - low > 1:
            mid = (low + high) // 2
            left = np.random.default_rng([seed, name, low, high]).binomial(drawn, (mid - low) * BLOCK / (min(high * BLOCK, n) - low * BLOCK))
            low, high, drawn = (low, mid, left) if block < mid else (mid, high, drawn - left)
        counts = np.random.default_rng([seed, name, block]).multinomial(drawn, [1 / len(rows)] * len(rows))
        out = pd.DataFrame({s: counts @ rows[s].to_numpy(np.float64 if kinds[s] == "double" else np.int64) for s in sums})
        return out.assign(b=np.arange(1, samples + 1), stratum=stratum)[["b", "stratum", *sums]]

    blocks = numbered(sources).withColumn("block", F.expr(f"i DIV {BLOCK}"))
    parts = blocks.groupBy("stratum", "block").applyInPandas(draw_block, f"b long, stratum {kind}, " + ", ".join(f"{s} {kinds[s]}" for s in sums))
    return parts.groupBy("b", "stratum").agg(*[F.sum(s).alias(s) for s in sums])


CHUNK, SALTS = 65_536, 25  # sources in a block (and draws in a row) of hashed draws, and parts in which a block is worked on


def hashed_replicates(sources: DataFrame, sums: list[str], samples: int, seed: int) -> DataFrame:
    """The replicates of law "draws" for any number of sources.

    A row holds one replicate's draws, at most CHUNK of them, that fall into one block of the stratum's sources in order;
    it meets the block's sums in a task, and the blocks' parts are added up.  A draw costs a hash and four bytes
    of the shuffle; a block of sources travels SALTS times.
    """
    long = {s: sources.schema[s].dataType.typeName() != "double" for s in sums}
    stratum = sources.schema["stratum"].dataType.simpleString()
    sources = stored(sources)
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("source")) - 1
    block = lambda i: F.floor(i / CHUNK).cast("int")
    values = sources.withColumn("i", place).withColumn("block", block(F.col("i"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    upto = lambda n: F.sequence(F.lit(0), block(n - 1))
    rows = sources.groupBy("stratum").agg(F.count(F.lit(1)).alias("size")).withColumn("b", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(samples).cast("long")))).withColumn("chunk", F.explode(upto(F.col("size"))))
    spark = sources.sparkSession
    rows = rows.repartition(4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "stratum", "b", "chunk")
    start = F.col("chunk").cast("long") * CHUNK
    hashed = lambda prefix: F.transform(F.sequence(start, F.least(start + CHUNK, F.col("size")) - 1), lambda j: draw(F.col("size"), prefix, j).cast("int"))
    made = rows.withColumn("drawn", let(F.concat_ws(":", F.lit(seed), F.col("b"), F.col("stratum")), hashed)).withColumn("block", F.explode(upto(F.col("size"))))
    kept = F.when(F.col("size") <= CHUNK, F.col("drawn")).otherwise(F.filter("drawn", lambda i: block(i) == F.col("block")))
    drawn = made.select("stratum", "block", (F.col("b") % SALTS).cast("int").alias("salt"), "b", kept.alias("at"))

    def add(left, right):
        import numpy as np
        import pyarrow as pa

        right = right.sort_by("i")
        of = [right[s].to_numpy().astype(np.int64 if long[s] else np.float64) for s in sums]
        first = right["i"][0].as_py() if len(right) else 0
        out = [[] for _ in sums]
        for at in left["at"]:
            at = at.values.to_numpy() - first
            for total, x in zip(out, of, strict=True):
                total.append(x[at].sum())
        kinds = [pa.int64() if long[s] else pa.float64() for s in sums]
        return pa.Table.from_arrays([left["b"].combine_chunks(), left["stratum"].combine_chunks(), *[pa.array(t, k) for t, k in zip(out, kinds, strict=True)]], names=["b", "stratum", *sums])

    keys = ["stratum", "block", "salt"]
    values = values.select(*[F.col(c).alias(c) for c in (*keys, "i", *sums)])
    parts = drawn.groupBy(*keys).cogroup(values.groupBy(*keys)).applyInArrow(add, f"b long, stratum {stratum}, " + ", ".join(f"{s} {'long' if long[s] else 'double'}" for s in sums))
    return parts.groupBy("b", "stratum").agg(*[F.sum(s).alias(s) for s in sums])


def replicates(sources: DataFrame, sums: list[str], samples: int, seed: int, law: str = "blocks") -> DataFrame:
    """Sums of `samples` resamples of the sources within each stratum: (b, stratum, sums).

    sources has one row for each (stratum, source), already summed, so that tasks don't count.  law: "blocks" counts
    draws block by block; "draws" draws each source by a hash of (seed, b, stratum, j) that any engine can repeat, which
    is for few sources: a replicate is one row that looks its draws up in the strata's lists; "hashes" makes the same
    draws of any number of sources, as "draws" does where they are few.
    """
    if law == "blocks":
        return block_replicates(sources, sums, samples, seed)
    if law not in ("draws", "hashes"):
        raise ValueError(f"unknown law {law!r}")
    if law == "hashes" and samples and sources.limit(FEW + 1).count() > FEW:
        return hashed_replicates(sources, sums, samples, seed)
    if not samples or law == "draws" and sources.limit(FEW + 1).count() > FEW:
        raise ValueError(f"law 'draws' is for at most {FEW} sources")
    row = F.struct("source", *sums)
    lists = sources.groupBy("stratum").agg(F.array_sort(F.collect_list(row)).alias("all"))  # few, as has been counted
    spark = sources.sparkSession
    numbers = spark.range(1, samples + 1, 1, spark.sparkContext.defaultParallelism).withColumnRenamed("id", "b")
    zero = F.struct(*[F.lit(0).cast(sources.schema[s].dataType).alias(s) for s in sums])

    def add(total: Column, j: Column) -> Column:
        return let(F.get("all", draw(F.size("all"), seed, F.col("b"), F.col("stratum"), j).cast("int")), lambda x: F.struct(*[(total[s] + x[s]).alias(s) for s in sums]))

    drawn = numbers.join(F.broadcast(lists), F.lit(True)).select("b", "stratum", F.aggregate(F.sequence(F.lit(0).cast("long"), F.size("all").cast("long") - 1), zero, add).alias("x"))
    return drawn.select("b", "stratum", *[F.col(f"x.{s}").alias(s) for s in sums])


def interval(values: DataFrame, confidence: float, *keys: str) -> DataFrame:
    """Percentile interval of column v over replicates; undefined ones are dropped, `samples` tells how many stayed."""
    q = (1 - confidence) / 2
    return values.where("v IS NOT NULL").groupBy(*keys).agg(F.percentile("v", F.lit(q)).alias("lower"), F.percentile("v", F.lit(1 - q)).alias("upper"), F.count("v").alias("samples"))


def bootstrap_accuracy(examples: DataFrame, samples: int = 5000, confidence: float = 0.95, seed: int = 0, macro: bool = False, law: str = "blocks") -> DataFrame:
    """Estimate and interval of the accuracy, sources resampled whole; macro: within namespaces, which weigh alike."""
    hit = (F.col("prediction") == F.col("answer")).cast("long")
    stratum = F.col("namespace") if macro else F.lit("all")
    sources = examples.groupBy(stratum.alias("stratum"), "source").agg(F.sum(hit).alias("c"), F.count(F.lit(1)).alias("n"))
    per = replicates(sources, ["c", "n"], samples, seed, law).withColumn("r", F.col("c") / F.col("n"))
    values = per.groupBy("b").agg(F.avg("r").alias("v"))
    point = macro_accuracy(examples).select(F.col("macro_accuracy").alias("estimate")) if macro else accuracy(examples).select(F.col("accuracy").alias("estimate"))
    return point.join(F.broadcast(interval(values, confidence)))  # one row with one row


STATISTICS = {
    "success_rate_delta": lambda: (F.sum("a") - F.sum("b0")) / F.sum("n"),
    "mean_attempts_delta": lambda: (F.sum("ba") - F.sum("aa")) / F.sum("n"),
    "mean_correction_turn_delta": lambda: F.try_divide(F.sum("t").cast("double"), F.nullif(F.sum("both"), F.lit(0)).cast("double")),
}


PAIR_SUMS = ["n", "a", "b0", "ba", "aa", "both", "t"]


def paired_sources(pairs: DataFrame, stratum: Column) -> DataFrame:
    """The sums of each stratum's sources that every paired statistic comes from."""
    long = lambda c: F.sum(c.cast("long"))
    a, b = F.col("a_ok"), F.col("b_ok")
    return pairs.groupBy(stratum.alias("stratum"), "source").agg(
        F.count(F.lit(1)).alias("n"), long(a).alias("a"), long(b).alias("b0"), F.sum("b_attempts").alias("ba"), F.sum("a_attempts").alias("aa"), long(a & b).alias("both"),
        F.coalesce(F.sum(F.when(a & b, F.col("b_attempts") - F.col("a_attempts"))), F.lit(0)).alias("t"),
    )


def _statistic(name: str, samples: int, confidence: float):
    if name not in STATISTICS:
        raise ValueError(f"statistic must be one of {sorted(STATISTICS)}")
    if samples < 1 or not 0 < confidence < 1:
        raise ValueError("samples must be positive and confidence between 0 and 1")
    return STATISTICS[name]


def bootstrap_by(pairs: DataFrame, key: str, statistic: str = "success_rate_delta", samples: int = 5000, confidence: float = 0.95, seed: int = 0, law: str = "blocks") -> DataFrame:
    """(key, estimate, lower, upper, samples) of one paired statistic for each key by itself."""
    f = _statistic(statistic, samples, confidence)
    sources = paired_sources(pairs, F.col(key))
    values = replicates(sources, PAIR_SUMS, samples, seed, law).groupBy("b", "stratum").agg(f().alias("v"))
    ends = interval(values, confidence, "stratum")
    return sources.groupBy("stratum").agg(f().alias("estimate")).join(ends, "stratum").withColumnRenamed("stratum", key)


def confidence_distribution(rows: DataFrame, correct: str, confidence: str = "confidence", at: tuple = (0.25, 0.5, 0.75)) -> DataFrame:
    """n and exact quantiles of the confidence for right and wrong answers; no task holds all confidences of a group."""
    x = rows.select(F.col(correct).alias("correct"), F.col(confidence).alias("_c"))
    n = x.groupBy("correct").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("n.correct").eqNullSafe(F.col("q.correct"))
    return n.alias("n").join(exact_quantiles(x, "_c", list(at), "correct").alias("q"), same, "left").select("n.correct", "n.n", *[f"q.q{k}" for k in range(1, len(at) + 1)])


def bootstrap_paired(pairs: DataFrame, statistic: str = "success_rate_delta", samples: int = 5000, confidence: float = 0.95, seed: int = 0, strata: Column | None = None, law: str = "blocks") -> DataFrame:
    """Estimate and interval of one paired statistic, sources resampled whole within each stratum."""
    f = _statistic(statistic, samples, confidence)
    sources = paired_sources(pairs, strata if strata is not None else F.lit("all"))
    values = replicates(sources, PAIR_SUMS, samples, seed, law).groupBy("b").agg(f().alias("v"))
    return sources.agg(f().alias("estimate")).join(F.broadcast(interval(values, confidence)))  # one row with one row


def excess(rows: DataFrame, hit: str, chance: Column, *keys: str) -> DataFrame:
    """Observed hits, their expectation under uniform choice, and the mean excess."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(hit).cast("int")).alias("hits"), F.sum(chance).alias("expected"), F.avg(F.col(hit).cast("int") - chance).alias("excess"))


def excess_interval(rows: DataFrame, hit: str, chance: Column, samples: int = 5000, confidence: float = 0.95, seed: int = 0, law: str = "blocks") -> DataFrame:
    """Mean excess over uniform choice and its interval, sources resampled whole."""
    over = F.sum(F.col(hit).cast("double") - chance)
    sources = rows.groupBy(F.lit("all").alias("stratum"), "source").agg(over.alias("e"), F.count(F.lit(1)).alias("n"))
    values = replicates(sources, ["e", "n"], samples, seed, law).select((F.col("e") / F.col("n")).alias("v"))
    return sources.agg((F.sum("e") / F.sum("n")).alias("estimate")).join(F.broadcast(interval(values, confidence)))  # one row with one row


def gate(result: DataFrame) -> DataFrame:
    """Three conditions at once: better count, significant, interval above zero."""
    return result.withColumns({"better": F.col("assisted_successes") > F.col("baseline_successes"), "significant": F.col("mcnemar_p") < 0.05, "above_zero": F.col("lower") > 0}).withColumn("passes", F.expr("better AND significant AND above_zero"))


def rescued_and_spoiled(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Crosstab of two hit flags."""
    kind = F.when(F.col(after) & ~F.col(before), "rescued").when(F.col(before) & ~F.col(after), "spoiled").when(F.col(before), "kept").otherwise("missed")
    return rows.groupBy(kind.alias("transition")).agg(F.count(F.lit(1)).alias("n"))


def threshold_sweep(rows: DataFrame, grid: list[float]) -> DataFrame:
    """(threshold, successes, best): successes if the assisted arm is taken at or above each confidence threshold.

    One pass counts what each grid cell adds; running sums over the (few) cells give every threshold.
    """
    cell = sum(((F.col("confidence") >= F.lit(t)).cast("int") for t in sorted(grid)), F.lit(0))  # thresholds that the row reaches
    cells = rows.groupBy(cell.alias("reached")).agg(F.sum(F.col("a_ok").cast("long")).alias("a"), F.sum(F.col("b_ok").cast("long")).alias("b"))
    steps = rows.sparkSession.createDataFrame([(k + 1, t) for k, t in enumerate(sorted(grid))], "k int, threshold double")
    took = F.sum(F.when(F.col("reached") >= F.col("k"), F.col("a")).otherwise(F.col("b")))
    out = steps.join(F.broadcast(cells), F.lit(True)).groupBy("k", "threshold").agg(took.alias("successes"))
    best = F.row_number().over(Window.orderBy(F.desc("successes"), F.desc("threshold"))) == 1
    return out.select("threshold", "successes", best.alias("best"))


def routed(rows: DataFrame, sweep: DataFrame) -> DataFrame:
    """rows of another set with the arm that the best threshold of a sweep chooses: routed_ok, took_assisted, threshold.

    The sweep is one row for each cell of its grid.  A row without a confidence takes the baseline.
    """
    best = sweep.where("best").select("threshold")
    took = F.coalesce(F.col("confidence") >= F.col("threshold"), F.lit(False))
    return rows.join(F.broadcast(best), F.lit(True)).withColumn("took_assisted", took).withColumn("routed_ok", F.when(F.col("took_assisted"), F.col("a_ok")).otherwise(F.col("b_ok")))


def routing_result(rows: DataFrame, *keys: str) -> DataFrame:
    """Routed rows against always assisting: n, both counts, the discordant tasks and their exact test, for each key or in total."""
    r, a = F.col("routed_ok"), F.col("a_ok")
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("took_assisted").alias("took_assisted"), F.count_if(a).alias("assisted_successes"), F.count_if(r).alias("routed_successes"),
        F.count_if(r & ~a).alias("routed_only"), F.count_if(a & ~r).alias("assisted_only"), F.max("threshold").alias("threshold"),
    )
    return g.withColumns({"delta": (F.col("routed_successes") - F.col("assisted_successes")) / F.nullif("n", F.lit(0)), "p": two_sided_binomial(F.col("routed_only"), F.col("assisted_only"))})


def failure_signatures(outs: DataFrame, recommendations: DataFrame) -> DataFrame:
    """How the assisted arm behaved toward its recommendation, a row for each task."""
    x = outs.where("arm = 'assisted'").join(recommendations, "task_id")
    correct = F.col("recommendation") == F.col("answer_index")
    followed = F.col("first_selected") == F.col("recommendation")  # null if the first answer was not readable
    failed = ~F.col("success")
    return x.select(
        "task_id", "namespace", correct.alias("recommendation_correct"), F.col("success").alias("assisted_success"), F.col("first_reason").alias("first_attempt_reason"), "terminal_reason",
        followed.alias("followed_recommendation"), (correct & failed & ~F.coalesce(followed, F.lit(False))).alias("ignored_correct"),
        (~correct & failed & F.coalesce(followed, F.lit(False))).alias("followed_wrong"), (failed & (F.col("attempts_used") > 1)).alias("recovery_failed"),
    )


def summarize_failures(signatures: DataFrame, *keys: str) -> DataFrame:
    n = F.count_if
    failed = ~F.col("assisted_success")
    un = "unparseable_selection"
    return signatures.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tasks"), n(failed).alias("assisted_failures"), n(~F.col("recommendation_correct")).alias("wrong_recommendations"), n("ignored_correct").alias("correct_ignored"),
        n("followed_wrong").alias("wrong_followed"), n("recovery_failed").alias("recovery_failures"), n(failed & (F.col("first_attempt_reason") == un)).alias("unparseable_first"),
        n(failed & (F.col("terminal_reason") == un)).alias("terminal_unparseable"), F.avg(failed.cast("int")).alias("failure_rate"),
    )


def recommendation_states(outs: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Successes on the first pass and within budget, and how often it was followed, by whether the recommendation is right."""
    x = outs.where("arm = 'assisted'").join(recommendations, "task_id")
    return x.groupBy((F.col("recommendation") == F.col("answer_index")).alias("recommendation_correct")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("first_pass_success").alias("first_pass"), F.count_if("success").alias("within_budget"), F.count_if(F.col("first_selected") == F.col("recommendation")).alias("followed"),
    )
