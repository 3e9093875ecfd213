"""Queries of the verification, replay, pairing, statistics and failure operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.bridges import ATTEMPTS, EXAMPLES, PAIRS, RECOMMENDATIONS, sql, view
from plumbline.operators import attempts as A
from plumbline.operators import paired as P

QUERIES, ORACLES = {}, {}


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def r(c: str, digits: int = 9):
    return F.round(c, digits).alias(c)


# Building blocks of the oracles, written without the operators.
PARSED = f"""(SELECT *, CASE WHEN k BETWEEN 1 AND 4 THEN k - 1 END AS sel FROM (
  SELECT *, TRY_CAST(regexp_extract(trim(output), '^(?:[Cc]andidate\\s*)?(\\d+)\\s*[:.)]?$', 1) AS INT) AS k FROM ({sql(ATTEMPTS)}) a) b)"""
VERDICTS = f"""(SELECT *, CASE WHEN task <> 'python.hard_masked_direct_call' THEN 'unsupported_task' WHEN sel IS NULL THEN 'unparseable_selection' WHEN sel <> answer_index THEN 'wrong_selection' ELSE 'ok' END AS why FROM {PARSED} p)"""
REPLAYED = f"""(SELECT *, CASE WHEN sel IS NULL THEN 'unparseable_selection' WHEN list_contains(rej, sel) THEN 'rejected_candidate' ELSE why END AS reason FROM (
  SELECT *, coalesce(list(sel) FILTER (WHERE why = 'wrong_selection') OVER w, []) AS rej, coalesce(max(CASE WHEN why = 'ok' THEN 1 ELSE 0 END) OVER w, 0) AS done FROM {VERDICTS} v
  WINDOW w AS (PARTITION BY task_id, arm ORDER BY attempt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x WHERE done = 0)"""
OUTCOMES = f"""(SELECT task_id, arm, bool_or(reason = 'ok') AS success, count(*) AS used, arg_min(reason = 'ok', attempt_no) AS first_ok, arg_min(reason, attempt_no) AS first_reason,
  arg_max(reason, attempt_no) AS last_reason, min(CASE WHEN attempt_no = 1 THEN sel END) AS first_sel, min(answer_index) AS answer_index, min(namespace) AS namespace, min(source) AS source FROM {REPLAYED} y GROUP BY task_id, arm)"""
RECS = f"({sql(RECOMMENDATIONS, attempts=sql(ATTEMPTS))})"


def _attempts(spark, d):
    return view(spark, d, ATTEMPTS)


def _recs(spark, d):
    return view(spark, d, RECOMMENDATIONS, attempts=ATTEMPTS)


def _outcomes(spark, d):
    return A.outcomes(A.replay(_attempts(spark, d)), "answer_index", "namespace", "source")


@register("ver1_parse_index", f"SELECT task_id, arm, attempt_no, sel AS selected_index FROM {PARSED} p")
def _(spark, d):
    return A.verify(_attempts(spark, d)).select("task_id", "arm", "attempt_no", "selected_index")


@register("ver2_verify_selection", f"SELECT task_id, arm, attempt_no, why AS reason, why = 'ok' AS valid FROM {VERDICTS} v")
def _(spark, d):
    return A.verify(_attempts(spark, d)).select("task_id", "arm", "attempt_no", "reason", "valid")


@register("ver3_verify_with_memory", f"""SELECT task_id, arm, attempt_no, CASE WHEN sel IS NULL THEN 'unparseable_selection' WHEN sel = attempt_no - 1 THEN 'rejected_candidate' ELSE why END AS reason FROM {VERDICTS} v""")
def _(spark, d):
    rows = _attempts(spark, d).withColumn("rejected", F.array(F.col("attempt_no") - 1))
    return A.verify_with_memory(rows).select("task_id", "arm", "attempt_no", "reason")


@register("ver6_replay", f"SELECT task_id, arm, attempt_no, reason, len(list_distinct(rej)) AS n_rejected FROM {REPLAYED} y")
def _(spark, d):
    return A.replay(_attempts(spark, d)).select("task_id", "arm", "attempt_no", "reason", F.size("rejected").cast("long").alias("n_rejected"))


RANKED = "[answer_index, (answer_index + 1) % 4, (answer_index + 2) % 4, (answer_index + 3) % 4]"


@register("ver6_ranked_replay", f"""SELECT task_id, arm, attempt_no, reason, list_filter([(answer_index + 1) % 4, answer_index, (answer_index + 2) % 4, (answer_index + 3) % 4], lambda i: i <> task_id % 4 AND NOT list_contains(rej, i))[1] AS recommendation FROM {REPLAYED} y""")
def _(spark, d):
    a = F.col("answer_index")
    rows = _attempts(spark, d).withColumn("ranking", F.array((a + 1) % 4, a, (a + 2) % 4, (a + 3) % 4)).withColumn("allowed", F.transform(F.array(*map(F.lit, range(4))), lambda i: i != F.col("task_id") % 4))
    return A.replay(rows, ranking="ranking", allowed="allowed").select("task_id", "arm", "attempt_no", "reason", "recommendation")


@register("ver7_gated_first", f"""SELECT task_id, arm, (answer_index + 1) % 4 = task_id % 4 AS gated FROM {REPLAYED} y WHERE attempt_no = 1""")
def _(spark, d):
    a = F.col("answer_index")
    rows = _attempts(spark, d).withColumn("ranking", F.array((a + 1) % 4, a, (a + 2) % 4, (a + 3) % 4)).withColumn("allowed", F.transform(F.array(*map(F.lit, range(4))), lambda i: i != F.col("task_id") % 4))
    return A.gated_at_first_turn(A.replay(rows, ranking="ranking", allowed="allowed"), "ranking")


@register("ver8_outcomes", f"SELECT task_id, arm, success, used AS attempts_used, greatest(used - 1, 0) AS correction_turns, first_ok AS first_pass_success FROM {OUTCOMES} o")
def _(spark, d):
    return _outcomes(spark, d).select("task_id", "arm", "success", "attempts_used", "correction_turns", "first_pass_success")


@register("ver9_pair_arms", f"""SELECT b.task_id, CAST(a.success AS INT) - CAST(b.success AS INT) AS success_delta, CASE WHEN a.success AND b.success THEN b.used - a.used END AS turn_delta
  FROM {OUTCOMES} b JOIN {OUTCOMES} a ON a.task_id = b.task_id AND a.arm = 'assisted' AND b.arm = 'baseline'""")
def _(spark, d):
    return A.pair(_outcomes(spark, d)).select("task_id", "success_delta", "turn_delta")


GATES = "count(*) AS n, count(*) FILTER (WHERE sel IS NOT NULL) AS parsed, count(*) FILTER (WHERE sel IS NOT NULL AND why <> 'unsupported_task') AS supported, count(*) FILTER (WHERE why = 'ok' AND sel IS NOT NULL) AS correct"


@register("ver10_funnel", f"SELECT 'total' AS level, '' AS value, {GATES} FROM {VERDICTS} v UNION ALL SELECT 'namespace', namespace, {GATES} FROM {VERDICTS} v GROUP BY namespace UNION ALL SELECT 'arm', arm, {GATES} FROM {VERDICTS} v GROUP BY arm")
def _(spark, d):
    rows = A.verify(_attempts(spark, d)).withColumns({"parsed": F.col("selected_index").isNotNull(), "supported": F.col("reason") != "unsupported_task", "correct": F.col("valid")})
    return A.funnel(rows, ["parsed", "supported", "correct"], "namespace", "arm")


@register("ver11_conditional_entry", f"SELECT v.task_id, arm FROM {VERDICTS} v JOIN {RECS} q ON v.task_id = q.task_id WHERE attempt_no = 1 AND recommendation <> answer_index AND sel = recommendation")
def _(spark, d):
    return A.conditional_entry(A.verify(_attempts(spark, d)), _recs(spark, d))


ACC = "avg(CAST(answer = prediction AS INT))"
EX = f"({sql(EXAMPLES)})"


@register("agg1_accuracy", f"SELECT count(*) AS n, round({ACC}, 9) AS accuracy FROM {EX} e")
def _(spark, d):
    return P.accuracy(view(spark, d, EXAMPLES)).select("n", r("accuracy"))


@register("agg2_namespace_accuracy", f"SELECT namespace, count(*) AS n, round({ACC}, 9) AS accuracy FROM {EX} e GROUP BY namespace")
def _(spark, d):
    return P.accuracy(view(spark, d, EXAMPLES), "namespace").select("namespace", "n", r("accuracy"))


@register("agg3_macro_accuracy", f"SELECT round(avg(a), 9) AS macro_accuracy, count(*) AS groups FROM (SELECT namespace, {ACC} AS a FROM {EX} e GROUP BY namespace) g")
def _(spark, d):
    return P.macro_accuracy(view(spark, d, EXAMPLES)).select(r("macro_accuracy"), "groups")


def replicated(sources: str, sums: list[str], samples: int, seed: int) -> str:
    total = ", ".join(f"CAST(sum({s}) AS DOUBLE) AS {s}" for s in sums)
    return f"""(SELECT b, g.stratum, {total} FROM (SELECT b, stratum, ('0x' || substr(md5(concat_ws(':', {seed}, b, stratum, j)), 1, 8))::BIGINT % size AS i
      FROM (SELECT b, stratum, size, unnest(range(0, size)) AS j FROM (SELECT stratum, count(*) AS size, unnest(range(1, {samples} + 1)) AS b FROM {sources} s GROUP BY stratum) z) y) g
      JOIN (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY source) - 1 AS i FROM {sources} s) x ON g.stratum = x.stratum AND g.i = x.i GROUP BY b, g.stratum)"""


def sources_of(stratum: str) -> str:
    return f"(SELECT {stratum} AS stratum, source, sum(CAST(answer = prediction AS INT)) AS c, count(*) AS n FROM {EX} e GROUP BY 1, 2)"


def ends(values: str) -> str:
    return f"(SELECT round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper, count(v) AS samples FROM {values} v)"


@register("agg4_bootstrap_accuracy", f"""SELECT (SELECT round({ACC}, 6) FROM {EX} e) AS estimate, t.* FROM {ends(f"(SELECT b, c / n AS v FROM {replicated(sources_of(chr(39) + 'all' + chr(39)), ['c', 'n'], 5000, 1)} q)")} t""")
def _(spark, d):
    return P.bootstrap_accuracy(view(spark, d, EXAMPLES), seed=1, law="hashes").select(r("estimate", 6), r("lower", 6), r("upper", 6), "samples")


@register("agg5_bootstrap_macro", f"""SELECT (SELECT round(avg(a), 6) FROM (SELECT {ACC} AS a FROM {EX} e GROUP BY namespace) m) AS estimate, t.* FROM {ends(f"(SELECT b, avg(c / n) AS v FROM {replicated(sources_of('namespace'), ['c', 'n'], 5000, 2)} q GROUP BY b)")} t""")
def _(spark, d):
    return P.bootstrap_accuracy(view(spark, d, EXAMPLES), seed=2, macro=True, law="hashes").select(r("estimate", 6), r("lower", 6), r("upper", 6), "samples")


PR = f"({sql(PAIRS)})"
SUMMARY = """count(*) AS tasks, count(*) FILTER (WHERE b_ok) AS baseline_successes, count(*) FILTER (WHERE a_ok) AS assisted_successes, count(*) FILTER (WHERE b_first) AS baseline_first_pass,
  count(*) FILTER (WHERE a_first) AS assisted_first_pass, count(*) FILTER (WHERE a_ok AND b_ok) AS both, count(*) FILTER (WHERE a_ok AND NOT b_ok) AS assisted_only,
  count(*) FILTER (WHERE b_ok AND NOT a_ok) AS baseline_only, count(*) FILTER (WHERE NOT a_ok AND NOT b_ok) AS neither, round(avg(b_attempts) - avg(a_attempts), 9) AS mean_attempts_delta,
  round(avg(b_attempts - a_attempts) FILTER (WHERE a_ok AND b_ok), 9) AS mean_turn_delta, count(*) FILTER (WHERE a_ok AND b_ok AND b_attempts > a_attempts) AS fewer_turns,
  count(*) FILTER (WHERE a_ok AND b_ok AND b_attempts < a_attempts) AS more_turns, round((count(*) FILTER (WHERE a_ok) - count(*) FILTER (WHERE b_ok)) / count(*), 9) AS success_rate_delta"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in ("mean_attempts_delta", "mean_turn_delta", "success_rate_delta")})


@register("agg6_paired_summary", f"SELECT {SUMMARY} FROM {PR} p")
def _(spark, d):
    return _rounded(P.summarize(view(spark, d, PAIRS)))


@register("agg7_paired_by_namespace", f"SELECT namespace, {SUMMARY} FROM {PR} p GROUP BY namespace")
def _(spark, d):
    return _rounded(P.summarize(view(spark, d, PAIRS), "namespace"))


@register("agg7_paired_by_family", f"SELECT family, {SUMMARY} FROM {PR} p GROUP BY family")
def _(spark, d):
    return _rounded(P.summarize(view(spark, d, PAIRS), "family"))


def tail(w: str, x: str) -> str:
    """Two-sided exact p-value by log-gamma, in DuckDB."""
    return f"least(1.0, coalesce(2 * (SELECT sum(exp(lgamma({w} + {x} + 1) - lgamma(k + 1) - lgamma({w} + {x} - k + 1) - ({w} + {x}) * ln(2.0))) FROM (SELECT unnest(range(0, least({w}, {x}) + 1)) AS k) u), 1.0))"


@register("agg8_mcnemar", f"""SELECT source, round({tail('assisted_only', 'baseline_only')}, 9) AS mcnemar_p FROM (SELECT source, {SUMMARY} FROM {PR} p GROUP BY source) s""")
def _(spark, d):
    return P.exact_tests(P.summarize(view(spark, d, PAIRS), "source")).select("source", r("mcnemar_p"))


@register("agg9_sign_test", f"""SELECT source, round({tail('fewer_turns', 'more_turns')}, 9) AS sign_p FROM (SELECT source, {SUMMARY} FROM {PR} p GROUP BY source) s""")
def _(spark, d):
    return P.exact_tests(P.summarize(view(spark, d, PAIRS), "source")).select("source", r("sign_p"))


BOOT = {"success_rate_delta": "(a - b0) / n", "mean_attempts_delta": "(ba - aa) / n", "mean_correction_turn_delta": "CASE WHEN bt > 0 THEN t / bt END"}
PAIR_SUMS = ["n", "a", "b0", "ba", "aa", "bt", "t"]
PAIR_SOURCES = f"""(SELECT namespace AS stratum, source, count(*) AS n, sum(CAST(a_ok AS INT)) AS a, sum(CAST(b_ok AS INT)) AS b0, sum(b_attempts) AS ba, sum(a_attempts) AS aa,
  sum(CAST(a_ok AND b_ok AS INT)) AS bt, coalesce(sum(b_attempts - a_attempts) FILTER (WHERE a_ok AND b_ok), 0) AS t FROM {PR} p GROUP BY 1, 2)"""
TOTALS = ", ".join(f"CAST(sum({s}) AS DOUBLE) AS {s}" for s in PAIR_SUMS)
for _name, _ratio in BOOT.items():

    @register(f"agg11_bootstrap_{_name}", f"""SELECT (SELECT round({_ratio}, 6) FROM (SELECT {TOTALS} FROM {PAIR_SOURCES} s) z) AS estimate, t.*
      FROM {ends(f"(SELECT b, {_ratio} AS v FROM (SELECT b, {TOTALS} FROM {replicated(PAIR_SOURCES, PAIR_SUMS, 5000, 3)} q GROUP BY b) w)")} t""")
    def _(spark, d, _name=_name):
        return P.bootstrap_paired(view(spark, d, PAIRS), _name, seed=3, strata=F.col("namespace"), law="hashes").select(r("estimate", 6), r("lower", 6), r("upper", 6), "samples")


# Exact tails are looked at only where the normal score is from 1.5 to 4: below, none is significant; before 4, one is.
DISCORDANT = f"""SELECT ratio, min(n) FILTER (WHERE p < 0.05) AS required FROM (SELECT ratio, n, {tail('w', '(n - w)')} AS p FROM (
  SELECT ratio, n, CAST(round_even(n * ratio, 0) AS BIGINT) AS w FROM (SELECT ratio, unnest(range(1, 10001)) AS n FROM (SELECT DISTINCT 0.5 + round(l_discount, 2) * 4 AS ratio FROM lineitem) g WHERE ratio > 0.5 AND ratio <= 1) h) i
  WHERE (2 * w - n) / sqrt(n) BETWEEN 1.5 AND 4) j GROUP BY ratio"""


def discordant(spark, d):
    ratios = spark.read.parquet(f"{d}/lineitem.parquet").select((0.5 + F.round("l_discount", 2) * 4).alias("ratio")).where("ratio > 0.5 AND ratio <= 1").distinct()
    return P.required_discordant(ratios).select("ratio", F.col("required").cast("long").alias("required"))


for _name in ("agg10_required_discordant", "agg10_required_discordant_full"):  # the second name is kept for those who use it
    register(_name, DISCORDANT)(discordant)


# The same statistics by multinomial counts of blocks, whose draws SQL cannot repeat.
@register("agg4_bootstrap_accuracy_full")
def _(spark, d):
    return P.bootstrap_accuracy(view(spark, d, EXAMPLES), seed=1).select(r("estimate", 6), r("lower", 6), r("upper", 6), "samples")


@register("agg5_bootstrap_macro_full")
def _(spark, d):
    return P.bootstrap_accuracy(view(spark, d, EXAMPLES), seed=2, macro=True).select(r("estimate", 6), r("lower", 6), r("upper", 6), "samples")


for _name in BOOT:

    @register(f"agg11_bootstrap_{_name}_full")
    def _(spark, d, _name=_name):
        return P.bootstrap_paired(view(spark, d, PAIRS), _name, seed=3, strata=F.col("namespace")).select(r("estimate", 6), r("lower", 6), r("upper", 6), "samples")


FAILS = f"""(SELECT o.task_id, namespace, recommendation = answer_index AS good, success, first_reason, last_reason, first_sel = recommendation AS followed, used FROM {OUTCOMES} o JOIN {RECS} q ON o.task_id = q.task_id WHERE arm = 'assisted')"""


@register("agg12_failure_signature", f"""SELECT task_id, namespace, good AS recommendation_correct, success AS assisted_success, first_reason AS first_attempt_reason, last_reason AS terminal_reason, followed AS followed_recommendation,
  good AND NOT success AND NOT coalesce(followed, false) AS ignored_correct, NOT good AND NOT success AND coalesce(followed, false) AS followed_wrong, NOT success AND used > 1 AS recovery_failed FROM {FAILS} f""")
def _(spark, d):
    return P.failure_signatures(_outcomes(spark, d), _recs(spark, d))


FSUM = """count(*) AS tasks, count(*) FILTER (WHERE NOT success) AS assisted_failures, count(*) FILTER (WHERE NOT good) AS wrong_recommendations,
  count(*) FILTER (WHERE good AND NOT success AND NOT coalesce(followed, false)) AS correct_ignored, count(*) FILTER (WHERE NOT good AND NOT success AND coalesce(followed, false)) AS wrong_followed,
  count(*) FILTER (WHERE NOT success AND used > 1) AS recovery_failures, count(*) FILTER (WHERE NOT success AND first_reason = 'unparseable_selection') AS unparseable_first,
  count(*) FILTER (WHERE NOT success AND last_reason = 'unparseable_selection') AS terminal_unparseable, round(avg(CAST(NOT success AS INT)), 9) AS failure_rate"""


@register("agg13_failure_summary", f"SELECT {FSUM} FROM {FAILS} f")
def _(spark, d):
    return P.summarize_failures(P.failure_signatures(_outcomes(spark, d), _recs(spark, d))).withColumn("failure_rate", F.round("failure_rate", 9))


@register("agg14_failures_by_namespace", f"SELECT namespace, {FSUM} FROM {FAILS} f GROUP BY namespace")
def _(spark, d):
    return P.summarize_failures(P.failure_signatures(_outcomes(spark, d), _recs(spark, d)), "namespace").withColumn("failure_rate", F.round("failure_rate", 9))


@register("agg15_transitions", f"""SELECT arm, CASE WHEN reason = 'ok' THEN 'correct' WHEN sel IS NULL THEN 'unparseable' WHEN sel = was_sel THEN 'repeated_rejected' ELSE 'different_wrong' END AS transition, count(*) AS n
  FROM (SELECT *, lag(sel) OVER w AS was_sel, lag(reason) OVER w AS was FROM {REPLAYED} y WINDOW w AS (PARTITION BY task_id, arm ORDER BY attempt_no)) z WHERE attempt_no = 2 AND was = 'wrong_selection' GROUP BY 1, 2""")
def _(spark, d):
    return A.transitions(A.replay(_attempts(spark, d)))


@register("agg16_recommendation_states", f"""SELECT good AS recommendation_correct, count(*) AS n, count(*) FILTER (WHERE first_reason = 'ok') AS first_pass, count(*) FILTER (WHERE success) AS within_budget, count(*) FILTER (WHERE followed) AS followed FROM {FAILS} f GROUP BY good""")
def _(spark, d):
    return P.recommendation_states(_outcomes(spark, d), _recs(spark, d))


@register("agg18_excess", f"SELECT namespace, count(*) AS n, CAST(sum(CAST(a_ok AS INT)) AS BIGINT) AS hits, round(sum(1.0 / a_attempts), 6) AS expected, round(avg(CAST(a_ok AS INT) - 1.0 / a_attempts), 9) AS excess FROM {PR} p GROUP BY namespace")
def _(spark, d):
    return P.excess(view(spark, d, PAIRS), "a_ok", 1 / F.col("a_attempts"), "namespace").select("namespace", "n", "hits", r("expected", 6), r("excess"))


OVER = f"(SELECT 'all' AS stratum, source, sum(CAST(a_ok AS INT) - 1.0 / a_attempts) AS e, count(*) AS n FROM {PR} p GROUP BY 2)"


@register("agg18_excess_interval", f"""SELECT (SELECT round(sum(e) / sum(n), 6) FROM {OVER} o) AS estimate, t.* FROM {ends(f"(SELECT b, e / n AS v FROM {replicated(OVER, ['e', 'n'], 5000, 5)} q)")} t""")
def _(spark, d):
    return P.excess_interval(view(spark, d, PAIRS), "a_ok", 1 / F.col("a_attempts"), seed=5, law="hashes").select(r("estimate", 6), r("lower", 6), r("upper", 6), "samples")


@register("agg18_excess_interval_full")
def _(spark, d):
    return P.excess_interval(view(spark, d, PAIRS), "a_ok", 1 / F.col("a_attempts"), seed=5).select(r("estimate", 6), r("lower", 6), r("upper", 6), "samples")


@register("agg6_turn_deltas", f"SELECT namespace, b_attempts - a_attempts AS turn_delta, count(*) AS n FROM {PR} p WHERE a_ok AND b_ok GROUP BY 1, 2")
def _(spark, d):
    return P.turn_deltas(view(spark, d, PAIRS), "namespace")


@register("agg20_rescued_spoiled", f"""SELECT CASE WHEN a_ok AND NOT b_ok THEN 'rescued' WHEN b_ok AND NOT a_ok THEN 'spoiled' WHEN b_ok THEN 'kept' ELSE 'missed' END AS transition, count(*) AS n FROM {PR} p GROUP BY 1""")
def _(spark, d):
    return P.rescued_and_spoiled(view(spark, d, PAIRS), "b_ok", "a_ok")


GRID = [0.2, 0.35, 0.55, 0.75, 0.95]


@register("agg21_threshold_sweep", f"""SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(successes AS BIGINT) AS successes, row_number() OVER (ORDER BY successes DESC, threshold DESC) = 1 AS best FROM (
  SELECT threshold, sum(CAST(CASE WHEN confidence >= threshold THEN a_ok ELSE b_ok END AS INT)) AS successes FROM {PR} p, (SELECT unnest({GRID}) AS threshold) g GROUP BY threshold) s""")
def _(spark, d):
    return P.threshold_sweep(view(spark, d, PAIRS), GRID)


@register("agg23_gate", f"""SELECT *, better AND significant AND above_zero AS passes FROM (SELECT s.namespace, assisted_successes > baseline_successes AS better, {tail('assisted_only', 'baseline_only')} < 0.05 AS significant, lower > 0 AS above_zero
  FROM (SELECT namespace, {SUMMARY} FROM {PR} p GROUP BY namespace) s JOIN (SELECT stratum, quantile_cont((a - b0) / n, 0.025) AS lower FROM {replicated(PAIR_SOURCES, PAIR_SUMS, 5000, 4)} q GROUP BY stratum) i ON s.namespace = i.stratum) t""")
def _(spark, d):
    pairs = view(spark, d, PAIRS)
    ends = P.bootstrap_by(pairs, "namespace", seed=4, law="hashes").select("namespace", "lower")
    s = P.exact_tests(P.summarize(pairs, "namespace")).join(ends, "namespace")
    return P.gate(s).select("namespace", "better", "significant", "above_zero", "passes")


@register("agg25_confidence", f"""SELECT a_ok AS correct, count(*) AS n, round(quantile_cont(confidence, 0.25), 9) AS q1, round(quantile_cont(confidence, 0.5), 9) AS q2, round(quantile_cont(confidence, 0.75), 9) AS q3 FROM {PR} p GROUP BY a_ok""")
def _(spark, d):
    return P.confidence_distribution(view(spark, d, PAIRS), "a_ok").select("correct", "n", r("q1"), r("q2"), r("q3"))


@register("entry_report", f"SELECT namespace, {SUMMARY}, round({tail('assisted_only', 'baseline_only')}, 9) AS mcnemar_p, round({tail('fewer_turns', 'more_turns')}, 9) AS sign_p FROM (SELECT namespace, {SUMMARY} FROM {PR} p GROUP BY namespace) s".replace(f"SELECT namespace, {SUMMARY}, round", "SELECT s.*, round"))
def entry_report(spark, d):
    """Does the assisted arm help, per namespace, with exact p-values."""
    return P.exact_tests(_rounded(P.summarize(view(spark, d, PAIRS), "namespace"))).withColumns({"mcnemar_p": F.round("mcnemar_p", 9), "sign_p": F.round("sign_p", 9)})
