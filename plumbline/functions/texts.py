"""Text of decisions: masking windows, candidate symbols, prompts, feedback and reports, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import let
from plumbline.functions.selection import REJECTED, UNPARSEABLE, UNSUPPORTED, WRONG

MARKER = "__CALL_TARGET__"

#: Our own wording; feedback names the kind of mistake, never the answer.
FEEDBACK = {
    UNPARSEABLE: "No candidate number could be read.",
    WRONG: "That candidate does not satisfy the constraint.",
    REJECTED: "That candidate was rejected before.",
    UNSUPPORTED: "This task cannot be verified.",
    "invalid_python": "What came back is not one whole Python function.",
    "wrong_function": "It is a different function now; keep the caller's name and kind.",
    "placeholder_remaining": "The mark for the missing name is still there.",
    "wrong_target": "The function that is called does not satisfy the constraint.",
    "unrelated_change": "More was changed than the missing name.",
    "invalid_call_expression": "What came back is not one call expression.",
    "unknown_target": "No candidate has the name that is called.",
    "ambiguous_target": "Several candidates have the name that is called.",
    "unbindable_call": "The candidate's parameters cannot take these arguments.",
    "wrong_arguments": "The arguments are not those of the place in the code.",
    "invalid_plan": "No plan of the given form could be read.",
    "inapplicable_operation": "The operation does not apply to the call.",
    "wrong_operations": "The operation does not restore the call.",
}


def focused(text: Column, radius: int, marker: str = MARKER) -> Column:
    """The header and the lines around first to last marker, notes where lines are left out; null without header or marker."""

    def cut(lines: Column) -> Column:
        where = lambda test: F.filter(F.transform(lines, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())
        at = where(lambda x: x.contains(marker))
        head = F.get(where(lambda x: x.rlike(r"^\s*(async\s+)?def\s")), F.lit(0))
        first, last, n = F.get(at, F.lit(0)), F.element_at(at, -1), F.size(lines)
        start, end = F.greatest(head + 1, first - radius), F.least(n, last + radius + 1)
        indent = F.regexp_extract(F.get(lines, first), r"^(\s*)", 1)
        indent = F.when(indent == "", "    ").otherwise(indent)
        note = lambda c, side: F.when(c, F.array(F.concat(indent, F.lit(f"# ... omitted {side} call site ...")))).otherwise(F.array().cast("array<string>"))
        parts = F.concat(F.slice(lines, 1, head + 1), note(start > head + 1, "before"), F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))), note(end < n, "after"))
        whole = (start == head + 1) & (end == n) & (head == 0)
        return F.when(F.size(at) > 0, F.when(whole, F.array_join(lines, "\n")).otherwise(F.array_join(parts, "\n")))

    return let(F.split(text, "\n"), cut)


def candidate_symbol(candidate: Column) -> Column:
    """The function name of a rendered candidate's first line; null if that is no signature."""
    found = F.regexp_extract(F.substring_index(candidate, "\n", 1), r"^(?:.*::)?([A-Za-z_]\w*)\(", 1)
    return F.when(found != "", found)


def without_own_names(candidates: Column) -> Column:
    """Candidates with their own names replaced by `__CANDIDATE__`; one whose first line is no signature is an error."""

    def renamed(c: Column) -> Column:
        symbol = F.coalesce(candidate_symbol(c), F.raise_error(F.concat(F.lit("no signature in candidate: "), F.substring(c, 1, 80))))
        return F.regexp_replace(c, F.concat(F.lit("\\b"), symbol, F.lit("\\b")), F.lit("__CANDIDATE__"))

    return F.transform(candidates, renamed)


def without_caller_name(context: Column) -> Column:
    """The context with the name of its function, where it is defined, replaced by `__CALLER__`; other places keep it."""
    return F.regexp_replace(context, r"(?s)\A(.*?^(?:async\s+)?def\s+)\w+".replace("(?s)", "(?sm)"), "$1__CALLER__")


def edited(context: Column, candidates: Column, index: Column, marker: str = MARKER) -> Column:
    """The context with the selected candidate's name in place of the marker."""
    return F.replace(context, F.lit(marker), candidate_symbol(F.get(candidates, index)))


def caller_name(context: Column) -> Column:
    return F.regexp_extract(context, r"(?m)^(?:async\s+)?def\s+(\w+)", 1)


def selection_prompt(context: Column, question: Column, candidates: Column, rejected: Column | None = None, recommendation: Column | None = None, previous: Column | None = None, why: Column | None = None) -> Column:
    """Prompt text: numbers stay those of the full list when rejected candidates are left out; previous and why add the last answer and its feedback."""
    shown = F.transform(candidates, lambda c, i: F.struct(i.alias("i"), F.concat((i + 1).cast("string"), F.lit(". "), c).alias("t")))
    if rejected is not None:
        shown = F.filter(shown, lambda x: ~F.array_contains(rejected, x["i"]))
    parts = [context, question, F.array_join(F.transform(shown, lambda x: x["t"]), "\n")]
    if recommendation is not None:
        parts.append(recommended(recommendation))
    return F.concat_ws("\n\n", *parts, *last_try(previous, why), F.lit("Answer with one number."))


def recommended(index: Column) -> Column:
    """A line for a recommendation; null, which concat_ws leaves out, without one."""
    return F.concat(F.lit("Recommended: "), (index + 1).cast("string"))


def last_try(previous: Column | None, why: Column | None) -> list[Column]:
    """Sections for the last answer and its feedback; both or none, row by row."""
    if previous is None or why is None:
        return []
    both = previous.isNotNull() & why.isNotNull()
    return [F.when(both, F.concat(F.lit("Last answer:\n"), previous)), F.when(both, feedback(why))]


def numbered(candidates: Column) -> Column:
    return F.array_join(F.transform(candidates, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n\n")


def code_prompt(asked: str, context: Column, candidates: Column, *more: Column, recommendation: Column | None = None, previous: Column | None = None, why: Column | None = None) -> Column:
    parts = [F.lit(asked), context, numbered(candidates), *more]
    return F.concat_ws("\n\n", *parts, *([] if recommendation is None else [recommended(recommendation)]), *last_try(previous, why))


def repair_prompt(context: Column, candidates: Column, **rest: Column) -> Column:
    """Asks for the whole caller with one candidate's name in the masked place."""
    return code_prompt(f"Give the whole function back with one of the candidates in place of {MARKER} and nothing else changed.", context, candidates, **rest)


def call_prompt(context: Column, candidates: Column, **rest: Column) -> Column:
    """Asks for the call expression alone."""
    return code_prompt(f"Give only the call expression that belongs in place of {MARKER}(...): one candidate's name, the same arguments.", context, candidates, **rest)


def plan_prompt(context: Column, candidates: Column, vocabulary: Column, **rest: Column) -> Column:
    """Asks for a candidate and one argument operation over the names that may be used."""
    names = F.concat(F.lit("Names: "), F.array_join(vocabulary, ", "))
    return code_prompt("The call has one wrong argument operation. Answer `candidate <number>; <operation>` with keep, swap i j, drop name, rename old new, name i name or unname name.", context, candidates, names, **rest)


def feedback(reason: Column) -> Column:
    out = F.lit("The answer was rejected.")
    for why, text in FEEDBACK.items():
        out = F.when(reason == why, text).otherwise(out)
    return out


def paired_report(summary: DataFrame, *keys: str) -> DataFrame:
    """Long rows (keys, metric, baseline, assisted) of a paired summary."""
    twice = {"tasks": "tasks", "both": "both", "neither": "neither"}
    rows = {"successes": "{}_successes", "first pass": "{}_first_pass", "only this arm": "{}_only", "terminal failures": "tasks - {}_successes"}
    parts = [f"'{k}', {v.format('baseline')}, {v.format('assisted')}" for k, v in rows.items()] + [f"'{k}', {v}, {v}" for k, v in twice.items()]
    return summary.selectExpr(*keys, f"stack({len(parts)}, {', '.join(parts)}) as (metric, baseline, assisted)")


def tests_report(summary: DataFrame, *keys: str) -> DataFrame:
    """Long rows (keys, metric, value) of a paired summary's deltas and exact tests; a delta that is not defined is null."""
    names = ["success_rate_delta", "mean_attempts_delta", "mean_turn_delta", "mcnemar_p", "sign_p"]
    return summary.selectExpr(*keys, f"stack({len(names)}, " + ", ".join(f"'{n}', CAST({n} AS DOUBLE)" for n in names) + ") as (metric, value)")


def printed(x: Column, digits: int) -> Column:
    """x as C's printf writes it with so many digits: nearest to its exact binary value, exact halves to the even digit.

    Spark's format_string and bround go by the shortest decimal that reads as the number: 2.015 lies below its half, and
    is a half to them.  The fraction is taken as a whole number of 2^-63, in decimals, which hold it exactly.
    """
    unit, size = 10**digits, F.abs(x)
    big = lambda c: c.cast("decimal(20,0)")

    def split(v: Column) -> Column:
        high = F.floor(v["f"] * 2.0**31)
        low = F.floor((v["f"] * 2.0**31 - high) * 2.0**32)
        return F.struct(v["w"].alias("w"), ((big(high) * F.lit(2**32).cast("decimal(10,0)") + big(low)) * F.lit(unit).cast("decimal(5,0)")).cast("decimal(30,0)").alias("s"))

    def rounded(v: Column) -> Column:
        one = F.lit(str(2**63)).cast("decimal(19,0)")
        cut = F.call_function("div", v["s"], one)
        twice = ((v["s"] - big(cut) * one) * F.lit(2).cast("decimal(1,0)")).cast("decimal(30,0)")
        even = v["w"] * unit + cut
        return even + F.when((twice > one) | ((twice == one) & (even % 2 == 1)), 1).otherwise(0)

    text = lambda t: F.format_string(f"%s%d.%0{digits}d", F.when(x < 0, "-").otherwise(""), F.floor(t / unit), t % unit)
    made = let(F.struct(F.floor(size).alias("w"), (size - F.floor(size)).alias("f")), lambda v: let(split(v), lambda v: let(rounded(v), text)))
    return F.when(x.isNotNull(), made)


def standard_report(summary: DataFrame, *keys: str) -> DataFrame:
    """Long rows (keys, part, metric, baseline, assisted) of a tested paired summary: the standard report, as text.

    Rates say how many of how many, mean attempts and deltas have two digits, p-values three, as `printed` rounds them.  Where both arms never
    solved a task, the turn delta is `not defined`.
    """
    of = lambda n: 100 * F.col(n).cast("double") / F.col("tasks")
    numbers = {f"_{n}": printed(of(n), 1) for n in ("baseline_first_pass", "assisted_first_pass", "baseline_successes", "assisted_successes")}
    numbers |= {f"_{n}": printed(F.col(n), 2) for n in ("b_mean_attempts", "a_mean_attempts", "mean_turn_delta")} | {f"_{n}": printed(F.col(n), 3) for n in ("mcnemar_p", "sign_p")}
    rate = lambda n: f"format_string('%d/%d (%s%%)', {n}, tasks, _{n})"
    both = lambda text: (text, "CAST(NULL AS STRING)")
    rows = [
        ("arms", "first-pass success", rate("baseline_first_pass"), rate("assisted_first_pass")), ("arms", "success within budget", rate("baseline_successes"), rate("assisted_successes")),
        ("arms", "terminal failures", "format_string('%d/%d', tasks - baseline_successes, tasks)", "format_string('%d/%d', tasks - assisted_successes, tasks)"),
        ("arms", "mean attempts", "_b_mean_attempts", "_a_mean_attempts"),
        *[("pairs", n, *both(f"CAST({c} AS STRING)")) for n, c in (("both succeed", "`both`"), ("assisted only", "assisted_only"), ("baseline only", "baseline_only"), ("neither succeeds", "neither"))],
        ("turns", "mean correction turns saved", *both("if(mean_turn_delta IS NULL, 'not defined', _mean_turn_delta)")),
        ("turns", "fewer, same, more", *both("format_string('%d, %d, %d of %d', fewer_turns, `both` - fewer_turns - more_turns, more_turns, `both`)")),
        ("tests", "McNemar", *both("format_string('%d discordant: %d to %d, p = %s', assisted_only + baseline_only, assisted_only, baseline_only, _mcnemar_p)")),
        ("tests", "sign test", *both("format_string('%d unequal: %d to %d, %d ties, p = %s', fewer_turns + more_turns, fewer_turns, more_turns, `both` - fewer_turns - more_turns, _sign_p)")),
    ]
    listed = ", ".join(f"'{part}', '{metric}', {b}, {a}" for part, metric, b, a in rows)
    return summary.withColumns(numbers).selectExpr(*keys, f"stack({len(rows)}, {listed}) as (part, metric, baseline, assisted)")


def failure_report(summary: DataFrame, *keys: str) -> DataFrame:
    """Long rows (keys, metric, n) of a failure summary."""
    names = ["tasks", "assisted_failures", "wrong_recommendations", "correct_ignored", "wrong_followed", "recovery_failures", "unparseable_first", "terminal_unparseable"]
    return summary.selectExpr(*keys, f"stack({len(names)}, " + ", ".join(f"'{n}', {n}" for n in names) + ") as (metric, n)")


def failure_rates(summary: DataFrame, *keys: str) -> DataFrame:
    """Long rows (keys, metric, rate) of a failure summary: what share of the tasks, or of the failures, each count is."""
    of = {"failure_rate": "assisted_failures / tasks", "wrong_recommendation_rate": "wrong_recommendations / tasks", "ignored_share_of_failures": "try_divide(correct_ignored, assisted_failures)", "followed_share_of_failures": "try_divide(wrong_followed, assisted_failures)"}
    return summary.selectExpr(*keys, f"stack({len(of)}, " + ", ".join(f"'{n}', CAST({x} AS DOUBLE)" for n, x in of.items()) + ") as (metric, rate)")
